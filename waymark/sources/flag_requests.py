"""Flag requests: base64 JSON of a user and of the context the flags were asked in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.functions.dates import week_of_arrival
from waymark.functions.variants import decode_base64_json, json_type
from waymark.schemas import DEFAULT_NAMESPACE


def parse_flag_requests(requests: DataFrame) -> DataFrame:
    """Adds ``user``, ``context`` (VARIANT) and ``reason`` (NULL where both decode)."""
    user, user_reason = decode_base64_json(F.col("user_obj"))
    context, context_reason = decode_base64_json(F.col("context_obj"))
    return (requests
            .withColumn("reason", F.coalesce(user_reason, context_reason))
            .withColumn("user", user)
            .withColumn("context", context))


def usage_events(parsed: DataFrame, seq: str = "seq") -> DataFrame:
    """A request that names a user and a feature is itself an event of that feature."""
    user_id = F.try_variant_get("user", "$.user_id", "variant")
    feature = F.try_variant_get("context", "$.feature", "variant")
    return (parsed.filter(F.col("reason").isNull())
            .filter(json_type(user_id).isin("STRING", "BIGINT"))
            .filter(json_type(feature) == "STRING")
            .select(F.col(seq).alias("seq"),
                    F.lit(DEFAULT_NAMESPACE).alias("namespace"),
                    F.try_variant_get("context", "$.feature", "string").alias("event_name"),
                    F.try_variant_get("user", "$.user_id", "string").alias("user_id"),
                    F.lit(None).cast("double").alias("value"),
                    F.lit(False).alias("ensure_goal"),
                    *week_of_arrival()))
