"""The analytics document: one JSON object per counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.operators.counters import with_display_name


def analytics_documents(nested: DataFrame) -> DataFrame:
    """Rows of ``nested_counts`` as JSON; a counter without values has an empty value."""
    named = with_display_name(nested)
    body = F.struct(
        "name", F.col("counter_type").alias("type"), "count", "event_counts",
        "single_event_counts", F.struct(F.col("value_sum").alias("sum")).alias("value"))
    return named.select("namespace", "name", "part", F.to_json(body).alias("document"))
