"""Flag specifications submitted as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions.dates import parse_rfc3339
from waymark.functions.variants import json_type


def _text(name: str) -> Column:
    return F.try_variant_get("_json", f"$.{name}", "string")


def _has(name: str) -> Column:
    return F.try_variant_get("_json", f"$.{name}", "variant").isNotNull()


def _type(name: str) -> Column:
    return json_type(F.try_variant_get("_json", f"$.{name}", "variant"))


def _condition(element: Column) -> Column:
    value = F.try_variant_get(element, "$.value", "variant")
    comparator = F.try_variant_get(element, "$.comparator", "string")
    property_ = F.try_variant_get(element, "$.property", "variant")
    items = F.try_variant_get(value, "$", "array<variant>")
    all_of = lambda kind: F.forall(items, lambda i: json_type(i) == kind)
    fits = (F.when(comparator == "=", json_type(value).isin("STRING", "BIGINT"))
            .when(comparator == "in", all_of("STRING") | all_of("BIGINT")))
    ok = F.coalesce(fits & (json_type(property_) == "STRING"), F.lit(False))
    return F.struct(
        F.try_variant_get(element, "$.property", "string").alias("property"),
        comparator.alias("comparator"),
        value.alias("value"),
        ok.alias("ok"))


def _seconds(name: str) -> Column:
    return F.unix_timestamp(parse_rfc3339(_text(name)))


def parse_flag_specs(bodies: DataFrame) -> DataFrame:
    """``body`` → typed spec columns plus ``reason`` (NULL where the body is usable)."""
    conditions = F.try_variant_get("_json", "$.user", "array<variant>")
    bad_date = lambda name: _has(name) & (
        (_type(name) != "STRING") | parse_rfc3339(_text(name)).isNull())
    reason = (F.when(F.try_variant_get("_json", "$", "map<string,variant>").isNull(),
                     F.lit("invalid_json"))
              .when(~_has("name"), F.lit("missing_required_key"))
              .when((_type("name") != "STRING")
                    | (_has("boolean") & (_type("boolean") != "BOOLEAN")),
                    F.lit("incorrect_type"))
              .when(bad_date("rollout_start") | bad_date("rollout_end"), F.lit("invalid_date"))
              .when(_has("user") & conditions.isNull(), F.lit("incorrect_type"))
              .when(F.exists("_user", lambda c: ~c["ok"]), F.lit("invalid_condition")))
    return (bodies
            .withColumn("_json", F.try_parse_json("body"))
            .withColumn("_user", F.transform(conditions, _condition))
            .withColumn("reason", reason)
            .withColumn("name", _text("name"))
            .withColumn("boolean", F.coalesce(
                F.try_variant_get("_json", "$.boolean", "boolean"), F.lit(False)))
            .withColumn("rollout_start", _seconds("rollout_start"))
            .withColumn("rollout_end", _seconds("rollout_end"))
            .withColumn("user", F.coalesce(F.transform("_user", lambda c: c.dropFields("ok")),
                                           F.expr("cast(array() as array<struct<"
                                                  "property:string,comparator:string,"
                                                  "value:variant>>)")))
            .drop("_json", "_user"))
