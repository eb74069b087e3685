"""Registered queries: snapshots written and read back, metrics, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.operators import counters
from waymark.plans.analysis_queries import bayes_predictions as bayes_query
from waymark.plans.event_queries import (ensure_goal_activation, marked_facts, nested,
                                         parsed_specs, rounded, weekly_facts)
from waymark.schemas import COUNTER_KEY
from waymark.sinks import (analytics_documents, counter_metrics, prediction_metrics,
                           read_counters, read_facts, read_goals, read_specs,
                           write_changed_counters, write_counters, write_facts, write_goals,
                           write_specs)
from waymark.storage import materialize, new_path


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "counters")
    write_counters(counters.counter_totals(weekly_facts(spark, sf_dir)), path)
    return read_counters(spark, path).select(*COUNTER_KEY, "count", rounded("value_sum"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of half of the facts written whole, then those that the rest changes."""
    path = new_path(spark, "changes")
    facts = materialize(weekly_facts(spark, sf_dir), "facts")
    early = F.pmod(F.xxhash64("user_id", "event_name"), F.lit(2)) == 0
    write_counters(counters.counter_totals(facts.where(early)), path)
    touched = facts.where(~early).select(*COUNTER_KEY).distinct().alias("t")
    changed = counters.counter_totals(facts).alias("c").join(
        touched, counters.same_counter("c", "t"), "left_semi")
    write_changed_counters(changed, path)
    return read_counters(spark, path).select(*COUNTER_KEY, "count", rounded("value_sum"))


def facts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "facts")
    write_facts(weekly_facts(spark, sf_dir), path)
    return read_facts(spark, path)


def registry_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals written and read back, then the registry of counters they belong to."""
    path = new_path(spark, "goals")
    write_goals(ensure_goal_activation(spark, sf_dir), path)
    totals = counters.counter_totals(weekly_facts(spark, sf_dir))
    return counters.registry(totals, read_goals(spark, path))


def flag_spec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "specs")
    write_specs(parsed_specs(spark, sf_dir).filter(F.col("reason").isNull()), path)
    return read_specs(spark, path).select(
        "name", "boolean", "rollout_start", "rollout_end",
        F.array_join(F.transform("user", lambda c: F.concat_ws(
            " ", c["property"], c["comparator"], F.to_json(c["value"]))), "|")
        .alias("conditions"))


def _label(name: str):
    return F.try_element_at("labels", F.lit(name)).alias(name)


def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = counter_metrics(counters.counter_totals(weekly_facts(spark, sf_dir)))
    return metrics.select("metric", _label("namespace"), _label("name"), _label("year"),
                          _label("week"), "value")


def metrics_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_metrics(bayes_query(spark, sf_dir)).select(
        "metric", _label("namespace"), _label("goal"), _label("event"), "value")


def analytics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with sums in whole units, so that their text can be compared."""
    marked = marked_facts(spark, sf_dir)
    totals = counters.counter_totals(marked).withColumn(
        "value_sum", F.round("value_sum").cast("long"))
    return analytics_documents(nested(marked, totals))


QUERIES = {
    "snapshot_roundtrip": snapshot_roundtrip,
    "snapshot_changes": snapshot_changes,
    "facts_roundtrip": facts_roundtrip,
    "registry_roundtrip": registry_roundtrip,
    "flag_spec_roundtrip": flag_spec_roundtrip,
    "metrics_counters": metrics_counters,
    "metrics_predictions": metrics_predictions,
    "analytics_json": analytics_json,
}
