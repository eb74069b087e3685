"""Continuous counts without Python: built-in deduplication, then aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.schemas import COUNTER_KEY


def unique_user_counts(log: DataFrame) -> DataFrame:
    """Unique users per event so far. Deduplication state is one key per user and event."""
    return (log.dropDuplicates(["namespace", "event_name", "user_id"])
            .groupBy("namespace", "event_name").agg(F.count("*").alias("count")))


def weekly_user_counts(log: DataFrame) -> DataFrame:
    """Unique users per event and ISO week of the event's date.

    Weeks never close: without a watermark, an event with an old date still adds to its
    old week.
    """
    week = ["namespace", "event_name", "iso_year", "iso_week"]
    return (log.dropDuplicates([*week, "user_id"])
            .groupBy(*week).agg(F.count("*").alias("count")))


def changed_counters(facts: DataFrame) -> DataFrame:
    """Counter totals over a stream of facts; in update mode only changed keys come out."""
    return facts.groupBy(*COUNTER_KEY).agg(F.count("*").alias("count"),
                                           F.sum("value").alias("value_sum"))


def latest_snapshot(batches: DataFrame, *keys: str) -> DataFrame:
    """The last written row of every key."""
    fields = [c for c in batches.columns if c not in keys and c != "batch_id"]
    return batches.groupBy(*keys).agg(
        *[F.max_by(c, "batch_id").alias(c) for c in fields])
