"""Churn: users not seen for some weeks become users of a ``last-login-N-weeks`` goal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions.dates import iso_week, iso_year


HASH_BITS = 61


def last_seen(log: DataFrame, seen_at: str = "ts") -> DataFrame:
    return log.groupBy("namespace", "user_id").agg(F.max(seen_at).alias("last_seen"))


def churn_events(log: DataFrame, as_of: Column, after_seq: Column, weeks: int = 4,
                 seen_at: str = "ts") -> DataFrame:
    """Goal events for users last seen at least ``weeks`` weeks before ``as_of``.

    They arrive after the whole log: ``after_seq`` is an order number behind it, with room
    for ``HASH_BITS`` bits above it. A hash of the user tells the events apart; nothing
    depends on their order, and two users with the same number are still two users.
    """
    idle_days = F.date_diff(as_of, F.col("last_seen"))
    return (last_seen(log, seen_at).filter(idle_days >= 7 * weeks)
            .select((after_seq + F.pmod(F.xxhash64("namespace", "user_id"),
                                        F.lit(1 << HASH_BITS))).alias("seq"), "namespace",
                    F.lit(f"last-login-{weeks}-weeks").alias("event_name"), "user_id",
                    F.lit(None).cast("double").alias("value"),
                    F.lit(True).alias("ensure_goal"),
                    iso_year(as_of).alias("iso_year"), iso_week(as_of).alias("iso_week")))
