"""Funnel questions over goal users and what they had done before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waymark.operators.counters import without_earlier_events
from waymark.schemas import COUNTER_KEY, NAMED


def _per_user(prior: DataFrame, *aggregates: Column) -> DataFrame:
    return prior.groupBy(*COUNTER_KEY, "user_id").agg(*aggregates)


def split_combinations(totals: DataFrame, prior: DataFrame, include: Sequence[str] = (),
                       exclude: Sequence[str] = ()) -> DataFrame:
    """Users per goal who had done an excluded event, else an included one, else neither.

    ``totals`` are those of the goal facts. Two flags per user decide; no event list is
    built.
    """
    def any_of(names: Sequence[str]) -> Column:
        return F.bool_or(F.col("tag").isin(*names)) if names else F.bool_or(F.lit(False))

    flagged = _per_user(prior, any_of(exclude).alias("out"), any_of(include).alias("in"))
    bucket = (F.when(F.col("out"), F.lit("excluded")).when(F.col("in"), F.lit("included"))
              .otherwise(F.lit("ignored")))
    split = (flagged.groupBy(*COUNTER_KEY, bucket.alias("bucket"))
             .agg(F.count("*").alias("count")))
    rest = without_earlier_events(totals, split).withColumn("bucket", F.lit("ignored"))
    return (split.unionByName(rest).groupBy(*COUNTER_KEY, "bucket")
            .agg(F.sum("count").alias("count")))


def funnel_depth(totals: DataFrame, prior: DataFrame) -> DataFrame:
    """How many distinct events users had done before each goal.

    ``totals`` are those of the goal facts.
    """
    depths = (_per_user(prior, F.count("*").cast("int").alias("depth"))
              .groupBy(*COUNTER_KEY, "depth").agg(F.count("*").alias("count")))
    rest = without_earlier_events(totals, depths).withColumn("depth", F.lit(0))
    return depths.unionByName(rest).withColumnRenamed("count", "users")


def goal_event_share(totals: DataFrame, singles: DataFrame) -> DataFrame:
    """Share of a goal's users who had done an event before it."""
    goals = (totals.filter(F.col("counter_type") == NAMED)
             .select("namespace", "event_name", F.col("count").alias("goal_count")))
    return (singles.filter(F.col("counter_type") == NAMED)
            .join(goals, ["namespace", "event_name"])
            .select("namespace", F.col("event_name").alias("goal"), "tag",
                    F.try_divide("count", "goal_count").alias("share")))
