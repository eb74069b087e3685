"""First-write facts: one row per counter and user, the base of every other result.

A user counts once per counter, with the value of that first event. The first event of a
name is the first of its weeks, and the first event of a namespace the first of its names.
So the raw log is aggregated at the finest level only, with map-side combining, and a user
with very many events reaches the later steps as one row per event name and week.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waymark.operators.cohorts import CohortRule, is_weekly
from waymark.schemas import (COUNTER_KEY, GLOBAL_COUNTER, INTERNAL, NAMED,
                             WEEKLY)

def _first() -> list[Column]:
    # min and min_by keep fixed-width buffers, so the aggregation stays hash based; a
    # minimum over a struct would be planned as a sort.
    return [F.min("seq").alias("seq"), F.min_by("value", "seq").alias("value")]


def _null_int() -> Column:
    return F.lit(None).cast("int")


def _targets(dated: Column) -> Column:
    """The counters a row writes to; the weekly one only where ``dated`` holds."""
    def target(name: Column, kind: str, week: bool) -> Column:
        return F.struct(
            name.alias("event_name"), F.lit(kind).alias("counter_type"),
            (F.col("iso_year") if week else _null_int()).alias("iso_year"),
            (F.col("iso_week") if week else _null_int()).alias("iso_week"))

    always = F.array(target(F.lit(GLOBAL_COUNTER), INTERNAL, False),
                     target(F.col("event_name"), NAMED, False))
    weekly = F.array(target(F.col("event_name"), WEEKLY, True))
    return F.when(dated, F.concat(always, weekly)).otherwise(always)


def _write_targets(rows: DataFrame, dated: Column) -> DataFrame:
    # The targets are never empty; the outer form keeps Spark from testing that first.
    return (rows.select("namespace", F.explode_outer(_targets(dated)).alias("t"), "user_id",
                        "seq", "value")
            .select("namespace", "t.*", "user_id", "seq", "value"))


def fan_out(log: DataFrame, rules: Sequence[CohortRule] = ()) -> DataFrame:
    """Every counter an event writes to: its namespace's, its own, and its week's."""
    return _write_targets(log, is_weekly(F.col("event_name"), rules))


def named_first_writes(log: DataFrame) -> DataFrame:
    """First write per event name and user only, for results that need no other level."""
    named = log.groupBy("namespace", "event_name", "user_id").agg(*_first())
    return named.select("namespace", "event_name", F.lit(NAMED).alias("counter_type"),
                        _null_int().alias("iso_year"), _null_int().alias("iso_week"),
                        "user_id", "seq", "value")


def first_writes(log: DataFrame, rules: Sequence[CohortRule] = ()) -> DataFrame:
    """All three levels: ``namespace`` counters, event counters, weekly counters.

    The log is scanned once and reduced to first rows per user, event and week. Those fan out
    to the counters and are aggregated by the whole counter key and user, so the rows of a
    user with a large vocabulary are spread over the names.
    """
    if any(rule.date_cohort == WEEKLY for rule in rules):
        dated = is_weekly(F.col("event_name"), rules)
        weeks = [F.when(dated, F.col(c)).alias(c) for c in ("iso_year", "iso_week")]
        finest = log.groupBy("namespace", "event_name", *weeks, "user_id").agg(*_first())
    else:
        finest = named_first_writes(log)
    return (_write_targets(finest, F.col("iso_week").isNotNull())
            .groupBy(*COUNTER_KEY, "user_id").agg(*_first()))


def merge_first_writes(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Facts of two parts of a log, in any order: the earlier write of each user stays."""
    return (stored.unionByName(added).groupBy(*COUNTER_KEY, "user_id").agg(*_first())
            .select(*stored.columns))


def prior_events(marked: DataFrame, include_self: bool = True) -> DataFrame:
    """What each goal user had done before the goal: one row per counter, user and tag.

    ``goal_seq`` is the order number of the goal's first write. ``marked`` are facts with
    ``is_goal``. Tags are event names of the user's whole history
    in the namespace. A weekly goal is written after the named one, so its history already
    holds the goal itself; ``include_self=False`` leaves that out.

    The history stays in rows. A join on the user with an order condition streams through
    a long history instead of collecting it, and adaptive execution splits it when skewed.
    """
    history = (marked.filter(F.col("counter_type") == NAMED)
               .select("namespace", "user_id", F.col("event_name").alias("tag"),
                       F.col("seq").alias("tag_seq")))
    earlier = F.col("tag_seq") < F.col("seq")
    same_event = (F.col("tag_seq") == F.col("seq")) & (F.col("counter_type") == WEEKLY)
    before = earlier | same_event
    if not include_self:
        before = before & (F.col("tag") != F.col("event_name"))
    return (marked.filter("is_goal").join(history, ["namespace", "user_id"]).filter(before)
            .select(*COUNTER_KEY, "user_id", F.col("seq").alias("goal_seq"), "tag"))
