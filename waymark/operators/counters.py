"""Counts over first-write facts, and everything read from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions.names import display_name
from waymark.schemas import COUNTER_KEY, INTERNAL, NAMED, WEEKLY
from waymark.storage import materialize

# Identity of a combination of events.
COMBINATION = [*COUNTER_KEY, "size", "digest_1", "digest_2"]
# Parts that the nested entries of a counter and the events of a goal are dealt to, whatever
# their number: as many as a hexadecimal digit has values.
PARTS = 16


def part_of(text: Column) -> Column:
    """The part an entry belongs to: the first hexadecimal digit of its digest."""
    return F.conv(F.substring(F.md5(text), 1, 1), 16, 10).cast("long")


def counter_totals(facts: DataFrame) -> DataFrame:
    """Unique users and first-write value sum of every counter (NULL sum: no value ever)."""
    return facts.groupBy(*COUNTER_KEY).agg(F.count("*").alias("count"),
                                           F.sum("value").alias("value_sum"))


def single_tag_counts(prior: DataFrame) -> DataFrame:
    """Per goal counter and earlier event: how many users had done that event."""
    return prior.groupBy(*COUNTER_KEY, "tag").agg(F.count("*").alias("count"))


def combination_counts(prior: DataFrame) -> DataFrame:
    """Per goal counter and exact set of earlier events: how many users had that set.

    A set is known by its size and a 128-bit digest that does not depend on order, so no
    user's history is ever collected and shuffled rows have a fixed, small size.
    ``sample_seq`` and ``sample_user`` (a hash) name the goal write of one user with the set.
    Several users may share an order number, so the number alone names nobody.
    """
    sets = prior.groupBy(*COUNTER_KEY, "user_id", "goal_seq").agg(
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64(F.lit(1), "tag")).alias("digest_1"),
        F.bit_xor(F.xxhash64(F.lit(2), "tag")).alias("digest_2"))
    return sets.groupBy(*COMBINATION).agg(
        F.count("*").alias("count"), F.min("goal_seq").alias("sample_seq"),
        F.min_by(F.xxhash64("user_id"), "goal_seq").alias("sample_user"))


def combination_events(combinations: DataFrame, prior: DataFrame) -> DataFrame:
    """The events of every combination, one row each, read off its sample user."""
    sample = combinations.select(*COMBINATION, F.col("sample_seq").alias("goal_seq"),
                                 F.col("sample_user").alias("user"))
    done = prior.select(*COUNTER_KEY, "goal_seq", F.xxhash64("user_id").alias("user"), "tag")
    return (done.alias("p").join(sample.alias("c"),
                                 same_counter("p", "c", [*COUNTER_KEY, "goal_seq", "user"]))
            .select("c.*", "p.tag").drop("goal_seq", "user"))


def with_event_lists(combinations: DataFrame, prior: DataFrame) -> DataFrame:
    """Combinations with their sorted event list, made once per distinct combination."""
    lists = (combination_events(combinations, prior)
             .groupBy(*COMBINATION).agg(F.array_sort(F.collect_list("tag")).alias("tags")))
    return (combinations.alias("f").join(lists.alias("l"), same_counter("f", "l", COMBINATION))
            .select(*[f"f.{c}" for c in COMBINATION], "l.tags", "f.count"))


def tag_combinations(prior: DataFrame) -> DataFrame:
    """Combinations with their event lists; the counts are written, since both need them."""
    return with_event_lists(materialize(combination_counts(prior), "combinations"), prior)


def without_earlier_events(totals: DataFrame, found: DataFrame) -> DataFrame:
    """Users per counter that no row of ``found`` counts: those without earlier events.

    The number is what ``found`` leaves of the total, so users need not be joined.
    """
    return (totals.select(*COUNTER_KEY, "count")
            .unionByName(found.select(*COUNTER_KEY, (-F.col("count")).alias("count")))
            .groupBy(*COUNTER_KEY).agg(F.sum("count").alias("count")).filter("count > 0"))


def tag_counts(totals: DataFrame, prior: DataFrame) -> DataFrame:
    """All combinations, with the empty one for users without earlier events.

    Non-goal counters have the empty combination only. It follows from the counts; the lists
    join last.
    """
    found = materialize(combination_counts(prior), "combinations")
    combinations = with_event_lists(found, prior)
    empty = without_earlier_events(totals, found).withColumn(
        "tags", F.array().cast("array<string>"))
    for name in ("size", "digest_1", "digest_2"):
        empty = empty.withColumn(name, F.lit(0).cast("long"))
    return combinations.unionByName(empty.select(*combinations.columns))


def average_values(totals: DataFrame) -> DataFrame:
    return totals.withColumn("value_avg", F.try_divide("value_sum", "count"))


def events_of_users(facts: DataFrame) -> DataFrame:
    """Named events of every user, one row each."""
    return (facts.filter(F.col("counter_type") == NAMED)
            .select("namespace", "user_id", "event_name"))


def events_of_user(facts: DataFrame, namespace: str, user_id: str) -> DataFrame:
    return (facts.filter((F.col("counter_type") == NAMED) & (F.col("namespace") == namespace)
                         & (F.col("user_id") == user_id))
            .select("event_name").distinct().orderBy("event_name"))


def namespaces(log: DataFrame) -> DataFrame:
    return log.select("namespace").distinct()


def same_counter(left: str, right: str, keys: Sequence[str] = tuple(COUNTER_KEY)) -> Column:
    """Equality of two aliased frames on ``keys``; missing weeks equal each other."""
    return reduce(and_, [F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
                         for name in keys])


def drop_counters(counters: DataFrame, removed: DataFrame) -> DataFrame:
    """Counters without the removed ones."""
    return counters.alias("c").join(removed.alias("r"), same_counter("c", "r"), "left_anti")


def lookup_counts(asked: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the named counter's count to each asked ``namespace, event_name``."""
    known = (totals.filter(F.col("counter_type") == NAMED)
             .select("namespace", "event_name", "count"))
    return asked.join(known, ["namespace", "event_name"], "left")


def with_display_name(counters: DataFrame) -> DataFrame:
    return counters.withColumn("name", display_name(
        F.col("event_name"), F.col("counter_type"), F.col("iso_year"), F.col("iso_week")))


def registry(totals: DataFrame, goals: DataFrame) -> DataFrame:
    """Every known counter and whether its event is a goal now."""
    registered = goals.select("namespace", F.col("goal_name").alias("event_name"),
                              F.lit(True).alias("_goal"))
    return (totals.select(*COUNTER_KEY).join(registered, ["namespace", "event_name"], "left")
            .select(*COUNTER_KEY, (F.coalesce("_goal", F.lit(False))
                                   & (F.col("counter_type") != INTERNAL)).alias("is_goal")))


def registered_counters(totals: DataFrame) -> DataFrame:
    """Number of counters; the totals hold one row for each."""
    return totals.agg(F.count("*").alias("counters"))


def nested_counts(totals: DataFrame, tags: DataFrame, singles: DataFrame) -> DataFrame:
    """Counters with their combinations and single events nested for reading.

    A goal can have as many combinations as users. The entries of every counter are therefore
    dealt to ``PARTS`` parts by the digest of their names, one row per part that has entries.
    """
    none = F.lit(None)
    entries = tags.select(
        *COUNTER_KEY, part_of(F.concat_ws("|", "tags")).alias("part"),
        F.struct(F.col("tags").alias("events"), "count").alias("combination"),
        none.cast("struct<name:string,count:bigint>").alias("single")).unionByName(
        singles.select(
            *COUNTER_KEY, part_of(F.col("tag")).alias("part"),
            none.cast("struct<events:array<string>,count:bigint>").alias("combination"),
            F.struct(F.col("tag").alias("name"), "count").alias("single")))
    nested = entries.groupBy(*COUNTER_KEY, "part").agg(
        F.array_sort(F.collect_list("combination")).alias("event_counts"),
        F.array_sort(F.collect_list("single")).alias("single_event_counts"))
    return (totals.alias("t").join(nested.alias("n"), same_counter("t", "n"), "left")
            .select("t.*", F.coalesce("n.part", F.lit(0)).cast("long").alias("part"),
                    "n.event_counts", "n.single_event_counts"))


def ranked_events(totals: DataFrame) -> DataFrame:
    """Counters with ``rank``: by count, largest first; equal counts by name.

    A namespace may have very many counters: rows are dealt by range of the order, ranked
    inside each range, and the sizes of the ranges before it are added.
    """
    order = [F.desc("count"), "event_name", "counter_type", "iso_year", "iso_week"]
    dealt = materialize(totals.repartitionByRange("namespace", *order).withColumn(
        "_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("namespace", "_range").agg(F.count("*").alias("_size"))
    before = (Window.partitionBy("namespace").orderBy("_range")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("namespace", "_range", F.coalesce(
        F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("namespace", "_range").orderBy(*order))
    return (dealt.withColumn("_inside", inside).join(starts, ["namespace", "_range"])
            .select(*totals.columns, (F.col("_start") + F.col("_inside")).cast("int")
                    .alias("rank")))


def weekly_totals(totals: DataFrame) -> DataFrame:
    return totals.filter(F.col("counter_type") == WEEKLY)
