"""Has a user done an event? Exactly, or through Bloom filters kept as rows.

A filter is a list of slices, each an ordinary Bloom filter of one capacity. A user belongs to
the slice given by a hash, so every slice gets its share of the users whatever the order they
come in, and a filter grows by having more slices. How many it has follows from the counter's
settings and its number of users: a scalable filter has as many as its users need, a filter of
fixed size has one and errs more when it is overfull.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from waymark.operators import filter_parts
from waymark.operators.cohorts import FIXED_SIZE
from waymark.operators.filter_parts import AT_ONCE, PART_BITS, USERS_AT_ONCE
from waymark.schemas import NAMED
from waymark.storage import materialize

PROBE = ["namespace", "event_name", "user_id"]
COUNTER = ["namespace", "event_name"]


def users_with_event(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """The probes whose user has done the event."""
    done = facts.filter(F.col("counter_type") == NAMED).select(*PROBE)
    return probes.join(done, PROBE, "left_semi")


def filter_plans(counted: DataFrame) -> DataFrame:
    """``(namespace, event_name, slices, bits, hashes)`` per counter, from its settings
    (``kind, size, error_probability``) and its measured ``count``.

    A slice is filled to its capacity on average; hashing spreads users unevenly by a few per
    cent, so a tenth of the capacity is kept free.
    """
    capacity = F.greatest(F.col("size"), F.lit(1))
    bits = F.ceil(-capacity * F.log("error_probability") / math.log(2) ** 2)
    grown = F.greatest(F.lit(1), F.ceil(F.col("count") * 1.1 / capacity))
    return counted.select(
        *COUNTER,
        F.when(F.col("kind") == FIXED_SIZE, F.lit(1)).otherwise(grown).cast("long")
        .alias("slices"),
        bits.cast("long").alias("bits"),
        F.greatest(F.lit(1), F.round(bits / capacity * math.log(2))).cast("int")
        .alias("hashes"))


def _place() -> tuple[Column, Column]:
    """The slice of a user, and its bit positions there: one hash per position."""
    chosen = F.pmod(F.xxhash64("user_id"), F.col("slices"))
    positions = F.transform(
        F.sequence(F.lit(1), F.col("hashes")),
        lambda i: F.pmod(F.xxhash64("user_id", i), F.col("bits")))
    return chosen, positions


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position % 64).cast("int"))


def build_filters(facts: DataFrame, plans: DataFrame) -> DataFrame:
    """The filters of all named counters, as words of 64 bits.

    Words of one filter are spread over tasks, so even the counter that holds a third of
    all users is built in parallel; OR-ing words is associative and combines map-side.
    """
    chosen, positions = _place()
    position = F.col("position")
    users = facts.filter(F.col("counter_type") == NAMED).select(*PROBE)
    return (users.join(plans, COUNTER)
            .select(*COUNTER, chosen.alias("slice"), F.explode(positions).alias("position"))
            .groupBy(*COUNTER, "slice", (position / 64).cast("long").alias("word"))
            .agg(F.bit_or(_bit(position)).alias("bits")))


def merge_filters(left: DataFrame, right: DataFrame) -> DataFrame:
    """The union of filters with the same plans."""
    return (left.unionByName(right).groupBy(*COUNTER, "slice", "word")
            .agg(F.bit_or("bits").alias("bits")))


def probably_done(probes: DataFrame, filters: DataFrame, plans: DataFrame) -> DataFrame:
    """Probes (distinct rows) with ``member``: never false for a user who did the event.

    A counter without a plan has no users.
    """
    chosen, positions = _place()
    position = F.col("position")
    asked = (probes.join(plans, COUNTER, "left")
             .select(*PROBE, chosen.alias("slice"), F.explode_outer(positions).alias("position"))
             .withColumn("word", (position / 64).cast("long"))
             .withColumn("bit", _bit(position)))
    found = asked.join(filters, [*COUNTER, "slice", "word"], "left")
    set_bit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return found.groupBy(*PROBE).agg(F.bool_and(set_bit).alias("member"))


# --- filters that grow after they were stored ------------------------------------------

# Stage k of a growing filter holds twice as many users as the one before it and errs half as
# often, so that all stages together stay below the counter's error probability.
#
# A stage is cut into parts, a power of two, and a user has all its bits in the part its hash
# begins with. The parts of all stages that may hold a user thus lie in one range of hashes: a
# probe is sent to its range once and read against all stages there, and a range is as small as
# the largest stage and the number of probes demand.
SLACK = 1.1  # users are dealt to stages by hash, so a stage may get a few per cent more
GROWING = [*COUNTER, "origin", "stage"]
_SETTINGS = ["kind", "size", "error_probability"]


def stage_plans(stages: DataFrame) -> DataFrame:
    """``stages`` (with ``kind, size, error_probability``) with ``bits``, ``hashes`` and
    ``parts``."""
    size = F.greatest(F.col("size"), F.lit(1))
    capacity = size * F.pow(F.lit(2.0), F.col("stage"))
    share = F.when(F.col("kind") == FIXED_SIZE, F.lit(1.0)).otherwise(
        F.pow(F.lit(0.5), F.col("stage") + 1))
    bits = F.ceil(-capacity * SLACK * F.log(F.col("error_probability") * share)
                  / math.log(2) ** 2)
    return stages.select(*stages.columns, bits.cast("long").alias("bits"), F.greatest(
        F.lit(1), F.round(bits / (capacity * SLACK) * math.log(2))).cast("int").alias("hashes"),
        _power_of_two(bits / PART_BITS).alias("parts"))


def _power_of_two(least: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(least, F.lit(1))))).cast("long")


@dataclass(frozen=True)
class GrowingFilters:
    """``stages``: ``(namespace, event_name, origin, stage, users, kind, size,
    error_probability)``; ``words``: the bytes of their parts ``(…, part, words)``, without
    those that have no users. ``origin`` tells filters apart that were built independently and
    then put together."""

    stages: DataFrame
    words: DataFrame


def _part_plans(stages: DataFrame) -> DataFrame:
    """What the parts of ``stages`` are like; written, so that its size is known."""
    plans = stage_plans(stages).where(F.col("bits").isNotNull())
    return materialize(plans.select(
        *GROWING, "users", "parts", F.ceil(F.col("bits") / F.col("parts")).alias("part_bits"),
        "hashes"), "filter-plans")


def _range_of(hash_: Column, ranges: Column) -> Column:
    """Which of ``ranges`` equal ranges, a power of two, a hash lies in."""
    return F.shiftright(F.shiftrightunsigned(hash_, 34) * ranges, 30)


def _words_of(users: DataFrame, stages: DataFrame) -> DataFrame:
    """The parts that ``users``, dealt to ``stages``, fill. Neighbouring parts are built
    together; the users of an overfull stage are dealt to several builds of the same parts."""
    keys, hash_ = [*GROWING, "block", "build"], F.xxhash64("user_id")
    blocks = F.ceil(F.col("parts") / AT_ONCE)
    builds = F.ceil(F.col("users") / (blocks * USERS_AT_ONCE))
    plans = _part_plans(stages).select("*", blocks.alias("blocks"), builds.alias("builds"))
    # The hash is made after the shuffle: there it takes no room.
    dealt = users.join(plans, GROWING).select(
        *GROWING, F.floor(_range_of(hash_, F.col("parts")) / AT_ONCE).alias("block"),
        F.pmod(F.xxhash64(F.lit("build"), "user_id"), F.col("builds")).alias("build"),
        "user_id").repartition(*keys).select(*keys, hash_.alias("hash"))
    wanted = plans.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *GROWING, "block", F.explode(F.sequence(F.lit(0), F.col("builds") - 1)).alias("build"),
        "parts", "part_bits", "hashes")
    return _merged(dealt.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(
        filter_parts.built, "namespace string, event_name string, origin string, stage int, "
        "part long, words binary"))


def _merged(words: DataFrame) -> DataFrame:
    """One row per part; the bytes of a part have one length."""
    return words.groupBy(*GROWING, "part").agg(
        F.bitmap_or_agg("words").alias("_united"), F.max(F.length("words")).alias("_length")
    ).select(*GROWING, "part", F.substring("_united", F.lit(1), F.col("_length")).alias("words"))


def add_users(filters: GrowingFilters | None, users: DataFrame, settings: DataFrame,
              origin: str = "") -> GrowingFilters:
    """Filters that also hold ``users`` (namespace, event_name, user_id).

    Users the filters already know are left out, as with an exact set. The others fill the
    last stage of their counter and then new stages; each is dealt by its hash to the place it
    would have in a list, so no list is made. ``settings`` has ``kind, size,
    error_probability`` per counter; it is kept with the filter and read for new counters
    only. A filter of fixed size has one stage, whatever it holds.
    """
    added = users.select(*PROBE).distinct()
    if filters:
        added = in_growing(added, filters).where(~F.col("member")).select(*PROBE)
    added = materialize(added, "filter-users")
    counts = added.groupBy(*COUNTER).agg(F.count("*").alias("_new"))
    if filters:
        own = filters.stages.where(F.col("origin") == origin)
        known = own.groupBy(*COUNTER).agg(
            F.sum("users").alias("_held"), *(F.first(c).alias(f"_{c}") for c in _SETTINGS))
        counts = counts.join(known, COUNTER, "left")
        settled = [F.coalesce(f"_{c}", c).alias(c) for c in _SETTINGS]
    else:
        counts = counts.withColumn("_held", F.lit(0))
        settled = [F.col(c) for c in _SETTINGS]
    plan = materialize(counts.join(settings, COUNTER, "left").select(
        *COUNTER, "_new", F.coalesce("_held", F.lit(0)).alias("_held"), *settled), "filter-counts")
    size = F.greatest(F.col("size"), F.lit(1))
    share = (F.pmod(F.xxhash64(F.lit("place"), "user_id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    place = F.col("_held") + share * F.col("_new")
    stage = F.when(F.col("kind") == FIXED_SIZE, F.lit(0)).otherwise(
        F.floor(F.log2(place / size + 1))).cast("int")
    dealt = added.join(plan, COUNTER).select(
        *PROBE, F.lit(origin).alias("origin"), stage.alias("stage"), *_SETTINGS)
    # Few rows are left for the second aggregation, which has to sort them.
    new = materialize(dealt.groupBy(*GROWING, *_SETTINGS).agg(F.count("*").alias("users")).groupBy(
        *GROWING).agg(F.sum("users").alias("users"), *(F.first(c).alias(c) for c in _SETTINGS)),
        "filter-stages")
    words = _words_of(dealt.select(*PROBE, "origin", "stage"), new)
    if not filters:
        return GrowingFilters(new, words)
    stages = filters.stages.unionByName(new).groupBy(*GROWING).agg(
        F.sum("users").alias("users"), *(F.first(c).alias(c) for c in _SETTINGS))
    return GrowingFilters(stages, _merged(filters.words.unionByName(words)))


def united(left: GrowingFilters, right: GrowingFilters) -> GrowingFilters:
    """Filters of both sides, whatever their sizes; origins must differ where counters are
    the same. The probabilities of error add up."""
    return GrowingFilters(left.stages.unionByName(right.stages),
                          left.words.unionByName(right.words))


def in_growing(probes: DataFrame, filters: GrowingFilters) -> DataFrame:
    """Probes (distinct rows) with ``member``: in any stage of their counter's filters.

    A probe without a counter's filters or without a user is in none.
    """
    asked, plans = materialize(probes, "filter-probes"), _part_plans(filters.stages)
    largest = plans.groupBy(*COUNTER).agg(F.max("parts").alias("_parts"))
    ranges = materialize(
        asked.groupBy(*COUNTER).agg(F.count("*").alias("_probes")).join(largest, COUNTER).select(
            *COUNTER, _power_of_two(F.greatest(
                F.col("_probes") / USERS_AT_ONCE, F.col("_parts") / AT_ONCE)).alias("_ranges")),
        "filter-ranges")
    keys, hash_ = [*COUNTER, "_range"], F.xxhash64("user_id")
    sent = asked.join(ranges, COUNTER, "left").select(
        *probes.columns, _range_of(hash_, F.col("_ranges")).alias("_range"))
    in_one = F.col("_range").isNotNull() & F.col("user_id").isNotNull()
    # A part may be larger than a range or smaller.
    first = F.col("part") * F.col("_ranges")
    last = first + F.col("_ranges") - 1
    parts = filters.words.join(plans, GROWING).join(ranges, COUNTER).select(
        *keys[:-1], "origin", "stage", "part", "words", "parts", "part_bits", "hashes",
        F.explode(F.sequence(F.floor(first / F.col("parts")), F.floor(last / F.col("parts"))))
        .alias("_range"))
    # Here, too, the hash of the shuffled rows is made after the shuffle.
    found = sent.where(in_one).repartition(*keys).withColumn("_hash", hash_)
    schema = T.StructType([*probes.schema.fields, T.StructField("member", T.BooleanType())])
    answers = found.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(
        filter_parts.looked_up(probes.columns), schema)
    return answers.unionByName(sent.where(~in_one).select(
        *probes.columns, F.lit(False).alias("member")))


def store_filters(filters: GrowingFilters, path: str) -> None:
    filters.stages.write.parquet(f"{path}/stages")
    filters.words.write.parquet(f"{path}/words")


def stored_filters(spark: SparkSession, path: str) -> GrowingFilters:
    return GrowingFilters(spark.read.parquet(f"{path}/stages"),
                          spark.read.parquet(f"{path}/words"))
