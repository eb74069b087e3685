"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources weigh 5, 2, 1, repeating in code-point order, and share all words; a target
stops at three times its source's size and the excess is shared again.

Draws: the documents of a source are put in a random order by a hash and cut into blocks of
about ``BLOCK_WORDS`` words. The mix takes whole passes over the source, then a prefix of the
order that ends nearest to the target. A draw is one pass over one block.

Shards: the draws of all sources are split among the output shards by a tree. Its root holds
the number of draws of every source; a node gives its left half of shards a share drawn from
the multivariate hypergeometric distribution, exactly as if all draws had been shuffled
together. A leaf holds the quota of each source in one shard; the shard takes that many next
draws of the source's permuted blocks. Inside a shard, documents are ordered by a hash.

The tree works on counts (sources x shards), the cut of a source is found by counting words
in cells of the hash, so no window or task ever holds the documents of a source. Document
text never moves to decide a draw.

Defined results: a null text has no words; a null source is a source, last in order; rows
equal in id and text are taken alike; documents without words are taken with the whole passes
only; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from waymark.llm.common import text_or_empty, words_of
from waymark.storage import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
SEED = "mix"
CELL_BITS = 12
PLACE_BITS = 60


def place(doc_id: Column, text: Column) -> Column:
    """A random number of 60 bits per document: its place in its source's order."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), doc_id.cast("string"), F.md5(text)))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", "source", F.size(words_of(text)).cast("long").alias("size"),
                       place(F.col("doc_id"), text).alias("place"))


def source_targets(sized: DataFrame) -> DataFrame:
    """``(source, source_size, target)``, one row per source.

    Sources are filled in the order in which they reach their cap. ``level`` is what one unit
    of weight gets once all earlier sources are full; the first source that stays below its
    cap settles the level for the rest.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (number % len(WEIGHTS)).cast("int") + 1)
    weighed = total.select("*", weight.alias("weight")).withColumn(
        "cap", MOST * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0))
    levels = (weighed.withColumn("level", left / weights)
              .withColumn("filled", F.col("level") * F.col("weight") >= F.col("cap")))
    settled = F.min(F.when(~F.col("filled"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)["level"]
    return levels.select(
        "source", "source_size",
        F.when(F.col("filled") | settled.isNull(), F.col("cap").cast("double"))
        .otherwise(settled * F.col("weight")).alias("target"))


def _cell(level: int) -> Column:
    """The first ``level * CELL_BITS`` bits of the place."""
    return F.shiftright("place", PLACE_BITS - level * CELL_BITS)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def source_cuts(sized: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS
                ) -> DataFrame:
    """Per source: whole ``passes``, ``blocks``, and the last ``place`` of the prefix, ``cut``.

    A document belongs to the prefix if its middle word does not lie beyond the rest of the
    target. The cut is found in three steps: a cell of the first 12 bits, a cell of the first
    24 bits in it, and the documents in that cell.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    cuts = targets.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.coalesce(passes, F.lit(0)).cast("long").alias("passes")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)))
    cuts = materialize(cuts, "cuts")
    found = cuts.select("_source", "rest", F.lit(0).cast("long").alias("cell"),
                        F.lit(0).cast("long").alias("before"))
    for level in (1, 2):
        inside = sized.join(found, _same(F.col("source"), F.col("_source"))
                            & (_cell(level - 1) == F.col("cell")))
        cells = inside.groupBy("_source", "rest", "before", _cell(level).alias("cell")).agg(
            F.sum("size").alias("words"))
        running = W.partitionBy("_source").orderBy("cell")
        found = materialize(
            cells.withColumn("end", F.col("before") + F.sum("words").over(running))
            .withColumn("begin", F.col("end") - F.col("words"))
            .where((F.col("begin") <= F.col("rest")) & (F.col("rest") < F.col("end")))
            .select("_source", "rest", "cell", F.col("begin").alias("before")), "cells")
    last = sized.join(found, _same(F.col("source"), F.col("_source"))
                      & (_cell(2) == F.col("cell")))
    alike = last.groupBy("_source", "rest", "before", "place").agg(F.sum("size").alias("words"))
    running = W.partitionBy("_source").orderBy("place")
    middle = F.col("before") + F.sum("words").over(running) - F.col("words") / 2
    taken = (alike.withColumn("middle", middle).where(F.col("middle") <= F.col("rest"))
             .groupBy("_source").agg(F.max("place").alias("within")))
    edges = found.select(F.col("_source").alias("_edge"), (
        F.shiftleft("cell", PLACE_BITS - 2 * CELL_BITS) - 1).alias("outside"))
    within = taken.select(F.col("_source").alias("_taken"), "within")
    cut = F.coalesce(F.col("within"), F.col("outside"), F.lit(-1).cast("long"))
    return (cuts.join(edges, _same(F.col("_source"), F.col("_edge")), "left")
            .join(within, _same(F.col("_source"), F.col("_taken")), "left")
            .select(F.col("_source").alias("source"), "source_size", "target", "passes",
                    "blocks", cut.alias("cut")))


def block_of(blocks: Column) -> Column:
    """The block of a place: places are dealt to equal ranges."""
    return F.shiftright(F.shiftright("place", PLACE_BITS - 32) * blocks, 32)


def hypergeometric(urn: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` balls are good, by inversion.

    The distribution is summed over ten standard deviations around its mean; what lies
    outside has less weight than a double can hold beside it. Weights follow from each other
    by the ratio of neighbouring probabilities.
    """
    share = F.when(urn > 0, good / urn).otherwise(0.0)
    mean = drawn * share
    spread = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share) * F.when(
        urn > 1, (urn - drawn) / (urn - 1)).otherwise(0.0)))
    low = F.greatest(F.lit(0), drawn + good - urn,
                     F.floor(mean - 10 * spread - 10).cast("long")).cast("long")
    high = F.least(drawn, good, F.ceil(mean + 10 * spread + 10).cast("long")).cast("long")

    def chosen(lowest: Column, highest: Column) -> Column:
        steps = F.sequence(lowest, highest)

        def next_weight(weight: Column, k: Column) -> Column:
            return weight * (good - k) * (drawn - k) / ((k + 1.0) * (urn - good - drawn + k + 1))

        total = F.aggregate(
            steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda a, k: F.struct(next_weight(a["w"], k).alias("w"),
                                  (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])
        return F.aggregate(
            steps, F.struct(F.lit(1.0).alias("w"), (uniform * total).alias("left"),
                            F.lit(0).cast("long").alias("passed")),
            lambda a, k: F.struct(
                next_weight(a["w"], k).alias("w"), (a["left"] - a["w"]).alias("left"),
                (a["passed"] + F.when((a["left"] >= a["w"]) & (k < highest), 1).otherwise(0))
                .cast("long").alias("passed")),
            lambda a: lowest + a["passed"])

    return F.when(low >= high, high).otherwise(chosen(low, high))


def _split(quotas: Column, total: Column, left: Column, node: Column) -> Column:
    """The left child's draws of every source, source after source."""
    empty = F.array().cast("array<long>")

    def step(state: Column, quota: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(
            F.lit(SEED), node, F.size(state["given"])), 11) / float(1 << 53))
        given = hypergeometric(state["urn"], quota, state["left"], uniform)
        return F.get(F.transform(F.array(given), lambda g: F.struct(
            (state["urn"] - quota).alias("urn"), (state["left"] - g).alias("left"),
            F.concat(state["given"], F.array(g)).alias("given"))), F.lit(0))

    return F.aggregate(quotas, F.struct(total.alias("urn"), left.alias("left"),
                                        empty.alias("given")), step, lambda s: s["given"])


def shard_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """From draws per source ``(source, draws)`` to ``(source, shard, first, draws)``.

    One row per node, holding a count per source; the number of rows ends at ``shards``.
    """
    # The sources and their counts in one row: counts of the plan, not documents.
    root = quotas.agg(F.sort_array(F.collect_list(F.struct(
        F.col("source").isNull().alias("last"), "source", "draws"))).alias("sources"))
    nodes = root.select(
        "sources", F.transform("sources", lambda s: s["draws"]).alias("quotas"),
        F.lit(0).alias("low"), F.lit(shards).alias("high")).withColumn(
        "total", F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)).withColumn(
        "urn", F.col("total"))

    def before(shard: Column) -> Column:  # draws of all shards before this one
        return F.floor(F.col("total") * shard / shards).cast("long")

    width = shards
    while width > 1:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        part = nodes.withColumn("middle", middle).withColumn(
            "left", _split(F.col("quotas"), F.col("urn"), before(F.col("middle"))
                           - before(F.col("low")), F.concat_ws("-", "low", "high")))
        right = F.zip_with("quotas", "left", lambda q, g: q - g)
        children = F.when(F.col("high") - F.col("low") > 1, F.array(
            F.struct(F.col("low"), F.col("middle").alias("high"), F.col("left").alias("quotas")),
            F.struct(F.col("middle").alias("low"), F.col("high"), right.alias("quotas"))
        )).otherwise(F.array(F.struct("low", "high", "quotas")))
        nodes = (part.select("sources", "total", F.explode(children).alias("node"))
                 .select("sources", "total", "node.*")
                 .withColumn("urn", before(F.col("high")) - before(F.col("low"))))
        width = -(-width // 2)
    leaves = nodes.select(F.col("low").alias("shard"),
                          F.explode(F.arrays_zip("sources", "quotas")).alias("s")).select(
        F.col("s.sources.source").alias("source"), "shard", F.col("s.quotas").alias("draws"))
    earlier = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("draws").over(earlier), F.lit(0)))


@dataclass(frozen=True)
class Mix:
    """``cuts``: one row per source. ``draws``: ``(source, draw, shard)``."""

    sized: DataFrame
    cuts: DataFrame
    draws: DataFrame


def plan_mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS
             ) -> Mix:
    sized = materialize(sizes(docs), "sizes")
    targets = materialize(source_targets(sized), "targets")
    cuts = materialize(source_cuts(sized, targets, block_words), "source-cuts")
    partial = F.when(F.col("cut") >= 0, block_of_cut() + 1).otherwise(0)
    quotas = cuts.select("source", (F.col("passes") * F.col("blocks") + partial)
                         .cast("long").alias("draws"))
    words = targets.agg(F.sum("target")).first()[0] or 0
    shards = max(1, -(-int(words) // shard_words))
    leaves = materialize(shard_quotas(quotas, shards), "leaves")
    draws = leaves.where(F.col("draws") > 0).select("source", "shard", F.explode(F.sequence(
        F.col("first"), F.col("first") + F.col("draws") - 1)).alias("draw"))
    return Mix(sized, cuts, draws)


def block_of_cut() -> Column:
    return F.shiftright(F.shiftright("cut", PLACE_BITS - 32) * F.col("blocks"), 32)


def assign(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (with source, place and size) once per copy that the mix takes, with ``copy``,
    ``shard`` and ``local_order``; rows that are not taken once, with nulls there."""
    cuts = mix.cuts.select(F.col("source").alias("_of"), "passes", "blocks", "cut")
    own = rows.join(cuts, _same(F.col("source"), F.col("_of")))
    extra = (F.col("place") <= F.col("cut")) & (F.col("size") > 0)
    copies = F.col("passes") + F.when(extra, 1).otherwise(0)
    copied = own.select(
        *rows.columns, block_of(F.col("blocks")).alias("_block"), "blocks",
        F.explode_outer(F.when(copies > 0, F.sequence(
            F.lit(0).cast("long"), (copies - 1).cast("long")))).alias("copy"))
    drawn = copied.withColumn("_draw", F.col("copy") * F.col("blocks") + F.col("_block"))
    draws = mix.draws.select(F.col("source").alias("_of"), F.col("draw").alias("_at"), "shard")
    return drawn.join(draws, _same(F.col("source"), F.col("_of"))
                      & (F.col("_draw") == F.col("_at")), "left").select(
        *rows.columns, "copy", "shard",
        F.when(F.col("copy").isNotNull(), F.xxhash64(F.lit(SEED), "place", "copy"))
        .alias("local_order"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, a row per copy, dealt by shard and shuffled inside it."""
    mix = plan_mix(docs)
    rows = docs.select(F.struct(*docs.columns).alias("document"), "source",
                       F.size(words_of(text_or_empty())).cast("long").alias("size"),
                       place(F.col("doc_id"), text_or_empty()).alias("place"))
    taken = assign(rows, mix).where(F.col("shard").isNotNull())
    dealt = taken.repartitionByRange("shard", "local_order").sortWithinPartitions(
        "shard", "local_order")
    return dealt.select("document.*")


def mixing_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` per document."""
    mix = plan_mix(docs)
    alike = mix.sized.groupBy("doc_id", "source", "size", "place").agg(
        F.count("*").alias("repeats"))
    drawn = assign(alike, mix).groupBy("doc_id", "source", "size", "place", "repeats").agg(
        F.count("shard").alias("copies"))
    totals = mix.cuts.select(F.col("source").alias("_of"), "source_size", "target")
    return (drawn.join(totals, _same(F.col("source"), F.col("_of")))
            .withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).alias("taken")))
