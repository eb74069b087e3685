"""Auditing how the sources of a language differ in their words, by a minimal-perfect-hash
recount.

1. First pass: the number of documents of every (language, term), exactly, combined before the
   shuffle. Terms in fewer than ``LEAST_DOCUMENTS`` go away. Both passes cut texts into terms by
   their bytes, for many documents at once.
2. The kept terms of a language are dealt to shards of about ``SHARD`` terms; every shard gets
   a minimal perfect hash (buckets with a displacement each) and stores its terms in slot
   order, so that a term that was not kept is told from the kept one in its slot.
3. Second pass: the shards are broadcast, never more than ``BROADCAST_BYTES`` at once; if there
   are more, the pass is repeated for each part of them. A task counts every (language,
   source) in a dense vector with one place per slot, and gives out the places in use.
4. The vectors of a source and shard are summed as a sorted stream, one vector at a time. A
   shard compares its sources by whole vectors; more sources than ``BLOCK`` are compared in
   blocks, so no task holds more than two blocks of one shard.

All arithmetic is on whole numbers.

Defined results: nulls in text, language and source read as ''. Groups without terms are
listed with the value 0. Equal values rank by the bytes of the item. Repeated rows are
documents of their own; very long texts are read whole; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from waymark.llm.common import text_or_empty
from waymark.storage import materialize

LEAST_DOCUMENTS = 10
TOP = 10
SHARD = 4096
BROADCAST_BYTES = 32 << 20
CELLS = 8 << 20  # places of dense vectors a task holds before it gives them out
SLICE = 4 << 20  # bytes of text whose terms a task holds at once; a longer document is a slice
BATCH = 4 << 20  # bytes of a batch between Spark and Python; a longer row is a batch
BYTES = 1 << 20  # bytes of text that are cut into terms at once
BLOCK = 128
SCALE = 1_000_000_000
# What each byte of a text is in a term, 0 if between terms; only A to Z are lower-cased.
IN_TERM = np.array([b if b >= 0x80 or chr(b).isalpha() else 0 for b in bytes(range(256)).lower()],
                   np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table. Its Python steps get batches of ``BATCH`` bytes: an executor
    holds those of all its tasks several times, outside its heap."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH))
    try:
        return materialize(df, label)
    finally:
        conf.set(key, before)


def terms_of(texts: pa.StringArray) -> pa.ListArray:
    """The terms of each text. All that separates terms is ASCII, so that bytes tell them."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kept, offsets, limits = np.empty(len(data), np.uint8), [], np.zeros(len(ends), np.int32)
    size = count = 0
    before = False
    for low in range(0, len(data), BYTES):
        cut = IN_TERM[data[low:low + BYTES]]
        inside = cut != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[0] &= not before
        a, b = np.searchsorted(ends, (low, low + len(cut)))
        opened = ends[a:b] - low  # a text begins a term of its own
        first[opened] = inside[opened]
        at = np.flatnonzero(first)
        limits[a:b] = np.searchsorted(at, opened) + count
        places = np.cumsum(inside, dtype=np.int32)
        offsets.append(places[at] + np.int32(size - 1))
        kept[size:size + places[-1]] = cut[inside]
        size, count, before = size + int(places[-1]), count + len(at), inside[-1]
    limits[np.searchsorted(ends, len(data)):] = count
    offsets = np.concatenate([*offsets, np.array([size], np.int32)])
    terms = pa.StringArray.from_buffers(count, pa.py_buffer(offsets), pa.py_buffer(kept[:size]))
    return pa.ListArray.from_arrays(pa.array(limits), terms)


def texts_of(docs: DataFrame) -> DataFrame:
    """``(lang, source, text)`` per document, without nulls."""
    return docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"),
                       F.make_valid_utf8(text_or_empty()).alias("text"))


def slices(batch: pa.RecordBatch, size: int = SLICE,
           column: str = "terms") -> Iterator[pa.RecordBatch]:
    """The documents of a batch, so many that they hold up to ``size`` terms, or bytes of text."""
    held = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(held.type) else pc.binary_length
    ends = np.cumsum(length(held).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(lang, sources, lengths, terms)`` for some documents of a language at a time, sorted by
    source: their sources, numbers of terms, and terms in one dictionary-encoded array."""
    for batch in batches:
        batch = batch.sort_by([("lang", "ascending"), ("source", "ascending")])
        for part in slices(batch, SLICE, "text"):
            start = 0
            for lang, same in groupby(part["lang"].to_pylist()):
                own = part.slice(start, len(list(same)))
                start += own.num_rows
                lists = terms_of(own["text"].cast(pa.string()))
                yield (lang, own["source"].to_pylist(), pc.list_value_length(lists).to_numpy(),
                       lists.flatten().dictionary_encode())


def document_counts(docs: DataFrame) -> DataFrame:
    """``(lang, term, n)``: in how many documents the terms are; partial sums, a row per term and
    slice."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, lengths, terms in tokenized(batches):
            size = len(terms.dictionary)
            if size:
                owner = np.repeat(np.arange(len(lengths), dtype=np.int64) * size, lengths)
                pairs = np.sort(owner + terms.indices.to_numpy())  # of document and term
                found = pairs[np.diff(pairs, prepend=-1) != 0] % size
                yield pa.record_batch([pa.repeat(lang, size), terms.dictionary,
                                       pa.array(np.bincount(found, minlength=size), pa.int64())],
                                      names=["lang", "term", "n"])

    return texts_of(docs).mapInArrow(count, "lang string, term string, n long")


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """``(lang, term)`` for the terms in at least so many documents of their language."""
    return document_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least).select("lang", "term")


# --- minimal perfect hashes -------------------------------------------------------------

def place(hashes: np.ndarray, seeds: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """The slot of each hash under the seed of its bucket; a negative seed names the slot."""
    value = (hashes ^ (seeds.astype(np.uint64) * _MIX)) * _ODD
    value ^= value >> np.uint64(32)
    value = (value * _MIX) >> np.uint64(33)
    return np.where(seeds < 0, -seeds - 1, (value % np.uint64(size)).astype(np.int64))


def buckets(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(count)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> np.ndarray:
    """Bucket seeds under which the (distinct) hashes fill the slots 0 to n - 1.

    The largest buckets choose first; buckets of one term take the slots that are left.
    """
    size = len(hashes)
    count = max(1, -(-size // 4))
    seeds = np.zeros(count, np.int64)
    bucket = buckets(hashes, count)
    order = np.argsort(bucket, kind="stable")
    limits = np.searchsorted(bucket[order], np.arange(count + 1))
    sizes = np.diff(limits)
    taken = np.zeros(size, bool)
    single = []
    for b in np.argsort(-sizes, kind="stable"):
        members = hashes[order[limits[b]:limits[b + 1]]]
        if len(members) <= 1:
            if len(members):
                single.append(b)
            continue
        seed, trial = 0, 64  # many seeds are tried at once
        while True:
            tried = np.arange(seed + 1, seed + 1 + trial)
            slots = place(members[None, :], np.repeat(tried[:, None], len(members), 1), size)
            ordered = np.sort(slots, axis=1)
            good = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                seeds[b] = tried[good.argmax()]
                taken[slots[good.argmax()]] = True
                break
            seed += trial
            trial = min(trial * 2, 1 << 14)
    for b, slot in zip(single, np.flatnonzero(~taken)):
        seeds[b] = -slot - 1
    return seeds


def term_hashes(terms: list[str] | list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))


def shards_of(hashes: np.ndarray, count: int) -> np.ndarray:
    return (hashes % np.uint64(count)).astype(np.int64)


def hash_shards(terms: DataFrame) -> DataFrame:
    """``(lang, n_shards, shard, seed, seeds, terms)``: a perfect hash per shard, its terms in
    slot order. ``seed`` is the hash seed under which the terms of the shard differ, mostly 0,
    the one by which terms are dealt."""
    sizes = terms.groupBy(F.col("lang").alias("_lang")).agg(
        F.ceil(F.count("*") / SHARD).cast("int").alias("n_shards"))
    sized = terms.join(sizes, F.col("lang") == F.col("_lang")).select("lang", "n_shards", "term")

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = term_hashes(list(batch["term"]))
            batch["shard"] = (hashes % batch["n_shards"].to_numpy().astype(np.uint64)
                              ).astype(np.int32)
            yield batch

    def build(group: pd.DataFrame) -> pd.DataFrame:
        found, seed = sorted(group["term"], key=lambda t: t.encode("utf-8")), 0
        while len(np.unique(hashes := term_hashes(found, seed))) < len(found):
            seed += 1
        seeds = perfect_hash(hashes)
        slots = place(hashes, seeds[buckets(hashes, len(seeds))], len(found))
        ordered = np.empty(len(found), object)
        ordered[slots] = found
        first = group.iloc[0]
        return pd.DataFrame([(first["lang"], first["n_shards"], first["shard"], seed, seeds,
                              ordered)],
                            columns=["lang", "n_shards", "shard", "seed", "seeds", "terms"])

    return sized.mapInPandas(dealt, "lang string, n_shards int, term string, shard int").groupBy(
        "lang", "shard").applyInPandas(
        build, "lang string, n_shards int, shard int, seed int, seeds array<long>, "
               "terms array<string>")


class Shards:
    """Some shards of the languages; finds the places of terms."""

    def __init__(self, table: pa.Table):
        self.langs: dict[str, tuple[int, dict[int, tuple]]] = {}
        self.sizes: dict[str, int] = {}
        small = (table[c].to_pylist() for c in ("lang", "n_shards", "shard", "seed"))
        for *names, seeds, terms in zip(*small, table["seeds"], table["terms"]):
            lang, n_shards, shard, seed = names
            found = self.langs.setdefault(lang, (n_shards, {}))[1]
            start = self.sizes.get(lang, 0)
            found[shard] = (start, seed, seeds.values.to_numpy(), terms.values)
            self.sizes[lang] = start + len(terms.values)
        self.starts = {lang: sorted((start, shard) for shard, (start, *_) in found.items())
                       for lang, (_, found) in self.langs.items()}

    def places(self, lang: str, terms: pa.Array) -> np.ndarray:
        """The place of each term in the language's vector, -1 for terms that are not here."""
        result = np.full(len(terms), -1, np.int64)
        n_shards, found = self.langs[lang]
        words = terms.cast(pa.binary()).to_pylist()
        dealt_by = term_hashes(words)
        shard_of = shards_of(dealt_by, n_shards)
        order = np.argsort(shard_of, kind="stable")
        limits = np.searchsorted(shard_of[order], np.arange(n_shards + 1))
        for shard, (start, seed, seeds, stored) in found.items():
            at = order[limits[shard]:limits[shard + 1]]
            if len(at):
                hashes = term_hashes([words[i] for i in at], seed) if seed else dealt_by[at]
                slots = place(hashes, seeds[buckets(hashes, len(seeds))], len(stored))
                same = pc.equal(stored.take(pa.array(slots)), terms.take(pa.array(at)))
                same = same.to_numpy(zero_copy_only=False)
                result[at[same]] = start + slots[same]
        return result


# --- recount ----------------------------------------------------------------------------

_COUNTS = "lang string, source string, shard int, slots array<int>, counts array<long>"


def counts_batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, source, shard, slots, counts = zip(*rows)
    return pa.record_batch(
        [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(shard, pa.int32()),
         pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
        names=["lang", "source", "shard", "slots", "counts"])


class DenseCounts:
    """A vector of counts per (language, source)."""

    def __init__(self, shards: Shards):
        self.shards = shards
        self.vectors: dict[tuple[str, str], np.ndarray] = {}
        self.cells = 0

    def add(self, lang: str, source: str, places: np.ndarray) -> None:
        vector = self.vectors.get((lang, source))
        if vector is None:
            vector = self.vectors[lang, source] = np.zeros(self.shards.sizes[lang], np.int64)
            self.cells += len(vector)
        np.add.at(vector, places, 1)

    def give_out(self) -> Iterator[pa.RecordBatch]:
        """The counts in use, a row per group and shard."""
        for (lang, source), vector in self.vectors.items():
            starts = self.shards.starts[lang]
            rows = []
            for (start, shard), end in zip(starts, [s for s, _ in starts[1:]] + [len(vector)]):
                slots = np.flatnonzero(vector[start:end])
                if len(slots):
                    rows.append((lang, source, shard, slots.astype(np.int32),
                                 vector[start:end][slots]))
            if rows:
                yield counts_batch(rows)
        self.vectors, self.cells = {}, 0


def recount(docs: DataFrame, shards: pa.Table) -> DataFrame:
    """``(lang, source, shard, slots, counts)``: how often the terms of some shards occur;
    partial sums of tasks."""
    shared, cells = docs.sparkSession.sparkContext.broadcast(shards), CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shards(shared.value)
        counts = DenseCounts(held)
        for lang, sources, lengths, terms in tokenized(batches):
            if lang not in held.langs or not len(terms):
                continue
            found = held.places(lang, terms.dictionary)[terms.indices.to_numpy()]
            ends = np.cumsum(lengths)
            start = doc = 0
            for source, same in groupby(sources):
                doc += len(list(same))
                here = found[start:ends[doc - 1]]
                start = ends[doc - 1]
                if len(here):
                    counts.add(lang, source, here[here >= 0])
                if counts.cells > cells:
                    yield from counts.give_out()
        yield from counts.give_out()

    return texts_of(docs).mapInArrow(run, _COUNTS)


def summed(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key with the sum of its vectors; those of other columns are of any row. A
    task holds one vector at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, total = None, None, np.zeros(0, np.int64)

        def done() -> tuple:
            slots = np.flatnonzero(total)
            return (*row, slots.astype(np.int32), total[slots])

        for batch in batches:
            rows = []
            names = [batch[c].to_pylist() for c in ("lang", "source", "shard")]
            for *found, slots, counts in zip(*names, batch["slots"], batch["counts"]):
                at = [v for v, c in zip(found, ("lang", "source", "shard")) if c in keys]
                if at != key:
                    if key is not None:
                        rows.append(done())
                    key, row, total = at, found, np.zeros(SHARD, np.int64)
                slots = slots.values.to_numpy()
                if len(slots) and slots[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(slots[-1] + 1, np.int64)])
                total[slots] += counts.values.to_numpy()
            if rows:
                yield counts_batch(rows)
        if key is not None:
            yield counts_batch([done()])

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _COUNTS)


def counted(docs: DataFrame, shards: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``(lang, source, shard, slots, counts)`` over all shards, in as many passes as the limit
    asks for."""
    size = (F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 4)
            + F.size("seeds") * 8)
    total, number = shards.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    passes = max(1, -(-total // broadcast_bytes))
    while True:
        dealt = shards.withColumn("turn", F.pmod(F.xxhash64("lang", "shard"), F.lit(passes)))
        largest = dealt.groupBy("turn").agg(F.sum(size).alias("size")).agg(F.max("size")).first()
        if (largest[0] or 0) <= broadcast_bytes or passes >= 8 * number:
            break
        passes += max(1, passes // 4)
    found = None
    for turn in range(passes):
        held = dealt.where(F.col("turn") == turn).drop("turn").toArrow().combine_chunks()
        part = written(summed(recount(docs, held), ("lang", "source", "shard")), "term-counts")
        found = part if found is None else found.union(part)
    return found


# --- comparison -------------------------------------------------------------------------

def scaled(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / (n + 2 v))``, exactly."""
    if counts.size and counts.max() > (1 << 62) // SCALE:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + 2) // (n + 2 * v)).astype(np.int64)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


_FOUND = "lang string, a int, b int, term string, value long"


def compare_shard(unit: pd.DataFrame, block: int) -> pd.DataFrame:
    """Sums of differences between the sources ``a`` < ``b`` of a unit (two blocks of sources,
    one shard), and the terms by which a source exceeds its language most (``b`` is null)."""
    head = unit[unit["terms"].notna()].iloc[0]
    lang, terms, whole_n, v = head["lang"], head["terms"], int(head["n"]), int(head["v"])
    names = unit[(unit["no"] >= 0) & unit["slots"].isna()].sort_values("no")
    numbers, sums = names["no"].to_numpy(), names["n"].to_numpy()
    counts = np.zeros((len(numbers), len(terms)), np.int64)
    whole = np.zeros(len(terms), np.int64)
    cells = unit[unit["slots"].notna()]
    for no, slots, n in zip(cells["no"], cells["slots"], cells["counts"]):
        (whole if no < 0 else counts[np.searchsorted(numbers, no)])[slots] = n
    p = np.stack([scaled(row, int(s), v) for row, s in zip(counts, sums)])
    q = scaled(whole, whole_n, v)
    blocks = numbers // block
    found = []
    for i in range(len(numbers)):
        others = (numbers > numbers[i]) & ((blocks != blocks[i])
                                           | (head["low"] == head["high"]))
        values = difference(p[i], p[others]).sum(axis=1)
        found += [(lang, numbers[i], b, None, value)
                  for b, value in zip(numbers[others], values)]
        if head["low"] == head["high"]:
            over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            gain = difference(p[i][over], q[over])
            if len(over) > TOP:  # all that tie with the last place stay until here
                limit = np.partition(gain, len(over) - TOP)[len(over) - TOP]
                over, gain = over[gain >= limit], gain[gain >= limit]
            best = sorted((-g, terms[k].encode("utf-8")) for g, k in zip(gain, over))[:TOP]
            found += [(lang, numbers[i], None, t.decode("utf-8"), -g) for g, t in best]
    made = pd.DataFrame(found, columns=["lang", "a", "b", "term", "value"])
    return made.astype({"b": "Int32", "value": "int64"})


def audit_sources(docs: DataFrame, least: int = LEAST_DOCUMENTS,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: per source its distance from the other
    sources of the language (part ``pair``) and the ten terms it has most in excess of the
    language (part ``term``)."""
    shards = written(hash_shards(kept_terms(docs, least)), "term-hashes")
    counts = counted(docs, shards, broadcast_bytes)
    in_lang = F.col("lang") == F.col("_lang")
    sizes = shards.groupBy(F.col("lang").alias("_lang")).agg(
        F.sum(F.size("terms")).cast("long").alias("v"))
    each = F.aggregate("counts", F.lit(0).cast("long"), lambda total, n: total + n)
    sums = counts.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(
        F.sum(each).alias("n"))
    by_name = W.partitionBy("lang").orderBy("source")
    groups = (texts_of(docs).select("lang", "source").distinct()
              .join(sums, in_lang & (F.col("source") == F.col("_source")), "left")
              .select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                      (F.row_number().over(by_name) - 1).alias("no")))
    groups = written(groups, "sources")
    langs = groups.groupBy(F.col("lang").alias("_lang")).agg(
        F.sum("n").alias("whole"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    ).join(sizes, "_lang")
    langs = written(langs, "languages")

    def row(no, slots, counts, n, v, terms):
        def typed(value, kind):
            return (F.col(value) if isinstance(value, str) else F.lit(value)).cast(kind)

        return ("lang", "shard", "blocks", typed(no, "int").alias("no"),
                typed(slots, "array<int>").alias("slots"),
                typed(counts, "array<long>").alias("counts"), typed(n, "long").alias("n"),
                typed(v, "long").alias("v"), typed(terms, "array<string>").alias("terms"))

    listed = shards.join(langs, in_lang)
    heads = listed.select(*row(-1, None, None, "whole", "v", "terms"))
    names = listed.select("_lang", "shard", "blocks").join(groups, in_lang).select(
        *row("no", None, None, "n", None, None))
    named = groups.select(F.col("lang").alias("_of"), F.col("source").alias("_source"), "no")
    cells = (counts.join(named, (F.col("lang") == F.col("_of"))
                         & (F.col("source") == F.col("_source")))
             .join(langs, in_lang).select(*row("no", "slots", "counts", None, None, None)))
    whole = summed(counts, ("lang", "shard")).join(langs, in_lang).select(
        *row(-1, "slots", "counts", None, None, None))
    size = BLOCK
    block = F.when(F.col("no") >= 0, F.floor(F.col("no") / BLOCK).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # Rows of no source go to all units of their shard, others to those of their block.
    firsts = F.when(block.isNull(), every).otherwise(F.array(block))
    units = (heads.union(names).union(cells).union(whole)
             .withColumn("one", F.explode(firsts)).withColumn("two", F.explode(every))
             .where(block.isNotNull() | (F.col("one") <= F.col("two")))
             .select("lang", "shard", F.least("one", "two").alias("low"),
                     F.greatest("one", "two").alias("high"), "no", "slots", "counts", "n", "v",
                     "terms"))
    found = written(units.groupBy("lang", "shard", "low", "high").applyInPandas(
        lambda unit: compare_shard(unit, size), _FOUND), "differences")

    between = found.where(F.col("b").isNotNull()).groupBy(
        F.col("lang").alias("_lang"), "a", "b").agg(F.sum("value").alias("value"))
    here = groups.select("lang", "source", "no")
    there = groups.select(F.col("lang").alias("_of"), F.col("source").alias("item"),
                          F.col("no").alias("other"))
    pairs = (here.join(there, (F.col("lang") == F.col("_of")) & (F.col("no") != F.col("other")))
             .join(between, in_lang & (F.least("no", "other") == F.col("a"))
                   & (F.greatest("no", "other") == F.col("b")), "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.coalesce("value", F.lit(0).cast("long")).alias("value")))
    terms = (found.where(F.col("b").isNull())
             .select(F.col("lang").alias("_lang"), "a", "term", "value")
             .join(here, in_lang & (F.col("a") == F.col("no")))
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     "value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.union(terms).withColumn("rank", F.row_number().over(order)).where(
        (F.col("part") == "pair") | (F.col("rank") <= TOP))
