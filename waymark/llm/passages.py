"""Passages that occur at several places of a corpus, wherever they lie in their texts.

The paragraphs compared here are all windows of ``least`` words of every text, across lines.

1. The band key of a window is the smallest hash of its shingles of a quarter of its words (a
   MinHash band of one row). Equal windows have equal keys, so no equal pair is missed.
   Neighbouring windows that take their key from the same place are a block, one row.
2. Blocks whose key occurs once go away. Only texts with a shared key are read again.
3. Equal blocks are combined, by key and a hash of all their words (128 bits together), with
   their number and first place, by document (id, null last, then text hash) and word.
   Only where the blocks of a key differ are their windows compared, each block's once.
4. Consecutive windows of a text whose first places lie in one document are one passage.

Nothing is paired: results are sums and minima.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from waymark.llm.common import text_or_empty
from waymark.llm.minhash import _ODD, SEED, mixed
from waymark.storage import materialize

CHUNK = 200  # texts at a time
PLAIN, VARIED, SAMPLE = 0, 1, 2  # equal to all blocks of its key, not so, and one of each such
_INDEX = np.uint64((1 << 31) - 1)
_BYTES = np.random.default_rng(SEED).integers(0, np.iinfo(np.uint64).max, 256, np.uint64)


class Blocks(NamedTuple):
    """Windows, and where their blocks begin and how many windows these have."""

    text: np.ndarray  # number of the window's text
    word: np.ndarray  # the window's first word in it
    window: np.ndarray  # hash
    begin: np.ndarray
    size: np.ndarray
    key: np.ndarray
    block: np.ndarray  # hash


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values, put together from runs of powers of two."""
    power, factor, run = 1, np.array([_ODD]), values
    found, done = None, 0
    while True:
        if width & power:
            found = run if found is None else (
                found[:len(values) - done - power + 1] * factor
                + run[done:done + len(values) - done - power + 1])
            done += power
        if done == width:
            return found
        run = run[:-power] * factor + run[power:]
        power, factor = 2 * power, factor * factor


class Powers:
    """Powers of an odd number and of its inverse, of 64 bits."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            inverse = pow(int(_ODD), -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(
                count, factor, np.uint64)), dtype=np.uint64) for factor in (int(_ODD), inverse))
        return self.up[:count], self.down[:count]


class Words(NamedTuple):
    """The words of some texts, one after the other."""

    sizes: np.ndarray  # words of each text
    hashes: np.ndarray
    starts: np.ndarray  # code points in the text
    ends: np.ndarray


def words_of(texts: pa.Array, powers: Powers) -> Words:
    """Words between the bytes 32 and 9 to 13 (see ``minhash.split_words``), without a Python
    object per word: a word's hash is a difference of running sums over its bytes."""
    texts = texts.cast(pa.large_string())
    _, limits, data = texts.buffers()
    limits = np.frombuffer(limits, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = (np.frombuffer(data, np.uint8)[limits[0]:limits[-1]] if limits[-1] > limits[0]
            else np.empty(0, np.uint8))
    limits = limits - limits[0]
    letter = (data != 32) & ((data < 9) | (data > 13))
    inner = limits[(limits > 0) & (limits < len(data))]
    before, behind = np.append(False, letter)[:-1], np.append(letter, False)[1:]
    before[inner], behind[inner - 1] = False, False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~behind) + 1
    up, down = powers.upto(len(data) + 1)
    sums = np.append(np.uint64(0), np.cumsum(_BYTES[data] * up[:len(data)], dtype=np.uint64))
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    border = np.searchsorted(starts, limits)
    sizes = np.diff(border)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    first = np.repeat(points[limits[:-1]], sizes)
    return Words(sizes, hashes, points[starts] - first, points[ends] - first)


def text_blocks(words: Words, least: int) -> Blocks:
    """All windows of ``least`` words of some texts, in blocks of the same key and place."""
    sizes = words.sizes
    own = np.append(words.hashes, np.zeros(least, np.uint64))  # as if a window followed
    width = max(least // 4, 1)
    count = len(own) - least + 1
    total, window = rolled(own, width), rolled(own, least)
    keys = mixed(total)
    # The smallest key of each window, the leftmost of equal ones: key and index in one number.
    lowest = (keys & ~_INDEX) | np.arange(len(keys), dtype=np.uint64)
    reach, wanted = 1, least - width + 1
    while reach < wanted:
        step = min(reach, wanted - reach)
        lowest = np.minimum(lowest[:-step], lowest[step:])
        reach += step
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0)
    text = np.searchsorted(ends, at, side="right")
    inside = at + least <= ends[text]  # windows over the border of two texts are none
    at, text = at[inside], text[inside]
    chosen = (lowest[at] & _INDEX).astype(np.int64)
    window = mixed(window[at] ^ np.uint64(least))
    new = np.ones(len(at), bool)  # the place of the key never moves back within a text
    new[1:] = (text[1:] != text[:-1]) | (chosen[1:] != chosen[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    offset = (np.arange(len(at)) - np.repeat(begin, size)).astype(np.uint64)
    block = np.add.reduceat(mixed(window + offset * _ODD), begin) if len(at) else window
    return Blocks(text, at - (ends - sizes)[text], window, begin, size, keys[chosen[begin]],
                  mixed(block ^ size.astype(np.uint64)))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def shared_blocks(docs: DataFrame, least: int) -> DataFrame:
    """``(doc_id, text_hash, blocks)`` of texts with blocks whose key occurs elsewhere: four
    times the first word of each, plus ``PLAIN``, ``VARIED`` or ``SAMPLE``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                made = text_blocks(words_of(part.column("text"), powers), least)
                of = pa.array(made.text[made.begin])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(of), part.column("text_hash").take(of),
                    pa.array(made.word[made.begin]), signed(made.key), signed(made.block)],
                    ["doc_id", "text_hash", "word", "key", "block"])

    text = text_or_empty()
    made = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
        found, f"doc_id {kind}, text_hash long, word long, key long, block long")
    # Most keys occur once. All blocks are therefore shuffled only once.
    same = W.partitionBy("key").orderBy("block")
    whole = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = ~F.lag("block").over(same).eqNullSafe(F.col("block"))
    return made.select(
        "doc_id", "text_hash", "word", F.count("*").over(whole).alias("n"),
        F.when(F.first("block").over(whole) == F.last("block").over(whole), PLAIN)
        .when(first, SAMPLE).otherwise(VARIED).alias("is")).where(F.col("n") > 1).groupBy(
        "doc_id", "text_hash").agg(F.collect_list(F.col("word") * 4 + F.col("is")).alias("blocks"))


def placed_blocks(docs: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """``(doc_id, text_hash, word, size, key, block, varied, starts, ends, windows)`` of shared
    blocks. Code points are those of all windows if the block is varied, else of the whole;
    only samples have the hashes of their windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").alias("_id"), text.alias("text"),
                       F.xxhash64(text).alias("_hash"))
    # Both sides grow with the corpus: the join is by shuffle at every size.
    joined = rows.join(shared.hint("merge"), (F.col("_hash") == F.col("text_hash"))
                       & F.col("_id").eqNullSafe(F.col("doc_id")))

    def lists(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
        """``count`` values from ``first`` on, of each."""
        ends = np.cumsum(count)
        at = np.repeat(first - (ends - count), count) + np.arange(count.sum())
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                        pa.array(values[at]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                words = words_of(part.column("text"), powers)
                made = text_blocks(words, least)
                # Equal rows of one document name a block several times: the largest counts.
                named = np.sort(np.concatenate([
                    (no << 40) + np.asarray(of, np.int64)
                    for no, of in enumerate(part.column("blocks").to_pylist())]))
                own = (made.text[made.begin] << 38) + made.word[made.begin]
                place = np.searchsorted(named >> 2, own, side="right") - 1
                chosen = np.flatnonzero((place >= 0) & ((named >> 2)[place] == own))
                state = named[place[chosen]] & 3
                word = (np.cumsum(words.sizes) - words.sizes)[made.text] + made.word
                starts, ends = words.starts.astype(np.int32), words.ends.astype(np.int32)
                begin, size = made.begin[chosen], made.size[chosen]
                count = np.where(state == PLAIN, 1, size)
                of = pa.array(made.text[begin])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(of), part.column("text_hash").take(of),
                    pa.array(made.word[begin]), pa.array(size), signed(made.key[chosen]),
                    signed(made.block[chosen]), pa.array(state != PLAIN),
                    lists(starts[word], begin, count),
                    lists(ends[word + least - 1], begin + size - count, count),
                    lists(made.window.view(np.int64), begin, np.where(state == SAMPLE, size, 0))],
                    names)

    schema = (f"doc_id {kind}, text_hash long, word long, size long, key long, block long, "
              "varied boolean, starts array<int>, ends array<int>, windows array<long>")
    names = [part.split(" ")[0] for part in schema.split(", ")]
    return joined.select("doc_id", "text_hash", "text", "blocks").mapInArrow(found, schema)


def block_classes(blocks: DataFrame) -> DataFrame:
    """``(key, block, low, high, n, first)``: runs of windows of distinct blocks that occur ``n``
    times at most and whose first places follow each other in one text, from ``first`` on."""
    place = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash", "word")
    distinct = materialize(blocks.groupBy("key", "block").agg(
        F.count("*").alias("n"), F.min(place).alias("first"), F.max("size").alias("size"),
        F.max("varied").alias("varied")), "distinct")
    plain = distinct.where(~F.col("varied")).select(
        "key", "block", F.lit(0).cast("long").alias("low"),
        (F.col("size") - 1).alias("high"), "n", "first")
    samples = blocks.where(F.size("windows") > 0).select(
        F.col("key").alias("_key"), F.col("block").alias("_block"), "windows").dropDuplicates(
        ["_key", "_block"])
    # A key has a row per different block, however often these occur.
    windows = distinct.where("varied").join(
        samples.hint("merge"), (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block"))
    ).select("key", "block", "n", "first", F.posexplode("windows").alias("at", "window"))
    same = W.partitionBy("key", "window")
    own = F.col("first").withField("word", F.col("first.word") + F.col("at"))
    several = windows.select("key", "block", "at", F.sum("n").over(same).alias("n"),
                             F.min(own).over(same).alias("first")).where(F.col("n") > 1)
    of_block = W.partitionBy("key", "block").orderBy("at")
    before = F.lag(F.struct("at", "first")).over(of_block)
    follows = (F.col("at") == before["at"] + 1) & F.col("first").eqNullSafe(
        before["first"].withField("word", before["first"]["word"] + 1))
    runs = several.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(
        of_block.rowsBetween(W.unboundedPreceding, 0))).groupBy("key", "block", "run").agg(
        F.min("at").cast("long").alias("low"), F.max("at").cast("long").alias("high"),
        F.max("n").alias("n"), F.min("first").alias("first")).drop("run")
    return plain.unionByName(runs)


def shared_passages(docs: DataFrame, least: int) -> DataFrame:
    """One row per passage of at least ``least`` words that all lie in windows found at several
    places: ``(doc_id, text_hash, start, end, n_words, cluster_doc_id, cluster_word, n_members,
    removed)``.

    The cluster is the document that holds the first places of these windows, and the word at
    which the first of them begins there. ``n_members`` is the largest number of places of
    one of the windows. Passages of one document overlap where their windows do.
    """
    blocks = materialize(placed_blocks(docs, shared_blocks(docs, least), least), "blocks")
    classes = block_classes(blocks).select(
        F.col("key").alias("_key"), F.col("block").alias("_block"), "low", "high", "n", "first")
    low = F.col("word") + F.col("low")
    stays = F.col("first").eqNullSafe(F.struct(
        F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash", low.alias("word")))
    found = blocks.join(classes.hint("merge"), (F.col("key") == F.col("_key"))
                        & (F.col("block") == F.col("_block"))).select(
        "doc_id", "text_hash", low.alias("low"), (F.col("word") + F.col("high")).alias("high"),
        F.get("starts", F.when(F.col("varied"), F.col("low")).otherwise(0)).alias("start"),
        F.get("ends", F.when(F.col("varied"), F.col("high")).otherwise(0)).alias("end"),
        "n", "first", F.struct("first.doc_id", "first.text_hash", (~stays).alias("removed"))
        .alias("of")).repartition("doc_id", "text_hash")
    of_text = W.partitionBy("doc_id", "text_hash").orderBy("low")  # one document
    before = F.lag(F.struct("high", "of")).over(of_text)
    follows = ((F.col("low") <= before["high"] + 1) & F.col("of").eqNullSafe(before["of"]))
    # Equal rows of one document: all but one lose their passages.
    passages = (found.withColumn("follows", F.coalesce(follows, F.lit(False)))
                .withColumn("passage", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(
                    of_text.rowsBetween(W.unboundedPreceding, 0)))
                .withColumn("rows", F.count("*").over(
                    W.partitionBy("doc_id", "text_hash", "low")))
                .groupBy("doc_id", "text_hash", "passage").agg(
                    F.min("start").cast("long").alias("start"),
                    F.max("end").cast("long").alias("end"),
                    (F.max("high") - F.min("low") + least).alias("n_words"),
                    F.max(F.when(~F.col("follows"), F.col("first"))).alias("first"),
                    F.max("n").alias("n_members"), F.max("rows").alias("rows"),
                    F.max("of.removed").alias("removed")))
    return passages.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", "text_hash", "start", "end", "n_words",
        F.col("first.doc_id").alias("cluster_doc_id"), F.col("first.word").alias("cluster_word"),
        "n_members", ((F.col("row") > 1) | F.col("removed")).alias("removed"))
