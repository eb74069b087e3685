"""Links between texts whose sets of word n-grams are similar, by MinHash bands.

1. Every text (a document, or each line of it) becomes a set of hashed five-word shingles and
   from it the keys of its bands; the same pass makes a 128-bit digest of its words.
2. Equal texts become one node with a number of copies, before anything is compared.
3. Nodes are counted by band key. Keys of a single node and keys with the same nodes as
   another key go away.
4. Every node is compared with the first and the last node of each of its keys, once per pair;
   shingle sets move once per pair. Node numbers order all keys alike, so a group of near
   copies has few such leaders. The links found make first components.
5. In a key whose nodes are in one component nothing is left to find. In the others the nodes
   outside the largest component (the rest) are compared with all nodes of other components,
   in units of two blocks of ``BLOCK`` nodes, by sparse products. A unit returns which
   components it joins, not its links.
6. All links make the final components. A link never leaves its component, so numbers of links
   come from comparing a component with itself, once, whatever the number of shared keys.

Only texts that share a key with another node are read again for their shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from waymark.llm.common import text_or_empty
from waymark.storage import materialize

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999  # of a pair at exactly SIMILARITY
BLOCK = 256
CACHED_WORDS = 300_000
SEED = 7
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BLANK = str.maketrans(dict.fromkeys("\x1c\x1d\x1e\x1f\x85\xa0", ""))
_REST = ["key", "low", "high", "chunk", "rest", "node", "root", "shingles"]
_WHOLE = ["key", "low", "high", "block", "node", "copies", "shingles"]


def plan_bands(similarity: float, recall: float, rows: int) -> int:
    """How many bands of ``rows`` rows find a pair of this similarity with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def split_words(text: str) -> list[str]:
    """Words between the characters U+0020 and U+0009 to U+000D; only those separate."""
    words = text.split()
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return words
    found = text
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    return [w for w in found.split(" ") if w]


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8"))
        return found


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed shuffle of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: list[str], hashes: WordHashes) -> np.ndarray:
    """Hashes of all windows of ``WORDS`` words; a shorter text is one window."""
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    total = np.full(max(len(words) - width + 1, 0) if width else 0, np.uint64(width))
    for k in range(width):
        total = total * _ODD + own[k:k + len(total)]
    return mixed(total)


class BandKeys:
    """Band keys of many texts at once, given all their shingles one after the other."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        high = np.iinfo(np.uint64).max
        self.factors = rng.integers(0, high, bands * rows, np.uint64) | np.uint64(1)
        self.shifts = rng.integers(0, high, bands * rows, np.uint64)

    def __call__(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of keys per text; every text has a shingle."""
        keys = np.empty((len(starts), self.bands), np.uint64)
        value = np.empty_like(shingles)
        for band in range(self.bands):
            key = np.full(len(starts), np.uint64(band + 1))
            for k in range(band * self.rows, (band + 1) * self.rows):
                np.multiply(shingles, self.factors[k], out=value)
                np.add(value, self.shifts[k], out=value)
                key = key * _ODD + mixed(np.minimum.reduceat(value, starts))
            keys[:, band] = mixed(key)
        return keys.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, by_line: bool, least: int = 1
               ) -> DataFrame:
    """``(doc_id, text_hash, no, start, end, n_words, digest, bands)`` per text or line.

    ``no`` counts lines from 0; lines of fewer than ``least`` words are left out. A text without
    words has no bands: it is similar to its copies only. With 0 ``bands`` only digests are made.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, text_hash long, no int, start long, end long, n_words long, "
              "digest binary, bands array<long>")
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, band_keys = WordHashes(), BandKeys(bands, rows)
        for batch in batches:
            for at in range(0, len(batch), 100):  # shingles of a few texts at a time
                part = batch.iloc[at:at + 100]
                yield signed(part, hashes, band_keys)

    def signed(part: pd.DataFrame, hashes: WordHashes, band_keys: BandKeys) -> pd.DataFrame:
        found, sets, places = [], [], []
        for doc_id, text, text_hash in zip(part.iloc[:, 0], part["text"], part["text_hash"]):
            begin = 0
            for no, piece in enumerate(text.split("\n") if by_line else [text]):
                words = split_words(piece)
                end = begin + len(piece)
                if len(words) >= least or not by_line:
                    if words and bands:
                        places.append(len(found))
                        sets.append(shingle_hashes(words, hashes))
                    digest = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8"))
                    found.append((doc_id, text_hash, no, begin, end, len(words), digest, []))
                begin = end + 1
        made = pd.DataFrame(found, columns=names)
        if sets:
            starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
            column = made["bands"].to_numpy(copy=True)
            for place, keys in zip(places, band_keys(np.concatenate(sets), starts)):
                column[place] = keys
            made["bands"] = column
        return made.astype({"doc_id": part.dtypes.iloc[0]})

    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")
                       ).mapInPandas(sign, schema)


def nodes_of(signed: DataFrame) -> DataFrame:
    """One row per distinct text: ``node``, ``digest``, ``copies``, where it is first found
    (``at``) and its bands. Copies are combined before the shuffle."""
    place = F.struct("doc_id", "no", "text_hash")
    known = F.struct(F.col("doc_id").isNull().alias("lost"), place.alias("place"))
    grouped = signed.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(known)["place"].alias("at"),
        F.first("bands").alias("bands"))
    return grouped.withColumn("node", F.monotonically_increasing_id())


def shared_keys(nodes: DataFrame) -> DataFrame:
    """``(key, first, last, node)`` for keys of several nodes; of keys with the same nodes one.

    Most keys belong to one node. All pairs of key and node are therefore shuffled only once,
    as two numbers; what is left is written before keys are compared.
    """
    same = W.partitionBy("key")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    several = materialize(keyed.select(
        "key", "node", F.count("*").over(same).alias("n"), F.min("node").over(same).alias("first"),
        F.max("node").over(same).alias("last"),
        F.bit_xor(F.xxhash64("node")).over(same).alias("members")).where(F.col("n") > 1),
        "key-nodes")
    kept = several.groupBy("n", "first", "last", "members").agg(
        F.min("key").alias("kept")).select("kept")
    return several.join(kept.hint("merge"), F.col("key") == F.col("kept")).select(
        "key", "first", "last", "node")


def shingle_sets(docs: DataFrame, wanted: DataFrame, by_line: bool) -> DataFrame:
    """``(node, shingles)`` of wanted ``(node, at)``."""
    pointers = wanted.groupBy("at.doc_id", "at.text_hash").agg(
        F.collect_list(F.struct("at.no", "node")).alias("lines"))  # lines of one document
    text = text_or_empty()
    texts = docs.select(F.col("doc_id").alias("_id"), text.alias("text"),
                        F.xxhash64(text).alias("_hash"))
    # Both sides grow with the corpus: the join is by shuffle at every size.
    found = texts.join(pointers.hint("merge"), (F.col("_hash") == F.col("text_hash"))
                       & F.col("_id").eqNullSafe(F.col("doc_id")))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = []
                part = batch.iloc[at:at + 200]
                for text, lines in zip(part["text"], part["lines"]):
                    pieces = text.split("\n") if by_line else [text]
                    for line in lines:
                        made = np.unique(shingle_hashes(
                            split_words(pieces[line["no"]]), hashes))
                        rows.append((line["node"], made.view(np.int64)))
                yield pd.DataFrame(rows, columns=["node", "shingles"])

    made = found.select("text", "lines").mapInPandas(sets, "node long, shingles array<long>")
    return made.dropDuplicates(["node"])  # repeated rows of the same document


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of the incidence matrix of shared elements."""
    count = len(sets)
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(count), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    number = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]])) if len(values) else owner
    shared = np.bincount(number, minlength=1)[number] > 1 if len(values) else number > 0
    owner = owner[shared]
    _, number = np.unique(number[shared], return_inverse=True)
    result = np.zeros((count, count), np.float32)
    width = 4096
    limits = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else 0) + 1, width))
    for low, high in zip(limits, [*limits[1:], len(number)]):
        if high > low:
            part = np.zeros((count, width), np.float32)
            part[owner[low:high], number[low:high] % width] = 1
            result += part @ part.T
    return result


def linked_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets are similar to which, as a matrix."""
    common = overlaps(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = common + 1e-6 >= similarity * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    return linked


def least_reached(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` numbers the least one that edges ``left`` to ``right`` reach."""
    least = np.arange(count)
    while True:
        before = least.copy()
        low = np.minimum(least[left], least[right])
        np.minimum.at(least, left, low)
        np.minimum.at(least, right, low)
        least = least[least]
        if (least == before).all():
            return least


def compare_rest(unit: pd.DataFrame, similarity: float) -> pd.DataFrame | None:
    """Components that the links between a rest block and a chunk join: ``(node, root)`` for
    each but the least of those joined, so a unit makes fewer rows than it has nodes."""
    names, roots = np.unique(unit["root"].to_numpy(), return_inverse=True)
    rest = unit["rest"].to_numpy() == unit["low"].iloc[0]
    chunk = unit["chunk"].to_numpy() == unit["high"].iloc[0]
    linked = linked_pairs(list(unit["shingles"]), similarity)
    linked &= rest[:, None] & chunk[None, :] & (roots[:, None] != roots[None, :])
    if not linked.any():
        return None
    left, right = np.nonzero(linked)
    least = least_reached(roots[left], roots[right], len(names))
    joined = np.flatnonzero(least != np.arange(len(names)))
    return pd.DataFrame({"node": names[joined], "root": names[least[joined]]})


def count_unit(unit: pd.DataFrame, similarity: float) -> pd.DataFrame | None:
    """Links ``(node, links, linked_copies)`` inside one block or between two."""
    linked = linked_pairs(list(unit["shingles"]), similarity)
    if unit["low"].iloc[0] != unit["high"].iloc[0]:  # pairs inside a block have their own unit
        block = unit["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    return pd.DataFrame({"node": unit["node"], "links": linked.sum(axis=1),
                         "linked_copies": linked @ unit["copies"].to_numpy()})


def by_unit(rows: DataFrame, compare, similarity: float, schema: str) -> DataFrame:
    """``compare`` applied to the rows of each (key, low, high); a task holds one unit."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            names = rows[["key", "low", "high"]].to_numpy()
            starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1)]
            found = [compare(rows.iloc[a:b], similarity) for a, b in zip(starts, starts[1:])]
            held = rows.iloc[starts[-1]:] if len(rows) else None
            found = [f for f in found if f is not None]
            if found:
                yield pd.concat(found)
        if held is not None:
            last = compare(held, similarity)
            if last is not None:
                yield last

    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInPandas(run, schema)


def leader_links(shared: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(node, root)`` between nodes and the first and last nodes of their keys."""
    leader = F.explode(F.array("first", "last")).alias("leader")
    pairs = (shared.select("first", "last", "node", leader)
             # a pair of both ends is compared from the first one only
             .where((F.col("leader") != F.col("node"))
                    & ((F.col("node") != F.col("first")) | (F.col("leader") != F.col("last"))))
             .select("leader", "node").distinct())
    pairs = materialize(pairs, "leaders")
    # A leader of many nodes is dealt to one part per BLOCK nodes.
    parts = pairs.groupBy(F.col("leader").alias("_leader")).agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    salted = pairs.join(parts.hint("merge"), F.col("leader") == F.col("_leader")).select(
        "leader", "node", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    own = sets.select(F.col("node").alias("_node"), F.col("shingles").alias("own"))
    theirs = parts.join(sets.hint("merge"), F.col("_leader") == F.col("node")).select(
        "_leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"),
        F.col("shingles").alias("theirs"))
    common = F.size(F.array_intersect("own", "theirs"))
    union = F.size("own") + F.size("theirs") - common
    return (salted.join(own.hint("merge"), F.col("node") == F.col("_node"))
            .join(theirs.hint("merge"), (F.col("leader") == F.col("_leader"))
                  & (F.col("part") == F.col("_part")))
            .where(common + 1e-6 >= similarity * union)
            .select("node", F.col("leader").alias("root")))


def rest_links(shared: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float
               ) -> DataFrame:
    """Joins ``(node, root)`` of different components ``roots`` that share a key."""
    labelled = materialize(shared.join(
        roots.select(F.col("node").alias("_in"), "root").hint("merge"),
        F.col("node") == F.col("_in"), "left").select(
        "key", "node", F.coalesce("root", "node").alias("root")), "labels")
    each = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed_keys = each.groupBy(F.col("key").alias("_key")).agg(
        F.count("*").alias("roots"), F.sum("n").alias("n"),
        F.max(F.struct("n", "root")).alias("top")).where(F.col("roots") > 1).select(
        "_key", F.col("top.root").alias("top"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("rests"))
    is_rest = F.col("root") != F.col("top")
    placed = labelled.join(mixed_keys.hint("merge"), F.col("key") == F.col("_key")).select(
        "key", "node", "root", "chunks", "rests",
        F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"),
        F.when(is_rest, F.pmod(F.xxhash64(F.lit(1), "node"), "rests").cast("int")).otherwise(-1)
        .alias("rest"))
    as_chunk = F.transform(F.sequence(F.lit(0), F.col("rests") - 1),
                           lambda i: F.struct(i.alias("low"), F.col("chunk").alias("high")))
    as_rest = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                          lambda j: F.struct(F.col("rest").alias("low"), j.alias("high")))
    units = placed.withColumn("unit", F.explode(F.when(
        F.col("rest") < 0, as_chunk).otherwise(F.array_union(as_chunk, as_rest))))
    rows = units.select("key", "unit.low", "unit.high", "chunk", "rest", "node", "root").join(
        sets.hint("merge"), "node").select(*_REST)
    return by_unit(rows, compare_rest, similarity, "node long, root long")


def link_groups(docs: DataFrame, nodes: DataFrame, by_line: bool, similarity: float
                ) -> tuple[DataFrame, DataFrame]:
    """Components ``(node, root)`` of the similar nodes (see :func:`components`), and the
    shingle sets ``(node, shingles)`` of all nodes that share a key."""
    shared = materialize(shared_keys(nodes), "shared-keys")
    wanted = shared.select(F.col("node").alias("_wanted")).distinct()
    at = nodes.join(wanted.hint("merge"), F.col("node") == F.col("_wanted")).select("node", "at")
    sets = materialize(shingle_sets(docs, at, by_line), "shingles")
    edges = materialize(leader_links(shared, sets, similarity), "links")
    more = materialize(rest_links(shared, components(edges), sets, similarity), "links")
    return components(edges.union(more)), sets


def link_counts(nodes: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float
                ) -> DataFrame:
    """``(node, links, linked_copies)`` for the nodes of components of several nodes."""
    members = roots.union(roots.select("root", "root").distinct())
    sizes = members.groupBy(F.col("root").alias("_root")).agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = members.join(sizes, F.col("root") == F.col("_root")).select(
        F.col("root").alias("key"), "node", own.alias("block"), other.alias("other")).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "node")
    rows = (units.join(nodes.select("node", "copies").hint("merge"), "node")
            .join(sets.hint("merge"), "node").select(*_WHOLE))
    counted = by_unit(rows, count_unit, similarity, "node long, links long, linked_copies long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"),
                                       F.sum("linked_copies").alias("linked_copies"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for edges ``(node, root)``: the smallest node that can be reached.

    Alternates two steps until nothing changes: larger neighbours of a node move to its
    smallest neighbour, then smaller ones do. Both are a minimum per node, combined before
    the shuffle, and a join.
    """
    current = edges.where(F.col("node") != F.col("root")).select(
        F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root"))
    current = materialize(current.distinct(), "edges")
    state = None
    while True:
        both = current.union(current.select(F.col("root"), F.col("node")))
        least = both.groupBy(F.col("node").alias("_node")).agg(
            F.least(F.min("root"), F.first("node")).alias("least"))
        larger = (both.where(F.col("root") > F.col("node"))
                  .join(least, F.col("node") == F.col("_node"))
                  .select(F.col("root").alias("node"), F.col("least").alias("root")))
        larger = materialize(larger.distinct(), "larger")
        lowest = larger.groupBy(F.col("node").alias("_node")).agg(F.min("root").alias("least"))
        moved = larger.join(lowest, F.col("node") == F.col("_node")).select(
            F.col("root").alias("node"), F.col("least").alias("root"))
        smaller = moved.where(F.col("node") != F.col("root")).union(
            lowest.select(F.col("_node"), F.col("least")))
        current = materialize(smaller.distinct(), "edges")
        before, state = state, current.agg(
            F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()
        if state == before:
            return current
