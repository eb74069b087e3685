"""Best-fit packing planned on a histogram of lengths.

1. Every document is tokenised and cut into pieces of at most ``capacity`` tokens; only
   lengths, places and checksums go on.
2. Pieces are counted by length: at most ``capacity`` rows, whatever the data size.
3. Best fit decreasing runs on these counts. It places many equal pieces at once, so its
   work follows the number of different fillings rather than the number of documents. The
   plan lists, for each length, ranges of ranks and the sequences and offsets they fill.
4. Pieces get their rank within their length, by a scan that splits hot lengths, and take
   the planned slot of that rank by a join on length and rank range.

Defined results: a null or empty text is one piece holding the end token; a repeated row is
packed each time; null ids are kept; an empty table gives an empty result. Rows of equal
length and id are interchangeable.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from waymark.llm.common import prefix_scan, text_or_empty
from waymark.llm.token_counts import ODD_BLANK, VOCABULARY, split_words
from waymark.storage import materialize

CAPACITY = 4096
END_ID = 1
BATCH_BYTES = 10 << 20  # of text encoded together
CACHED_WORDS = 500_000  # entries of each of a worker's two tables; they start again when full
PLAN = "length long, first_rank long, last_rank long, first_sequence long, offset long"


class WordIds(dict):
    """Ids of white-space free chunks as little-endian bytes, made by the tokenizer.

    A column of texts is split and its chunks are numbered by Arrow; only distinct chunks are
    looked up, and new words are encoded together, many in one call. A word ends with a token
    that carries the vocabulary's end mark. Words are normalised and cut before they are
    learnt, so the tokenizer only merges them.
    """

    def __init__(self, path: str):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Texts that Arrow would split otherwise, or that hold special tokens.
        self.odd = "|".join([ODD_BLANK, *map(re.escape, special)])
        vocabulary = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        split = pc.ascii_split_whitespace(plain)
        numbered = split.flatten().dictionary_encode()
        made = self._chunks(numbered.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(made), "<u4")
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        firsts = np.cumsum(sizes) - sizes
        codes = numbered.indices.to_numpy()
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        # Each token's place in the pool: its chunk's first place, then one by one.
        places = np.repeat(firsts[codes] - ends[:-1], lengths) + np.arange(ends[-1])
        ids = pool[places]
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        found = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(odd):
            found[i] = np.frombuffer(self._whole(texts[i].as_py()), "<u4")
        return found

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        for cache in (self, self.words):
            if len(cache) >= CACHED_WORDS:
                cache.clear()
                self[""] = b""
        parts = {chunk: split_words(chunk) for chunk in chunks if chunk not in self}
        self._learn(list({w for words in parts.values() for w in words} - self.words.keys()))
        for chunk, words in parts.items():
            self[chunk] = b"".join(map(self.words.__getitem__, words))
        return list(map(self.__getitem__, chunks))

    def _learn(self, words: list[str]) -> None:
        groups = [words[i:i + 500] for i in range(0, len(words), 500)]
        for group, encoded in zip(groups, self.merger.encode_batch_fast(
                [" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype="<u4")
            raw, cuts = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(group):  # a word the tokenizer cuts otherwise
                self.words.update((w, self._whole(w)) for w in group)
                continue
            begin = 0
            for word, end in zip(group, cuts.tolist()):
                self.words[word] = raw[begin:end]
                begin = end

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table per worker process, kept from task to task."""
    return WordIds(path)


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces ``(id, piece, start, length, ids_crc32)`` of all documents."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = (f"{id_column} {docs.schema[id_column].dataType.simpleString()}, piece int, "
              "start long, length long, ids_crc32 long")
    kind = to_arrow_type(docs.schema[id_column].dataType)
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            sizes = pc.cast(pc.binary_length(batch.column(1)), pa.int64()).to_numpy()
            at = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES, prepend=-1))
            for at, end_at in zip(at, [*at[1:], len(batch)]):
                part = batch.slice(at, end_at - at)
                columns: list[list] = [[], [], [], [], []]
                for key, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1))):
                    for piece, start in enumerate(range(0, len(ids) + 1, capacity)):
                        own = ids[start:start + capacity]
                        check = zlib.crc32(own)
                        length = len(own)
                        if length < capacity:  # the last piece, with room for the end
                            check, length = zlib.crc32(end, check), length + 1
                        for column, value in zip(columns, (key, piece, start, length, check)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    [id_column, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_column), text_or_empty(text_column).alias("text")).mapInArrow(
        cut, schema)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts.

    Returns ``(length, first_rank, last_rank, first_sequence, offset)``: pieces of these
    ranks fill one sequence each, from ``first_sequence`` on, at ``offset``.
    """
    slots = []
    runs: dict[int, list[tuple[int, int]]] = {}  # free room: runs (first sequence, count)
    rooms: list[int] = []  # the rooms that have runs, ascending
    sequences = 0

    def add(room: int, first: int, count: int) -> None:
        if room not in runs:
            runs[room] = []
            bisect.insort(rooms, room)
        runs[room].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            place = bisect.bisect_left(rooms, length)
            if place < len(rooms):
                room = rooms[place]
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(place)
            else:  # as many new sequences as these pieces need
                room, first = capacity, sequences
                count = -(-left // (capacity // length))
                sequences += count
            # The tightest room is filled up before the next one: each sequence of the run
            # takes as many pieces as fit, the last one what is left of them.
            fitting = room // length
            full = min(count, left // fitting)
            rest = min(left - full * fitting, fitting - 1) if full < count else 0
            for k in range(fitting if full else rest):
                taken = full + (k < rest)
                slots.append((length, rank, rank + taken - 1, first, capacity - room + k * length))
                rank += taken
            left -= full * fitting + rest
            if full and room > fitting * length:
                add(room - fitting * length, first, full)
            if rest:
                add(room - rest * length, first + full, 1)
            if count > full + bool(rest):
                add(room, first + full + bool(rest), count - full - bool(rest))
    return slots


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces with the sequence and offset they take."""
    pieces = materialize(token_pieces(docs, id_column, text_column, capacity, path), "pieces")
    return place_pieces(pieces, id_column, capacity)


def place_pieces(pieces: DataFrame, id_column: str, capacity: int) -> DataFrame:
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = pieces.sparkSession.createDataFrame(plan_slots(counts, capacity), PLAN)
    ranked = prefix_scan(pieces, ["length"], [id_column, "piece", "ids_crc32"], {}, "_rank",
                         "ranked-pieces")
    within = ((ranked["length"] == plan["length"])
              & ranked["_rank"].between(plan["first_rank"], plan["last_rank"]))
    return ranked.join(plan, within).select(
        id_column, "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first_sequence") + F.col("_rank") - F.col("first_rank")).alias("sequence_id"),
        F.col("offset"))
