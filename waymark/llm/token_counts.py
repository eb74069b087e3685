"""Token counts by heap-and-linked-list pair merging, without making ids.

A word starts as its UTF-8 bytes, the last one marked as the end of the word. The adjacent
pair of lowest rank is popped from a heap and merged until no pair of the merge list is
left. The count is the number of bytes minus the number of merges.

Words are counted once per task: a text is the sum over its words, looked up in a bounded
table. Nothing is shuffled.

Defined results: a null or empty text has no tokens; columns beside the text do not matter;
repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from waymark.llm.common import free_names, text_or_empty

VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 400_000  # entries of a task's table; it starts again when full
LIMIT = 2048

# White space as the tokenizer's patterns understand it.
_BLANK = "".join(map(chr, (
    9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000)))
# Blanks beyond ASCII, and control characters that other splitters take for blanks.
ODD_BLANK = ("[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}"
             "\\x{205f}\\x{3000}]")
# Fixed value: the pattern that cuts text into words before merging.
_WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_BLANK}\p{{L}}\p{{N}}]+")
_CHUNK = regex.compile(rf"[^{_BLANK}]+")
_NORMAL = Sequence([NFC(), Lowercase()])  # by the tables of the tokenizer, not Python's
_KINDS = Split(Regex(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
# str.split also cuts at these, which are ordinary characters here.
_EXTRA_BLANK = regex.compile("[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    """The parts of ``text`` between white space."""
    return _CHUNK.findall(text) if _EXTRA_BLANK.search(text) else text.split()


@functools.lru_cache(maxsize=10_000)
def stand_in(char: str) -> str:
    """A letter, digit or symbol for a character that is newer than Python's tables, by the
    tables of the tokenizer."""
    def pieces(text: str) -> int:
        return len(_KINDS.pre_tokenize_str(text))

    if pieces("a" + char) == 1:
        return "a"
    return "0" if pieces(char + char) == 2 else "\ue000"


def split_words(chunk: str) -> list[str]:
    """The lower-case words of a chunk, as the tokenizer cuts them before merging."""
    if chunk.isascii():
        lower = chunk.lower()
        if lower.isalpha():
            return [lower]
        if lower[-1] in ".," and lower[:-1].isalpha():
            return [lower[:-1], lower[-1]]
        return _WORD.findall(lower)
    lower = _NORMAL.normalize_str(chunk)
    if lower.isalpha():
        return [lower]
    known = "".join(stand_in(c) if unicodedata.category(c) == "Cn" else c for c in lower)
    return [lower[m.start():m.end()] for m in _WORD.finditer(known)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the lowest-rank-first rule makes on ``symbols``."""
    size = len(symbols)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    heap = []
    for i in range(size - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    parts: list[str | None] = list(symbols)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= size or parts[j] != right:
            continue
        merges += 1
        parts[i] = left + right
        parts[j] = None
        after[i] = after[j]
        if after[i] < size:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < size:
                rank = ranks.get((parts[a], parts[b]))
                if rank is not None:
                    heapq.heappush(heap, (rank, a, parts[a], parts[b]))
    return merges


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordCounter(dict):
    """Tokens of a white-space free chunk of text; chunks are counted when first asked."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        merges = model["model"]["merges"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        self.ranks = {(left, right): rank for rank, (left, right) in enumerate(pairs)}
        self.suffix = model["model"].get("end_of_word_suffix") or ""
        self.bytes = byte_symbols()
        self.special = [t["content"] for t in model["added_tokens"]]
        self.words: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            symbols = [self.bytes[b] for b in word.encode("utf-8")]
            symbols[-1] += self.suffix
            found = len(symbols) - merge_count(symbols, self.ranks)
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def __missing__(self, chunk: str) -> int:
        found = sum(map(self.count_word, split_words(chunk)))
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[chunk] = found
        return found

    def count(self, text: str) -> int:
        extra = 0
        if any(s in text for s in self.special):
            marks = regex.compile("|".join(map(regex.escape, self.special)))
            extra = len(marks.findall(text))
            return extra + sum(self.count(part) for part in marks.split(text))
        return sum(map(self.__getitem__, chunks(text)))


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of ``text`` under the vocabulary file at ``path``."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = WordCounter(path)
        for batch in batches:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, text_column: str = "text", limit: int = LIMIT,
                 path: str | None = None) -> DataFrame:
    """``docs`` without the text, with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    kept = [c for c in docs.columns if c != text_column]
    n_bytes, n_tokens, over = free_names(docs.select(*kept), "n_bytes", "n_tokens", "over_limit")
    text = text_or_empty(text_column)
    counted = docs.select(*kept, F.octet_length(text).cast("long").alias(n_bytes),
                          count_tokens(text, path).alias(n_tokens))
    return counted.withColumn(over, F.col(n_tokens) > limit)
