"""Token counts and packing against the tokenizer itself."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from waymark.llm.packing import WordIds, pack_documents, plan_slots
from waymark.llm.token_counts import WordCounter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = WordCounter(PATH)
IDS = WordIds(PATH)
TEXTS = [
    "", "The cat's hat, isn't it?", "Straße ΣΟΦΟΣ İstanbul é é", "a\x1cb\x1f c\x85d\xa0e",
    "x <|endoftext|> y<|startoftext|>z <|ENDOFTEXT|>", "123 4567 $$$ ### ｆｕｌｌ　ｗｉｄｅ",
    "日本語のテキスト 🎉🎉 ​ zero em", "'''s 's'll ''", "word " * 5000, "\n\n\t ",
]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_count_equals_library(text):
    assert COUNTER.count(text) == len(ids_of(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    expected = ids_of(text)
    assert COUNTER.count(text) == len(expected)
    assert [list(ids) for ids in IDS.encode(pa.array(["a b", text, text]))] == [
        ids_of("a b"), expected, expected]


def test_counts_of_a_table(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, None, None), (0, TEXTS[1], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    found = sorted(map(tuple, token_counts(docs).collect()), key=repr)
    expected = sorted(((i, x, len((t or "").encode()), len(ids_of(t or "")),
                        len(ids_of(t or "")) > 2048) for i, t, x in rows), key=repr)
    assert found == expected
    assert token_counts(docs.limit(0)).collect() == []


def check_packing(rows, texts, capacity):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for key, copies in texts.items():
        expected = []
        for text in copies:
            ids = [*ids_of(text or ""), 1]
            for n, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start:start + capacity]
                expected.append((n, start, len(part),
                                 zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
        assert sorted(pieces[key]) == sorted(expected)
    return len(sequences)


def test_packing(spark):
    texts = defaultdict(list)
    rows = [(i, "word " * (i * 7 % 90), "x") for i in range(150)]
    rows += [(500, "same text", "x")] * 60 + [(None, None, None), (7, "", None)]
    for key, text, _ in rows:
        texts[key].append(text)
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    packed = pack_documents(docs, capacity=64)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                              "offset"]
    found = packed.collect()
    used = check_packing(found, texts, 64)
    tokens = sum(r["length"] for r in found)
    assert used <= -(-tokens // 64) * 1.1
    assert pack_documents(docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_equals_plain_best_fit(counts):
    """The plan on counts fills the same rooms as best fit decreasing, item by item."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - length)
            else:
                rooms.append(40 - length)
    used, ranks = defaultdict(int), defaultdict(set)
    for length, low, high, first, offset in plan_slots(counts, 40):
        for rank in range(low, high + 1):
            assert rank not in ranks[length]
            ranks[length].add(rank)
            used[first + rank - low] += length
    assert {k: len(v) for k, v in ranks.items()} == counts
    assert sorted(40 - u for u in used.values()) == sorted(rooms)


def test_characters_newer_than_pythons_tables():
    """Every character of the first planes in four places, and marks in any order."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [f"a{chr(i)}b {chr(i)}x {chr(i)}{chr(i)} Q{chr(i)}" for i in range(1, 0x20000)
             if not 0xD800 <= i < 0xE000 and (i < 0x3400 or 0xA000 <= i < 0xAC00 or i > 0xFA00)]
    texts += ["e̸࢘ z", "e࣑ᷴ z", "ᲉꟌꟜ"]
    wanted = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(ids) for ids in WordIds(path).encode(pa.array(texts))] == wanted
    counter = WordCounter(path)
    assert list(map(counter.count, texts)) == list(map(len, wanted))
