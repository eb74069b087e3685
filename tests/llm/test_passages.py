"""Passages that repeat inside lines and across them, against all windows of all texts."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import passages, queries
from waymark.llm.minhash import split_words
from waymark.llm.paragraph_dedup import repeated_passages
from waymark.llm.passages import Powers, shared_passages, text_blocks, words_of

SCHEMA = "doc_id long, text string"
BIG = 2 ** 60 + 1  # not a double


def prose(pick, count):
    return [f"w{pick.randrange(3000)}" for _ in range(count)]


def rows_of(pick):
    """Texts with passages of 40 to 90 words at any place, cut into lines at random."""
    planted = [prose(pick, n) for n in (40, 49, 50, 51, 64, 90)]
    rows = []
    for doc_id in range(60):
        words = prose(pick, pick.randrange(0, 200))
        for _ in range(pick.randrange(3)):
            at = pick.randrange(len(words) + 1)
            words[at:at] = pick.choice(planted)
        text = "".join(w + pick.choice([" "] * 12 + ["\n", "\t ", " \r\n"]) for w in words)
        rows.append((BIG + doc_id, text))
    rows += [(200, "long " * 300), (201, " ".join(["a b c"] * 40)), (202, None), (203, ""),
             (None, rows[4][1]), (None, " ".join(planted[5] + prose(pick, 9))), (7, rows[9][1])]
    return rows + [rows[20], rows[20]]


def brute_force(rows, least):
    """Spans by chains of windows found at several places."""
    texts = []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    places = defaultdict(list)
    for at, i in enumerate(order):
        found = [m.span() for m in re.finditer("[^\x20\x09-\x0D]+", rows[i][1] or "")]
        words = [rows[i][1][a:b] for a, b in found]
        texts.append((rows[i], found))
        for k in range(len(words) - least + 1):
            places[tuple(words[k:k + least])].append((at, k))
    of = {place: (where[0], len(where)) for where in places.values() if len(where) > 1
          for place in where}
    expected = []
    for at, (row, found) in enumerate(texts):
        chain = None
        for k in range(len(found) - least + 2):
            first, n = of.get((at, k), (None, 0))
            # Equal rows of a document have one place.
            source = None if first is None else (texts[first[0]][0], first != (at, k))
            if chain and source != chain[0]:
                expected.append((row[0], found[chain[1]][0], found[k + least - 2][1],
                                 k - 1 + least - chain[1], chain[0][0][0], chain[2], chain[3],
                                 chain[0][1]))
                chain = None
            if source:
                chain = chain or [source, k, first[1], 0]
                chain[3] = max(chain[3], n)
    return expected


def comparable(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("least", [50, 9])
def test_all_passages_inside_lines_and_across_them(spark, monkeypatch, least):
    monkeypatch.setattr(passages, "CHUNK", 7)
    rows = rows_of(random.Random(3))
    # Texts of null ids are ordered by their hash: here they are told apart by their sources.
    found = shared_passages(spark.createDataFrame(rows, SCHEMA).repartition(5), least)
    got = [(r["doc_id"], r["start"], r["end"], r["n_words"], r["cluster_doc_id"],
            r["cluster_word"], r["n_members"], r["removed"]) for r in found.collect()]
    assert comparable(got) == comparable(brute_force(rows, least))


def blocks_of(texts):
    return text_blocks(words_of(pa.array(texts), Powers()), 50)


def test_words_are_those_of_all_texts():
    texts = ["", "a", "b c", " d\u00a0e\n\r f\x1fg", "\u00e9t\u00e9 \U0001f600x\t", "", "\x0b", "ba ab",
             "b c", "c", "", "x" * 5000 + " y"]
    powers = Powers()
    for column in (pa.array(["q q", *texts]).slice(1), pa.array(texts, pa.large_string())):
        made = words_of(column, powers)
        words = [split_words(t) for t in texts]
        assert made.sizes.tolist() == [len(w) for w in words]
        flat = [(t, w) for t, of in zip(texts, words) for w in of]
        assert [t[a:b] for (t, _), a, b in zip(flat, made.starts, made.ends)] == [w for _, w in flat]
        assert len(set(zip(made.hashes, (w for _, w in flat)))) == len(set(made.hashes)) == len(
            {w for _, w in flat})
    assert [len(column) for column in words_of(pa.array(["", ""]), powers)] == [2, 0, 0, 0]


def test_windows_and_blocks_are_those_of_each_text():
    pick = random.Random(5)
    words = [prose(pick, n) for n in (0, 3, 50, 49, 120, 51)] + [["x"] * 80]
    words.append(["y"] * 9 + words[4][10:110] + ["z"] * 9)
    made = blocks_of([" ".join(w) for w in words])
    places = [(t, k) for t, w in enumerate(words) for k in range(len(w) - 49)]
    assert list(zip(made.text, made.word)) == places
    assert len(np.unique(made.window)) == len({tuple(words[t][k:k + 50]) for t, k in places})
    keys, contents = {}, {}
    for begin, size, key, block in zip(made.begin, made.size, made.key, made.block):
        t, k = places[begin]
        contents.setdefault((key, block), set()).add(tuple(words[t][k:k + size + 49]))
        for at in range(size):
            keys.setdefault(tuple(words[t][k + at:k + at + 50]), set()).add(key)
    assert all(len(found) == 1 for found in [*keys.values(), *contents.values()])
    assert sum(made.size) == len(places) > 1.5 * len(made.begin)
    empty = blocks_of(["", "a"])
    assert not any(len(column) for column in empty)


def test_query_finds_planted_passages_and_leaves_clean_documents_alone(spark, tmp_path):
    pick = random.Random(8)
    planted, short = prose(pick, 60), " ".join(prose(pick, 9))
    near = prose(pick, 80)
    edited = [*near]
    edited[30] = "other"  # no equal run of 50 words
    rows = [(i, " ".join(prose(pick, 70) + planted + prose(pick, 70))) for i in range(3)]
    split = " ".join(planted[:20]) + "\n" + " ".join(planted[20:45]) + "\n" + " ".join(planted[45:])
    rows += [(10, " ".join(prose(pick, 30)) + "\n" + split),
             (11, " ".join(prose(pick, 30)) + "\n" + " ".join(near)),
             (12, " ".join(near[:30]) + " other " + " ".join(near[31:]))]
    rows += [(i, " ".join(prose(pick, 200)) + "\n" + short) for i in range(20, 30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_paragraph_dedup(spark, str(tmp_path)).collect()
    texts = dict(rows)
    spans = {(r["doc_id"], r["kind"], r["removed"]): texts[r["doc_id"]][r["start"]:r["end"]]
             for r in found}
    assert {k: " ".join(v.split()) for k, v in spans.items()} == {
        (0, "passage", False): " ".join(planted), (1, "passage", True): " ".join(planted),
        (2, "passage", True): " ".join(planted), (10, "passage", True): " ".join(planted),
        (11, "line", False): " ".join(near), (12, "line", True): " ".join(edited)}
    assert len(found) == 6


def test_equal_rows_keep_one_and_empty_tables_have_none(spark):
    text = " ".join(prose(random.Random(1), 60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], SCHEMA)
    found = repeated_passages(docs).collect()
    for kind in ("line", "passage"):
        assert sorted((r["doc_id"] is None, r["removed"]) for r in found if r["kind"] == kind
                      ) == [(False, False), (False, True), (True, True), (True, True)]
    assert repeated_passages(docs.limit(0)).collect() == []
