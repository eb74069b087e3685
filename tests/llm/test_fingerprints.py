"""Fingerprints: edited texts against plain Python, collision rate against exact similarity."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from waymark.llm.fingerprints import fingerprints, likeness, weighted_samples

SCHEMA = "doc_id long, text string, word string"


def weights(text):
    return Counter(re.findall("[^\x20\x09-\x0D]+", text)) or Counter({"": 1})


def similarity(a, b):
    x, y = weights(a), weights(b)
    return sum((x & y).values()) / sum((x | y).values())


def sample():
    pick = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i * 3, " ".join(pick.choice(vocabulary[:10 + i]) for _ in range(10 + 3 * i)), "x")
            for i in range(40)]
    rows += [(1000, "", "x"), (1001, None, None), (1002, " \n\t", "x"), (1003, "a", "x"),
             (1004, "é🎉ñ " * 5, "x"), (1005, "ab cd ef gh", "x"), (-5, "y " * 9000, "x"),
             (None, "lost text of no id at all", None), (9, "x" * 20000, "x")]
    return [r for r in rows if r[1] != "x" * 20000] + [(2000, "x" * 20000, None), rows[3]]


def test_fingerprints(spark):
    rows = sample()
    found = fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    order = sorted(texts, key=lambda i: (i is not None, i or 0))
    after = dict(zip(order, order[1:] + order[:1]))
    edited = {}
    for i, text in texts.items():
        cut = len(text) // 4
        edited[i] = text[:len(text) - cut] + texts[after[i]][:cut]
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found)
    assert got == Counter((r[0], len(r[1] or ""), hashlib.sha256(
        edited[r[0]].encode()).hexdigest()) for r in rows)
    prints = {}
    for r in found:
        own, other = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        for text, mark in ((own, r["fingerprint"]), (edited[r["doc_id"]],
                                                     r["edited_fingerprint"])):
            assert prints.setdefault(frozenset(weights(text).items()), mark) == mark
        assert abs(r["near_edited"] - similarity(own, edited[r["doc_id"]])) < 0.4
        assert abs(r["near_next"] - similarity(own, other)) < 0.4
    assert len(set(prints.values())) == len(prints)


def test_collision_rate_is_generalised_jaccard(spark):
    rows = [(w, a, b) for w, a, b in ((i, i % 4, (i * 7) % 5) for i in range(1, 60)) if a or b]
    exact = sum(min(a, b) for _, a, b in rows) / sum(max(a, b) for _, a, b in rows)
    words = spark.createDataFrame(rows, "word long, own int, edited int").select(
        F.lit(1).alias("key"), F.xxhash64("word").alias("word"), "own", "edited")
    made = weighted_samples(words, ["key"], ["own", "edited"], 2048)
    rate = made.select(likeness(F.col("own"), F.col("edited"), 2048)).first()[0]
    assert abs(rate - exact) < 0.04


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(4, "a b c d", "x")], SCHEMA)
    row = fingerprints(one).collect()[0]
    assert row["near_next"] == 1.0
    assert row["edited_sha256"] == hashlib.sha256(b"a b c a").hexdigest()
    assert fingerprints(one.limit(0)).collect() == []
