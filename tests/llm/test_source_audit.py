"""The source audit against plain Python, and its perfect hashes."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import source_audit
from waymark.llm.source_audit import audit_sources, buckets, perfect_hash, place, term_hashes

SCHEMA = "doc_id long, text string, lang string, source string, shard string"


def terms(text):
    found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in found]


def expected(rows, least):
    frequency, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        frequency[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    result = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in frequency[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        share = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o)
                     for o in sources if o != s]
            over = [(f(share[s][t], whole[t]), t) for t in kept
                    if counts[lang, s][t] and share[s][t] > whole[t]]
            for part, items, top in (("pair", pairs, len(pairs)), ("term", over, 10)):
                items.sort(key=lambda i: (-i[0], i[1].encode()))
                result += [(lang, s, part, item, value, rank)
                           for rank, (value, item) in enumerate(items[:top], 1)]
    return sorted(result)


def sample():
    pick = random.Random(3)
    words = [f"{a}{b}" for a in ("alpha", "Éta", "ζeta", "Beta", "x") for b in "abcdefghij"]
    rows = []
    for i in range(220):
        lang = pick.choice(["en", "en", "de", None, "x\0y"])
        source = pick.choice(["s1", "s2", "S3", "", None, "é"])
        text = pick.choice([" ", "-", "1", "\x7f"]).join(
            pick.choice(words) for _ in range(pick.randrange(30)))
        rows.append((i, pick.choice([text, text, None, ""]), lang, source, "x"))
    rows += [(900, "rare " * 50, "en", "only one", None), (901, None, "fr", "a", None),
             (902, "", "fr", "b", None), (903, "long " * 30_000, "en", "s1", None)]
    return rows + rows[:20]


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:  # several passes, blocks of sources and many small shards
        monkeypatch.setattr(source_audit, "BLOCK", 2)
        monkeypatch.setattr(source_audit, "SHARD", 8)
        monkeypatch.setattr(source_audit, "CELLS", 40)
    docs = spark.createDataFrame(sample(), SCHEMA).repartition(3)
    found = audit_sources(docs, least=4, broadcast_bytes=400 if small else 1 << 20)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == expected(sample(), 4)


def test_no_documents_and_no_terms(spark):
    assert audit_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a", "en", "s", ""), (2, "b", "en", "t", "")], SCHEMA)
    assert sorted(map(tuple, audit_sources(docs).collect())) == [
        ("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_perfect_hash():
    for size in (1, 2, 3, 50, 4096):
        hashes = term_hashes([f"term {i}" for i in range(size)])
        seeds = perfect_hash(hashes)
        slots = place(hashes, seeds[buckets(hashes, len(seeds))], size)
        assert sorted(slots) == list(range(size))


def test_shares_of_large_counts():
    counts = np.array([10**12, 0, 7], np.int64)
    n = int(counts.sum())
    assert list(source_audit.scaled(counts, n, 3)) == [
        1 + 10**9 * (int(c) + 2) // (n + 6) for c in counts]


def test_slices_hold_every_document():
    lists = [["a"] * n for n in (0, 3, 9, 0, 1, 1, 1, 7, 0)]
    batch = pa.record_batch([pa.array(range(9)), pa.array(lists, pa.list_(pa.string()))],
                            names=["no", "terms"])
    made = list(source_audit.slices(batch, 4))
    assert [m["no"].to_pylist() for m in made] == [[0, 1], [2], [3, 4, 5, 6], [7], [8]]
    assert [t for m in made for t in m["terms"].to_pylist()] == lists
    assert list(source_audit.slices(batch.slice(0, 0))) == []


@pytest.mark.parametrize("size", [1, 2, 5, 1 << 20])
def test_terms_of_many_texts(monkeypatch, size):
    monkeypatch.setattr(source_audit, "BYTES", size)
    texts = ["", "A b", "", "cÉ", "É", "x", "", "1", "\0Zz\x7f@[`{aé\u2028b", "é" * 9, "tail "]
    array = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    assert source_audit.terms_of(array).to_pylist() == [terms(t) for t in texts]
    assert source_audit.terms_of(array.slice(0, 1)).to_pylist() == [[]]
    assert source_audit.terms_of(array.slice(0, 0)).to_pylist() == []
    assert source_audit.terms_of(pa.array([], pa.string())).to_pylist() == []


def test_document_counts_leave_a_task_summed(spark):
    rows = [(i, "one two ONE", "en", str(i % 7), "") for i in range(500)] + [
        (500, None, "en", "", ""), (501, "two", None, "", "")]
    found = source_audit.document_counts(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert sorted(map(tuple, found.collect())) == [
        ("", "two", 1), ("en", "one", 500), ("en", "two", 500)]


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT id AS doc_id, CAST(X'6120ff4220c3' AS STRING) AS text, 'en' AS lang, "
                     "CAST(id % 2 AS STRING) AS source FROM range(20)")
    found = audit_sources(docs).where("part = 'pair'").collect()
    assert [(r.source, r.item, r.value) for r in sorted(found)] == [("0", "1", 0), ("1", "0", 0)]
    kept = {r.term for r in source_audit.kept_terms(docs, 20).collect()}
    assert kept == {"a", "\ufffdb", "\ufffd"}


@pytest.mark.parametrize("seed", [0, 3])
def test_places_of_a_shard_with_its_own_seed(seed):
    words = [f"é{i}" for i in range(50)]
    hashes = term_hashes(words, seed)
    seeds = perfect_hash(hashes)
    slots = place(hashes, seeds[buckets(hashes, len(seeds))], len(words))
    stored = [words[i] for i in np.argsort(slots)]
    held = source_audit.Shards(pa.table({"lang": ["en"], "n_shards": [1], "shard": [0],
                                         "seed": [seed], "seeds": [seeds], "terms": [stored]}))
    found = held.places("en", pa.array(["other", *words, "é"]))
    assert list(found) == [-1, *slots, -1]


def test_batches_for_python_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "BATCH", 1000)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    def failing(batches):
        raise ValueError

    table = source_audit.written(texts.mapInArrow(sizes, "n long"), "sizes")
    found = [r.n for r in table.collect()]
    assert sum(found) == 200 and max(found) < 20
    with pytest.raises(Exception):
        source_audit.written(texts.mapInArrow(failing, "n long"), "failing")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
