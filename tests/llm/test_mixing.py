"""Targets, draws and shards of the mix against plain Python."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from waymark.llm.mixing import (assign, hypergeometric, mixed_documents, mixing_report, plan_mix,
                                shard_quotas)

SCHEMA = "doc_id long, text string, source string, size string"


def targets_of(totals):
    """Water filling, one capped source at a time."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = sum(totals.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] >= 3 * totals[s]]
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = float(3 * totals[s])
            left -= 3 * totals[s]
            open_.remove(s)
    return target


def sample():
    rows = [(i, "w " * (i * 37 % 50), f"s{i % 7}" if i % 7 else "big", "x") for i in range(400)]
    rows += [(1000 + i, "w " * 20, "big", None) for i in range(300)]
    return rows + [(None, None, None, None), (5000, "a b c", None, None), (5001, "", "none", None),
                   (1000, "w " * 20, "big", None), (1000, "w " * 20, "big", None)]


def test_report(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing_report(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter(
        (d, len((t or "").split())) for d, t, *_ in rows)
    totals = defaultdict(int)
    for _, text, source, _ in rows:
        totals[source] += len((text or "").split())
    expected, taken = targets_of(totals), defaultdict(int)
    for r in found:
        assert r["source_size"] == totals[r["source"]]
        assert math.isclose(r["target"], expected[r["source"]], abs_tol=1e-6)
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, words in taken.items():
        assert abs(words - expected[source]) <= 75
    again = mixing_report(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert mixing_report(docs.limit(0)).collect() == []


def test_shards_take_disjoint_blocks(spark):
    docs = spark.createDataFrame(sample(), SCHEMA)
    mix = plan_mix(docs, block_words=64, shard_words=1500)
    rows = assign(mix.sized, mix).where("shard is not null").collect()
    report = {(r["doc_id"], r["source"]): r["taken"] for r in mixing_report(docs).collect()}
    words = Counter()
    for r in rows:
        words[(r["doc_id"], r["source"])] += r["size"]
    repeats = Counter((d, s) for d, _, s, _ in sample())
    for key, taken in report.items():
        assert words[key] == taken * repeats[key]
    draws = mix.draws.collect()
    places = Counter((r["source"], r["draw"]) for r in draws)
    assert set(places.values()) == {1}
    per_shard = Counter(r["shard"] for r in draws)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) > 5


def test_quotas_add_up(spark):
    quotas = spark.createDataFrame([("a", 500), ("b", 40), ("c", 3), (None, 7), ("e", 0)],
                                   "source string, draws long")
    for shards in (1, 7):
        rows = shard_quotas(quotas, shards).collect()
        by_source, by_shard = Counter(), Counter()
        for r in sorted(rows, key=lambda r: r["shard"]):
            assert r["first"] == by_source[r["source"]] and r["draws"] >= 0
            by_source[r["source"]] += r["draws"]
            by_shard[r["shard"]] += r["draws"]
        assert by_source == {"a": 500, "b": 40, "c": 3, None: 7, "e": 0}
        assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_hypergeometric_by_inversion(spark):
    def pmf(urn, good, drawn, k):
        return math.comb(good, k) * math.comb(urn - good, drawn - k) / math.comb(urn, drawn)

    cases = ((20, 7, 9), (1000, 300, 500), (5, 5, 2), (5, 0, 2), (300, 299, 7))
    n = 200
    rows = [(*case, (i + 0.5) / n) for case in cases for i in range(n)]
    frame = spark.createDataFrame(rows, "u long, g long, d long, x double")
    for urn, good, drawn, x, value in frame.select("*", hypergeometric(
            F.col("u"), F.col("g"), F.col("d"), F.col("x"))).collect():
        low = max(0, drawn + good - urn)
        below = sum(pmf(urn, good, drawn, k) for k in range(low, value))
        assert below - 1e-9 <= x <= below + pmf(urn, good, drawn, value) + 1e-9


def test_mixed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(sample(), SCHEMA)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    found = Counter(r["doc_id"] for r in mixed.collect() if r["text"])
    report = mixing_report(docs).where("size > 0").collect()
    expected = Counter()
    for r in report:
        expected[r["doc_id"]] += r["taken"] // r["size"]
    assert found == +expected
