"""N-gram join and paragraph removal against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from waymark.llm import minhash, paragraph_dedup
from waymark.llm.minhash import components, overlaps, plan_bands
from waymark.llm.ngram_join import ngram_links, one_of_each_group
from waymark.llm.paragraph_dedup import repeated_paragraphs, without_repeats
from waymark.storage import materialize

SCHEMA = "doc_id long, text string, node string"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    width = min(5, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)
                     ) if words else frozenset()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9 if a | b else True


def groups_of(items, sets):
    """Links and components of all pairs."""
    links, parent = Counter(), {i: i for i in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(items, 2):
        if similar(sets[a], sets[b]):
            links[a] += 1
            links[b] += 1
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return links, {i: root(i) for i in items}


def sample(lines=False):
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    base = [pick.choice(vocabulary) for _ in range(60)]
    for i in range(60):  # near copies of one text, some too far from each other
        words = list(base)
        for _ in range(i % 3):
            words[pick.randrange(60)] = "new" + str(i)
        rows.append((i, " ".join(words), "x"))
    for i in range(100, 130):
        text = [pick.choice(vocabulary) for _ in range(pick.randrange(5, 80))]
        rows.append((i, " ".join(text), None))
        if i % 3 == 0:
            rows.append((i + 100, " ".join(text) + " more", None))
    rows += [(300, "", "x"), (301, None, "x"), (302, " \n", None), (303, "a b", None),
             (304, "a  b", None), (305, "a b c", None), (306, "x x x x x", None),
             (307, "x x x x x x", None), (308, " ".join(base) + "\x1f", None),
             (309, "long " * 9000, None)]
    return rows + [rows[0]]


@pytest.mark.parametrize("block", [8, 256])
def test_join(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = sample()
    found = ngram_links(spark.createDataFrame(rows, SCHEMA)).collect()
    items = list(range(len(rows)))
    links, root = groups_of(items, [shingles(r[1]) for r in rows])
    expected = Counter((rows[i][0], min(rows[k][0] for k in items if root[k] == root[i]),
                        links[i]) for i in items)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == expected


def test_one_document_of_each_group(spark):
    rows = sample() + [(None, "no id here", None), (None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("node", "_hash")
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    items = list(range(len(rows)))
    _, root = groups_of(items, [shingles(r[1]) for r in rows])
    groups = {}
    for i in items:
        groups.setdefault(root[i], []).append(rows[i][0])
    expected = Counter(min((d for d in g if d is not None), default=None)
                       for g in groups.values())
    assert Counter(r["doc_id"] for r in kept.collect()) == expected
    assert one_of_each_group(docs.limit(0)).collect() == []


def test_groups_without_an_id_or_with_the_same_one(spark):
    texts = ["one two three four five six", "red green blue pink gray teal",
             "salt pepper basil thyme sage mint", "oak elm ash fir yew box"]
    rows = [(None, t, "x") for t in texts[:3]] + [(7, t, "x") for t in texts[2:]]
    rows += [(7, "iron zinc lead tin gold silver", "x"), (None, texts[0], "x"),
             (8, " ".join(texts[3].split()), "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = one_of_each_group(docs).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([
        (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, rows[5][1])])
    named = ngram_links(docs).collect()
    assert len({r["class_digest"] for r in named}) == 5
    assert {r["class_id"] for r in named} == {None, 7}


def test_paragraphs(spark):
    lines = [r[1] for r in sample() if r[1]]
    pick = random.Random(2)
    rows = [(i, "\n".join(pick.choice(lines) for _ in range(pick.randrange(1, 5))), "x")
            for i in range(50)] + [(90, None, "x"), (91, "", None), (92, "\n \n", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = repeated_paragraphs(docs)
    places, texts = [], []
    for doc_id, text, _ in rows:
        at = 0
        for no, line in enumerate((text or "").split("\n")):
            if re.search("[^\x20\x09-\x0D]", line):
                places.append((doc_id, no, at, at + len(line)))
                texts.append(line)
            at += len(line) + 1
    links, root = groups_of(list(range(len(texts))), [shingles(t) for t in texts])
    expected = {(*places[i], places[root[i]][0], places[root[i]][1], root[i] != i)
                for i in range(len(texts)) if links[i]}
    got = {(r["doc_id"], r["paragraph"], r["start"], r["end"], r["cluster_doc_id"],
            r["cluster_paragraph"], r["removed"]) for r in found.collect()}
    assert got == expected
    gone = {(p[0], p[1]) for p in expected if p[-1]}
    rest = without_repeats(docs)
    assert rest.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in rest.collect()} == {
        (d, None if t is None else "\n".join(
            line for no, line in enumerate(t.split("\n")) if (d, no) not in gone))
        for d, t, _ in rows}
    assert repeated_paragraphs(docs.limit(0)).collect() == []


def test_components(spark):
    pick = random.Random(4)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(400, 460)] + [(1000, i) for i in range(1001, 1100)]
    found = dict(map(tuple, components(
        spark.createDataFrame(edges, "node long, root long")).collect()))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert {x: r for x, r in found.items()} == {x: root(x) for x in parent if root(x) != x}


def test_overlaps():
    pick = random.Random(9)
    sets = [np.unique(np.array([pick.randrange(9000) for _ in range(pick.randrange(0, 6000))],
                               np.uint64)) for _ in range(6)]
    exact = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    made = overlaps(sets)
    for i in range(6):
        for j in range(6):
            assert i == j or made[i, j] == exact[i][j]


def test_band_plan():
    for rows in (3, 5):
        bands = plan_bands(0.8, 0.9999, rows)
        assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999


def test_shared_keys(spark):
    pick = random.Random(6)
    bands = {node: sorted({pick.randrange(60) for _ in range(4)}) for node in range(70)}
    bands |= {100: [200, 201], 101: [200, 201], 102: [202], 103: []}  # 200 and 201: same nodes
    nodes = spark.createDataFrame(list(bands.items()), "node long, bands array<long>")
    members = {}
    for node, keys in bands.items():
        for key in keys:
            members.setdefault(key, []).append(node)
    kept = {tuple(m): k for k, m in sorted(members.items(), reverse=True) if len(m) > 1}
    expected = Counter((k, m[0], m[-1], node) for m, k in kept.items() for node in m)
    assert Counter(map(tuple, minhash.shared_keys(nodes).collect())) == expected


def test_wide_rows_of_paragraphs_move_once(spark, monkeypatch):
    """Keys are shuffled with their nodes once, and bands are written once per distinct line."""
    plans, bands = {}, []

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        if "bands" in df.columns:
            bands.append(label)
        return materialize(df, label)

    monkeypatch.setattr(minhash, "materialize", watched)
    monkeypatch.setattr(paragraph_dedup, "materialize", watched)
    repeated_paragraphs(spark.createDataFrame(sample(), SCHEMA)).collect()
    assert bands == ["nodes"]
    pairs = [text for text in plans.values() if "Generate explode(bands" in text]
    assert len(pairs) == 1 and pairs[0].count("Exchange hash") == 1


def test_a_unit_returns_joined_components_not_links():
    pick = random.Random(8)
    sets, of = [], []
    for family in range(3):  # near copies of each other, of another family's, of nothing
        common = list(range(1000 * family, 1000 * family + (40 if family < 2 else 0)))
        for _ in range(40):
            own = [pick.randrange(10**6, 10**9) for _ in range(3 if family < 2 else 30)]
            sets.append(np.unique(np.array(common + own, np.int64)))
            of.append(family)
    roots = [900 - i // 2 for i in range(120)]  # some nodes are in one component already
    unit = pd.DataFrame({"key": 5, "low": 1, "high": 2, "chunk": [pick.choice([2, 2, 3]) for _ in of],
                         "rest": [pick.choice([1, 1, 2, -1]) for _ in of],
                         "node": range(2000, 2120), "root": roots, "shingles": sets})
    links, parent = 0, {r: r for r in roots}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(120):
        for b in range(120):
            if (unit["rest"][a] == 1 and unit["chunk"][b] == 2 and roots[a] != roots[b]
                    and of[a] == of[b] < 2):
                links += 1
                low, high = sorted((root(roots[a]), root(roots[b])))
                parent[high] = low
    found = minhash.compare_rest(unit, 0.8)
    expected = {(r, root(r)) for r in roots if root(r) != r}
    assert Counter(zip(found["node"], found["root"])) == Counter(expected)
    assert links > 5 * len(unit) > 5 * len(found)
