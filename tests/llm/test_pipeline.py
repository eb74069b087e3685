"""The pipeline, stage by stage, against plain Python on the smallest documents."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__
from tests.llm.test_sanitise import expected_spans
from tests.llm.test_similarity import groups_of, shingles
from tests.llm.test_tokens import check_packing
from waymark.llm.mixing import mixing_report
from waymark.llm.quality_rules import judge_documents
from waymark.storage import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    results = []
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = materialize(stage(spark, current, SMALL), "stage")
        results.append(current.collect())
    assert all(list(r.asDict()) == columns for rows in results[:4] for r in rows)

    good = {r["doc_id"] for r in judge_documents(docs).collect() if r["kept"]}
    assert Counter(r["doc_id"] for r in results[0]) == Counter(good)
    assert 0.6 * docs.count() < len(good) < docs.count()

    texts = {r["doc_id"]: r["text"] for r in results[0]}
    _, root = groups_of(sorted(texts), {i: shingles(t) for i, t in texts.items()})
    assert sorted(r["doc_id"] for r in results[1]) == sorted(set(root.values()))

    before = {r["doc_id"]: r["text"] for r in results[1]}
    assert Counter(r["doc_id"] for r in results[2]) == Counter(before.keys())
    for r in results[2]:
        spans = expected_spans(before[r["doc_id"]])
        assert (r["text"] == before[r["doc_id"]]) == (not spans)
        assert not expected_spans(r["text"])

    cleaned = spark.createDataFrame(results[2], docs.schema)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing_report(cleaned).collect()}
    assert Counter(r["doc_id"] for r in results[3]) == +Counter(taken)

    by_id = defaultdict(list)
    for r in results[3]:
        by_id[r["doc_id"]].append(r["text"])
    check_packing(results[4], by_id, 4096)


def test_it_is_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    numbers = {int(name[2:].split("_")[0]) for name in __spark_entry__.queries()
               if name.startswith("op") and name[2].isdigit()}
    assert numbers == set(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram join", "PII", "mixing", "packing"]
