"""The quality classifier: parts against plain numpy, scores against held-out labels."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from waymark.llm.classifier import (Projection, STATISTICS, isotonic, normal_equations,
                                    quality_scores, statistics)

SMALL = "/root/testdata/sf0.01"


def test_isotonic_is_the_monotone_fit():
    x, levels = isotonic(np.arange(6.0), np.array([0, 3, 1, 2, 4, 4]), np.full(6, 4))
    assert np.allclose(levels, [0, 0.5, 1.0])
    assert np.all(np.diff(x) > 0)


def test_partition_sums_equal_one_product(spark):
    rng = np.random.default_rng(0)
    stats = rng.random((200, len(STATISTICS)))
    rows = [(int(i % 2), int(i % 3 == 0), stats[i].tolist()) for i in range(200)]
    training = spark.createDataFrame(rows, "fold int, label int, stats array<double>")
    projection = Projection(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)),
                            rng.random((len(STATISTICS), 8)), rng.random(8))
    sums = normal_equations(training.repartition(5), projection)
    import pandas as pd
    for fold in (0, 1):
        own = [r for r in rows if r[0] == fold]
        z = np.hstack([projection.features(pd.Series([r[2] for r in own])),
                       np.array([[r[1]] for r in own])])
        assert np.allclose(sums[fold], z.T @ z)


def test_statistics_of_odd_texts():
    for text in ("", " \n ", "a", "!", "x " * 30000, "é🎉"):
        made = statistics(text)
        assert len(made) == len(STATISTICS) and np.all(np.isfinite(made))


def test_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = spark.createDataFrame([(None, None), (5000, ""), (5001, None), (5001, "x")],
                                "doc_id long, text string")
    scored = quality_scores(docs.select("doc_id", "text").union(odd)
                            .withColumn("score", F.lit("clash")), labels)
    rows = scored.collect()
    assert len(rows) == docs.count() + 4
    truth = dict(map(tuple, labels.select("doc_id", "quality").collect()))
    right = total = 0
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["held_out"] and r["doc_id"] in truth:
            total += 1
            right += truth[r["doc_id"]] == r["predicted"]
    assert right / total > 0.97


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_scores(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1), (2, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality_scores(docs, ones).collect()} <= {0.5, 1.0}
    assert quality_scores(docs.limit(0), none).collect() == []
