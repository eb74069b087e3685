"""Counts and verdicts of the quality rules against plain Python and numpy."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from waymark.llm.quality_rules import (FLOORS, LIMIT, NAMES, PAIRS, _with_distance,
                                       _with_factor, chi_square_cdf, chi_square_quantile, consistency,
                                       judge_documents, minimum_determinant, robust_estimates)

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")),
            len(lines) - len(set(lines)), len(covered))


def sample():
    pick = random.Random(5)
    words = [pick.choice("abcdefgh") * pick.randrange(1, 9) for _ in range(400)]
    rows = []
    for i in range(240):
        text = " ".join(pick.choice(words) + (".\n" if pick.random() < 0.1 else "")
                        for _ in range(pick.randrange(12, 200)))
        if i % 8 == 0:
            text = text.replace(" ", " | ")
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, "x"))
    odd = [None, "", " \n\t ", "a", "a b c d e", "a b c d e a b c d e", "x " * 12000,
           "l\n" * 50 + "\x1f\x85\xa0", "é🎉 " * 7 + "\r\n\x0b", "# $ % " * 30,
           "a b c d e f g h a b c d e z z z z z z z z"]
    rows += [(1000 + i, t, "en", "s1", None) for i, t in enumerate(odd)]
    return rows + [rows[3], rows[3], (None, "word " * 30, None, None, None)]


def test_counts(spark):
    rows = sample()
    found = judge_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                   r["n_repeat_words"], r["base_failed"]) for r in found)
    expected = Counter()
    for doc_id, text, *_ in rows:
        made = counts(text)
        expected[(doc_id, *made, made[0] < 10 or 100 * made[4] > 20 * made[0])] += 1
    assert got == expected
    verdicts = {r["doc_id"]: r["kept"] for r in found}
    for i in range(240):
        assert verdicts[i] == (i % 8 != 0), i
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_distance_is_that_of_the_estimates(spark):
    rng = np.random.default_rng(8)
    size = len(NAMES)
    root = rng.normal(size=(size, size))
    scatter, mean = root @ root.T + np.eye(size), rng.normal(size=size)
    names = ", ".join(f"{n} double" for n in NAMES)
    points = rng.normal(0, 3, (50, size))
    rows = spark.createDataFrame([("g", *map(float, x)) for x in points], f"key string, {names}")
    columns = [f"m{i} double" for i in range(size)] + [f"c{i}{j} double" for i, j in PAIRS]
    params = spark.createDataFrame(
        [("g", *map(float, mean), *(float(scatter[i, j]) for i, j in PAIRS))],
        "key string, " + ", ".join(columns))
    found = sorted(r["distance"] for r in _with_distance(rows, _with_factor(params), "key").collect())
    expected = sorted((x - mean) @ np.linalg.solve(scatter, x - mean) for x in points)
    assert np.allclose(found, expected)


def test_outliers_do_not_move_the_estimate(spark):
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal(np.arange(5), np.diag([1, 2, 3, 4, 5]) + 0.5, 1200)
    bad = rng.normal(60, 1, (300, 5))
    rows = [(False, "en", "a", *map(float, r)) for r in np.vstack([good, bad])]
    names = ", ".join(f"{n} double" for n in NAMES)
    facts = spark.createDataFrame(rows, f"base_failed boolean, lang string, source string, {names}")
    found = robust_estimates(facts).first()
    floors = list(FLOORS.values())
    for i in range(5):
        assert abs(found[f"m{i}"] - i) < 0.3
        assert abs(found[f"c{i}{i}"] - floors[i] ** 2 - (i + 1.5)) < 0.25 * (i + 1.5)


def plain_search(points, starts=200):
    """Smallest log determinant of half of the points, from random starts."""
    rng, best = np.random.default_rng(1), np.inf
    floor, half = np.diag(np.square(list(FLOORS.values()))), len(points) // 2
    for _ in range(starts):
        part = points[rng.choice(len(points), 6, False)]
        for _ in range(30):
            mean, scatter = part.mean(0), np.cov(part.T, bias=True) + floor
            away = ((points - mean) @ np.linalg.inv(scatter) * (points - mean)).sum(1)
            part = points[np.argsort(away, kind="stable")[:half]]
        scatter = np.cov(part.T, bias=True) * consistency(0.5) + floor
        best = min(best, np.linalg.slogdet(scatter)[1])
    return best


def test_scattered_outliers_of_a_third(spark):
    """35 % junk of varying distance is left out, and the determinant is that of a search."""
    rng = np.random.default_rng(12)
    good, bad = rng.normal(0, 1, (1200, 5)), rng.normal(8, 3, (646, 5))
    other = rng.multivariate_normal(np.arange(5), np.diag([1, 2, 3, 4, 5]) + 0.5, 400)
    names = ", ".join(f"{n} double" for n in NAMES)
    rows = [("a", *map(float, r)) for r in np.vstack([good, bad])]
    rows += [("b|1", *map(float, r)) for r in other]
    keyed = spark.createDataFrame(rows, f"key string, {names}")
    found = {r["key"]: r["determinant"] for r in minimum_determinant(keyed).collect()}
    assert abs(found["a"] - plain_search(np.vstack([good, bad]))) < 0.25
    assert abs(found["b|1"] - plain_search(other)) < 0.25
    facts = spark.createDataFrame(
        [(False, "en", key, *values) for key, *values in rows if key == "a"],
        f"base_failed boolean, lang string, source string, {names}")
    estimate = robust_estimates(facts).first()
    mean = np.array([estimate[f"m{i}"] for i in range(5)])
    scatter = np.zeros((5, 5))
    for i, j in PAIRS:
        scatter[i, j] = scatter[j, i] = estimate[f"c{i}{j}"]
    limit = chi_square_quantile(LIMIT, 5)

    def kept(points):
        away = ((points - mean) @ np.linalg.inv(scatter) * (points - mean)).sum(1)
        return (away <= limit).mean()

    assert kept(bad) < 0.05
    assert kept(good) > 0.99


def test_chi_square():
    assert abs(chi_square_cdf(11.0705, 5) - 0.95) < 1e-5
    assert abs(chi_square_quantile(LIMIT, 5) - 25.745) < 1e-2


def test_empty_table(spark):
    assert judge_documents(spark.createDataFrame([], SCHEMA)).collect() == []
