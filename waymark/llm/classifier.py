"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. Each text becomes a vector of statistics (one pass, no shuffle).
2. ``cos(W x + b)`` with Gaussian ``W`` approximates a Gaussian kernel over them.
3. Every partition sums its part of the normal equations; Spark adds the parts and the
   driver solves one system of ``features + 1`` unknowns, whatever the number of rows.
4. Labelled rows come in two folds. Each fold is scored by the weights of the other one;
   these scores, counted in fixed bins, are calibrated by pooling adjacent violators.

Labels, language, source and ids are never inputs of a score. Training uses all rows with a
label that are not held out.

Defined results: a null text is an empty one and gets a score like any other; a null label or
a label without a document is not used; of several labels of a document the smallest counts;
repeated documents are scored each; without labels of either kind every score is the share
of ones (0.5 without any label); a null id is held in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.common import text_or_empty
from waymark.storage import materialize

FEATURES = 128
WIDTH = 3.0  # of the kernel, in standard deviations of the statistics
RIDGE = 1e-3  # per training row
BINS = 2000  # of raw scores from LOW to HIGH, for the calibration
LOW, HIGH = -1.0, 2.0
SEED = 20240

SYMBOLS = "#*$%&|<>"
STATISTICS = (
    "words", "word_length", "symbols", "bars", "exclamations", "capital_words", "digits",
    "distinct_words", "repeated_lines", "repeated_triples", "line_words", "stops", "top_word",
    "short_words", "long_words", "compact_letters")
_LETTERS = re.compile(r"[^\W\d_]+")


def statistics(text: str) -> list[float]:
    """The statistics of one text, each of moderate size."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    letters = sum(map(len, words))
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    counts = Counter(words)
    triples = set(zip(words, words[1:], words[2:]))
    return [
        math.log1p(n), min(20.0, letters / n),
        math.sqrt(sum(map(text.count, SYMBOLS)) / letters), math.sqrt(text.count("|") / n),
        math.sqrt(text.count("!") / n), sum(map(str.isupper, words)) / n,
        math.sqrt(sum(map(text.count, "0123456789")) / letters), len(counts) / n,
        1 - len(set(lines)) / len(lines), 1 - len(triples) / max(1, n - 2),
        math.log1p(n / len(lines)), sum(w[-1] in ".!?" for w in words) / n,
        max(counts.values()) / n, sum(len(w) <= 3 for w in words) / n,
        sum(len(w) > 12 for w in words) / n, len(_LETTERS.findall(text)) / (2 * n)]


def with_statistics(docs: DataFrame, keep: dict[str, Column],
                    text_column: str = "text") -> DataFrame:
    """``keep`` columns and ``stats``, an array in the order of ``STATISTICS``."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch], dtype=object)

    return docs.select(*(c.alias(name) for name, c in keep.items()),
                       vectors(text_or_empty(text_column)).alias("stats"))


@dataclass(frozen=True)
class Projection:
    """Random features over standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def features(self, stats: pd.Series) -> np.ndarray:
        x = np.clip((np.stack(stats.to_numpy()) - self.mean) / self.scale, -8, 8)
        waves = np.cos(x @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(waves), 1)), waves])


def fit_projection(training: DataFrame, features: int = FEATURES) -> Projection:
    size = len(STATISTICS)
    sums = training.agg(*(f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop)
                          for i in range(size))).first()
    values = np.array([v or 0.0 for v in sums], dtype=float)
    rng = np.random.default_rng(SEED)
    return Projection(values[:size], np.maximum(values[size:], 1e-3),
                      rng.standard_normal((size, features)) / WIDTH,
                      rng.uniform(0, 2 * math.pi, features))


def normal_equations(training: DataFrame, projection: Projection) -> dict[int, np.ndarray]:
    """Per fold, the matrix of sums of products of ``(features, label)``."""
    size = len(projection.phases) + 2
    upper = np.triu_indices(size)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, rows in batch.groupby("fold"):
                z = np.hstack([projection.features(rows["stats"]),
                               rows[["label"]].to_numpy(dtype=float)])
                sums[fold] = sums.get(fold, 0) + z.T @ z
        for fold, total in sums.items():
            yield pd.DataFrame({"fold": fold, "cell": np.arange(len(upper[0])),
                                "value": total[upper]})

    cells = (training.select("fold", "label", "stats")
             .mapInPandas(partial, "fold int, cell int, value double")
             .groupBy("fold", "cell").agg(F.sum("value").alias("value")))
    found = {fold: np.zeros((size, size)) for fold in (0, 1)}
    for row in cells.collect():  # two folds of size * (size + 1) / 2 cells
        i, j = upper[0][row["cell"]], upper[1][row["cell"]]
        found[row["fold"]][i, j] = found[row["fold"]][j, i] = row["value"]
    return found


def solve(sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights; the constant is not shrunk."""
    penalty = np.full(len(sums) - 1, ridge * max(1.0, sums[0, 0]))
    penalty[0] = 1e-9
    return np.linalg.solve(sums[:-1, :-1] + np.diag(penalty), sums[:-1, -1])


def isotonic(positions: np.ndarray, ones: np.ndarray, counts: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres of the pooled blocks and their share of ones."""
    blocks: list[list[float]] = []
    for x, y, n in zip(positions, ones, counts):
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    made = np.array(blocks)
    return made[:, 0] / made[:, 2], made[:, 1] / made[:, 2]


@dataclass(frozen=True)
class Classifier:
    projection: Projection | None
    weights: np.ndarray | None
    centres: np.ndarray
    levels: np.ndarray

    def score(self, stats: pd.Series) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.levels[0])
        raw = np.clip(self.projection.features(stats) @ self.weights, LOW, HIGH)
        return np.interp(raw, self.centres, self.levels)


def fit(training: DataFrame, features: int = FEATURES) -> Classifier:
    """From rows ``(fold 0 or 1, label 0 or 1, stats)``."""
    share = training.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if share[0] is None or share[1] == share[2]:
        level = 0.5 if share[0] is None else float(share[0])
        return Classifier(None, None, np.zeros(1), np.array([level]))
    projection = fit_projection(training, features)
    sums = normal_equations(training, projection)
    total = sums[0] + sums[1]
    # A fold is scored by the other fold's weights, so the calibration sees unseen rows.
    other = {fold: solve(sums[1 - fold] if sums[1 - fold][0, 0] else total) for fold in (0, 1)}

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = projection.features(batch["stats"])
            raw = np.where(batch["fold"] == 0, z @ other[0], z @ other[1])
            place = (np.clip(raw, LOW, HIGH - 1e-9) - LOW) / (HIGH - LOW) * BINS
            yield pd.DataFrame({"bin": place.astype(int), "label": batch["label"].to_numpy()})

    counted = (training.select("fold", "label", "stats").mapInPandas(binned, "bin int, label int")
               .groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
               .orderBy("bin").toPandas())  # at most BINS rows
    centres = LOW + (counted["bin"].to_numpy() + 0.5) / BINS * (HIGH - LOW)
    return Classifier(projection, solve(total),
                      *isotonic(centres, counted["ones"].to_numpy(), counted["n"].to_numpy()))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for all documents."""
    part = F.coalesce(remainder(F.col("doc_id")), F.lit(0))
    stats = materialize(with_statistics(docs, {"doc_id": F.col("doc_id"), "part": part}),
                        "statistics")
    known = (labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("label")))
    training = materialize(
        stats.where(F.col("part") != 1).join(known, "doc_id")
        .select((F.col("part") / 2).cast("int").alias("fold"), "label", "stats"), "training")
    model = fit(training, features)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(batch) if len(batch) else [], dtype="float64")

    scores = stats.select("doc_id", (F.col("part") == 1).alias("held_out"),
                          scored("stats").alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
