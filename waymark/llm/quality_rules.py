"""Quality rules: counted facts of a text, and robust multivariate outliers.

Every text gives counts (words, their characters, symbols, repeated lines, words in repeated
five-word windows). Plain limits reject first. The others are judged by a vector of
transformed statistics: for each language and source the minimum covariance determinant
gives a location and scatter that outliers do not move, and a text is rejected if its
Mahalanobis distance exceeds a chi-square limit.

The determinant is searched from three starts: medians with quartile scales, the same scales
with correlations of squashed values, and with correlations of directions from the median. A
concentration step takes the half of the texts with the smallest distances, which gives the
next mean and covariance; it is one aggregation, because sums are kept per distance bin and
the bin at the border counts by its share. Every start takes two steps, the one with the
smallest determinant goes on until its determinant stops falling. All groups take their steps
together, as rows of one small table. A last step uses all texts below the usual limit. Groups
with few texts lean on their language: both estimates are averaged with the weight of
``PRIOR`` texts. A floor under each scale (it belongs to the determinant) keeps constant
statistics from rejecting the first other value.

All work is column expressions: texts are read once, and the steps run over the small table
of statistics, with one row per group of parameters.

Defined results: a null text is an empty one (no words, fails the limits); null languages and
sources are groups of their own; repeated rows are judged each and alike; columns beside id,
text, lang and source do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from waymark.llm.common import WORD, free_names, text_or_empty, words_of
from waymark.storage import materialize

MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SUBSET = 0.5
FIRST_STEPS = 2  # of every start
MOST_STEPS = 15  # of the best one; it stops when no group's determinant falls any more
FALLS = 0.01  # smallest fall of a log determinant that counts
SALTS = 16  # parts that the texts of a group are joined in
PRIOR = 30
LIMIT = 0.9999  # of the chi-square distribution
BIN = 8  # distance bins per doubling

# Statistic, and the floor under its scale.
FLOORS = {"word_length": 0.25, "symbols": 0.05, "repeated_lines": 0.1, "repeated_words": 0.05,
          "line_words": 0.5}
NAMES = tuple(FLOORS)
PAIRS = tuple(combinations_with_replacement(range(len(NAMES)), 2))


def chi_square_cdf(x: float, degrees: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, half = degrees / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        if chi_square_cdf(middle, degrees) < share:
            low = middle
        else:
            high = middle
    return high


def consistency(share: float) -> float:
    """Makes the covariance of the ``share`` of smallest distances that of normal data."""
    degrees = len(NAMES)
    return share / chi_square_cdf(chi_square_quantile(share, degrees), degrees + 2)


def repeated_window_words(windows: Column) -> Column:
    """Words inside windows that occur more than once; ``windows`` holds a hash for every
    start. Windows are sorted by hash, equal neighbours are repeats, and the union of their
    ranges is counted from the gaps between starts."""

    def repeated_starts(ordered: Column) -> Column:
        same = F.filter(ordered, lambda w, k: (
            (F.get(ordered, k - 1)["h"].eqNullSafe(w["h"]))
            | (F.get(ordered, k + 1)["h"].eqNullSafe(w["h"]))))
        return F.array_sort(F.transform(same, lambda w: w["at"]))

    def covered(starts: Column) -> Column:
        following = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
        gaps = F.zip_with(starts, following, lambda a, b: F.coalesce(
            F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    ordered = F.sort_array(F.transform(
        windows, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        once(once(ordered, repeated_starts), covered))


def text_facts(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, text_hash)``, the counts and the transformed statistics."""
    text = docs.select("doc_id", "lang", "source", text_or_empty().alias("text"))
    words = text.select("*", words_of(F.col("text")).alias("words"))
    hashed = words.select(
        "doc_id", "lang", "source", "text", F.size("words").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    starts = F.when(F.col("n_words") >= WINDOW,
                    F.sequence(F.lit(0), F.col("n_words") - WINDOW))
    windows = hashed.select("*", F.coalesce(F.transform(starts, lambda i: F.xxhash64(
        *(F.get("hashes", i + k) for k in range(WINDOW)))),
        F.array().cast("array<long>")).alias("windows"))
    worded = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    lines = windows.select("*", worded.alias("lines"))
    counted = lines.select(
        "doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"),
        F.col("n_words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long")
        .alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, "")))
        .cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"))
    n_words = F.greatest(F.col("n_words"), F.lit(1))
    n_lines = F.greatest(F.col("n_lines"), F.lit(1))
    # Short texts lean on 50 words of five letters: their averages scatter more.
    return counted.select(
        "*", ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
        .alias("base_failed"),
        ((F.col("word_chars") + 250) / (F.col("n_words") + 50)).alias("word_length"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbols"),
        (F.col("n_dup_lines") / n_lines).alias("repeated_lines"),
        (F.col("n_repeat_words") / n_words).alias("repeated_words"),
        F.log(n_words / n_lines).alias("line_words")).drop("n_lines")


SUMS = tuple([f"s{i}" for i in range(len(NAMES))] + [f"p{i}{j}" for i, j in PAIRS])


def _sums() -> list[Column]:
    return ([F.expr(f"sum({name}) AS s{i}") for i, name in enumerate(NAMES)]
            + [F.expr(f"sum({NAMES[i]} * {NAMES[j]}) AS p{i}{j}") for i, j in PAIRS])


def _scatter(sums: DataFrame, factor: float) -> DataFrame:
    """Means and covariances from ``n`` and ``SUMS``, with the floors added."""
    found = [c for c in sums.columns if c not in SUMS]
    found += [f"s{i} / n AS m{i}" for i in range(len(NAMES))]
    for i, j in PAIRS:
        value = f"(p{i}{j} / n - m{i} * m{j}) * {factor}D"
        if i == j:
            value = f"greatest({value}, 0D) + {FLOORS[NAMES[i]] ** 2}D"
        found.append(f"{value} AS c{i}{j}")
    return sums.selectExpr(*found)


def _with_factor(params: DataFrame) -> DataFrame:
    """The lower triangular factor of the covariance, entry by entry, and ``determinant``,
    which is the logarithm. Later entries of the selection use the earlier ones."""
    size = range(len(NAMES))
    entries = []
    for j in size:
        known = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        entries.append(f"sqrt(greatest(c{j}{j}{known}, 1e-9D)) AS l{j}{j}")
        for i in range(j + 1, len(NAMES)):
            known = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            entries.append(f"(c{j}{i}{known}) / l{j}{j} AS l{i}{j}")
    others = [c for c in params.columns if c not in {f"c{i}{j}" for i, j in PAIRS}]
    return params.selectExpr(*(f"`{c}`" for c in others), *entries,
                             f"2 * ({' + '.join(f'ln(l{j}{j})' for j in size)}) AS determinant")


def _with_distance(rows: DataFrame, factors: DataFrame, key: str, *more: str) -> DataFrame:
    """Squared Mahalanobis distances, by forward substitution: one row for every row of
    ``factors`` with the same key, whose columns ``more`` are added."""
    size = range(len(NAMES))
    salt = f"pmod(xxhash64({', '.join(NAMES)}), {SALTS}L)"
    salted = factors.selectExpr(*(f"`{c}`" for c in factors.columns if c != key),
                                f"`{key}` AS _key",
                                f"explode(sequence(0L, {SALTS - 1}L)) AS _part")
    joined = rows.join(salted, F.expr(f"`{key}` = _key AND {salt} = _part"))
    kept = [f"`{c}`" for c in (*rows.columns, *more)]
    solved = [f"({name} - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i}"
              for i, name in enumerate(NAMES)]
    squares = " + ".join(f"y{i} * y{i}" for i in size)
    return joined.selectExpr(*kept, *solved).selectExpr(*kept, f"{squares} AS distance")


def _starts(rows: DataFrame) -> DataFrame:
    """First locations and scatters: three rows per group, told apart by ``start``."""
    quartiles = rows.groupBy("key").agg(*(
        F.percentile_approx(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(name)
        for name in NAMES))
    middle = _small(quartiles.select(
        F.col("key").alias("_key"),
        *(F.get(name, F.lit(1)).alias(f"m{i}") for i, name in enumerate(NAMES)),
        *(F.sqrt(F.pow((F.get(name, F.lit(2)) - F.get(name, F.lit(0))) / 1.349, 2)
                 + FLOORS[name] ** 2).alias(f"r{i}") for i, name in enumerate(NAMES))), "medians")
    size = range(len(NAMES))
    scaled = rows.join(middle, F.col("key") == F.col("_key")).select(
        "key", *((F.col(name) - F.col(f"m{i}")) / F.col(f"r{i}") for i, name in enumerate(NAMES))
    ).toDF("key", *(f"z{i}" for i in size))
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in size), F.lit(1e-9)))
    turned = scaled.select("key", *(F.tanh(f"z{i}").alias(f"a{i}") for i in size),
                           *((F.col(f"z{i}") / length).alias(f"b{i}") for i in size))
    products = turned.groupBy("key").agg(*(
        F.avg(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}{i}{j}")
        for x in "ab" for i, j in PAIRS))
    entries = []
    for number, letter in enumerate(("", "a", "b")):
        values = [F.lit(number).alias("start")]
        for i, j in PAIRS:
            scale = F.col(f"r{i}") * F.col(f"r{j}")
            if i != j and letter:  # a correlation, with the scales of the quartiles
                scale *= F.col(f"{letter}{i}{j}") / F.sqrt(
                    (F.col(f"{letter}{i}{i}") + 1e-9) * (F.col(f"{letter}{j}{j}") + 1e-9))
            elif i != j:
                scale = F.lit(0.0)
            values.append(scale.alias(f"c{i}{j}"))
        entries.append(F.struct(*values))
    both = middle.join(products, F.col("key") == F.col("_key"))
    return both.select("key", *(f"m{i}" for i in size), F.inline(F.array(*entries)))


def _small(groups: DataFrame, label: str) -> DataFrame:
    """Written in a few files: one row per group is little beside the texts, and every step
    reads it whole."""
    return materialize(groups.coalesce(
        max(SALTS, 2 * groups.sparkSession.sparkContext.defaultParallelism)), label)


def _step(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """One concentration step of every group and start: factors of the half of the rows with
    the smallest distances, and the determinant ``before``."""
    group = ["key", "start", "before"]
    place = F.expr(f"floor(log2(distance + 1e-6D) * {BIN}) AS place")
    given = factors.drop("before").withColumnRenamed("determinant", "before")
    bins = (_with_distance(rows, given, "key", "start", "before").groupBy(*group, place)
            .agg(F.count("*").alias("n"), *_sums()))
    # Of the bins (not texts) by distance, the share of each that belongs to the half.
    group_of = f"PARTITION BY {', '.join(group)}"
    share = bins.selectExpr(
        *group, "n", *SUMS,
        f"least(1D, greatest(0D, ({SUBSET}D * sum(n) OVER ({group_of})"
        f" - sum(n) OVER ({group_of} ORDER BY place)) / n + 1)) AS share")
    sums = share.where("share > 0").groupBy(*group).agg(*(
        F.expr(f"sum({name} * share) AS {name}") for name in ("n", *SUMS)))
    return _with_factor(_scatter(sums, consistency(SUBSET)).drop("n"))


def _smallest(factors: DataFrame) -> DataFrame:
    """Of every key the row with the smallest determinant."""
    first = W.partitionBy("key").orderBy("determinant", "start")
    return (factors.withColumn("_rank", F.row_number().over(first))
            .where("_rank = 1").drop("_rank"))


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """Per ``key`` the location and factor of the half of the rows with the smallest
    determinant that is found, and its logarithm ``determinant``."""
    factors = _with_factor(_starts(rows))
    for _ in range(FIRST_STEPS):
        factors = _step(rows, _small(factors, "factors"))
    found = falling = _small(_smallest(factors), "factors")
    for _ in range(MOST_STEPS):
        taken = _small(_step(rows, falling), "factors")
        found = found.unionByName(taken)
        falling = taken.where(F.col("before") - F.col("determinant") >= FALLS)
        if falling.isEmpty():
            break
    return _small(_smallest(found), "best")


def group_key(lang: Column, source: Column) -> Column:
    """A text that tells nulls, languages and sources apart."""
    return F.to_json(F.struct(lang.alias("l"), source.alias("s")))


def robust_estimates(facts: DataFrame) -> DataFrame:
    """Location and scatter per language and source, one row each."""
    judged = facts.where(~F.col("base_failed"))
    nothing = F.lit(None).cast("string")
    own = group_key(F.col("lang"), F.col("source"))
    language = F.concat(F.lit("all "), group_key(F.col("lang"), nothing))
    # The language is a group beside its sources.
    rows = materialize(judged.select(
        F.explode(F.array(own, language)).alias("key"), *NAMES), "statistics")
    usual = 0.975
    near = _with_distance(rows, minimum_determinant(rows), "key").where(
        F.col("distance") <= chi_square_quantile(usual, len(NAMES)))
    sums = near.groupBy("key").agg(F.count("*").alias("n"), *_sums())
    params = _small(_scatter(sums, consistency(usual)), "scatter")
    values = [f"m{i}" for i in range(len(NAMES))] + [f"c{i}{j}" for i, j in PAIRS]
    groups = facts.select(own.alias("group"), language.alias("language")).distinct()
    sources = params.select(F.col("key").alias("_own"), "n", *values)
    languages = params.select(F.col("key").alias("_language"),
                              *(F.col(v).alias(f"all_{v}") for v in values))
    weight = F.coalesce(F.col("n"), F.lit(0)) / (F.coalesce(F.col("n"), F.lit(0)) + PRIOR)
    return (groups.join(sources, F.col("group") == F.col("_own"), "left")
            .join(languages, F.col("language") == F.col("_language"), "left")
            .select("group", *(
                (F.coalesce(v, f"all_{v}") * weight + F.col(f"all_{v}") * (1 - weight)).alias(v)
                for v in values)))


def judge_documents(docs: DataFrame) -> DataFrame:
    """The counts of every text, ``base_failed``, ``distance`` and the verdict ``kept``."""
    facts = materialize(text_facts(docs), "facts")
    estimates = _small(robust_estimates(facts), "estimates")
    keyed = facts.withColumn("group", group_key(F.col("lang"), F.col("source")))
    limit = chi_square_quantile(LIMIT, len(NAMES))
    return _with_distance(keyed, _with_factor(estimates), "group").select(
        "doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False)))
        .alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, without the rejected rows."""
    rejected = judge_documents(docs).where(~F.col("kept")).select(
        F.col("text_hash").alias("_hash"),
        group_key(F.col("lang"), F.col("source")).alias("_group")).distinct()
    # Equal texts of a language and source are judged alike, whatever their ids.
    own, key = free_names(docs, "_own", "_key")
    keyed = docs.withColumn(own, F.xxhash64(text_or_empty())).withColumn(
        key, group_key(F.col("lang"), F.col("source")))
    same = (keyed[own] == rejected["_hash"]) & (keyed[key] == rejected["_group"])
    return keyed.join(rejected.hint("merge"), same, "left_anti").select(*docs.columns)
