"""Document fingerprints by consistent weighted sampling.

A text is a vector of words weighted by their frequency. For every sample and word, hashes
give two gamma variates r, c and a uniform b that all texts share. A word of weight w scores
``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b) - r``; the word of smallest a, with
its t, is the sample. Two texts agree in a sample with the probability of their generalised
Jaccard similarity (sum of minima over sum of maxima of their weights).

A text and its edited version are sampled together: their common words go through the hashes
once. A sample is one long, score above and 24 bits of (word, t) below, so that a plain minimum
finds it. Words are counted and samples taken where the texts lie after the join with their
neighbours; only one row of samples per text leaves that stage.

Defined results: a null text is empty; a text without words has the one word "" of weight 1,
so such texts equal each other and nothing else. Documents are ordered by id, null first; of
documents with the same id, the one with the smallest text hash is the neighbour of others.
A single document is its own neighbour. Repeated rows give repeated results. Columns beside
id and text do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from waymark.llm.common import SPACE, text_or_empty
from waymark.storage import materialize

SAMPLES = 32
AT_ONCE = 8  # samples of one row; larger rows make methods that the JVM will not compile
ID_BITS = 24
BLANKS = " \t\n\x0b\x0c\r"


def _uniforms(word: Column, number: Column, count: int) -> list[Column]:
    """``count`` uniform numbers in (0, 1) for a word hash and a sample number."""
    made = []
    for part in range((count + 1) // 2):
        bits = F.xxhash64(word, number, F.lit(part))
        made += [(F.shiftrightunsigned(bits, 32) + 0.5) / float(1 << 32),
                 (bits.bitwiseAND(F.lit((1 << 32) - 1)) + 0.5) / float(1 << 32)]
    return made[:count]


def next_ids(keyed: DataFrame) -> DataFrame:
    """``(key, next_key)`` of rows ``(key, doc_id)``, one per key, in ascending id order.

    Ids are dealt by range; each range finds its own neighbours, and the first id of every
    range, one row each, gives the neighbour of the range before.
    """
    dealt = materialize(keyed.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn(
        "_range", F.spark_partition_id()), "ids")
    order = F.col("doc_id").asc_nulls_first()
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key")
    firsts = dealt.groupBy("_range").agg(F.min(place)["key"].alias("first"))
    everything = W.orderBy("_range")
    whole = everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = firsts.select(
        F.col("_range").alias("_of"),
        F.coalesce(F.lead("first").over(everything), F.first("first").over(whole))
        .alias("_after"))
    inside = dealt.withColumn("_next", F.lead("key").over(
        W.partitionBy("_range").orderBy(order)))
    return inside.join(following, F.col("_range") == F.col("_of")).select(
        "key", F.coalesce("_next", "_after").alias("next_key"))


def _keyed(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("null"))
    text = text_or_empty()
    return docs.select("doc_id", key.alias("key"), text.alias("text"),
                       F.xxhash64(text).alias("text_hash"))


def neighbours(docs: DataFrame) -> DataFrame:
    """``(key, next_key, cut)``: the beginning of the next document that each one needs."""
    keyed = _keyed(docs)
    shapes = materialize(
        keyed.select("doc_id", "key", F.char_length("text").alias("n"), "text_hash")
        .groupBy("doc_id", "key").agg(F.max("n").alias("n"), F.min("text_hash").alias("first")),
        "shapes")
    links = materialize(next_ids(shapes.select("key", "doc_id")), "links")
    wanted = (links.join(shapes.select("key", "n"), "key")
              .join(shapes.select(F.col("key").alias("next_key"), "first"), "next_key")
              .select(F.col("key").alias("for_key"), F.col("next_key").alias("_at"), "first",
                      F.floor(F.col("n") / 4).cast("int").alias("need")))
    cuts = keyed.join(wanted, (F.col("key") == F.col("_at"))
                      & (F.col("text_hash") == F.col("first"))).select(
        F.col("for_key").alias("key"), F.col("_at").alias("next_key"),
        F.left("text", F.col("need")).alias("cut"))
    return materialize(cuts.dropDuplicates(["key"]), "cuts")


def _blank(text: Column) -> Column:
    return F.char_length(F.translate(text, BLANKS, "")) == 0


def edited_words(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Words of texts and edited texts: ``word`` and its weights ``own`` and ``edited``.

    The words before the cut belong to both. The word that the cut may split goes with the
    two tails.
    """
    rows = _keyed(docs).drop("doc_id").join(cuts.select("key", "cut"), "key").withColumn(
        "row", F.monotonically_increasing_id()).withColumn("n_chars", F.char_length("text"))
    replaced = F.floor(F.col("n_chars") / 4).cast("int")
    parts = rows.select(
        "key", "row", "text_hash", "n_chars", "text",
        F.left("text", F.col("n_chars") - replaced).alias("head"),
        F.substring("text", F.col("n_chars") - replaced + 1, F.col("n_chars")).alias("tail"),
        F.left("cut", replaced).alias("new_tail"))
    blanks = F.translate("head", BLANKS, " " * len(BLANKS))
    split = parts.withColumn("open", F.substring_index(blanks, " ", -1)).withColumn(
        "edited_text", F.concat("head", "new_tail"))
    def piece(text: Column, own: int, edited: int) -> Column:
        return F.struct(text.alias("piece"), F.lit(own).alias("own"), F.lit(edited).alias("edited"))

    pieces = F.array(
        piece(F.left("head", F.char_length("head") - F.char_length("open")), 1, 1),
        piece(F.concat("open", "tail"), 1, 0), piece(F.concat("open", "new_tail"), 0, 1))
    texts = split.select(
        "key", "row", "text_hash", "n_chars",
        F.unhex(F.sha2("edited_text", 256)).alias("sha"),
        _blank(F.col("text")).cast("int").alias("no_word"),
        _blank(F.col("edited_text")).cast("int").alias("no_edited_word"),
        F.explode(pieces).alias("p"))
    words = texts.select(
        "key", "row", "text_hash", "n_chars", "sha", "no_word", "no_edited_word", "p.own",
        "p.edited", F.explode(F.split("p.piece", SPACE)).alias("word"))
    empty = F.col("word") == ""
    flagged = words.select(
        "key", "row", "text_hash", "n_chars", "sha", "word",
        F.when(empty, F.col("own") * F.col("no_word")).otherwise(F.col("own")).alias("own"),
        F.when(empty, F.col("edited") * F.col("no_edited_word")).otherwise(F.col("edited"))
        .alias("edited"))
    counted = flagged.where((F.col("own") + F.col("edited")) > 0).groupBy(
        "key", "row", "text_hash", "n_chars", "sha", "word").agg(
        F.sum("own").alias("own"), F.sum("edited").alias("edited"))
    single = [F.when(F.col("word") == "", F.least(F.col(c), F.lit(1))).otherwise(F.col(c))
              .alias(c) for c in ("own", "edited")]
    return counted.select("key", "row", "text_hash", "n_chars", "sha",
                          F.xxhash64("word").alias("word"), *single)


def weighted_samples(words: DataFrame, keys: list[str], weights: list[str],
                     samples: int = SAMPLES) -> DataFrame:
    """``keys`` and, for each weight column, an array of ``samples`` numbers of 24 bits.

    A weight of 0 takes the word out; every text needs a word.
    """
    groups = samples // AT_ONCE
    spread = words.select("*", *(F.log(F.col(w).cast("double")).alias(f"log_{w}")
                                 for w in weights),
                          F.explode(F.array(*map(F.lit, range(groups)))).alias("group"))
    base, scored = [], []
    for i in range(AT_ONCE):
        u = _uniforms(F.col("word"), F.col("group") * AT_ONCE + i, 5)
        base += [(-F.log(u[0] * u[1])).alias(f"r{i}"),
                 F.log(-F.log(u[2] * u[3])).alias(f"c{i}"), u[4].alias(f"b{i}")]
    gammas = spread.select(*keys, "word", "group", *weights, *(f"log_{w}" for w in weights), *base)
    for w in weights:
        for i in range(AT_ONCE):
            r, c, b = F.col(f"r{i}"), F.col(f"c{i}"), F.col(f"b{i}")
            t = F.floor(F.col(f"log_{w}") / r + b)
            score = F.floor((c - r * (t - b) - r + 100.0) * float(1 << 32))
            name = F.xxhash64("word", t).bitwiseAND(F.lit((1 << ID_BITS) - 1))
            packed = F.shiftleft(score, ID_BITS).bitwiseOR(name)
            scored.append(F.min(F.when(F.col(w) > 0, packed)).alias(f"{w}_{i}"))
    least = gammas.groupBy(*keys, "group").agg(*scored)
    arrays = [F.array(*(F.col(f"{w}_{i}").bitwiseAND(F.lit((1 << ID_BITS) - 1))
                        for i in range(AT_ONCE))).alias(w) for w in weights]
    together = least.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("group", *arrays))).alias("all"))
    return together.select(*keys, *(F.flatten(F.transform("all", lambda g: g[w])).alias(w)
                                    for w in weights))


def fingerprint_text(samples: Column) -> Column:
    return F.concat_ws("", F.transform(samples, lambda s: F.lpad(
        F.lower(F.hex(s)), ID_BITS // 4, "0")))


def likeness(left: Column, right: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples, an estimate of the generalised Jaccard similarity."""
    same = F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda equal: equal)
    return F.size(same) / F.lit(float(samples))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all texts and edited texts, and their likeness to each other and to
    the next document."""
    cuts = neighbours(docs)
    words = edited_words(docs, cuts)
    keys = ["key", "row", "text_hash", "n_chars", "sha"]
    made = materialize(weighted_samples(words, keys, ["own", "edited"], samples), "samples")
    following = made.groupBy(F.col("key").alias("_next")).agg(
        F.min(F.struct("text_hash", "own"))["own"].alias("next_own"))
    linked = made.join(cuts.select(F.col("key").alias("_of"), "next_key"),
                       F.col("key") == F.col("_of")).join(
        following, F.col("next_key") == F.col("_next"))
    kind = docs.schema["doc_id"].dataType
    return linked.select(
        F.when(F.col("key") != "null", F.expr("substring(key, 2)")).cast(kind).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        fingerprint_text(F.col("own")).alias("fingerprint"),
        fingerprint_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), samples).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), samples).alias("near_next"))
