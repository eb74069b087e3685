"""Personal data, and the words that give it away.

Fixed patterns find addresses, network numbers, card and phone numbers in whole texts. Each
value found is a protected entity. The words of all texts that mention it are counted,
wherever they stand outside of the spans: a word that is rare in general but keeps coming
with the entity carries information about it. With p over all documents and n the number of
different texts with both,

    disclosure(word, entity) = n / (n + PSEUDO)
        * log(p(word, entity) / (p(word) p(entity))) / log(1 / p(entity))

is the share of the entity's information that the word reveals (pointwise mutual information
over information content), lowered where few texts support it. Copies of one text are one
support. A word that comes with the entity only is removed from ``SUPPORT`` texts on and
generalised from two; in a single text every rare word comes with every entity by chance,
and its disclosure is at most 1 / (1 + PSEUDO).

Words above ``REMOVE`` are removed, words above ``GENERALISE`` are replaced by a mark: at
every place of every document, also where the entity is not mentioned, for there they give it
away. A word has the disclosure of the entity it reveals most about.

Counts cover all documents. Words and entities are combined per text before the shuffle. Only
entities of enough texts, and words rare enough, to pass ``GENERALISE`` are paired; the bounds
follow from the formula and leave the result as it is.

Defined results: a null text is empty and has no spans; kinds are searched independently,
leftmost and without overlap per kind; matches that fail their check are dropped without a
second try; repeated rows are treated each and alike; null ids stay; columns beside id and
text do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import free_names, text_or_empty
from waymark.storage import materialize

NEAR = 8  # words on each side of a mention
SUPPORT = 5  # distinct texts from which a word that comes with the entity only is removed
GENERALISE = 0.7
REMOVE = 0.9
PSEUDO = SUPPORT * (1 - REMOVE)  # texts against the pair: 5 / 5.5 is just above REMOVE
SLICE = 500  # texts whose words are in memory at once
COUNTED_WORDS = 200_000
LEAST_SUPPORT = math.floor(PSEUDO * GENERALISE / (1 - GENERALISE)) + 1  # else below GENERALISE

# The patterns, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # A match can only begin where a run of digits begins; saying so keeps long runs cheap.
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

FOUND = ("doc_id {0}, text_hash long, spans array<struct<kind:int,start:long,end:long>>, "
         "entities array<string>, words array<string>")
TERMS = "text_hash long, terms array<struct<start:long,end:long,disclosure:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, tried only where an at sign follows local characters.

    A match begins at the first local character after the last match or other character, so
    it is found by going back from each at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = PATTERNS["email"].match(text, start) if start < at else None
        if match:
            yield match.span()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of all checked matches, by start, then kind."""
    spans = [(0, *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in PATTERNS["ip"].finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                spans.append((1, *m.span()))
        for m in PATTERNS["card"].finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    if "+" in text:
        for m in PATTERNS["phone"].finditer(text):
            if 9 <= sum(map(str.isdecimal, m[0])) <= 15:
                spans.append((3, *m.span()))
    return sorted(spans, key=lambda s: (s[1], s[0]))


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def entity_name(kind: int, value: str) -> str:
    """Equal values in other writing are one entity."""
    plain = value.lower() if kind < 2 else re.sub("[^0-9]", "", value)
    return f"{KINDS[kind]}:{plain}"


def words_outside(text: str, spans: list[tuple[int, int, int]]
                  ) -> Iterator[tuple[str, int, int]]:
    """``(word, start, end)`` for all words that touch no span."""
    inside: list[list[int]] = []  # the union of the spans
    for _, begin, end in spans:
        if inside and begin < inside[-1][1]:
            inside[-1][1] = max(inside[-1][1], end)
        else:
            inside.append([begin, end])
    for m in _WORD.finditer(text):
        place = bisect.bisect_left(inside, [m.end()]) - 1
        if not (place >= 0 and inside[place][1] > m.start()):
            yield m[0].lower(), m.start(), m.end()


def words_near(text: str, spans: list[tuple[int, int, int]]
               ) -> Iterator[tuple[str, str, int, int]]:
    """``(entity, word, start, end)`` for the ``NEAR`` words on each side of each span."""
    outside = {(a, b): word for word, a, b in words_outside(text, spans)}
    places = [m.span() for m in _WORD.finditer(text)] if spans else []
    for kind, begin, end in spans:
        before = [p for p in places if p[1] <= begin][-NEAR:]
        after = itertools.islice((p for p in places if p[0] >= end), NEAR)
        for place in itertools.chain(before, after):
            if place in outside:
                yield entity_name(kind, text[begin:end]), outside[place], *place


def found_spans(docs: DataFrame) -> DataFrame:
    """Base spans of every document; its entities, and its words if it has an entity."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                yield searched(batch.iloc[at:at + SLICE])

    def searched(part: pd.DataFrame) -> pd.DataFrame:
        spans = [base_spans(t) for t in part["text"]]
        return pd.DataFrame({
            "doc_id": part["doc_id"].to_numpy(), "text_hash": part["text_hash"].to_numpy(),
            "spans": [[dict(zip(("kind", "start", "end"), s)) for s in own] for own in spans],
            "entities": [list({entity_name(k, t[a:b]) for k, a, b in own})
                         for t, own in zip(part["text"], spans)],
            "words": [list({w for w, _, _ in words_outside(t, own)}) if own else []
                      for t, own in zip(part["text"], spans)]
            }).astype({"doc_id": part.dtypes["doc_id"]})

    text = text_or_empty()
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")
                       ).mapInPandas(search, FOUND.format(kind))


def words_in(text: str) -> set[str]:
    return {word.lower() for word in set(_WORD.findall(text))}


def text_words(docs: DataFrame) -> DataFrame:
    """``(text_hash, word)``: the different words of every document."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at:at + SLICE]
                own = [list(words_in(t)) for t in part["text"]]
                yield pd.DataFrame({
                    "text_hash": part["text_hash"].repeat([len(w) for w in own]).to_numpy(),
                    "word": list(itertools.chain.from_iterable(own))})

    text = text_or_empty()
    return docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInPandas(
        split, "text_hash long, word string")


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, documents)``: in how many documents each word occurs."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(words_in(text))
                if len(counts) >= COUNTED_WORDS:
                    yield pd.DataFrame(counts.items(), columns=["word", "documents"])
                    counts.clear()
        if counts:
            yield pd.DataFrame(counts.items(), columns=["word", "documents"])

    counted = docs.select(text_or_empty().alias("text")).mapInPandas(
        count, "word string, documents long")
    return counted.groupBy("word").agg(F.sum("documents").alias("documents"))


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(entity, word, disclosure)`` of all pairs above ``GENERALISE``."""
    texts = found.where(F.size("spans") > 0)
    copies = texts.groupBy(F.col("text_hash").alias("_copied")).agg(
        F.count("*").alias("copies"))
    mentions = (texts.select("text_hash", F.explode("entities").alias("entity")).distinct()
                .join(copies, F.col("text_hash") == F.col("_copied")))
    entities = materialize(
        mentions.groupBy(F.col("entity").alias("_entity")).agg(
            F.count("*").alias("texts"), F.sum("copies").alias("own"))
        .where(F.col("texts") >= LEAST_SUPPORT), "entities")
    mentions = materialize(
        mentions.join(entities, F.col("entity") == F.col("_entity"))
        .select("text_hash", "entity", "copies", "own"), "mentions")
    held = mentions.groupBy(F.col("text_hash").alias("_hash")).agg(F.max("own").alias("most"))
    candidates = materialize(
        texts.join(held, F.col("text_hash") == F.col("_hash"))
        .select("text_hash", F.explode("words").alias("word"), "most").distinct(), "candidates")
    total = float(max(docs.count(), 1))
    general = word_counts(docs).withColumnRenamed("word", "_word")
    # Above GENERALISE, documents < both * (total / own) ** (1 - GENERALISE), and both <= own.
    most = F.pow("most", F.lit(GENERALISE)) * (total ** (1 - GENERALISE) * (1 + 1e-9))
    rare = candidates.join(general, (F.col("word") == F.col("_word"))
                           & (F.col("documents") <= most)).select(
        F.col("text_hash").alias("_hash"), "word", "documents")
    counted = mentions.join(rare, F.col("text_hash") == F.col("_hash")).groupBy(
        "entity", "word").agg(
        F.count("*").alias("support"), F.sum("copies").alias("both"),
        F.max("own").alias("own"), F.max("documents").alias("documents"))
    information = F.log(F.lit(total) / F.col("own"))
    mutual = F.log(F.col("both") * total / (F.greatest("documents", "both") * F.col("own")))
    certain = F.col("support") / (F.col("support") + PSEUDO)
    return counted.select("entity", "word", F.when(
        information > 0, certain * mutual / information).otherwise(0.0).alias("disclosure")
        ).where(F.col("disclosure") > GENERALISE)


def found_terms(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """``(text_hash, terms)``: all places of telling ``(word, disclosure)``, one row per
    different text that has one."""
    revealed = telling.select(F.col("word").alias("_word"), "disclosure")
    held = text_words(docs).join(revealed, F.col("word") == F.col("_word")).select(
        "text_hash", "word", "disclosure").distinct()
    held = held.groupBy(F.col("text_hash").alias("_hash")).agg(  # the words of one text
        F.collect_list(F.struct("word", "disclosure")).alias("held"))
    held = materialize(held, "held")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                yield placed_words(batch.iloc[at:at + SLICE])

    def placed_words(part: pd.DataFrame) -> pd.DataFrame:
        terms = []
        for text, own in zip(part["text"], part["held"]):
            known = {h["word"]: h["disclosure"] for h in own}
            terms.append([{"start": a, "end": b, "disclosure": known[w]}
                          for w, a, b in words_outside(text, base_spans(text)) if w in known])
        return pd.DataFrame({"text_hash": part["text_hash"].to_numpy(), "terms": terms})

    text = text_or_empty()
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))
    placed = texts.join(held, F.col("text_hash") == F.col("_hash")).select(
        "text_hash", "text", "held").mapInPandas(place, TERMS)
    return placed.where(F.size("terms") > 0).dropDuplicates(["text_hash"])


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, spans, terms)``: base spans, and revealing words with their
    disclosure, per document."""
    found = materialize(found_spans(docs), "spans")
    telling = materialize(disclosures(docs, found).groupBy("word").agg(
        F.max("disclosure").alias("disclosure")), "telling")
    terms = materialize(found_terms(docs, telling), "terms").withColumnRenamed(
        "text_hash", "_hash")
    return found.join(terms, F.col("text_hash") == F.col("_hash"), "left").select(
        "doc_id", "text_hash", "spans", "terms")


def sanitised(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; entities become their kind, revealing words a mark or
    nothing."""
    spans = personal_data(docs).where((F.size("spans") > 0) | F.col("terms").isNotNull())
    key, found, telling = free_names(docs, "_hash", "_spans", "_terms")
    marked = spans.select(F.col("text_hash").alias(key), F.col("spans").alias(found),
                          F.col("terms").alias(telling)).dropDuplicates([key])
    marked = materialize(marked, "marked")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else replace_spans(t, s, w) for t, s, w in zip(
            texts, spans, terms)], dtype=object)

    joined = docs.join(marked.hint("merge"), F.xxhash64(text_or_empty()) == F.col(key), "left")
    return joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(
        cleaned("text", found, telling))).select(*docs.columns)


def replace_spans(text: str, spans, terms) -> str:
    """Spans that overlap are replaced together, by the kind of the first."""
    edits = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in spans]
    for t in terms if terms is not None else ():
        edits.append((t["start"], t["end"], "" if t["disclosure"] > REMOVE else "[WORD]"))
    parts, at = [], 0
    for start, end, mark in sorted(edits):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the base spans, and all spans as text."""
    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                  "spans string")
    def described(spans: pd.Series, terms: pd.Series) -> pd.DataFrame:
        rows = []
        for base, words in zip(spans, terms):
            own = [(s["kind"], s["start"], s["end"]) for s in base]
            counts = [sum(k == kind for k, _, _ in own) for kind in range(4)]
            every = own + [(4, t["start"], t["end"]) for t in (() if words is None else words)]
            digest = hashlib.sha256(span_text(own).encode()).hexdigest()
            rows.append((*counts, digest, span_text(sorted(every, key=lambda s: (s[1], s[0])))))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone",
                                           "base_sha256", "spans"])

    return personal_data(docs).select("doc_id", described("spans", "terms").alias("r")).select(
        "doc_id", "r.*")
