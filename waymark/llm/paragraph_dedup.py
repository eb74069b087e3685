"""Repeated paragraphs: MinHash bands over lines, exact verification, removal by component.

A paragraph is a line with a word. Similar paragraphs (Jaccard similarity of their five-word
shingles, or equal words) form components; in each the first paragraph, by document id and
place, stays and the others are removed.

Defined results: a paragraph of fewer than five words is one shingle. Null texts have no
paragraphs; null ids come last in a component; repeated rows are documents of their own, of
which all but one lose their paragraphs. Columns beside id and text do not matter; an empty
table gives an empty result.

Repeated passages are those of many words: long similar paragraphs, and what is equal word for
word inside longer lines or across them (see :mod:`waymark.llm.passages`).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from waymark.llm.common import free_names, text_or_empty
from waymark.llm.minhash import (RECALL, SIMILARITY, link_groups, nodes_of, plan_bands,
                                 signatures)
from waymark.llm.passages import shared_passages
from waymark.storage import materialize

ROWS = 3
PASSAGE = 50  # words


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL,
                        least: int = 1) -> DataFrame:
    """One row per paragraph of at least ``least`` words that has a similar one: ``(doc_id,
    text_hash, paragraph, start, end, n_words, cluster_doc_id, cluster_paragraph, n_members,
    removed)``.

    ``start`` and ``end`` are code points; the cluster is named by the paragraph that stays.
    """
    bands = plan_bands(similarity, recall, ROWS)
    # Bands are by far the widest column: they are written once per distinct line, and the
    # digests of all lines are made a second time for the result.
    nodes = materialize(nodes_of(signatures(docs, bands, ROWS, True, least)), "nodes")
    roots, _ = link_groups(docs, nodes, True, similarity)
    clustered = (nodes.select("node", "digest", "copies", "at")
                 .join(roots.select(F.col("node").alias("_in"), "root"),
                       F.col("node") == F.col("_in"), "left")
                 .withColumn("root", F.coalesce("root", "node")))
    order = F.struct(F.col("at.doc_id").isNull().alias("lost"), F.col("at").alias("at"))
    stays = clustered.groupBy(F.col("root").alias("_root")).agg(
        F.min(order)["at"].alias("stays"), F.sum("copies").alias("n_members"),
    ).where(F.col("n_members") > 1)
    members = clustered.join(stays, F.col("root") == F.col("_root")).select(
        F.col("digest").alias("_digest"), "stays", "n_members")
    signed = signatures(docs, 0, ROWS, True, least).drop("bands")
    found = signed.join(members, F.col("digest") == F.col("_digest"))
    first = (F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))
             & (F.col("no") == F.col("stays.no"))
             & (F.col("text_hash") == F.col("stays.text_hash")))
    return found.select(
        "doc_id", "text_hash", F.col("no").alias("paragraph"), "start", "end", "n_words",
        F.col("stays.doc_id").alias("cluster_doc_id"),
        F.col("stays.no").alias("cluster_paragraph"), "n_members", (~first).alias("removed"))


def repeated_passages(docs: DataFrame, least: int = PASSAGE, similarity: float = SIMILARITY,
                      recall: float = RECALL) -> DataFrame:
    """One row per repeated passage of at least ``least`` words, of two kinds: ``(doc_id,
    text_hash, kind, paragraph, start, end, n_words, cluster_doc_id, cluster_paragraph,
    cluster_word, n_members, removed)``.

    A ``line`` is a paragraph with a similar one (:func:`repeated_paragraphs`), named by line
    numbers. A ``passage`` is equal, word for word, to one elsewhere, and may be part of a line
    or run over several (:func:`passages.shared_passages`). Equal lines show up as both.
    """
    same = W.partitionBy("doc_id", "text_hash", "paragraph").orderBy("start")  # equal rows
    lines = repeated_paragraphs(docs, similarity, recall, least).withColumn(
        "removed", F.col("removed") | (F.row_number().over(same) > 1))
    nothing, none = F.lit(None).cast("int"), F.lit(None).cast("long")
    columns = ["doc_id", "text_hash", "kind", "paragraph", "start", "end", "n_words",
               "cluster_doc_id", "cluster_paragraph", "cluster_word", "n_members", "removed"]
    return (lines.withColumns({"kind": F.lit("line"), "cluster_word": none}).select(columns)
            .unionByName(shared_passages(docs, least).withColumns({
                "kind": F.lit("passage"), "paragraph": nothing, "cluster_paragraph": nothing,
            }).select(columns)))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, the text without its removed paragraphs."""
    own, key, of, gone_lines = free_names(docs, "_hash", "_id", "_of", "_gone")
    removed = repeated_paragraphs(docs).where("removed").groupBy(
        F.col("doc_id").alias(key), F.col("text_hash").alias(of)).agg(
        F.sort_array(F.collect_set("paragraph")).alias(gone_lines))  # lines of one document
    keyed = docs.withColumn(own, F.xxhash64(text_or_empty()))
    joined = keyed.join(removed.hint("merge"), (F.col(own) == F.col(of))
                        & F.col("doc_id").eqNullSafe(F.col(key)), "left")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([
            text if lines is None or text is None else "\n".join(
                line for n, line in enumerate(text.split("\n")) if n not in set(lines))
            for text, lines in zip(texts, gone)], dtype=object)

    return joined.withColumn("text", rest("text", gone_lines)).select(*docs.columns)
