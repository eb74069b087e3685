"""Joining documents by the Jaccard similarity of their five-word shingles.

The bands are chosen for a recall of ``minhash.RECALL`` at the similarity limit; every pair
that shares a band is verified on the full shingle sets. The result has one row per document:
its group of connected documents and the number of documents it links to, so that copies and
large groups are never expanded into pairs.

Defined results: words are separated by U+0020 and U+0009 to U+000D; a text of fewer than
five words is one shingle; texts without words (also null ones) are copies of each other;
repeated rows are copies. The group's ``class_id`` is its smallest id; a null id gets that of
its group, which is null if it has no other id. Ids may be missing or repeated, so only
``class_digest``, the digest of the words of the group's first text (by id, null last, then
text), tells groups apart. Columns beside id and text do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import free_names, text_or_empty
from waymark.llm.minhash import (RECALL, SIMILARITY, link_counts, link_groups, nodes_of,
                                 plan_bands, signatures)
from waymark.storage import materialize

ROWS = 5


def groups_of(docs: DataFrame, similarity: float, recall: float, with_links: bool) -> DataFrame:
    bands = plan_bands(similarity, recall, ROWS)
    signed = materialize(signatures(docs, bands, ROWS, False), "signatures")
    nodes = materialize(nodes_of(signed), "nodes")
    roots, sets = link_groups(docs, nodes, False, similarity)
    labelled = (nodes.select("node", "digest", "copies", "at")
                .join(roots.select(F.col("node").alias("_in"), "root"),
                      F.col("node") == F.col("_in"), "left")
                .withColumn("root", F.coalesce("root", "node")))
    if with_links:
        counted = link_counts(nodes, roots, sets, similarity).select(
            F.col("node").alias("_linked"), F.col("linked_copies").alias("linked"))
        labelled = labelled.join(counted, F.col("node") == F.col("_linked"), "left")
    else:
        labelled = labelled.withColumn("linked", F.lit(None).cast("long"))
    order = F.struct(F.col("at.doc_id").isNull().alias("lost"), "at", "digest")
    names = labelled.groupBy(F.col("root").alias("_root")).agg(F.min(order).alias("first"))
    named = labelled.join(names, F.col("root") == F.col("_root")).select(
        F.col("digest").alias("_digest"), F.col("first.at.doc_id").alias("class_id"),
        F.lower(F.hex("first.digest")).alias("class_digest"),
        F.col("at.doc_id").alias("copies_id"), "copies",
        F.coalesce("linked", F.lit(0)).alias("linked"))
    return signed.select("doc_id", "text_hash", "digest").join(
        named, F.col("digest") == F.col("_digest")).select(
        "doc_id", "text_hash", "class_id", "class_digest", "copies_id",
        F.col("copies").alias("n_copies"),
        (F.col("linked") + F.col("copies") - 1).alias("n_links"))


def ngram_links(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL
                ) -> DataFrame:
    """``(doc_id, text_hash, class_id, class_digest, copies_id, n_copies, n_links)`` per
    document.

    ``class_digest`` identifies the group of connected documents and ``class_id`` is its
    smallest id. ``copies_id`` names the group of equal word sequences, ``n_copies`` counts it;
    ``n_links`` counts the other documents of at least this similarity, copies included.
    """
    return groups_of(docs, similarity, recall, True)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; of each group the first document, by id (null last) and text
    hash, stays. Groups are told apart by their digest, not by ids."""
    row = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash")
    first = groups_of(docs, SIMILARITY, RECALL, False).groupBy("class_digest").agg(F.min(row).alias("first"))
    own, kept_hash, kept_id = free_names(docs, "_hash", "_kept_hash", "_kept_id")
    kept = first.select(F.col("first.text_hash").alias(kept_hash),
                        F.col("first.doc_id").alias(kept_id))
    chosen = docs.withColumn(own, F.xxhash64(text_or_empty())).join(
        kept.hint("merge"), (F.col(own) == F.col(kept_hash))
        & F.col("doc_id").eqNullSafe(F.col(kept_id)))
    return chosen.dropDuplicates([own, kept_id]).select(*docs.columns)
