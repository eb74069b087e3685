"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from waymark.storage import materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; white space is ``SPACE``."""
    return F.array_remove(F.split(text, SPACE), "")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names no column of ``df`` has yet; Spark compares names without case."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                sums: dict[str, str], rank: str, label: str,
                dealt_by: Sequence[str] | None = None) -> DataFrame:
    """Running sums before each row, and its rank from 0, within ``keys`` by ``order``.

    ``sums`` maps a new column to the column it adds up. A group may hold most of the rows:
    rows are dealt by range of (keys, order), summed inside each range, and the totals of the
    earlier ranges of the same group are added. Only range totals meet in one window, one row
    per range and group. ``order`` should tell rows apart; equal rows take any order. The
    ranges are those of (keys, ``dealt_by``) if given: a first part of ``order`` without long
    texts, which would be sampled.
    """
    dealt = materialize(
        df.repartitionByRange(*keys, *(dealt_by or order)).withColumn("_range", F.spark_partition_id()), label)
    window = W.partitionBy("_range", *keys).orderBy(*order)
    before = window.rowsBetween(W.unboundedPreceding, -1)
    local = dealt.select("*", (F.row_number().over(window) - 1).cast("long").alias(rank), *(
        F.coalesce(F.sum(F.col(source)).over(before), F.lit(0)).cast("long").alias(name)
        for name, source in sums.items()))
    totals = dealt.groupBy("_range", *keys).agg(
        F.count("*").alias("_rows"),
        *(F.sum(source).alias(f"_total_{name}") for name, source in sums.items()))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_range").alias("_at"), *(F.col(k).alias(f"_key_{k}") for k in keys),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rank_before"),
        *(F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
          for name in sums))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return local.join(offsets, same).select(
        *df.columns, (F.col(rank) + F.col("_rank_before")).alias(rank),
        *((F.col(name) + F.col(f"_before_{name}")).alias(name) for name in sums))
