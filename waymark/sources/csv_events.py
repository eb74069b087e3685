"""``user,event`` text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from waymark.functions.dates import week_of_arrival
from waymark.schemas import DEFAULT_NAMESPACE
from waymark.storage import materialize

# Spark numbers the rows of a task in the low 33 bits of its generated id.
TASK_ROW_BITS = 33
# The place in a file takes the low bits of the order number, the file's rank the high bits.
FILE_PLACE_BITS = 42


def events_from_lines(lines: DataFrame, line: str = "value", seq: str = "seq",
                      event_prefix: str = "", goal: bool = False) -> DataFrame:
    """Split at the first comma, trim both parts, prefix the event name.

    A line without a comma has no event; it is dropped here and can be listed by filtering
    the input with ``instr(line, ',') = 0``.
    """
    parts = F.split(F.col(line), ",", 2)
    return (lines.filter(F.instr(F.col(line), ",") > 0)
            .select(F.col(seq).alias("seq"),
                    F.lit(DEFAULT_NAMESPACE).alias("namespace"),
                    F.concat(F.lit(event_prefix), F.trim(parts[1])).alias("event_name"),
                    F.trim(parts[0]).alias("user_id"),
                    F.lit(None).cast("double").alias("value"),
                    F.lit(goal).alias("ensure_goal"),
                    *week_of_arrival()))


def _ranked(files: DataFrame) -> DataFrame:
    """``(_path, _rank)``: ranges of paths are ranked side by side, then put in order."""
    dealt = materialize(files.repartitionByRange("_path").withColumn(
        "_range", F.spark_partition_id()), "files")
    inside = Window.partitionBy("_range").orderBy("_path")
    earlier = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(F.col("_range").alias("_at")).agg(F.count("*").alias("_files"))
    offsets = before.select("_at", F.coalesce(F.sum("_files").over(earlier), F.lit(0))
                            .alias("_before"))
    return dealt.join(offsets, F.col("_range") == F.col("_at")).select(
        "_path", (F.row_number().over(inside) - 1 + F.col("_before")).alias("_rank"))


def read_event_files(spark: SparkSession, path: str, event_prefix: str = "",
                     goal: bool = False) -> DataFrame:
    """Read line files in order of file path, then of place in the file, in one scan.

    Inside a file the order is the split's byte offset plus the row's number in its task.
    Every line takes at least one byte, so a later split always starts higher. Only the
    list of files is ranked, never the lines, and it is ranked in ranges of paths. More than
    2^21 files or a place beyond 2^42 is an error: the order number could not hold it.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << TASK_ROW_BITS) - 1))
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"),
        (F.col("_metadata.file_block_start") + row).alias("_place"))
    # Written, so that its size decides how it joins: lines stay in place beside a short list.
    files = materialize(_ranked(spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("_path"))), "ranks")
    fits = (F.col("_rank") < 1 << (63 - FILE_PLACE_BITS)) & (
        F.col("_place") < 1 << FILE_PLACE_BITS)
    ordered = lines.join(files, "_path").select("value", F.when(
        fits, F.shiftleft(F.col("_rank").cast("long"), FILE_PLACE_BITS) + F.col("_place"))
        .otherwise(F.raise_error(F.lit("too many files or too large a file for the order")))
        .alias("seq"))
    return events_from_lines(ordered, event_prefix=event_prefix, goal=goal)
