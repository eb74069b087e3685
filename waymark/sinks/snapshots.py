"""Snapshots of facts, counters, goals and specs as Parquet; a missing snapshot reads as empty.

A snapshot is versioned (:mod:`waymark.versions`): its files are written below a name of their
own and become the snapshot by one rename. A failed write leaves the snapshot before it, and
a reader never sees half of one. One writer per snapshot; files of older versions are deleted
when ``KEPT_VERSIONS`` newer ones exist, so readers that take longer need a larger number.

Counters can be written as changes: only the counters that changed since the last snapshot.
After ``MOST_PARTS`` of them the parts are merged.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from waymark.schemas import COUNTER_KEY, COUNTERS, FIRST_WRITES, FLAG_SPECS, GOALS
from waymark.versions import Versions

KEPT_VERSIONS = 3
MOST_PARTS = 8
FOLDERS = ("namespace", "counter_type")


def _write(rows: DataFrame, path: str, order: tuple[str, ...] = (),
           folders: tuple[str, ...] = ()) -> str:
    """Files below a new name, which is returned; nobody reads them yet."""
    name = f"data-{uuid.uuid4().hex}"
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.partitionBy(*folders).parquet(f"{path.rstrip('/')}/{name}")
    return name


def _publish(spark: SparkSession, path: str, parts: list[str]) -> int:
    """Makes ``parts`` the snapshot; returns its version."""
    versions = Versions(spark, path)
    number = versions.latest()[0] + 1
    versions.publish(number, {"parts": parts})
    numbers = versions.numbers()
    old, kept = numbers[:-KEPT_VERSIONS], numbers[-KEPT_VERSIONS:]
    used = {part for n in kept for part in versions.read(n)["parts"]}
    for n in old:
        for part in set(versions.read(n)["parts"]) - used:
            versions.delete(part)
        versions.delete(f"version-{n:012d}.json")
    return number


def _parts(spark: SparkSession, path: str, version: int | None) -> list[str]:
    return Versions(spark, path).latest(version)[1].get("parts", [])


def _read(spark: SparkSession, path: str, schema: T.StructType, part: str) -> DataFrame:
    # Folder columns are read last; the schema's order is restored.
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{part}").select(
        *schema.fieldNames())


def _read_whole(spark: SparkSession, path: str, schema: T.StructType,
                version: int | None) -> DataFrame:
    parts = _parts(spark, path, version)
    return _read(spark, path, schema, parts[0]) if parts else spark.createDataFrame([], schema)


COUNTER_ORDER = ("namespace", "counter_type", "event_name", "iso_year", "iso_week")


def write_counters(totals: DataFrame, path: str) -> int:
    """Folders by namespace and counter type; inside, rows are sorted by event and week.

    Event names can be very many, so they are not folders: the sort gives each file a
    narrow range of names, and readers skip by the file's minimum and maximum.
    """
    name = _write(totals.select(*COUNTERS.fieldNames()), path, COUNTER_ORDER, FOLDERS)
    return _publish(totals.sparkSession, path, [name])


def write_changed_counters(changed: DataFrame, path: str) -> int:
    """Adds the counters of ``changed`` (with their new totals) to the snapshot."""
    spark = changed.sparkSession
    name = _write(changed.select(*COUNTERS.fieldNames()), path, COUNTER_ORDER, FOLDERS)
    parts = [*_parts(spark, path, None), name]
    if len(parts) > MOST_PARTS:
        parts = [_write(_last_of(spark, path, parts), path, COUNTER_ORDER, FOLDERS)]
    return _publish(spark, path, parts)


def _last_of(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """Every counter with the totals of the last part that has it."""
    rows = reduce(DataFrame.union, (
        _read(spark, path, COUNTERS, part).withColumn("part", F.lit(number))
        for number, part in enumerate(parts)))
    values = [c for c in COUNTERS.fieldNames() if c not in COUNTER_KEY]
    return rows.groupBy(*COUNTER_KEY).agg(
        F.max_by(F.struct(*values), "part").alias("last")).select(*COUNTER_KEY, "last.*")


def read_counters(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest snapshot, or the last one not after ``version``."""
    parts = _parts(spark, path, version)
    if len(parts) > 1:
        return _last_of(spark, path, parts)
    return _read_whole(spark, path, COUNTERS, version)


def write_facts(facts: DataFrame, path: str) -> int:
    """Facts by namespace and counter type, so that readers open only what they ask for.

    Rows are dealt by range first, so a task writes to few folders.
    """
    name = _write(facts.select(*FIRST_WRITES.fieldNames()), path,
                  (*FOLDERS, "event_name", "user_id"), FOLDERS)
    return _publish(facts.sparkSession, path, [name])


def read_facts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _read_whole(spark, path, FIRST_WRITES, version)


def write_goals(goals: DataFrame, path: str) -> int:
    return _publish(goals.sparkSession, path, [_write(goals.select(*GOALS.fieldNames()), path)])


def read_goals(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _read_whole(spark, path, GOALS, version)


def write_specs(specs: DataFrame, path: str) -> int:
    name = _write(specs.select(*FLAG_SPECS.fieldNames()), path)
    return _publish(specs.sparkSession, path, [name])


def read_specs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _read_whole(spark, path, FLAG_SPECS, version)
