"""Tables that grow batch by batch and are read by key.

A batch adds one *run*: Parquet files ordered by a hash of the key. When ``FAN`` runs of a
level have come together, they are merged into one run of the next level, so a table of n
batches has a number of runs that follows the logarithm of n, and a row is rewritten that
often. Readers keep to the runs of one version (:mod:`waymark.versions`).

A lookup of few keys pushes their hashes into the scan: the order inside the files lets
Parquet skip row groups and pages that hold none of them, so what is read follows the keys
asked for and not the size of the table. More keys than ``PUSHED`` meet the table in a join.

A batch that is repeated starts from the version before it and replaces its own one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from waymark.versions import Versions

FAN = 6
PUSHED = 400
KEPT_VERSIONS = 3  # older ones lose their files, if no newer version has them
# Small row groups and pages, so that a lookup reads little around its rows.
LAYOUT = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(64 << 10),
          "parquet.page.row.count.limit": "2000"}
_HASH, _BATCH = "_key_hash", "_batch"


class Runs:
    """Rows of ``schema`` by ``key``.

    ``combine`` makes one row of several of the same key, for instance sums; it is applied
    when runs are merged and when they are read, so it must give the same result in steps.
    Its rows carry ``_batch``, the batch they came with.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType,
                 key: Sequence[str], combine: Callable[[DataFrame], DataFrame] | None = None,
                 fan: int = FAN) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.key, self.combine, self.fan = list(key), combine, fan
        self.stored = T.StructType([T.StructField(_HASH, T.LongType()),
                                    T.StructField(_BATCH, T.LongType()), *schema.fields])
        self.versions = Versions(spark, path)

    def runs(self, up_to: int | None = None) -> list[dict]:
        return self.versions.latest(up_to)[1].get("runs", [])

    def _rows(self, runs: Sequence[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(
            *(f"{self.path}/{run['name']}" for run in runs))

    def _combined(self, rows: DataFrame) -> DataFrame:
        return self.combine(rows) if self.combine else rows

    def read(self, up_to: int | None = None) -> DataFrame:
        """All rows up to a batch, or of the latest version."""
        return self._combined(self._rows(self.runs(up_to))).select(*self.schema.fieldNames())

    def lookup(self, keys: DataFrame, up_to: int | None = None) -> DataFrame:
        """The rows whose key is among ``keys``, a frame with the key columns that is read
        twice."""
        rows = self._rows(self.runs(up_to))
        hashed = keys.select(key_hash(self.key).alias(_HASH)).distinct()
        asked = [r[0] for r in hashed.limit(PUSHED + 1).collect()]
        if len(asked) <= PUSHED:
            found = rows.where(F.col(_HASH).isin(asked))
        else:
            found = rows.join(hashed, _HASH, "left_semi")
        # Hashes of different keys may agree.
        exact = keys.select(*(F.col(k).alias(f"_asked_{k}") for k in self.key)).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_asked_{k}")) for k in self.key]
        found = found.join(exact, same, "left_semi")
        return self._combined(found).select(*self.schema.fieldNames())

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Adds a batch, replacing an earlier attempt at it, and merges runs that are due."""
        before = self.runs(batch_id - 1)
        dated = rows.select(key_hash(self.key).alias(_HASH),
                            F.lit(batch_id).cast("long").alias(_BATCH),
                            *self.schema.fieldNames())
        runs = [*before, self._write(dated, 0, batch_id, batch_id)]
        level = 0
        while len(due := [r for r in runs if r["level"] == level]) >= self.fan:
            merged = self._combined(self._rows(due)).select(*self.stored.fieldNames())
            runs = [r for r in runs if r["level"] != level]
            runs.append(self._write(merged, level + 1, due[0]["first"], due[-1]["last"]))
            level += 1
        self.versions.publish(batch_id, {"runs": runs})
        self._clean(batch_id)

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> dict:
        name = f"run-{level}-{uuid.uuid4().hex}"
        (rows.repartitionByRange(_HASH).sortWithinPartitions(_HASH)
         .write.options(**LAYOUT).option(f"parquet.bloom.filter.enabled#{_HASH}", "true")
         .parquet(f"{self.path}/{name}"))
        return {"name": name, "level": level, "first": first, "last": last}

    def _clean(self, batch_id: int) -> None:
        """Deletes files that only versions before the last few have."""
        numbers = [n for n in self.versions.numbers() if n <= batch_id]
        old, kept = numbers[:-KEPT_VERSIONS], numbers[-KEPT_VERSIONS:]
        if old:
            used = {r["name"] for n in kept for r in self.versions.read(n)["runs"]}
            for number in old:
                for run in self.versions.read(number)["runs"]:
                    if run["name"] not in used:
                        self.versions.delete(run["name"])
                self.versions.delete(f"version-{number:012d}.json")


def key_hash(key: Sequence[str]) -> Column:
    return F.xxhash64(*key)


def summed(key: Sequence[str], *sums: str) -> Callable[[DataFrame], DataFrame]:
    """Combines rows of a key by adding; a sum of nulls only stays null."""
    return lambda rows: rows.groupBy(_HASH, *key).agg(
        F.max(_BATCH).alias(_BATCH), *(F.sum(c).alias(c) for c in sums))


def latest(key: Sequence[str], *values: str) -> Callable[[DataFrame], DataFrame]:
    """Keeps the row of the last batch of every key."""
    return lambda rows: rows.groupBy(_HASH, *key).agg(
        F.max_by(F.struct(*values), _BATCH).alias("_last"), F.max(_BATCH).alias("_at")).select(
        _HASH, F.col("_at").alias(_BATCH), *key, *(F.col(f"_last.{v}").alias(v) for v in values))
