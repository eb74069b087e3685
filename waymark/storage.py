"""Where intermediate tables go, and how lineage is cut.

Facts and other reused intermediate results are written as Parquet to the shared folder
the cluster names in ``spark.checkpoint.dir``. A written table survives the loss of
executors, is read once per consumer instead of being recomputed from the raw log, and its
file sizes are known to Catalyst, so broadcast joins are chosen from measured sizes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
LOCAL_DIR = "waymark.local.dir"


# Paths of the tables this process has written, by application.
_written: dict[str, list[str]] = defaultdict(list)


def shared_dir(spark: SparkSession) -> str:
    """The shared working folder named by the session.

    A local-mode session without the setting, as in a first try, gets a temporary folder
    once: on a cluster such a folder would exist on one machine only.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    spark.conf.set(LOCAL_DIR, spark.conf.get(LOCAL_DIR, None)
                   or tempfile.mkdtemp(prefix="waymark-"))
    return spark.conf.get(LOCAL_DIR)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_dir(spark)}/waymark/{label}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for files that :func:`remove_written` shall delete."""
    path = new_path(spark, label)
    _written[spark.sparkContext.applicationId].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table.

    The table stays until :func:`remove_written` is called.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Delete the tables this process has materialised; returns how many.

    To be called when the results that read them have been collected or written.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(settings).delete(place, True)
    return len(paths)
