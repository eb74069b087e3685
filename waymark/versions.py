"""Numbered versions of a table, each a small document that names the files it consists of.

Data files are written first, under names of their own. A version becomes visible by one
rename of its document: a writer that fails leaves the earlier version as it was, and a reader
keeps to the files of the version it has opened.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import SparkSession

_NAME = re.compile(r"version-(\d{12})\.json")


class Versions:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.gateway, self.jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.place = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.place.getFileSystem(settings)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.files.makeQualified(self.place).toUri(), settings)

    def _file(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """All published versions, in order."""
        if not self.files.exists(self.place):
            return []
        names = (status.getPath().getName() for status in self.files.listStatus(self.place))
        return sorted(int(found[1]) for found in map(_NAME.fullmatch, names) if found)

    def read(self, number: int) -> dict:
        stream = self.files.open(self._file(f"version-{number:012d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def latest(self, up_to: int | None = None) -> tuple[int, dict]:
        """The last version, or the last one not after ``up_to``; (-1, {}) before the first."""
        known = [n for n in self.numbers() if up_to is None or n <= up_to]
        return (known[-1], self.read(known[-1])) if known else (-1, {})

    def publish(self, number: int, document: dict) -> None:
        """Makes a version visible, or replaces it, as a whole."""
        new = self._file(f".new-{uuid.uuid4().hex}")
        stream = self.files.create(new)
        stream.write(bytearray(json.dumps(document).encode("utf-8")))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.gateway.new_array(rename, 1)
        flags[0] = rename.OVERWRITE
        self.context.rename(new, self._file(f"version-{number:012d}.json"), flags)

    def delete(self, name: str) -> None:
        self.files.delete(self._file(name), True)

    def entries(self) -> list[str]:
        if not self.files.exists(self.place):
            return []
        return [status.getPath().getName() for status in self.files.listStatus(self.place)]
