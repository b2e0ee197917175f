"""Numbered commits in a folder: each number is taken by one writer only."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """Entries 0, 1, 2 and so on as small JSON files. A file system whose rename replaces what is there (plain object
    stores) can't keep writers apart; HDFS and local disks can, the latter by hard links."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at, fs = self._at()
        if not fs.exists(at):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(at))
        return sorted(int(name) for name in names if name.isdigit())

    def read(self, number: int) -> dict:
        at, fs = self._at(f"{number:012d}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, number: int, entry: dict) -> bool:
        """Writes the entry whole, or returns False if the number is taken."""
        folder, fs = self._at()
        fs.mkdirs(folder)
        folder = fs.resolvePath(folder)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        draft, at = path(folder, f".{uuid.uuid4().hex}"), path(folder, f"{number:012d}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), at.toUri().getPath())
                return True
            return bool(fs.rename(draft, at))
        except FileExistsError:
            return False
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        finally:
            fs.delete(draft, False)
