"""What the operators of this subpackage share: scratch tables, keys and reading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are A-Z, and the a-z that replace them.
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a local one where it is unset and there is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kelpworks-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of the tables stored since the innermost `passing` began.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/kelpworks-{name}-{uuid.uuid4().hex}"
    if (tables := _PASSING.get()) is not None:
        tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at the end, so what is returned must be stored `lasting`."""
    tables: list[str] = []
    token = _PASSING.set(tables)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in tables:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """df stored beyond the `passing` around it."""
    tables = _PASSING.get()
    found = stored(df, name)
    if tables is not None:
        tables.pop()
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: Column) -> list[Column]:
    """96 bits that name a row by its content, so that a row needs no id; equal rows share it, as they share every verdict."""
    return [F.xxhash64(*cols).alias("k1"), F.hash(*reversed(cols)).alias("k2")]


def blocks_of(items, weight, most):
    """Lists of items whose weights sum to at most `most` (a heavier single item stands alone)."""
    block, total = [], 0
    for item in items:
        w = weight(item)
        if block and total + w > most:
            yield block
            block, total = [], 0
        block.append(item)
        total += w
    if block:
        yield block


#: A side of a join is broadcast when it is counted and has at most so many keys of 12 bytes; beyond that both sides are shuffled.
BROADCAST_KEYS = 500_000


def only_or_without(docs: DataFrame, keys: DataFrame, how: str, cols: list[str]) -> DataFrame:
    """docs joined left_semi or left_anti to a stored table of keys, which is broadcast where its counted size allows."""
    keys = keys.select(*cols).distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, cols, how)
