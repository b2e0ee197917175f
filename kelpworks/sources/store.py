"""The chunk store: Parquet folders a collection, and a log of numbered commits that says which of them count.

A commit adds folders or stands for the whole collection. Writers don't lock: data is written first, then the next number
is claimed. Additions take whichever number is free. What depends on the rows that are there (replacing, deleting, adding
what is missing) must get the number after the one it read, else it is worked out again on what is there by then. So a
failed or late writer loses nothing of another's, and readers see whole commits only. Folders of commits that a later
whole one replaced are left for readers that still use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.sources.commits import CommitLog

SCHEMA = "chunk_id string, content string, meta map<string,string>, embedding array<float>"

#: Keys and bytes of keys up to which they are sent to all executors, in place of moving the collection's rows.
SMALL_KEYS, SMALL_BYTES = 500_000, 16 << 20


def sized(keys: DataFrame) -> DataFrame:
    """One string column, distinct, to be broadcast if it was found small."""
    name = keys.columns[0]
    keys = keys.distinct()
    n, held = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    return F.broadcast(keys) if n <= SMALL_KEYS and held <= SMALL_BYTES else keys


class Conflict(RuntimeError):
    """Others committed each time first."""


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA, chunk_id: str = "chunk_id", tries: int = 20):
        self.spark, self.path, self.schema, self.chunk_id, self.tries = spark, path.rstrip("/"), schema, chunk_id, tries
        self.names = [f.name for f in spark.createDataFrame([], schema).schema]

    def _log(self, collection: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.path}/{collection}/_log")

    def _now(self, collection: str) -> tuple[int, list[str]]:
        """The last commit's number (0: none) and the folders that count there."""
        log, data = self._log(collection), []
        numbers = log.numbers()
        for n in reversed(numbers):
            entry = log.read(n)
            data = entry["data"] + data
            if entry["whole"]:
                break
        return (numbers[-1] if numbers else 0), data

    def _of(self, collection: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{collection}/{f}" for f in folders))

    def _save(self, df: DataFrame, collection: str) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        df.select(*self.names).write.parquet(f"{self.path}/{collection}/{folder}")
        return folder

    def _drop(self, collection: str, folder: str) -> None:
        """A folder that no commit names."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{collection}/{folder}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _change(self, collection: str, make: Callable[[DataFrame], DataFrame], whole: bool) -> None:
        """Commits make(rows that are there) right after the commit that was read, or tries again."""
        for _ in range(self.tries):
            number, folders = self._now(collection)
            folder = self._save(make(self._of(collection, folders)), collection)
            if self._log(collection).put(number + 1, {"whole": whole, "data": [folder]}):
                return
            self._drop(collection, folder)
        raise Conflict(f"{collection}: {self.tries} tries")

    def read(self, collection: str, where=None) -> DataFrame:
        """Pruned to the collection's files; the filter reaches the scan."""
        df = self._of(collection, self._now(collection)[1]).withColumn("collection", F.lit(collection))
        return df if where is None else df.where(where)

    def append(self, df: DataFrame, collection: str) -> None:
        """S12."""
        folder, log = self._save(df, collection), self._log(collection)
        while not log.put(max(log.numbers(), default=0) + 1, {"whole": False, "data": [folder]}):
            pass

    def append_missing(self, df: DataFrame, collection: str) -> None:
        """Rows of df whose id the collection lacks, also where several writers ask for the same one at once. Rows that
        share an id within df all count as one writer's; rows without an id are always added."""
        self._change(collection, lambda rows: df.join(sized(rows.select(self.chunk_id)), self.chunk_id, "left_anti"), whole=False)

    def count(self, collection: str) -> int:
        """S11."""
        return self.read(collection).count()

    def has(self, collection: str, key: str, value: str) -> bool:
        """Stops at the first row."""
        return not self.read(collection, F.col("meta")[key] == value).limit(1).isEmpty()

    def delete(self, collection: str, key: str, keys: DataFrame) -> None:
        """An anti-join by a metadata key (keys: one column); rows without the key stay."""
        gone = sized(keys.select(F.col(keys.columns[0]).cast("string").alias("__k")))
        self._change(collection, lambda rows: rows.withColumn("__k", F.col("meta")[key]).join(gone, "__k", "left_anti"), whole=True)

    def clear(self, collection: str) -> None:
        """S16."""
        self._change(collection, lambda rows: rows.limit(0), whole=True)

    def upsert(self, df: DataFrame, collection: str, key: str) -> None:
        """What df has replaces all rows of its keys, in one commit."""
        keys = sized(df.select(F.col("meta")[key].alias("__k")).where("__k is not null"))
        kept = lambda rows: rows.withColumn("__k", F.col("meta")[key]).join(keys, "__k", "left_anti").select(*self.names)
        self._change(collection, lambda rows: kept(rows).unionByName(df.select(*self.names)), whole=True)

    def copy_missing(self, source: str, target: str, embed) -> None:
        """Chunks that the target lacks, with new vectors; embed maps a DataFrame to one with `embedding`."""
        modes = [self.read(c).select(F.col("meta")["chunkingMode"].alias("m")).where("m is not null").distinct().limit(2).collect() for c in (source, target)]
        if all(modes) and {r["m"] for r in modes[0]} != {r["m"] for r in modes[1]}:
            raise ValueError("collections were chunked in different modes")
        rows = self.read(source).drop("collection")
        self._change(target, lambda own: embed(rows.join(sized(own.select(self.chunk_id)), self.chunk_id, "left_anti").drop("embedding")), whole=False)

    def rebuild(self, rows: DataFrame, collection: str, key: str, name: str, make: Callable[[DataFrame], DataFrame] = lambda df: df, pages: int = 50) -> None:
        """The collection anew from rows, in pages along an integer key; make turns a page into chunks.

        Each page is committed to the build's own log, so a build of the same name that was interrupted goes on after its
        last page. The pages' bounds are found once, in one pass, and cover all keys whatever their spread (null keys are in
        the first page), so each page is one filtered scan. Readers see the old rows until all pages are there. Rows that
        others add meanwhile stay; if others replaced the collection meanwhile, Conflict is raised and nothing changes.
        """
        log, main = CommitLog(self.spark, f"{self.path}/{collection}/_build-{name}"), self._log(collection)
        if not log.numbers():
            parts = [i / pages for i in range(1, pages)]
            found = rows.agg(F.percentile_approx(key, parts, 100 * pages)).first()[0] if parts else []
            log.put(0, {"base": self._now(collection)[0], "marks": sorted(set(found or []))})
        plan, done = log.read(0), set(log.numbers())
        edges = [None, *plan["marks"], None]
        for i, (after, to) in enumerate(zip(edges, edges[1:], strict=False), 1):
            if i in done:
                continue
            above = F.lit(True) if after is None else F.col(key) > after
            below = F.lit(True) if to is None else F.col(key) <= to
            inside = above & below if after is not None else below | F.col(key).isNull()
            folder = self._save(make(rows.where(inside)), collection)
            if not log.put(i, {"data": [folder]}):
                self._drop(collection, folder)
        data = [f for i in range(1, len(edges)) for f in log.read(i)["data"]]
        while True:
            last = max(main.numbers(), default=0)
            since = [main.read(n) for n in range(plan["base"] + 1, last + 1)]
            if any(e.get("build") == name for e in since):
                return
            if any(e["whole"] for e in since):
                raise Conflict(f"{collection} was replaced while {name} was built")
            if main.put(last + 1, {"whole": True, "data": data + [f for e in since for f in e["data"]], "build": name}):
                return
