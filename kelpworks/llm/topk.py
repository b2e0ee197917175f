"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Rows are read in blocks; in each, every dimension has its list of rows by component. A query walks all lists at once,
from the end that its sign favours, scores each row at first sight, and stops when no unseen row can reach its kth
score: the bound is the sum, over dimensions, of query component times the component now at hand. The kth scores found so
far are carried from block to block. Each task gives its best k per query; the best of these are the result.

Queries come in blocks of bounded size, each of which passes over all rows.

Defined results: rows with a null id, a null vector, or null or non-finite components take no part; a query's own row
is any with its id; shorter vectors count as padded with zeros; equal scores go to the smaller id; equal query rows
give a result each (told apart by `query_row`); without queries or rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpworks.llm.shared import blocks_of, table

#: Rows of a block, and components of a query block (16 MB).
ROWS, NUMBERS = 8192, 2_000_000


def scored(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[-1]) < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0, np.int64) for _ in range(queries)]
        self.ids = [np.empty(0, np.int64) for _ in range(queries)]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(own := self.scores[q]) == self.k and len(scores):
            keep = scores >= own[-1]
            scores, ids = scores[keep], ids[keep]
        if len(scores):
            scores, ids = np.concatenate([own, scores]), np.concatenate([self.ids[q], ids])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores[q], self.ids[q] = scores[order], ids[order]

    def least(self, q: int) -> int | None:
        return int(self.scores[q][-1]) if len(self.scores[q]) == self.k else None


def threshold_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> int:
    """Adds the block's rows to best; returns how many scores it took."""
    n, took = len(ids), 0
    lists = np.argsort(-x, axis=0, kind="stable").astype(np.int32)
    values = np.take_along_axis(x, lists, axis=0)
    floats = x.astype(np.float64) if np.abs(x).max(initial=0) < 2**20 and np.abs(queries).max(initial=0) < 2**20 else None
    for i, q in enumerate(queries):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        depth, step = 0, 16
        while depth < n:
            until = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[lists[depth:until, up]] = True
            fresh[lists[n - until : n - depth, down]] = True
            if not len(up) and not len(down):
                fresh[:] = True
            rows = np.flatnonzero(fresh & ~seen)
            seen[rows] = True
            depth, step = until, step * 2
            took += len(rows)
            scores = (floats[rows] @ q.astype(np.float64)).astype(np.int64) if floats is not None else scored(x[rows], q)
            other = ids[rows] != query_ids[i]
            best.add(i, scores[other], ids[rows][other])
            bound = int(values[until - 1, up] @ q[up]) + int(values[n - until, down] @ q[down])
            if seen.all() or (least := best.least(i)) is not None and bound < least:
                break
    return took


def top_k(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), row_id, score and query_row. Vectors are arrays of long; see whole_numbers()."""
    spark = rows.sparkSession
    schema = f"query_row long, query_id long, {row_id} long, score long"
    base = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    if (least := spark.sparkContext.defaultParallelism) > base.rdd.getNumPartitions():
        base = base.repartition(least)  # so few partitions are small
    asked = ((r[0], r[1]) for r in queries.select(row_id, vector).where(F.col(vector).isNotNull()).toLocalIterator())
    parts, before = [], 0
    for block in blocks_of(asked, lambda r: max(1, len(r[1])), NUMBERS):
        parts.append(_pass(base, block, before, k, schema))
        before += len(block)
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, {row_id} long, score long, query_row long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), row_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", row_id, "score", "query_row")


def _pass(base: DataFrame, block: list[tuple], before: int, k: int, schema: str) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast(block)
    names = [x.split()[0] for x in schema.split(", ")]

    def dense(vectors: list, width: int) -> np.ndarray:
        out = np.zeros((len(vectors), width), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        query_ids = np.array([q for q, _ in asked], np.int64)
        best = Best(len(asked), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = part.column(1).to_pylist()
                width = max(len(v) for v in [*vectors, *(q for _, q in asked)])
                threshold_search(part.column(0).to_numpy(), dense(vectors, width), query_ids, dense([q for _, q in asked], width), best)
        for i in range(len(asked)):
            if n := len(best.ids[i]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, before + i)), pa.array(np.full(n, query_ids[i])), pa.array(best.ids[i]), pa.array(best.scores[i])], names)

    return base.mapInArrow(search, schema)


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """Each component, as a double, times scale and rounded down; null if one is null or not finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other vectors of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers(F.col("embedding")).alias("embedding"))
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
