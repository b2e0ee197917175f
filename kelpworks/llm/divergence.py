"""Source divergence audit: how far the sources of a language differ in their use of its terms.

Sort-based streaming in three scans over sorted runs, none of which holds more than a batch:

1. Each task sorts its batch's words by (source, term, document) and scans the runs: a run of one document counts once
   for the document frequency, a run of one term gives partial counts. So what is shuffled is partial runs, not words.
2. Partial runs are dealt by (lang, term, source) and sorted within each task with the document last; runs of equal
   (lang, term, source) add up. A term that every document holds is one row a batch and source here.
3. These are dealt by (lang, term) and sorted by source; a run has one row a source, and tells whether the language
   keeps the term. Kept runs are stored.

With the totals known, the kept runs are scanned once more in that order: each run gives partial pairs of sources, added
up in memory until they are PAIRS and passed on, and the terms that a source uses more than its language does.

Only sources that have a term meet in its run. For terms that one or both of two sources lack, the distance follows from
how many terms a source has with each count, so a pair of sources costs no work for the terms neither has.

Defined results: null text, lang and source count as ''; each row is a document, repeated ones too; a group without any
kept term has pairs, of value 0 where the language keeps nothing, and no terms; a language with one source has no pairs;
equal values rank by the item's UTF-8 bytes; no documents give no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpworks.llm.shared import LOWER, UPPER, stored, table

#: Term characters are letters of ASCII and all from U+0080; all others become spaces.
_KEPT = frozenset(LOWER) | frozenset(range(0x80, 0x100))
TERMS = bytes(c if c in _KEPT else 32 for c in bytes(range(256)).translate(bytes.maketrans(UPPER, LOWER)))
#: Documents that must hold a term, the scale of shares, what is added to each count, and the ranks of terms that are given.
MIN_DOCS, SCALE, ADDED, TOP = 10, 1_000_000_000, 2, 10
#: Words that are sorted at once, and partial pairs that are held at once.
BATCH, PAIRS = 3_000_000, 500_000


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERMS).split() if text else []


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, and where the last one ends."""
    n = len(sorted_columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for c in sorted_columns:
        change |= c[1:] != c[:-1]
    return np.concatenate([np.zeros(min(n, 1), np.int64), np.flatnonzero(change) + 1, [n]])


def partial_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, term, source, document (the first of the run), docs and n: the runs of sorted batches of whole documents."""
    names = ["lang", "term", "source", "document", "docs", "n"]

    def scan(code: dict[bytes, int], place: dict[tuple, int], ids: list, rows: list[np.ndarray], groups: list[int]) -> pa.RecordBatch:
        sizes = [len(r) for r in rows]
        key = (np.repeat(np.array(groups), sizes) * len(code) + np.concatenate(rows)) * len(rows) + np.repeat(np.arange(len(rows)), sizes)
        key.sort()
        first = _runs(key)  # a run here is one document's uses of a term
        per_doc = key[first[:-1]]
        of_term = per_doc // len(rows)
        start = _runs(of_term)
        at = of_term[start[:-1]]
        where = (at // len(code)).tolist()
        langs, sources = zip(*place, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([langs[i] for i in where], pa.string()), pa.array(list(code), pa.binary()).cast(pa.string()).take(pa.array(at % len(code))), pa.array([sources[i] for i in where], pa.string()),
                pa.array(ids, pa.string()).take(pa.array(per_doc[start[:-1]] % len(rows))), pa.array(np.diff(start)), pa.array(np.diff(first[start])),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ({}, {}, [], [], [])
        words = 0
        for batch in batches:
            for at in range(batch.num_rows):
                code, place, ids, rows, groups = held
                own = terms_of(batch.column(3)[at].as_buffer().to_pybytes())
                if own:
                    rows.append(np.fromiter((code.setdefault(t, len(code)) for t in own), np.int64, len(own)))
                    group = batch.column(1)[at].as_py(), batch.column(2)[at].as_py()
                    groups.append(place.setdefault(group, len(place)))
                    ids.append(batch.column(0)[at].as_py())
                    words += len(own)
                if words >= BATCH:
                    yield scan(*held)
                    held, words = ({}, {}, [], [], []), 0
        if words:
            yield scan(*held)

    chosen = docs.select(F.col(doc_id).cast("string").alias("document"), *(F.coalesce(F.col(c), F.lit("")).alias(c2) for c, c2 in ((lang, "lang"), (source, "source"))), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return chosen.mapInArrow(run, "lang string, term string, source string, document string, docs long, n long")


def _joined(batches: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, names) for b in batches]).combine_chunks().to_batches()[0]


def _codes(batch: pa.RecordBatch, columns: int) -> list[np.ndarray]:
    return [batch.column(i).dictionary_encode().indices.to_numpy(zero_copy_only=False) for i in range(columns)]


def merged_runs(runs: DataFrame) -> DataFrame:
    """One row for each lang, term and source: docs and n of its runs, added up along the sorted order."""
    names = ["lang", "term", "source", "docs", "n"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the run that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select([0, 1, 2, 4, 5])
            whole = batch if left is None else _joined([left, batch], names)
            start = _runs(*_codes(whole, 3))
            sums = [np.add.reduceat(whole.column(i).to_numpy(), start[:-1]) for i in (3, 4)]
            done = pa.RecordBatch.from_arrays([*(whole.column(i).take(pa.array(start[:-1])) for i in range(3)), *map(pa.array, sums)], names)
            left = done.slice(done.num_rows - 1)
            yield done.slice(0, done.num_rows - 1)
        if left is not None:
            yield left

    dealt = runs.repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source", "document")
    return dealt.select("lang", "term", "source", "document", "docs", "n").mapInArrow(scan, "lang string, term string, source string, docs long, n long")


def _whole_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in which every run of the first columns is whole, with the places where runs begin and the last ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            whole = _joined(held, batch.schema.names)
            if len(start := _runs(*_codes(whole, columns))) > 2:
                cut = int(start[-2])
                yield whole.slice(0, cut), start[:-1]
                held = [whole.slice(cut)]
    if held:
        whole = _joined(held, held[0].schema.names)
        yield whole, _runs(*_codes(whole, columns))


def kept_runs(merged: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, source, n, uses (of the term in the language) and first (1 for a term's first row) of the kept terms."""
    names = ["lang", "term", "source", "n", "uses", "first"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, start in _whole_runs(batches, 2):
            sizes = np.diff(start)
            docs, n = (np.add.reduceat(whole.column(i).to_numpy(), start[:-1]) for i in (3, 4))
            first = np.zeros(whole.num_rows, np.int64)
            first[start[:-1]] = 1
            out = pa.RecordBatch.from_arrays([*(whole.column(i) for i in (0, 1, 2, 4)), pa.array(np.repeat(n, sizes)), pa.array(first)], names)
            yield out.filter(pa.array(np.repeat(docs >= min_docs, sizes)))

    dealt = merged.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(scan, "lang string, term string, source string, n long, uses long, first long")


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)), exact for any number of words; null if the language keeps nothing."""
    above, below = (count + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * size).cast("decimal(20,0)")
    return F.when(size > 0, 1 + F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(20,0)"))))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _partial_pairs(kept: DataFrame) -> DataFrame:
    """lang, a, b (a before b) and part: what the terms that both have add to the distance beyond _base."""
    names = ["lang", "a", "b", "part"]

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[tuple[str, str], int] = {}
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        part: list[np.ndarray] = []
        held = 0

        def added_up() -> tuple[np.ndarray, np.ndarray]:
            key = np.concatenate(left) * len(code) + np.concatenate(right)
            own, at = np.unique(key, return_inverse=True)
            sums = np.zeros(len(own), np.int64)
            np.add.at(sums, at, np.concatenate(part))
            return own, sums

        def out(own: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            groups = list(code)
            a, b = ([groups[i] for i in x.tolist()] for x in (own // len(code), own % len(code)))
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in a], pa.string()), pa.array([g[1] for g in a], pa.string()), pa.array([g[1] for g in b], pa.string()), pa.array(sums)], names)

        for whole, start in _whole_runs(batches, 2):
            group = np.array([code.setdefault(g, len(code)) for g in zip(whole.column(0).to_pylist(), whole.column(2).to_pylist(), strict=True)])
            p, p0 = whole.column(3).to_numpy(), whole.column(4).to_numpy()
            after = np.repeat(start[1:], np.diff(start)) - np.arange(whole.num_rows) - 1  # rows of its run after each row
            reach = np.concatenate([[0], np.cumsum(after)])
            at = 0
            while at < whole.num_rows:
                until = max(at + 1, int(np.searchsorted(reach, reach[at] + PAIRS, "right")) - 1)
                n = after[at:until]
                a = np.repeat(np.arange(at, until), n)
                b = a + 1 + np.arange(len(a)) - np.repeat(reach[at:until] - reach[at], n)
                left.append(group[a])
                right.append(group[b])
                part.append(f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
                held, at = held + len(a), until
                if held > 2 * PAIRS:
                    own, sums = added_up()
                    if len(own) > PAIRS:
                        yield out(own, sums)
                        own, sums = own[:0], sums[:0]
                    left, right, part, held = [own // len(code)], [own % len(code)], [sums], len(own)
        if held:
            yield out(*added_up())

    sorted_runs = kept.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").select("lang", "term", "source", "p", "p0")
    return sorted_runs.mapInArrow(scan, "lang string, a string, b string, part long")


def audit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank; see the contract in op13_divergence."""
    kept = stored(kept_runs(merged_runs(partial_runs(docs, doc_id, text, lang, source)), min_docs), "kept-terms")
    there = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c2) for c, c2 in ((lang, "lang"), (source, "source")))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("size"), F.sum("n").alias("lang_total"))
    known = there.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "size", "lang_total"])
    groups = stored(known.withColumn("p0", share(F.lit(0), F.col("total"), F.col("size"))), "groups")  # a row for each source of a language

    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("uses"), F.col("lang_total"), F.col("size"))
    used = kept.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q})
    over = used.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("other_p0"))
    pairs = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    none = distance(F.col("p0"), F.col("other_p0"))
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("size") * none, F.lit(0).cast("long")).alias("value"))
    levels = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"]).withColumn("p", p)
    alone = levels.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (distance(F.col("p"), F.col("other_p0")) - none)).alias("value"))
    both = _partial_pairs(used).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.col("part").alias("value"))
    one_way = alone.unionByName(both)
    parts = base.unionByName(one_way).unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(summed).unionByName(ranked(over).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each source to the others of its language, and the terms that it uses most beyond its language."""
    return audit(table(spark, sf_dir, "documents"))


#: The same in DuckDB: every kept term against every source of its language, in whole numbers.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (
  SELECT k, lang, source, unnest(ws) AS term FROM d
), keep AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10
), v AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM keep GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN keep USING (lang, term) GROUP BY lang, source, term
), t AS (
  SELECT g.lang, g.source, coalesce(CAST(sum(c.n) AS HUGEINT), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), p AS (
  SELECT t.lang, t.source, keep.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v.v) AS p, 1 + (1000000000 * (keep.n + 2)) // (v.total + 2 * v.v) AS q
  FROM t JOIN keep ON t.lang = keep.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = keep.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = o.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
