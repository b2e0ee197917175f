"""Benchmark decontamination with a positional inverted index.

1. Index: every document becomes one shard of postings (term: its sorted positions) for all terms that some test
   item uses, stored in the shared folder. Nothing is shuffled; a document of any length is one row.
2. Dictionary: how many documents hold each term, counted over the whole index.
3. Search: a window of consecutive item words starts from its rarest term; the lists of its terms, each shifted by
   the term's offset in the window, are intersected from the rarest on. What remains are exact phrase matches. With
   `slop`, windows all of whose terms lie within a few words more, in any order, are proximity matches.

Test items are a query set: they are read in blocks of bounded size, each of which passes over all documents.

Defined results: a null text, or one without words, has no words and no hits; an item without words has no window;
an item whose id is null can hit words but is not listed; repeated rows get the same result each; other columns are
left alone, whatever their names.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.llm.shared import LOWER, UPPER, blocks_of, only_or_without, row_key, stored, table

#: What is no word character becomes a space (words are 0-9, a-z and all from U+0080, after lower-casing A-Z).
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
WORDS = bytes(c if c in _KEPT else 32 for c in bytes(range(256)).translate(bytes.maketrans(UPPER, LOWER)))
#: Item words in one block: its windows then take some hundred MB at most.
BLOCK_WORDS = 1_000_000
#: Words that a proximity match of op2_proximity may span beyond its window.
SLOP = 2


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, pa.int32()))


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its key, id and number of words, and the postings of the vocabulary's terms in it."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n_words, n_terms, terms, counts, positions = [], [], [], [], []
                for data in batch.column(3).cast(pa.binary()).to_pylist():
                    words = words_of(data)
                    ids = np.array([get(w, -1) for w in words], np.int32)
                    where = np.flatnonzero(ids >= 0)
                    ids = ids[where]
                    order = np.argsort(ids, kind="stable")
                    own, n = np.unique(ids[order], return_counts=True)
                    n_words.append(len(words))
                    n_terms.append(len(own))
                    terms.append(own)
                    counts.append(n)
                    positions.append(where[order])
                sizes = [len(x) for x in positions]
                flat = [np.concatenate([*x, np.empty(0, np.int32)]).astype(np.int32) for x in (terms, counts, positions)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(3)), pa.array(n_words, pa.int64()), _lists(flat[0], n_terms), _lists(flat[1], n_terms), _lists(flat[2], sizes)],
                    ["k1", "k2", "id", "n_words", "terms", "counts", "positions"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return chosen.mapInArrow(index, f"k1 long, k2 int, id {kind}, n_words long, terms array<int>, counts array<int>, positions array<int>")


class Windows:
    """The distinct windows of a block of items, by their rarest and second rarest terms."""

    def __init__(self, items: list[tuple], vocabulary: dict[bytes, int], held_by: dict[int, int], size: int):
        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item_id, words in items:
            ids = tuple(vocabulary[w] for w in words)
            for i in range(max(1, len(ids) - size + 1)) if ids else ():
                windows[ids[i : i + size]].update([] if item_id is None else [str(item_id)])
        self.by_term: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for window, names in windows.items():
            if all(t in held_by for t in window):
                steps = sorted(((t, o) for o, t in enumerate(window)), key=lambda x: (held_by[x[0]], x[0], x[1]))
                (first, at), second = steps[0], steps[min(1, len(steps) - 1)]
                self.by_term[first][second[0], second[1] - at].append((at, steps[2:], len(window), sorted(names)))
        self.by_term = {t: dict(x) for t, x in self.by_term.items()}


def find(by_term: dict[int, dict], postings: dict[int, list[int]], slop: int | None) -> tuple[list[tuple[int, int]], set[str], set[str]]:
    """Matched ranges of words, and the items that match exactly and in proximity."""
    ranges, exact, near, sets = set(), set(), set(), {}

    def at(t: int) -> set[int]:
        if t not in sets:
            sets[t] = set(postings[t])
        return sets[t]

    for first in by_term.keys() & postings.keys():
        for (second, step), windows in by_term[first].items():
            if second not in postings:
                continue
            starts = [p for p in postings[first] if p + step in at(second)]
            for own, rest, n, names in windows:
                if any(t not in postings for t, _ in rest):
                    continue
                left = [p - own for p in starts]
                for t, o in rest:
                    if not left:
                        break
                    left = [s for s in left if s + o in at(t)]
                if left:
                    ranges.update((s, s + n) for s in left)
                    exact.update(names)
                if slop is not None and close(postings, first, {second, *(t for t, _ in rest)}, n + slop):
                    near.update(names)
    merged: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged, exact, near


def close(postings: dict[int, list[int]], first: int, others: set[int], span: int) -> bool:
    """Whether all terms occur within `span` consecutive words, around an occurrence of the rarest."""
    for p in postings[first]:
        for start in range(p - span + 1, p + 1):
            if all((i := bisect.bisect_left(postings[t], start)) < len(postings[t]) and postings[t][i] < start + span for t in others):
                return True
    return False


def search(index: DataFrame, windows: Windows, slop: int | None = None) -> DataFrame:
    """Rows of the index with `hits` (disjoint ranges of matched words), `items` and `near` (sorted ids of items)."""
    shared = index.sparkSession.sparkContext.broadcast(windows.by_term)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term = shared.value
        firsts = np.array(sorted(by_term), np.int32)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            terms, counts, positions = (batch.column(i) for i in (4, 5, 6))
            hits, items, near = [], [], []
            ends = positions.offsets.to_numpy()
            bounds = terms.offsets.to_numpy()
            t_all, c_all, p_all = (x.values.to_numpy() for x in (terms, counts, positions))
            for i in range(batch.num_rows):
                own = t_all[bounds[i] : bounds[i + 1]]
                if np.isin(own, firsts).any():
                    cut = np.cumsum(c_all[bounds[i] : bounds[i + 1]])
                    place = p_all[ends[i] : ends[i + 1]]
                    found = find(by_term, _Postings(own, cut, place), slop)
                else:
                    found = [], (), ()
                hits.append([{"start": s, "end": e} for s, e in found[0]])
                items.append(sorted(found[1]))
                near.append(sorted(found[2]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(hits, kind), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))], ["k1", "k2", "id", "n_words", "hits", "items", "near"])

    kept = index.select("k1", "k2", "id", "n_words", "terms", "counts", "positions")
    kind = index.schema["id"].dataType.simpleString()
    return kept.mapInArrow(look, f"k1 long, k2 int, id {kind}, n_words long, hits array<struct<start:int,end:int>>, items array<string>, near array<string>")


class _Postings(dict):
    """A document's lists by term; a list is cut out when it is first asked for."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        super().__init__((t, i) for i, t in enumerate(terms.tolist()))
        self.ends, self.positions, self.cut = ends, positions, {}

    def __getitem__(self, t: int) -> list[int]:
        if t not in self.cut:
            i = super().__getitem__(t)
            self.cut[t] = self.positions[self.ends[i - 1] if i else 0 : self.ends[i]].tolist()
        return self.cut[t]


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: k1, k2, id, n_words, hits, items, near (see search)."""
    spark = docs.sparkSession
    rows = ((r[0], words_of(r[1].encode() if r[1] else None)) for r in items.select(item_id, item_text).toLocalIterator())
    out = None
    for block in blocks_of(rows, lambda r: len(r[1]), block_words) if not items.isEmpty() else [[]]:
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in block for w in words}))}
        index = stored(build_index(docs, vocabulary, doc_id, text), "postings")
        held_by = {r[0]: r[1] for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # at most a block's terms
        found = search(index, Windows(block, vocabulary, held_by, window), slop)
        if out is None:
            out = found
        else:  # rows of one key have the same text, so the same result
            more = found.where((F.size("hits") > 0) | (F.size("near") > 0)).select("k1", "k2", *(F.col(c).alias(f"more_{c}") for c in ("hits", "items", "near"))).dropDuplicates(["k1", "k2"])
            both = lambda c: F.array_sort(F.array_distinct(F.concat(c, F.coalesce(f"more_{c}", F.array().cast(dict(found.dtypes)[c])))))
            out = stored(out.join(more, ["k1", "k2"], "left").select("k1", "k2", "id", "n_words", *(both(c).alias(c) for c in ("hits", "items", "near"))), "hits")
    return out


def verdicts(found: DataFrame) -> DataFrame:
    """k1, k2, id, n_words, n_hit, items, contaminated: at least a twentieth of the words, and one, is hit."""
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1))))
    n_hit = F.when(F.size("hits") < 2, F.aggregate("hits", F.lit(0), lambda a, h: a + h["end"] - h["start"])).otherwise(F.size(places)).cast("long")
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated ones, all columns as they were."""
    bad = stored(verdicts(find_contamination(docs, items, doc_id, text)).where("contaminated").select("k1", "k2"), "contaminated")
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    bad = bad.withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    return only_or_without(keyed, bad, "left_anti", ["__k1", "__k2"]).select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold passages of the benchmark."""
    found = verdicts(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the items near a document's words in any order: how many and which, exact matches among them."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("items").cast("long").alias("n_items"), F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"))


#: The same in DuckDB: words of both sides, windows of the lengths that occur, joined as texts.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark
), bw AS (
  SELECT item_id, least(13, len(ws)) AS n, unnest(range(1, greatest(2, len(ws) - 11))) AS i, ws FROM b WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, l.n, unnest(range(1, len(ws) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) l WHERE len(ws) >= l.n)
), hit AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.w = win.w
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
