"""The nearest row of each query by cosine: all pairs as products of matrices, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Components of a query block, and scores that a task holds at once (16 MB each).
NUMBERS, SCORES = 2_000_000, 2_000_000
#: Scores are compared at six digits. NaN is above all numbers; a row does not meet itself; a null score is below all.
DIGITS, NAN, ITSELF, NULL = 6, 3.0, -9.0, -5.0
UNITS = 10**DIGITS


def query_blocks(queries: Iterator[tuple], most: int, numbers: int = NUMBERS) -> Iterator[dict]:
    """Blocks of (id, vector) as ids and a matrix for each width; vectors that are null or have a null share the width None."""
    block, count, held = {}, 0, 0
    for query_id, vector in queries:
        width = None if vector is None or any(x is None for x in vector) else len(vector)
        if count and (count >= most or held + (width or 0) > numbers):
            yield _stacked(block)
            block, count, held = {}, 0, 0
        block.setdefault(width, []).append((query_id, None if width is None else np.array(vector, np.float64)))
        count, held = count + 1, held + (width or 0)
    if count:
        yield _stacked(block)


def _stacked(block: dict) -> dict:
    return {w: (np.array([q for q, _ in found], np.int64), None if w is None else np.stack([v for _, v in found])) for w, found in block.items()}


def of_width(ids: np.ndarray, vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the matrix of the vectors that have this width and no null."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if not (lengths == width).all():
        at = np.flatnonzero(lengths == width)
        ids, vectors = ids[at], vectors.take(pa.array(at))
    flat = vectors.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), width)
    if flat.null_count:
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(ids), width).any(axis=1)
        ids, x = ids[whole], x[whole]
    return ids, x


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which of them have no direction (no length, or a component that is not finite)."""
    with np.errstate(all="ignore"):
        own = np.einsum("ij,ij->i", x, x)
        void = ~(np.isfinite(own) & (own > 0))
        unit = x / np.sqrt(own)[:, None]
    unit[void] = 0
    return unit, void


def exact(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of rows i and queries j, their terms added in order, to the last bit those of search.best_matches."""

    def product(a, m, b, n):
        total = np.zeros(len(m))
        for c in range(a.shape[1]):
            total += a[m, c] * b[n, c]
        return total

    return product(x, i, q, j) / np.sqrt(product(x, i, x, i) * product(q, j, q, j))


def places(scores: np.ndarray) -> np.ndarray:
    """Scores rounded as Spark does, half up in their decimal form, as whole units."""
    scaled = scores * UNITS
    out = np.floor(scaled + 0.5).astype(np.int64)
    for s in np.unique(scores[np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3]):
        out[scores == s] = int(Decimal(repr(float(s))).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP))
    return out


class Nearest:
    """The best row so far of each query of one width: the highest rounded score, then the smallest id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray):
        self.query_ids, self.queries = query_ids, queries
        self.unit, self.void = units(queries)
        #: How far a matrix product can be from the exact cosine.
        self.error = (4 * queries.shape[1] + 16) * 2.3e-16
        self.top = np.full(len(queries), NULL)
        self.place = np.full(len(queries), int(NULL * UNITS))
        self.id = np.full(len(queries), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        unit, void = units(x)
        step = max(1, SCORES // len(self.queries))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            self._add(ids[part], x[part], unit[part], void[part])

    def _add(self, ids: np.ndarray, x: np.ndarray, unit: np.ndarray, void: np.ndarray) -> None:
        scores = unit @ self.unit.T
        scores[void] = NAN
        scores[:, self.void] = NAN
        for i in np.flatnonzero(np.isin(ids, self.query_ids)):
            scores[i, self.query_ids == ids[i]] = ITSELF
        self.top = np.maximum(self.top, scores.max(axis=0))
        # what is rounded to the best score is at most a unit below the highest
        i, j = np.nonzero(scores >= self.top - (1.0 / UNITS + 4 * self.error))
        s = scores[i, j]
        low, high = (np.floor((s + e) * UNITS + 0.5).astype(np.int64) for e in (-self.error, self.error))
        open_ = (high > self.place[j]) | ((high == self.place[j]) & (ids[i] < self.id[j]))
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        if len(unsure := np.flatnonzero(low != high)):
            low[unsure] = places(exact(x, self.queries, i[unsure], j[unsure]))
        order = np.lexsort((ids[i], -low, j))
        i, j, low = i[order], j[order], low[order]
        first = np.flatnonzero(np.diff(j, prepend=-1))
        i, j, low = i[first], j[first], low[first]
        better = (low > self.place[j]) | ((low == self.place[j]) & (ids[i] < self.id[j]))
        j = j[better]
        self.place[j], self.id[j] = low[better], ids[i[better]]


def nearest_of_block(rows: DataFrame, block: dict) -> DataFrame:
    """query_id, place, vec_id: of each partition of rows (id, vector and others) the best row of each query; place is lower for a
    higher score. Where no score is a number or NaN, the smallest other id stands for all null scores."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = {w: Nearest(*found) for w, found in asked.items() if w is not None}
        least = np.empty(0, np.int64)  # the two smallest ids
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            least = np.unique(np.concatenate([least, ids]))[:2]
            for width, of in best.items():
                step = max(1, NUMBERS // max(1, width))
                for at in range(0, len(ids), step):
                    fit, x = of_width(ids[at : at + step], batch.column(1).slice(at, step), width)
                    if len(fit):
                        of.add(fit, x)
        for width, (query_ids, _) in asked.items():
            place, found = np.full(len(query_ids), int(NULL * UNITS)), np.zeros(len(query_ids), np.int64)
            if width in best:
                place, found = best[width].place, best[width].id
            some, null = place > int(NULL * UNITS), place == int(NULL * UNITS)
            for other in least[::-1]:
                at = null & (query_ids != other)
                found[at], some[at] = other, True
            for at in range(0, len(query_ids), 65536):
                part = np.flatnonzero(some[at : at + 65536]) + at
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[part]), pa.array(-place[part]), pa.array(found[part])], ["query_id", "place", "vec_id"])

    return rows.mapInArrow(search, "query_id long, place long, vec_id long")
