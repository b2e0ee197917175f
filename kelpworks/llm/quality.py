"""Quality by pairwise ranking: a Bradley-Terry model learns document scores from preference pairs.

A pair is a document labelled good and one labelled bad; its loss is the logistic loss on the difference of their
features, so only the order matters and the classes need no balance. The raw score is then placed so that 0.3 is its
quantile at the share of bad labels, with the slope at which training labels are likeliest.

The model is fitted on a bounded sample of labelled rows (SAMPLE of each class, by a hash of their id); every
document is scored from its whole text. Defined results: a null text scores as an empty one, and empty texts score as
the model has it; without good and bad labels all scores are 0.5; a null id is in no sample and not held out;
repeated rows score alike; other columns are left alone, save `score`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpworks.llm.shared import table

#: Labelled documents of each class that are read for the model, at most.
SAMPLE = 8000
#: Preference pairs drawn from them.
PAIRS = 60_000
MARKS = "!|#%*$&.,;:?\"'()[]{}<>/=+-_@~^\\"


def features_of(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, words and lines; logarithms let small shares count."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(data, minlength=256).astype(float)
    n = max(1.0, kinds.sum())
    upper, lower, digits, high = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum(), kinds[128:].sum()
    words = text.split()
    w = max(1, len(words))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    again = sum(map(str.__eq__, words, words[1:])) if words else 0
    bare = sum(1 for x in words if not any(c.isalnum() for c in x))
    shouted = sum(1 for x in words if len(x) > 1 and x.isupper())
    tail = sum(1 for x in words if len(x) > 2 and not x[-1].isalnum() and not x[-2].isalnum())
    lines = [x for x in text.split("\n") if x]
    doubled = len(lines) - len(set(lines))
    shares = [upper / n, digits / n, high / n, kinds[10] / n, *(kinds[ord(c)] / n for c in MARKS), again / w, bare / w, shouted / w, tail / w, doubled / max(1, len(lines)), seen.most_common(1)[0][1] / w if seen else 0.0, upper / max(1.0, upper + lower), 1 - (lower + upper + high + kinds[32]) / n]
    plain = [np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), min(50.0, lengths.max()), len(seen) / w, np.log1p(len(seen)) - np.log1p(len(words)), float(not words)]
    return np.array([*plain, *(np.log(s + 1e-3) for s in shares), *shares], np.float32)


def fit_pairs(good: np.ndarray, bad: np.ndarray, steps: int = 300, penalty: float = 1e-3, pairs: int = PAIRS) -> np.ndarray:
    """Weights that minimise the mean logistic loss on good - bad over drawn pairs, with a ridge penalty."""
    rng = np.random.default_rng(10)
    d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    w = np.zeros(d.shape[1], np.float64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        g = -(d / (1 + np.exp(np.clip(d @ w, -50, 50)))[:, None]).mean(0) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


class Model:
    """mean, scale, weights: the raw score; cut, slope: where it stands at 0.3, and how fast it turns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bad_share: float):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        self.weights = fit_pairs(z[y == 1], z[y == 0])
        raw = z @ self.weights
        weight = np.where(y == 1, (1 - bad_share) / max(1, (y == 1).sum()), bad_share / max(1, (y == 0).sum()))
        order = np.argsort(raw)
        at = min(int(np.searchsorted(np.cumsum(weight[order]), bad_share)), len(raw) - 1)
        self.cut = float(raw[order][max(0, at - 1) : at + 1].mean())
        tried = np.geomspace(0.02, 20, 60)
        self.slope = float(min(tried, key=lambda s: -(weight * np.log(np.clip(np.where(y == 1, p := self.place(raw, s), 1 - p), 1e-9, 1))).sum()))

    def place(self, raw: np.ndarray, slope: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(slope * (raw - self.cut) + np.log(0.3 / 0.7), -50, 50)))

    def parts(self) -> tuple:
        return self.mean, self.scale, self.weights, self.cut, self.slope


def mapped(docs: DataFrame, text: str, column: str, kind: T.DataType, of) -> DataFrame:
    """docs with a column that `of` makes from lists of texts."""
    kept = docs.drop(column)
    names, at = kept.columns, kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                yield pa.RecordBatch.from_arrays([*batch.columns, of(batch.column(at).to_pylist())], [*names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, kind)]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> tuple | None:
    """Parts of the model, or None without labels of both classes. labels: doc_id and 0/1; more columns are ignored."""
    own = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("__id").isNotNull())
    there = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    if len(there) < 2:
        return None
    mixed = F.xxhash64("__id", F.lit(10))
    picked = own.where("y = 0").orderBy(mixed, "__id").limit(sample).unionByName(own.where("y = 1").orderBy(mixed, "__id").limit(sample))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(picked), "__id").select("text", "y")  # at most 2 * sample ids

    def many(texts: list) -> pa.Array:
        return pa.array([features_of(t).tolist() for t in texts], pa.list_(pa.float32()))

    got = mapped(rows, "text", "x", T.ArrayType(T.FloatType()), many).select("x", "y").toArrow()
    y = got.column("y").to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1).astype(float)
    return Model(x, y, there[0] / (there[0] + there[1])).parts()


def score(docs: DataFrame, model: tuple | None, text: str = "text", to: str = "score") -> DataFrame:
    """docs with a score: 0 to 1, higher where the label is likelier 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def many(texts: list) -> pa.Array:
        if shared.value is None:
            return pa.array([0.5] * len(texts), pa.float64())
        mean, scale, weights, cut, slope = shared.value
        raw = ((np.stack([features_of(t) for t in texts]).astype(float) - mean) / scale) @ weights if texts else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(slope * (raw - cut) + np.log(0.3 / 0.7), -50, 50))))

    return mapped(docs, text, to, T.DoubleType(), many)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """docs that the classifier accepts, all columns as they were."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model, to="__score").where(F.col("__score") >= least).select(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of documents; learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
