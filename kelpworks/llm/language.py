"""Language mixtures: expectation-maximisation over n-gram likelihoods, language set by penalised likelihood.

Model: for each language, smoothed probabilities of hashed character 1- to 3-grams, counted over labelled documents.
Prediction: a document is a mixture; EM estimates the share of each language in its n-grams. Starting from all
languages, the one with the least share is left out as long as the Bayesian information
criterion does not rise; the shares of the remaining set are the result. Documents go through in small dense batches.

Defined results: a null text, and one without a letter, gets `und` and score 0; text of any length is read whole;
without any labelled document every text gets `und`; repeated rows get equal results; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpworks.llm.shared import table

#: Buckets of hashed n-grams.
BUCKETS = 4096
#: About so many labelled documents of each language are read for the model, chosen by a hash of their id.
SAMPLE = 20_000
#: n-grams count for this many observations at most in the criterion: they overlap, so they are not independent.
OVERLAP = 3.0


def counts_of(text: str) -> np.ndarray:
    """Counts of the text's hashed n-grams; all that is no letter counts as one kind of gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.where(codes < 128, np.where((codes >= 97) & (codes <= 122), codes, 32), codes).astype(np.uint64)
    out = np.zeros(BUCKETS, np.float32)
    if len(small):
        small = small[np.concatenate([[True], (small[1:] != 32) | (small[:-1] != 32)])]
        mixed = small * np.uint64(0x9E3779B97F4A7C15)
        two = (mixed[:-1] ^ (mixed[1:] >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
        three = (two[:-1] ^ (mixed[2:] >> np.uint64(13))) * np.uint64(0x94D049BB133111EB)
        for grams in (mixed * np.uint64(0xD6E8FEB86659FD93), two, three):
            out += np.bincount((grams >> np.uint64(52)).astype(np.int64), minlength=BUCKETS).astype(np.float32)
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the buckets by language."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id), F.lit(6)).alias("h"))
    there = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # as many rows as languages
    if not there:
        return [], np.zeros((0, BUCKETS))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in there.items() for x in (k, min(1.0, sample / n)))), F.col("lang"))
    chosen = labelled.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch.column(0), batch.column(1), strict=True):
                if (k := k.as_py()) not in sums:
                    sums[k] = np.zeros(BUCKETS)
                sums[k] += counts_of(t.as_py())
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * BUCKETS), pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(v)], ["lang", "bucket", "n"])

    totals = chosen.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(totals["lang"].unique())
    n = np.zeros((len(langs), BUCKETS))
    n[totals["lang"].map({k: i for i, k in enumerate(langs)}), totals["bucket"]] = totals["n"]
    n += 0.5
    return langs, np.log(n / n.sum(1, keepdims=True))


def mixtures(counts: np.ndarray, logs: np.ndarray, steps: int = 8) -> np.ndarray:
    """Shares of the languages (rows: documents) within the set that the criterion selects."""
    docs, langs = len(counts), len(logs)
    p = np.exp(logs).T.astype(np.float32)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    alone = counts @ logs.T.astype(np.float32)
    kept = np.ones((docs, langs), bool)

    def em(kept: np.ndarray, pi: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(steps):
            pi = pi * ((c / (pi @ p.T)) @ p) / n
            pi = np.where(kept, np.maximum(pi, 1e-9), 0)
            pi = (pi / pi.sum(1, keepdims=True)).astype(np.float32)
        return pi, (c * np.log(pi @ p.T)).sum(1)

    pi = (kept / kept.sum(1, keepdims=True)).astype(np.float32)
    pi, fit = em(kept, pi, counts, total)
    penalty = 0.5 * np.log(np.maximum(total[:, 0] / OVERLAP, 2)) * OVERLAP
    # no mixture fits better than that of all, so where it gains less than one language costs, the best one stands alone
    best = alone.argmax(1)
    single = fit - alone[np.arange(docs), best] <= penalty
    pi[single], kept[single] = 0, False
    pi[single, best[single]], kept[single, best[single]] = 1, True
    left = np.arange(docs)
    while len(left := left[kept[left].sum(1) > 1]):
        fewer = kept[left].copy()
        fewer[np.arange(len(left)), np.where(fewer, pi[left], np.inf).argmin(1)] = False
        start = np.where(fewer, pi[left] + 1e-3, 0)
        other, less = em(fewer, (start / start.sum(1, keepdims=True)).astype(np.float32), counts[left], total[left])
        better = less + penalty[left] >= fit[left]
        left, other, less, fewer = left[better], other[better], less[better], fewer[better]
        pi[left], fit[left], kept[left] = other, less, fewer
    return pi


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, text: str = "text", size: int = 128) -> DataFrame:
    """docs with lang_pred, score (that language's share) and mixture (language: share, of the selected set)."""
    kept = docs.drop("lang_pred", "score", "mixture")
    names = kept.columns
    at = names.index(text)
    model = docs.sparkSession.sparkContext.broadcast((langs, logs))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = model.value
        for whole in batches:
            for begin in range(0, whole.num_rows, size):
                batch = whole.slice(begin, size)
                texts = batch.column(at).to_pylist()
                known = [i for i, t in enumerate(texts) if langs and t and has_letter(t)]
                pred, score, mix = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                if known:
                    shares = mixtures(np.stack([counts_of(texts[i]) for i in known]), logs)
                    for i, row in zip(known, shares, strict=True):
                        best = int(row.argmax())
                        pred[i], score[i] = langs[best], min(1.0, float(row[best]))
                        mix[i] = [(k, float(x)) for k, x in zip(langs, row, strict=True) if x > 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score), pa.array(mix, pa.map_(pa.string(), pa.float64()))], [*names, "lang_pred", "score", "mixture"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))]
    return kept.mapInArrow(label, T.StructType([*kept.schema.fields, *more]))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents; learned where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    langs, logs = train(docs.where(~held))
    found = predict(docs.select("doc_id", "text"), langs, logs)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
