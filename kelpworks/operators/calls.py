"""Calls of an outside model from Spark (L10, L14, E3, E4, E5): keyed, cached, resumable, and bisected where a batch fails.

A request is asked once: equal requests share a key, and answers are kept in a table under a folder. What is new is asked
in waves of bounded size, each committed before the next, so that a lost driver costs one wave at most. Within a task,
requests go out in batches; a batch that fails is halved until single requests fail, which get an error and no answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What answers a batch of requests, in order; it may raise, and must answer as many as it is given.
Caller = Callable[[list[str]], list[str]]
#: Requests of a batch and of a wave.
BATCH, WAVE = 16, 100_000
ANSWERS = "key string, answer string, error string, calls int"


def asked_in_halves(caller: Caller, requests: list[str]) -> list[tuple[str | None, str | None, int]]:
    """E5: answer, error and the calls it took part in, for each request; a failing batch is split from a work queue."""
    out: list[tuple[str | None, str | None, int]] = [(None, None, 0)] * len(requests)
    todo = [(0, len(requests))] if requests else []
    while todo:
        low, high = todo.pop()
        for i in range(low, high):
            out[i] = (None, None, out[i][2] + 1)
        try:
            answers = caller(requests[low:high])
            if len(answers) != high - low:
                raise ValueError(f"{len(answers)} answers to {high - low} requests")
        except Exception as failure:  # whatever the outside raises is the row's error
            if high - low == 1:
                out[low] = (None, f"{type(failure).__name__}: {failure}", out[low][2])
            else:
                middle = (low + high) // 2
                todo += [(middle, high), (low, middle)]
            continue
        for i, answer in enumerate(answers, low):
            out[i] = (answer, None, out[i][2])
    return out


class AnswerCache:
    """Answers under a folder, one subfolder a committed wave."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        empty = spark.createDataFrame([], ANSWERS)
        empty.write.mode("append").parquet(f"{self.path}/wave=none")

    def read(self) -> DataFrame:
        """One row a key: an answer if there is one, else the last error."""
        rows = self.spark.read.schema(ANSWERS + ", wave string").parquet(self.path)
        return rows.groupBy("key").agg(F.max("answer").alias("answer"), F.max("error").alias("error"), F.sum("calls").cast("int").alias("calls"))

    def add(self, requests: DataFrame, caller: Caller, batch: int = BATCH, wave: int = WAVE, again: bool = False) -> None:
        """Ask what has no row in the cache (with `again` also what has an error only). requests: key, request."""
        known = self.read()
        known = (known.where("answer is not null") if again else known).select("key")
        new = requests.select("key", "request").where("request is not null").dropDuplicates(["key"]).join(known, "key", "left_anti")
        waves = max(1, -(-new.count() // wave))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for at in range(0, rows.num_rows, batch):
                    part = rows.slice(at, batch)
                    found = asked_in_halves(caller, part.column(1).to_pylist())
                    answers, errors, calls = (list(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(calls, pa.int32())], ["key", "answer", "error", "calls"])

        for n in range(waves):
            own = new.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == n) if waves > 1 else new
            own.repartition(F.col("key")).mapInArrow(run, ANSWERS).write.parquet(f"{self.path}/wave={uuid.uuid4().hex}")


def request_key(request: Column) -> Column:
    return F.sha2(request, 256)


def answered(rows: DataFrame, request: Column, caller: Caller, cache: AnswerCache, fallback: Column | None = None, batch: int = BATCH) -> DataFrame:
    """rows with `answer`, `error` and `fell_back`. Null requests aren't asked; without an answer the fallback stands.

    L10 is this with the filters of L8 as the fallback, L14 and E3 with a prompt of context and question.
    """
    keyed = rows.withColumns({"__request": request, "__key": request_key(request)})
    cache.add(keyed.select(F.col("__key").alias("key"), F.col("__request").alias("request")), caller, batch)
    got = cache.read().select(F.col("key").alias("__key"), F.col("answer").alias("__answer"), F.col("error").alias("__error"))
    joined = keyed.drop("answer", "error", "fell_back").join(got, "__key", "left")
    missing = F.col("__answer").isNull()
    answer = F.coalesce("__answer", fallback.cast("string")) if fallback is not None else F.col("__answer")
    return joined.withColumns({"answer": answer, "error": F.col("__error"), "fell_back": missing & F.lit(fallback is not None)}).drop("__key", "__request", "__answer", "__error")


def prompt(instructions: str, context: Column, question: Column) -> Column:
    """What the model is asked: the instructions, the context and the question, with blank lines between."""
    return F.concat_ws("\n\n", F.lit(instructions), F.nullif(F.trim(context), F.lit("")), question)


def verdict_score(answer: Column, good: str = "yes") -> Column:
    """The share of good verdicts in a judge's JSON answer; 1 where it gives none, null where it is no such answer."""
    verdicts = F.from_json(answer, "verdicts array<struct<verdict:string>>")["verdicts"]
    good_ones = F.filter(verdicts, lambda v: F.lower(v["verdict"]) == good)
    return F.when(F.size(verdicts) == 0, F.lit(1.0)).otherwise(F.round(F.size(good_ones) / F.size(verdicts), 6))
