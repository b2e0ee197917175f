"""Readers and writers of documents, manifests and reports. Everything goes through Spark's file systems."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpworks.functions.text import clean_text, quality_of

POSTS = "postId bigint, content string, metadata map<string,string>"
PLANNING = "planningDocumentId bigint, title string, sourceUrl string, format string, documentType string, dossierCode string, city string, district string, planYear int, propertyId bigint, rawMeta variant"
TRACES = "input string, conversation_history_used array<struct<role:string,content:string>>, rewritten_query string, retrieval_context array<string>, retrieved_doc_ids array<string>, retrieval_scores array<double>, actual_output string, metadata map<string,string>"


class PageReader(Protocol):
    """What turns a file's bytes into the text of its pages (a PDF library, an OCR engine)."""

    def __call__(self, data: bytes) -> list[str]: ...


def plain_pages(data: bytes) -> list[str]:
    """UTF-8 without what can't be decoded, as one page."""
    return [data.decode("utf-8", "ignore")]


def kind_of(declared: Column, url: Column) -> Column:
    """S5."""
    given = F.nullif(F.regexp_replace(F.trim(F.lower(F.coalesce(declared, F.lit("")))), r"^\.+|\.+$", ""), F.lit(""))
    return F.coalesce(given, F.when(F.endswith(F.lower(F.regexp_replace(url, r"[?#].*$", "")), F.lit(".pdf")), "pdf").otherwise("txt"))


def read_pages(spark: SparkSession, path: str, readers: dict[str, PageReader] | None = None) -> DataFrame:
    """Path, kind, page (from 1), text, quality of each staged file's pages. Formats without a reader have no row."""
    readers = {"txt": plain_pages} | (readers or {})
    files = spark.read.format("binaryFile").load(path).select("path", kind_of(F.lit(None).cast("string"), F.col("path")).alias("kind"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, k, n, t) for p, k, data in f.itertuples(index=False) if k in readers for n, t in enumerate(readers[k](data), 1)]
            yield pd.DataFrame(rows, columns=["path", "kind", "page", "text"])

    return files.mapInPandas(run, "path string, kind string, page int, text string").withColumn("text", clean_text("text"))


def document_quality(pages: DataFrame, by: str = "path") -> DataFrame:
    """H13 over a document's pages; under 0.42 it is one for OCR."""
    whole = pages.groupBy(by).agg(F.count("*").alias("pages"), F.count_if(F.length("text") >= 40).alias("long"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.select(by, "pages", quality_of(F.col("text"), F.col("pages"), F.col("long")).alias("quality")).withColumn("needs_ocr", F.col("quality") < 0.42)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A malformed line fails; blank lines and what is no object are left out; a missing file is empty."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A byte order mark in front of the header is no part of it."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, multiLine=True)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def write_report(frames: list[DataFrame], path: str) -> None:
    """Small tables as one CSV file with the union of their columns in order of first sight."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    whole = None
    for f in frames:
        f = f.select(*(F.col(c).cast("string") if c in f.columns else F.lit(None).cast("string").alias(c) for c in names))
        whole = f if whole is None else whole.unionByName(f)
    whole.coalesce(1).write.mode("overwrite").csv(path, header=True)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
