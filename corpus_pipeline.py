"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.llm.decontaminate import drop_contaminated
from kelpworks.llm.line_dedup import drop_lines
from kelpworks.llm.mixing import domain_of, mix
from kelpworks.llm.near_dedup import drop_near, near_groups
from kelpworks.llm.quality import keep_good
from kelpworks.llm.shared import row_key, stored, table

#: What makes near copies: words of a shingle and similarity in percent.
SIZE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go; n_chars follows the text. The documents of a verified group of near copies count as one
    here, since the next stage keeps one of them: what only copies share is no boilerplate."""
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text"))[0], "text")
    groups = near_groups(keyed, "k1", size=SIZE, percent=PERCENT, native=True)
    copies = groups.where("id != component").select(F.col("id").alias("k1"), F.col("component").alias("of")).distinct()
    return drop_lines(docs, copies=copies).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8) stays: the one with the smallest id."""
    return drop_near(docs, size=SIZE, percent=PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the targets of their domains ask for, with domain, rate and copy."""
    labels = table(spark, sf_dir, "labels").select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    return mix(docs, labels)


STAGES = [("quality", quality), ("line dedup", lines), ("near dedup", near), ("decontaminate", decontaminate), ("mixing", mixing)]
#: SQL can't express the fitted models; the pipeline's tests hold it against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
