"""The narrowest scope with enough rows, decided for a whole table of questions in one job.

A scope is a list of fields; it applies to a question that has them all, and its rows are those with the same values.
Rows are counted and ranked once for each value of a scope, not for each question, so a scope that many questions share
costs no more than one. Questions then join counts, and only the chosen scopes' best rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpworks.functions.text import district_code

#: The planning scopes, from the narrowest on.
PLANNING = (
    ("dossier", ("dossier_code",)), ("district_year", ("district", "plan_year")), ("district", ("district",)),
    ("document_year", ("document_id", "plan_year")), ("document", ("document_id",)), ("year", ("plan_year",)), ("planning", ()),
)


#: Parts of the rows: each task ranks the rows of a part for every scope, and a table of few columns is few files.
PARTS = 128


def with_dossier(questions: DataFrame) -> DataFrame:
    """Questions with the code of the dossier that their district and year name."""
    return questions.withColumn("dossier_code", F.when(F.col("plan_year").isNotNull() & (F.trim("district") != ""), district_code(F.col("district"), F.col("plan_year").cast("string"))))


def _keys(rows: DataFrame, scopes, keep: list[Column]) -> DataFrame:
    """keep, place and key: a row for each scope whose fields are all there."""
    present = lambda fields: reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in fields), F.lit(True))
    made = [F.when(present(fields), F.struct(F.lit(n).alias("place"), F.to_json(F.array(*(F.col(f).cast("string") for f in fields))).alias("key"))) for n, (_, fields) in enumerate(scopes)]
    exploded = rows.select(*keep, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("__scope"))
    return exploded.select(*[c for c in exploded.columns if c != "__scope"], "__scope.place", "__scope.key")


def scoped(rows: DataFrame, questions: DataFrame, question_id: str, row_id: str, order: list[Column], k: int, least: int = 1, scopes=PLANNING) -> DataFrame:
    """question_id, scope, rank and row_id: the k first rows of each question's first scope with at least `least` rows, else of
    its fullest (the first of equals). Rows and questions have the scopes' fields as columns.

    Questions without a row in any scope have no result; equal questions have one each if their ids differ; scopes with the
    same rows for a question are one scope, the first.
    """
    keyed = _keys(rows.repartition(PARTS, row_id), scopes, [F.col(row_id), F.struct(*order).alias("__order")])
    counts = keyed.groupBy("place", "key").agg(F.count("*").alias("rows"))
    asked = _keys(questions, scopes, [F.col(question_id)]).join(counts, ["place", "key"])
    best = F.min(F.struct(F.when(F.col("rows") >= least, F.lit(0)).otherwise(-F.col("rows")).alias("worse"), F.col("place").alias("place"), F.col("key").alias("key")))
    enough = F.min(F.when(F.col("rows") >= least, F.struct("place", "key")))
    chosen = asked.groupBy(question_id).agg(enough.alias("enough"), best.alias("best"))
    chosen = chosen.select(question_id, F.coalesce("enough.place", "best.place").alias("place"), F.coalesce("enough.key", "best.key").alias("key"))
    per_key = Window.partitionBy("place", "key").orderBy("__order", row_id)
    top = keyed.withColumn("rank", F.row_number().over(per_key)).where(F.col("rank") <= k)
    names = F.array(*(F.lit(name) for name, _ in scopes))
    return chosen.join(top, ["place", "key"]).select(question_id, F.get(names, F.col("place")).alias("scope"), "rank", row_id)
