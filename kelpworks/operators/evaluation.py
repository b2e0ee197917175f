"""Evaluation analytics: metric statistics, scorecards, balanced samples, cost proxy, choice of a configuration."""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds, and how a judge's metric names map to ours (tested in this order).
THRESHOLDS = {"contextual_recall": 0.65, "faithfulness": 0.70, "answer_relevancy": 0.70, "composite": 0.70, "knowledge_retention": 0.75}
NAMES = (("contextual recall", "contextual_recall"), ("contextual relevancy", "contextual_recall"), ("faithfulness", "faithfulness"), ("relevancy", "answer_relevancy"), ("retention", "knowledge_retention"))
REQUIRED = ("contextual_recall", "faithfulness", "answer_relevancy")


def canonical(name: Column) -> Column:
    """A7."""
    flat = F.lower(F.translate(name, "_", " "))
    return reduce(lambda out, x: F.when(F.contains(flat, F.lit(x[0])), F.lit(x[1])).otherwise(out), reversed(NAMES), F.lit(None).cast("string"))


def metric_rows(results: DataFrame, tests: str = "test_results") -> DataFrame:
    """case_id, metric, score of a judge's nested results (see the type in FIXTURES A5)."""
    cases = results.select(F.posexplode(tests).alias("case_id", "t"))
    long = cases.select("case_id", F.explode("t.metrics_data").alias("m")).select("case_id", canonical(F.col("m.name")).alias("metric"), F.col("m.score").cast("double").alias("score"))
    return long.where("metric is not null")


def metric_stats(scores: DataFrame, thresholds: dict[str, float] = THRESHOLDS, by: tuple[str, ...] = ()) -> DataFrame:
    """N, threshold, mean, pass_count and pass_rate by metric, six digits; null where there is no score."""
    limit = F.coalesce(*(F.when(F.col("metric") == m, F.lit(t)) for m, t in thresholds.items()))
    marked = scores.withColumn("threshold", limit)
    out = marked.groupBy(*by, "metric", "threshold").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.count_if(F.col("score") >= F.col("threshold")).alias("pass_count"))
    return out.withColumn("pass_rate", F.round(F.col("pass_count") / F.nullif(F.col("n"), F.lit(0)), 6))


def case_table(scores: DataFrame, required: tuple[str, ...] = REQUIRED, case: str = "case_id") -> DataFrame:
    """Cases that have all metrics, with the composite (their mean) and whether all thresholds are met."""
    wide = scores.groupBy(case).pivot("metric", list(required)).agg(F.first("score")).dropna("any", subset=list(required))
    mean = reduce(lambda a, b: a + b, (F.col(m) for m in required)) / len(required)
    strict = reduce(lambda a, b: a & b, (F.col(m) >= THRESHOLDS[m] for m in required))
    return wide.withColumn("composite", F.round(mean, 6)).withColumn("strict", strict)


def weighted_quality(means: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted mean of the metrics that have one; null without."""
    w = F.coalesce(*(F.when(F.col("metric") == m, F.lit(x)) for m, x in weights.items()), F.lit(0.0))
    has = F.when(F.col("mean").isNotNull(), w)
    return means.agg(F.round(F.sum(has * F.col("mean")) / F.nullif(F.sum(has), F.lit(0.0)), 6).alias("quality"))


def scorecard(scores: DataFrame, weights: dict[str, float], case: str = "case_id") -> DataFrame:
    """One row: composite, its pass rate, the strict rate, and the weighted quality."""
    cases = case_table(scores, case=case)
    head = cases.agg(F.count("*").alias("cases"), F.round(F.avg("composite"), 6).alias("composite_mean"), F.round(F.avg((F.col("composite") >= THRESHOLDS["composite"]).cast("int")), 6).alias("composite_pass_rate"), F.round(F.avg(F.col("strict").cast("int")), 6).alias("strict_pass_rate"))
    return head.withColumn("__j", F.lit(1)).join(weighted_quality(metric_stats(scores), weights).withColumn("__j", F.lit(1)), "__j").drop("__j")  # one row each


def value_counts(rows: DataFrame, field: str, empty_too: bool = False) -> DataFrame:
    """Null (and, if asked, empty) counts as unknown."""
    value = F.nullif(F.col(field), F.lit("")) if empty_too else F.col(field)
    return rows.groupBy(F.coalesce(value, F.lit("unknown")).alias(field)).agg(F.count("*").alias("n"))


def profile(rows: DataFrame, by: str, means: list[str], tokens: list[str]) -> DataFrame:
    """Mean seconds (3 digits), mean (1 digit) and summed tokens; what is no number is left out."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    parts = [F.round(F.avg(number(c)), 3).alias(f"{c}_avg") for c in means]
    for c in tokens:
        parts += [F.round(F.avg(number(c)), 1).alias(f"{c}_avg"), F.coalesce(F.sum(number(c)), F.lit(0.0)).cast("bigint").alias(f"{c}_sum")]
    return rows.groupBy(F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("unknown")).alias(by)).agg(F.count("*").alias("cases"), *parts).orderBy(by)


def balanced_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Rows in turn from each group, groups by their first row, up to n in all; at most n of a group are shuffled."""
    turned = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("turn") <= n)
    first = turned.withColumn("__first", F.min(order).over(Window.partitionBy(group)))
    return first.orderBy("turn", "__first", order).limit(n).drop("__first")


def cost_proxy(runtime: Column, characters: Column, chunks: Column, k: Column) -> Column:
    """H29."""
    return runtime + characters / 4000 + chunks / 100000 + k / 100


def configurations(models: DataFrame, chunkings: DataFrame, ks: DataFrame) -> DataFrame:
    """The grid of three bounded lists (hundreds of rows at most), with an id of each."""
    array = lambda df: F.array(*(F.lit(r[0]) for r in df.collect()))
    spark = models.sparkSession
    grid = spark.range(1).select(F.explode(array(models)).alias("embedding_model")).withColumn("chunking", F.explode(array(chunkings))).withColumn("top_k", F.explode(array(ks)))
    from kelpworks.functions.text import slug

    return grid.withColumn("config_id", F.concat(slug(F.col("embedding_model")), F.lit("__"), slug(F.col("chunking")), F.lit("__k"), F.col("top_k")))


def eligible(rows: DataFrame, base_faithfulness: float, base_relevancy: float) -> DataFrame:
    """Not failed, not more than 0.02 under the baseline, within 0.01 of the best recall."""
    good = rows.where((F.coalesce("status", F.lit("ok")) != "failed") & (F.col("f") >= base_faithfulness - 0.02) & (F.col("ar") >= base_relevancy - 0.02))
    best = good.agg(F.max("cr").alias("__best"))
    return good.withColumn("__j", F.lit(1)).join(F.broadcast(best.withColumn("__j", F.lit(1))), "__j").where(F.col("cr") >= F.col("__best") - 0.01).drop("__best", "__j")


def winner(rows: list) -> object | None:
    """The order with tolerances isn't transitive, so it is applied to the few eligible rows on the driver."""

    def compare(a, b) -> int:
        for m in ("cr", "f", "ar"):
            if abs(a[m] - b[m]) > 0.005:
                return -1 if a[m] > b[m] else 1
        for m in ("cost", "run_s", "top_k"):
            if a[m] != b[m]:
                return -1 if a[m] < b[m] else 1
        return 0

    return sorted(rows, key=functools.cmp_to_key(compare))[0] if rows else None


def top_report(rows: DataFrame, metric: str, key: str, n: int = 10) -> DataFrame:
    """A null metric ranks as -1."""
    return rows.orderBy(F.desc(F.coalesce(F.col(metric), F.lit(-1.0))), key).limit(n)


def target_metadata(text: Column, names: tuple[str, ...] = ("postId", "propertyId", "planningDocumentId")) -> list[Column]:
    """key=int pairs of a context as columns."""
    return [F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?i)\b{n}\s*[=:]\s*(\d+)", 1), F.lit("")).cast("bigint").alias(n) for n in names]


#: Where a message's JSON has its token counts, the first that is neither absent nor 0 first.
USAGE = {
    "input_tokens": ("usage_metadata.input_tokens", "token_usage.prompt_tokens", "token_usage.input_tokens"),
    "output_tokens": ("usage_metadata.output_tokens", "token_usage.completion_tokens", "token_usage.output_tokens"),
    "total_tokens": ("usage_metadata.total_tokens", "token_usage.total_tokens"),
}


def token_usage(message: Column) -> Column:
    """A struct of a message's input, output and total tokens from its JSON; the total is their sum where it isn't given.

    A response's usage is that of `token_usage`, or of `usage` where that is absent or empty. What is no number is null;
    a count of 0 counts only where no other place has one."""
    own = F.coalesce(message, F.lit("{}"))
    inner = lambda name: F.nullif(F.get_json_object(own, f"$.response_metadata.{name}"), F.lit("{}"))
    response = F.coalesce(inner("token_usage"), inner("usage"))

    def at(path: str) -> Column:
        where, name = path.split(".")
        found = F.get_json_object(own, f"$.{path}") if where == "usage_metadata" else F.get_json_object(response, f"$.{name}")
        return found.try_cast("bigint")

    picked = {n: F.coalesce(*(F.nullif(at(p), F.lit(0)) for p in paths), *(at(p) for p in reversed(paths))) for n, paths in USAGE.items()}
    total = F.coalesce(picked["total_tokens"], picked["input_tokens"] + picked["output_tokens"])
    return F.struct(picked["input_tokens"].alias("input_tokens"), picked["output_tokens"].alias("output_tokens"), total.alias("total_tokens"))
