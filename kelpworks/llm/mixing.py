"""Mixing to target weights with soft domain membership; built-in Spark functions only.

1. Classifier: naive Bayes on the presence of all terms (words, runs of ASCII symbols, a word said three times in a row),
   hashed to BUCKETS and counted over the documents of a labelled table, predicts each document's posterior over the
   domains (a document belongs to each in part). A bucket's log odds in a domain count where they differ from those
   in all documents by more than SURE standard errors and FACTOR, so that small differences of many terms don't add up.
2. Rates: minimise the squared relative misses of the expected domain token totals plus a ridge that keeps rates near
   one, over nonnegative rates of the documents, by projected gradient. A step needs one sum per domain over all
   documents; a document's rate follows from the residuals of all steps, so only these go to the driver.
3. Mix: a document of rate r appears floor(r) times, and once more with the remaining chance, by a hash of its key.

Only the sums per domain and step, and the counts of the buckets, leave the executors.

Defined results: a null or empty text has no tokens, the prior as posterior, and rate 1; domains without a labelled
document get no mass; targets are normalised over those that have; without labels all posteriors are equal; a label
whose id or domain is null is ignored, repeated labels count once each; repeated rows share the rounding of their
rate; other columns are left alone, whatever their names, save domain, rate and copy, which are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.llm.shared import row_key, stored, table

#: Buckets of hashed terms, and labelled documents of each domain that the classifier reads, at most.
BUCKETS, SAMPLE = 32_768, 10_000
#: A bucket's log odds count where they differ by more than so many standard errors and by more than this factor (chosen by held-out likelihood of labels).
SURE, FACTOR = 4.0, 4.0
#: Steps of the projected gradient, and the weight of the ridge against the misses.
STEPS, RIDGE = 40, 1e-3
#: The steps end when the token-weighted root mean square of the projected gradient is below.
SETTLED = 3e-5
#: Target shares of the expected tokens by domain.
TARGETS = {"good": 0.92, "low": 0.08, "toxic": 0.0}


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "low")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]++"), lambda w: w != "")


def terms_of(words: Column, text: Column, of=lambda bucket: bucket) -> Column:
    """Different buckets (or what `of` makes of them) of a text's words, its runs of ASCII symbols, and of a word said three times in a row."""
    text = F.coalesce(text, F.lit(""))
    signs = F.regexp_extract_all(text, F.lit(r"[!-/:-@\[-`{-~]++"), F.lit(0))
    again = F.when(text.rlike(r"(?<!\S)(\S{1,40}+)\x20\1\x20\1(?!\S)"), F.array(F.lit("<again>"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(words, signs, again), lambda t: of(F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))))


def bucket_weights(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Log likelihood of a text without any term by domain, and what the presence of each bucket adds. labels: doc_id, domain."""
    own = labels.select(F.col(doc_id).alias("id"), "domain").where("id is not null and domain is not null")
    there = {r[0]: r[1] for r in own.groupBy("domain").count().collect()}  # as many rows as domains
    if not there:
        return {}, {}
    mixed = F.xxhash64("id", F.lit(8))
    picked = reduce(DataFrame.unionByName, [own.where(F.col("domain") == d).orderBy(mixed, "id").limit(sample) for d in sorted(there)])
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")  # at most sample ids a domain
    rows = stored(rows.select("domain", terms_of(words_of(F.col("text")), F.col("text")).alias("terms")), "labelled")
    size = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    if not size:  # none of the labelled documents is there
        return {}, {}
    held = rows.select("domain", F.explode("terms").alias("bucket")).groupBy("bucket").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(sorted(size)))).collect()  # at most BUCKETS rows
    total, whole = sum(there[d] for d in size), sum(size.values())
    start, weights = {d: math.log(there[d] / total) for d in size}, {d: [0.0] * BUCKETS for d in size}
    for row in held:
        pooled = (sum(row[1:]) + 0.5) / (whole + 1)
        base = math.log(pooled / (1 - pooled))
        for n, d in zip(row[1:], sorted(size), strict=True):
            yes, no = n + 0.5, size[d] - n + 0.5
            apart = math.log(yes / no) - base
            apart = apart if abs(apart) > max(SURE * math.sqrt(1 / yes + 1 / no), math.log(FACTOR)) else 0.0
            weights[d][row["bucket"]] = apart  # what all domains have in common makes no difference to the posterior
            start[d] -= math.log1p(math.exp(base + apart)) - math.log1p(math.exp(base))
    return start, weights


def _sum(places: str, values: Column, start: float) -> Column:
    return F.aggregate(places, F.lit(start), lambda a, n: a + F.get(values, n))


def with_posteriors(docs: DataFrame, priors: dict[str, float], weights: dict[str, list[float]], domains: list[str]) -> DataFrame:
    """docs (with a column text, and others that are kept) with tokens (long) and posterior (array in the order of domains)."""
    kept = [c for c in docs.columns if c not in ("tokens", "posterior")]
    docs = docs.select(*kept, words_of(F.col("text")).alias("w"))
    if not priors:
        return docs.select(*kept, F.size("w").cast("long").alias("tokens"), F.array(*(F.lit(1.0 / len(domains)) for _ in domains)).alias("posterior"))
    known = [d for d in domains if d in priors]
    telling = [i for i, x in enumerate(zip(*(weights[d] for d in known), strict=True)) if any(x)]
    rank = [-1] * BUCKETS
    for n, i in enumerate(telling):
        rank[i] = n
    literal = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")  # noqa: E731 - folded to one constant
    terms = F.filter(terms_of(F.col("w"), F.col("text"), lambda b: F.get(literal(rank, "int"), b)), lambda n: n >= 0)
    docs = docs.select(*kept, F.size("w").cast("long").alias("tokens"), (terms if telling else F.array().cast("array<int>")).alias("t"))
    scores = []
    for d in known:
        column = literal([weights[d][i] for i in telling], "double") if telling else F.array().cast("array<double>")
        scores.append(_sum("t", column, priors[d]))
    docs = docs.select(*kept, "tokens", F.array(*scores).alias("l"))
    docs = docs.select(*kept, "tokens", F.transform("l", lambda x: F.exp(x - F.array_max("l"))).alias("e"))
    docs = docs.select(*kept, "tokens", "e", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("m"))
    share = {d: F.get("e", F.lit(i)) / F.col("m") for i, d in enumerate(known)}
    return docs.select(*kept, "tokens", F.array(*(share.get(d, F.lit(0.0)) for d in domains)).alias("posterior"))


def steps_of(moves: list[list[float]], width: float, ridge: float, onward: float = 0.0) -> Column:
    """A document's rate `r` after the steps so far, `was` before the last one, `y`, from where that one went, and `next`,
    where the momentum `onward` takes it. All numbers that change from step to step are inside this one expression, so that
    the code generated for a step's sums is the same for all steps and is compiled once.

    A move has the momentum that takes the last two rates to y, then a residual for each domain; the step is
    -width * (ridge * (y - 1) + posterior . residual), and the rate at least 0.
    """
    one = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("was"), F.lit(1.0).alias("y"))
    if not moves:
        return one.withField("next", F.lit(1.0))

    def step(s: Column, m: Column) -> Column:
        y = s["r"] + F.get(m, F.lit(0)) * (s["r"] - s["was"])
        slope = reduce(lambda x, z: x + z, (F.get(m, F.lit(i)) * F.get("posterior", F.lit(i - 1)) for i in range(1, len(moves[0]))))
        return F.struct(F.greatest(F.lit(0.0), y - width * (slope + ridge * (y - 1.0))).alias("r"), s["r"].alias("was"), y.alias("y"))

    ahead = lambda s: F.struct(s["r"].alias("r"), s["was"].alias("was"), s["y"].alias("y"), (s["r"] + onward * (s["r"] - s["was"])).alias("next"))
    return F.aggregate(F.array(*(F.array(*(F.lit(float(x)) for x in m)) for m in moves)), one, step, ahead)


def fit_rates(docs: DataFrame, targets: dict[str, float], domains: list[str], steps: int = STEPS, ridge: float = RIDGE) -> tuple[Column, list[float], list[float]]:
    """The rate as an expression over posterior; shares before and after. docs: tokens, posterior (best stored).

    With N tokens in all, the misses are e_k = sum_d r_d * tokens_d * p_dk / N - target_k, the loss
    sum_k e_k^2 / (2 start_k), with start_k the share at rate 1, plus ridge / 2 times the token-weighted mean of
    (r_d - 1)^2. In the metric that weighs documents by their tokens the gradient at a document is
    sum_k p_dk e_k / start_k + ridge * (r_d - 1); its curvature is at most 1 + ridge, so steps of 1 / (1 + ridge)
    converge, from points that momentum has carried on (accelerated projected gradient).
    """
    width = 1.0 / (1.0 + ridge)
    moves: list[list[float]] = []
    docs = stored(docs.groupBy("posterior").agg(F.sum("tokens").alias("tokens")), "cells")  # equal posteriors have equal rates

    def totals(momentum: float) -> tuple[float, list[float], list[float], float]:
        """Tokens, shares where the next step starts and those at the rates, and the size of the projected gradient that the last step followed."""
        own = docs.withColumn("s", steps_of(moves, width, ridge, momentum))
        at, r = F.col("s.next"), F.col("s.r")
        moved = F.sum(F.col("tokens") * F.pow((r - F.col("s.y")) / width, F.lit(2))).alias("moved")
        sums = [F.sum(F.col("tokens") * x * F.get("posterior", F.lit(i))).alias(f"{n}{i}") for n, x in (("y", at), ("r", r)) for i in range(len(domains))]
        row = own.agg(F.sum("tokens").alias("n"), moved, *sums).first()
        n = float(row["n"] or 0)
        shares = lambda c: [float(row[f"{c}{i}"] or 0) / max(n, 1.0) for i in range(len(domains))]
        return n, shares("y"), shares("r"), math.sqrt(float(row["moved"] or 0) / max(n, 1.0))

    n, there, start, _ = totals(0.0)
    wanted = [targets.get(d, 0.0) if s > 0 else 0.0 for d, s in zip(domains, start, strict=True)]
    whole = sum(wanted)
    now, momentum = start, 0.0
    if n and whole:
        wanted = [w / whole for w in wanted]
        for turn in range(1, steps + 1):
            moves.append([momentum, *((s - w) / max(b, 1e-6) for s, w, b in zip(there, wanted, start, strict=True))])
            momentum = (turn - 1) / (turn + 2)
            n, there, now, gradient = totals(momentum)
            if gradient < SETTLED:
                break
    return F.when(F.col("tokens") > 0, steps_of(moves, width, ridge)["r"]).otherwise(1.0), start, now


def copies_of(k1: str, k2: str) -> Column:
    """How often a document of column `rate` appears: rounded by a hash of its key, so that totals hold on average."""
    chance = F.pmod(F.xxhash64(k1, k2, F.lit(88)), F.lit(1_000_000)) / 1e6
    return (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], doc_id: str, text: str) -> tuple[DataFrame, tuple, Column]:
    """The stored posteriors (k1, k2, id, tokens, posterior), the classifier, and the rate as an expression over them."""
    domains = sorted(targets)
    model = bucket_weights(docs, labels, doc_id, text)
    own = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    scored = stored(with_posteriors(own, *model, domains).drop("text"), "posteriors")
    return scored, model, fit_rates(scored, targets, domains)[0]


def likeliest(targets: dict[str, float]) -> Column:
    return F.get(F.array(*(F.lit(d) for d in sorted(targets))), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs as often as their rates say, with domain, rate and copy (from 0). Posteriors are computed anew, so no text is shuffled."""
    _, model, rate = fit(docs, labels, targets, doc_id, text)
    own = [c for c in docs.columns if c not in ("domain", "rate", "copy")]
    keyed = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"), F.struct(*(F.col(c) for c in own)).alias("row"))
    rated = with_posteriors(keyed, *model, sorted(targets)).withColumn("rate", rate).withColumn("domain", likeliest(targets))
    times = rated.withColumn("n", copies_of("k1", "k2"))
    # no filter below the generator: it would be pushed down and compute the posteriors again for each use
    spread = F.explode_outer(F.slice(F.sequence(F.lit(0).cast("long"), F.col("n")), F.lit(1), F.col("n").cast("int")))
    return times.select("row", "domain", "rate", spread.alias("copy")).where("copy is not null").select("row.*", "domain", "rate", "copy")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of all documents; the domains good, low and toxic are learned from labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    scored, _, rate = fit(table(spark, sf_dir, "documents"), labels, TARGETS, "doc_id", "text")
    found = scored.withColumn("rate", rate).withColumn("copies", copies_of("k1", "k2"))
    shares = [F.round(F.get("posterior", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return found.select(F.col("id").alias("doc_id"), likeliest(TARGETS).alias("domain"), "tokens", *shares, F.round("rate", 6).alias("rate"), "copies")
