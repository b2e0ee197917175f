"""Retrieval: exact vector top-k, weighted lexical search, rank fusion, scope cascade, quota selection."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpworks.functions.text import normalize_text
from kelpworks.operators.nearest import nearest_of_block, query_blocks

#: The fusion's constant and words that are no search terms.
RRF_K = 60
STOPWORDS = frozenset(("va", "la", "cua", "cho", "trong", "theo", "ve", "tu", "tai", "voi", "duoc", "nam", "bao", "nhieu", "nao", "nhu", "the", "ra", "sao"))


class Embedder(Protocol):
    """What makes unit vectors of texts; called once a batch inside an Arrow UDF."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def cosine(a: Column, b: Column) -> Column:
    """In double, whatever the vectors' type; null where one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_top_k(rows: DataFrame, query: list[float], k: int, where: Column | None = None, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """O1 of one query: the filter reaches the scan, and each task keeps its best k (TakeOrderedAndProject)."""
    rows = rows if where is None else rows.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), row_id).limit(k)


def folded(text: str) -> str:
    text = (text or "").lower()
    if not text.isascii():
        unmarked = lambda m: "".join(c for c in m[0] if unicodedata.category(c) != "Mn")
        text = re.sub(r"[^\x00-\x7F]+", unmarked, unicodedata.normalize("NFD", text.replace("đ", "d")))
    return " ".join(text.split())


def terms_of(query: str, most: int = 12) -> list[str]:
    """R3 for one question, on the driver; lexical_index.terms_column is the same for a table of questions."""
    bare = lambda t: re.sub(r"[^a-z0-9]", "", folded(t))
    plain = [w for w in re.findall(r"[a-z0-9/.\-]+", folded(query)) if w not in STOPWORDS]
    grams = (" ".join(plain[i : i + n]) for n in range(5, 1, -1) for i in range(len(plain) - n + 1))
    phrases = list(islice((g for g in grams if len(bare(g)) >= 10), 6))
    out: dict[str, None] = {}
    for word in (w.strip("._-") for w in [*phrases, *re.findall(r"[\w/.\-]+", query.lower()), *re.findall(r"[\w/.\-]+", folded(query))]):
        short = len(word) < 3 and "/" not in word and not word.isdigit()
        if word and word not in STOPWORDS and not short and word not in out and len(out) < most:
            digits = re.sub("[^0-9]", "", word)
            out |= dict.fromkeys([word, *[bare(word)] * (len(bare(word)) >= 10), *[digits] * (len(digits) >= 4)])
    return list(out)


def weight_of(term: str) -> float:
    """How much a term's hit is worth."""
    norm, bare = folded(term), re.sub(r"[^a-z0-9]", "", folded(term))
    if " " in norm and len(bare) >= 10:
        return 2.4
    if re.fullmatch(r"\d{4,}", norm):
        return 2.0
    if "/" in norm or len(bare) >= 12:
        return 1.8
    return 1.4 if len(norm) >= 9 else 1.0


def lexical_search(rows: DataFrame, terms: list[str], fields: list[str], k: int, row_id: str, min_hits: int = 1, where: Column | None = None) -> DataFrame:
    """R2: a term hits if one field holds it raw, normalised or compact. The forms of a field are made once a row."""
    rows = rows if where is None else rows.where(where)
    forms = rows.withColumns({f"__{kind}_{f}": of(F.col(f)) for f in fields for kind, of in (("raw", lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))), ("norm", normalize_text))})
    forms = forms.withColumns({f"__comp_{f}": F.replace(F.col(f"__norm_{f}"), F.lit(" "), F.lit("")) for f in fields})
    hit_columns = {}
    for i, term in enumerate(terms):
        bare = re.sub(r"[^a-z0-9]", "", folded(term))
        plain = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", folded(term))).strip()
        wanted = [("raw", term.lower()), ("norm", plain), ("comp", bare)]
        tests = [F.contains(F.col(f"__{kind}_{f}"), F.lit(t)) for f in fields for kind, t in wanted if t]
        hit_columns[f"__hit_{i}"] = reduce(lambda a, b: a | b, tests, F.lit(False)).cast("int")
    marked = forms.withColumns(hit_columns)
    score = reduce(lambda a, b: a + b, (F.col(f"__hit_{i}") * weight_of(t) for i, t in enumerate(terms)), F.lit(0.0))
    hits = reduce(lambda a, b: a + b, (F.col(c) for c in hit_columns), F.lit(0))
    found = marked.select(*rows.columns, F.round(score, 6).alias("lex_score"), hits.alias("hits"))
    # the filter comes after the limit: below it, it would make each form again for each test
    enough = F.col("hits") >= max(1, min_hits)
    return found.orderBy(F.desc(enough), F.desc("lex_score"), F.desc("hits"), row_id).limit(k).where(enough)


def fetch_size(k: int, factor: int = 3) -> int:
    return max(k, min(96, k * factor))


def ranked(rows: DataFrame, *order: Column, per: str | None = None, most: int | None = None) -> DataFrame:
    """rows with `rank0`; without `per` over all rows, so only after a limit. With `most` the first so many of each group:
    the bound is on the row number itself, so that each task drops the others before the shuffle."""
    window = (Window.partitionBy(per) if per else Window.partitionBy(F.lit(0))).orderBy(*order)
    numbered = rows.withColumn("__n", F.row_number().over(window))
    return (numbered if most is None else numbered.where(F.col("__n") <= most)).withColumn("rank0", F.col("__n") - 1).drop("__n")


def fuse(sides: list[tuple[DataFrame, float]], key: str, k: int) -> DataFrame:
    """Sum of weight / (60 + rank + 1) over the sides; ties go to the smaller rank, then the key."""
    every = reduce(DataFrame.unionByName, [df.select(key, (F.lit(w) / (RRF_K + F.col("rank0") + 1)).alias("part"), F.col("rank0")) for df, w in sides])
    return every.groupBy(key).agg(F.round(F.sum("part"), 9).alias("rrf"), F.min("rank0").alias("first_seen")).orderBy(F.desc("rrf"), "first_seen", key).limit(k)


def wants_lexical(found: int, k: int, filtered: bool, one: bool, sparse_only: bool = True) -> bool:
    """Never with an identity filter; if only for sparse results, when some but under k came, or none without a filter."""
    return not one and (not sparse_only or 0 < found < k or (found == 0 and not filtered))


def multi_query_rrf(rows: DataFrame, queries: DataFrame, k: int, probe: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best `probe` rows of each query (at most 12 rows: query_id, q), fused in one pass over rows."""
    scored = rows.withColumn("__q", F.explode(_literal(queries)))
    scored = scored.select(row_id, F.col("__q.query_id").alias("query_id"), F.round(cosine(F.col(vector), F.col("__q.q")), 9).alias("sim"))
    return fuse([(ranked(scored, F.desc("sim"), F.col(row_id), per="query_id", most=probe), 1.0)], row_id, k)


def _literal(queries: DataFrame) -> Column:
    """The queries, at most 12, as an array literal, so that no join is needed."""
    rows = queries.limit(12).collect()
    return F.array(*(F.struct(F.lit(r["query_id"]).alias("query_id"), F.array(*(F.lit(float(x)) for x in r["q"])).alias("q")) for r in rows))


def query_candidates(message: str, district: str | None = None, year: int | None = None, dossier: str | None = None) -> list[str]:
    """The message, with the district, the year and both, and the dossier's code; each once by its normal form."""
    found = [message, f"{message} {district}" if district else "", f"{message} {year}" if year else "", f"{message} {district} {year}" if district and year else "", dossier or ""]
    return list({folded(x): x for x in reversed(found) if x.strip()}.values())[::-1]


@dataclass(frozen=True)
class Scope:
    """What a planning question asks for."""

    top_k: int = 16
    fact: bool = False
    final_k: int = field(init=False)
    probe_k: int = field(init=False)

    def __post_init__(self) -> None:
        final = max(4, min(self.top_k, 16 if self.fact else 12))
        object.__setattr__(self, "final_k", final)
        object.__setattr__(self, "probe_k", max(20, min(120, 8 * final)))

    def min_docs(self, strict: bool = False) -> int:
        """R10."""
        base = max(4, self.final_k // 2)
        return max(1, min(self.final_k, max(base, min(self.final_k, 6)) if strict and self.fact else base))


def cascade(rows: DataFrame, key: str, steps: list[tuple[Column, int]]) -> DataFrame:
    """The rows of the first step that has enough per key, in one job; else those of the fullest step.

    steps: a condition and the least number of rows. Counts of all steps are taken at once, then one is chosen.
    """
    marked = rows.withColumns({f"__s{i}": F.coalesce(c, F.lit(False)) for i, (c, _) in enumerate(steps)})
    counts = marked.groupBy(key).agg(*(F.count_if(f"__s{i}").alias(f"__n{i}") for i in range(len(steps))))
    enough = F.coalesce(*(F.when(F.col(f"__n{i}") >= least, F.lit(i)) for i, (_, least) in enumerate(steps)))
    fullest = F.array_position(F.array(*(F.col(f"__n{i}") for i in range(len(steps)))), F.greatest(*(F.col(f"__n{i}") for i in range(len(steps))), F.lit(0))).cast("int") - 1
    chosen = counts.select(key, F.coalesce(enough, fullest).alias("step"))
    of = F.get(F.array(*(F.col(f"__s{i}") for i in range(len(steps)))), F.col("step"))
    return marked.join(chosen, key).where(of).select(*rows.columns, "step")


def table_quota(limit: int, prefer_text: bool) -> int:
    """R13."""
    quota = 1 if limit == 1 else min(max(1, limit // 2), limit - 1)
    return min(quota, max(1, limit // 4)) if prefer_text else quota


def quota_select(rows: DataFrame, key: str, kind: str, order: list[Column], limit: int, table_kind: str = "table", prefer_text: bool = False) -> DataFrame:
    """Per key at most so many tables and texts, then what is left in order, up to the limit; adds `place`.

    A row beyond the limit among its own kind has that many before it in any case, so only so many a kind are shuffled."""
    tables = table_quota(limit, prefer_text)
    quota = F.when(F.col(kind) == table_kind, tables).otherwise(limit - tables)
    whole = Window.partitionBy(key)
    numbered = rows.withColumn("__in", F.row_number().over(Window.partitionBy(key, kind).orderBy(*order))).where(F.col("__in") <= limit)
    late = numbered.withColumn("__late", (F.col("__in") > quota).cast("int"))
    return late.withColumn("place", F.row_number().over(whole.orderBy("__late", *order))).where(F.col("place") <= limit).drop("__in", "__late")


def until_unique(rows: DataFrame, key: str, order: Column, most: int) -> DataFrame:
    """Per key the candidates up to the one at which `most` distinct items are reached. rows: key, candidate, item."""
    seen = Window.partitionBy(key, "item").orderBy(order)
    fresh = rows.withColumn("__new", (F.row_number().over(seen) == 1).cast("int"))
    before = fresh.groupBy(key, "candidate").agg(F.sum("__new").alias("__new"))
    running = before.withColumn("__before", F.sum("__new").over(Window.partitionBy(key).orderBy("candidate")) - F.col("__new")).where(F.col("__before") < most).select(key, "candidate")
    return rows.join(running, [key, "candidate"])


def best_matches(rows: DataFrame, asked: Column, block: int = 32768, nulls: bool = False) -> DataFrame:
    """query_id, vec_id, label and score of the best match of each asked row among all others, ties to the smaller
    id. Queries come to the driver a block at a time; a block meets all rows as products of matrices (nearest.py), which name
    the best row, and only that pair is scored here. As in SQL, NaN is above all numbers, and a vector without length scores
    NaN; null vectors take no part, or with `nulls` have null scores, which come last."""
    rows = rows.where(F.col("vec_id").isNotNull() if nulls else F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    queries = rows.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    # dealt by id, so that work doesn't hang on how the files are cut; with all columns, so that the join has the same exchange
    dealt = rows.select("vec_id", "embedding", "label").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "vec_id")
    met = [nearest_of_block(dealt, part) for part in query_blocks(queries.toLocalIterator(), block)]
    if not met:
        return rows.select(F.col("vec_id").alias("query_id"), "vec_id", "label", F.lit(0.0).alias("score")).limit(0)
    best = reduce(DataFrame.unionByName, met).groupBy("query_id").agg(F.min(F.struct("place", "vec_id")).alias("b")).select("query_id", "b.vec_id")
    pairs = dealt.join(best, "vec_id").join(queries, "query_id")
    owned = pairs.withColumns({"__own": dot(F.col("embedding"), F.col("embedding")), "__asked": dot(F.col("v"), F.col("v"))})
    lengths = F.sqrt(F.col("__own") * F.col("__asked"))
    score = F.when(lengths == 0, float("nan")).otherwise(dot(F.col("embedding"), F.col("v")) / F.nullif(lengths, F.lit(0.0)))
    scored = owned.select("query_id", "vec_id", "label", F.round(score, 6).alias("score"))
    return scored.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "label")).alias("b")).select("query_id", "vec_id", "b.label", "b.score")


def richer(current: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rows of the candidate list where it is strictly longer, else the current ones; order columns are kept.

    Both lists have the same columns; a null key is a key as others are."""
    sides = current.withColumn("__side", F.lit(0)).unionByName(candidate.withColumn("__side", F.lit(1)))
    sizes = sides.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(*(F.count_if(F.col("__side") == i).alias(f"__n{i}") for i in (0, 1)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return sides.join(sizes, same).where(F.col("__side") == (F.col("__n1") > F.col("__n0")).cast("int")).select(*current.columns)


def chunk_scan(rows: DataFrame, whole: Column, local: Column, limit: int = 2500) -> DataFrame:
    """The first chunks by their number in the document, else in their type, else 0; ties by content."""
    return rows.orderBy(F.coalesce(whole.cast("string"), local.cast("string"), F.lit("0")).cast("int"), *rows.columns).limit(max(1, limit))
