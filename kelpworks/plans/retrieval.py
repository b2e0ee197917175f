"""Retrieval queries: vector, lexical and fused top-k, cascades, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.operators.filters import build_filter, compiled
from kelpworks.operators.search import best_matches, cascade, fetch_size, fuse, lexical_search, multi_query_rrf, quota_select, ranked, terms_of, until_unique, vector_top_k, weight_of
from kelpworks.plans.tables import table

#: A question of the tables' own words, its terms and the fields that are searched.
QUESTION = "the license version 2.0 of thing"
K = 8


def _query(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest to vector 0 among labels 0 to 4."""
    rows = table(spark, sf_dir, "embeddings").where(compiled({"label": {"$in": ["0", "1", "2", "3", "4"]}}, lambda n: F.col(n)))
    return vector_top_k(rows, _query(spark, sf_dir), K).select("vec_id", "label", F.round("score", 6).alias("score"))


_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"
VECTOR_TOP = f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label < 5 ORDER BY {_COS} DESC, e.vec_id LIMIT {K}"


def lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, R2: weighted term hits over text and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lexical_search(docs, terms_of(QUESTION), ["text", "source"], fetch_size(K), "doc_id").select("doc_id", "lex_score", "hits")


def _lexical_sql() -> str:
    import re

    from kelpworks.functions.text import FROM, TO

    fold = lambda c: f"regexp_replace(translate(lower(coalesce({c}, '')), '{FROM}', '{TO}'), '\\p{{Mn}}+', '', 'g')"
    forms, tests = [], []
    for f in ("text", "source"):
        forms += [f"lower(coalesce({f}, '')) AS raw_{f}", f"trim(regexp_replace(regexp_replace({fold(f)}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm_{f}", f"regexp_replace({fold(f)}, '[^a-z0-9]', '', 'g') AS comp_{f}"]
    for t in terms_of(QUESTION):
        plain, bare = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t)).strip(), re.sub(r"[^a-z0-9]", "", t)
        tests.append("CAST((" + " OR ".join(f"contains({k}_{f}, '{v}')" for f in ("text", "source") for k, v in (("raw", t), ("norm", plain), ("comp", bare)) if v) + ") AS INTEGER)")
    score = " + ".join(f"{t} * CAST({weight_of(x)} AS DOUBLE)" for t, x in zip(tests, terms_of(QUESTION), strict=True))
    return f"WITH b AS (SELECT doc_id, {', '.join(forms)} FROM documents), s AS (SELECT doc_id, round({score}, 6) AS lex_score, {' + '.join(tests)} AS hits FROM b) SELECT doc_id, lex_score, hits FROM s WHERE hits >= 1 ORDER BY lex_score DESC, hits DESC, doc_id LIMIT {fetch_size(K)}"


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and lexical ranks of one question, fused."""
    vectors = vector_top_k(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), fetch_size(K)).select(F.col("vec_id").alias("doc_id"), "score")
    sides = [(ranked(vectors, F.desc("score"), F.col("doc_id")), 1.0), (ranked(lexical_top(spark, sf_dir), F.desc("lex_score"), F.desc("hits"), F.col("doc_id")), 1.0)]
    return fuse(sides, "doc_id", K)


def _hybrid_sql() -> str:
    n = fetch_size(K)
    return f"""WITH v AS (SELECT e.vec_id AS doc_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, doc_id LIMIT {n}),
vr AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS rank0 FROM v),
l AS ({_lexical_sql()}), lr AS (SELECT doc_id, row_number() OVER (ORDER BY lex_score DESC, hits DESC, doc_id) - 1 AS rank0 FROM l),
a AS (SELECT * FROM vr UNION ALL SELECT * FROM lr)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank0 + 1)), 9) AS rrf, CAST(min(rank0) AS INTEGER) AS first_seen FROM a GROUP BY doc_id ORDER BY rrf DESC, first_seen, doc_id LIMIT {K}"""


def multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ids 0, 7 and 14 as candidate queries."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id").isin(0, 7, 14)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return multi_query_rrf(rows, asked, 12, 20)


MULTI = f"""WITH s AS (SELECT q.vec_id AS qid, e.vec_id, round({_COS}, 9) AS sim FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (0, 7, 14)) q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) - 1 AS rank0 FROM s)
SELECT vec_id, round(sum(1.0::DOUBLE / (61 + rank0)), 9) AS rrf, CAST(min(rank0) AS INTEGER) AS first_seen FROM r WHERE rank0 < 20 GROUP BY vec_id ORDER BY rrf DESC, first_seen, vec_id LIMIT 12"""


def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the documents of the strictest of three scopes that has 30, else of the fullest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    steps = [((F.col("lang") == "es") & (F.col("n_chars") > 3000), 30), (F.col("lang") == "es", 30), (F.col("lang").isin("es", "fr"), 30)]
    return cascade(docs, "source", steps).groupBy("source", "step").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


CASCADE = """WITH d AS (SELECT source, doc_id, lang = 'es' AND n_chars > 3000 AS s0, lang = 'es' AS s1, lang IN ('es', 'fr') AS s2 FROM documents),
c AS (SELECT source, count(*) FILTER (s0) AS n0, count(*) FILTER (s1) AS n1, count(*) FILTER (s2) AS n2 FROM d GROUP BY source),
p AS (SELECT source, CASE WHEN n0 >= 30 THEN 0 WHEN n1 >= 30 THEN 1 WHEN n2 >= 30 THEN 2 WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS step FROM c)
SELECT source, step, count(*) AS n, min(doc_id) AS first_id FROM d JOIN p USING (source) WHERE (step = 0 AND s0) OR (step = 1 AND s1) OR (step = 2 AND s2) GROUP BY source, step"""


def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6 documents a source, at most 3 of the odd lengths that stand for tables, longest first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.when(F.col("n_chars") % 2 == 1, "table").otherwise("text").alias("kind"))
    return quota_select(docs, "source", "kind", [F.desc("n_chars"), F.col("doc_id")], 6).select("source", "doc_id", "kind", "place")


QUOTA = """WITH d AS (SELECT source, doc_id, n_chars, CASE WHEN n_chars % 2 = 1 THEN 'table' ELSE 'text' END AS kind FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY n_chars DESC, doc_id) > 3 AS late FROM d),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY late, n_chars DESC, doc_id) AS INTEGER) AS place FROM a)
SELECT source, doc_id, kind, place FROM b WHERE place <= 6"""


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer in turn, until 5 distinct parts are reached."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"), "l_linenumber")
    rows = orders.join(items, "o_orderkey").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("candidate"), "item", "l_linenumber")
    kept = until_unique(rows, "key", F.struct("candidate", "l_linenumber"), 5)
    return kept.groupBy("key").agg(F.count("*").alias("n"), F.max("candidate").alias("last_candidate"))


EARLY = """WITH r AS (SELECT o_custkey AS key, o_orderkey AS candidate, l_partkey AS item, l_linenumber AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY key, item ORDER BY candidate, n) = 1 AS INTEGER) AS fresh FROM r),
c AS (SELECT key, candidate, sum(fresh) AS s FROM f GROUP BY key, candidate),
k AS (SELECT key, candidate FROM (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY candidate) - s AS before FROM c) WHERE before < 5)
SELECT key, count(*) AS n, max(candidate) AS last_candidate FROM r JOIN k USING (key, candidate) GROUP BY key"""


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a compiled filter over JSON fields: k from 20 to 80 of clicks and views."""
    tree = build_filter({"priceMin": 20, "priceMax": 80, "chunkTypes": ["Click", " view "]})
    fields = {"price": F.get_json_object("props", "$.k"), "chunkType": F.col("event_type")}
    rows = table(spark, sf_dir, "events").where(compiled(tree, lambda n: fields[n]))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


FILTER = """SELECT event_type, count(*) AS n, min(event_id) AS first_event FROM events
WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 20 AND 80 AND lower(event_type) IN ('click', 'view') GROUP BY event_type"""


def label_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100 the label of the best match among all others."""
    return best_matches(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, nulls=True)


NEIGHBOURS = f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q ON q.vec_id <> e.vec_id)
SELECT query_id, vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n = 1"""

QUERIES = {"vector_top": vector_top, "lexical_top": lexical_top, "hybrid_rrf": hybrid_rrf, "multi_query": multi_query, "filter_cascade": filter_cascade, "quota_selection": quota_selection, "early_stop": early_stop, "metadata_filter": metadata_filter, "label_neighbours": label_neighbours}
SQL = {"vector_top": VECTOR_TOP, "lexical_top": _lexical_sql(), "hybrid_rrf": _hybrid_sql(), "multi_query": MULTI, "filter_cascade": CASCADE, "quota_selection": QUOTA, "early_stop": EARLY, "metadata_filter": FILTER, "label_neighbours": NEIGHBOURS}
