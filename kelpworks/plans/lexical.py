"""Queries that look for tables of markers and questions in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.functions.text import FROM, TO, normalize_text
from kelpworks.operators.lexical_index import LexicalIndex, question_terms
from kelpworks.operators.markers import match_markers
from kelpworks.operators.search import STOPWORDS
from kelpworks.plans.tables import table
from kelpworks.sources.scratch import fresh_path

#: Rows of each question, and the least length of a word of benchmark that is looked for in documents.
K, LEAST = 10, 4


def marker_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many and which of the benchmark's words of four letters or more each document holds, inside words too."""
    words = F.explode(F.split(normalize_text("text"), " "))
    markers = table(spark, sf_dir, "benchmark").select(words.alias("marker")).where(F.length("marker") >= LEAST).distinct()
    numbered = markers.withColumn("marker_id", F.xxhash64("marker"))
    docs = table(spark, sf_dir, "documents")
    found = match_markers(docs, numbered, "doc_id", normalize_text("text"))
    return found.groupBy("doc_id").agg(F.sum(F.size("found")).cast("long").alias("n_markers"))


_FOLD = f"regexp_replace(translate(lower(coalesce({{}}, '')), '{FROM}', '{TO}'), '\\p{{{{Mn}}}}+', '', 'g')"
_NORM = "trim(regexp_replace(regexp_replace(" + _FOLD + ", '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_LOOSE = "trim(regexp_replace(" + _FOLD + ", '\\s+', ' ', 'g'))"
_BARE = "regexp_replace(" + _FOLD + ", '[^a-z0-9]', '', 'g')"
MARKERS = f"""WITH m AS (SELECT DISTINCT unnest(string_split({_NORM.format('text')}, ' ')) AS marker FROM benchmark), d AS (SELECT doc_id, {_NORM.format('text')} AS body FROM documents)
SELECT doc_id, count(marker) AS n_markers FROM d LEFT JOIN m ON length(marker) >= {LEAST} AND contains(body, marker) GROUP BY doc_id"""


def lexical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of every user turn of conversations, with their weights."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    return question_terms(asked).select("question_id", "place", "term", (F.col("weight") / 10).alias("weight"))


def lexical_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 for a table of questions: the documents that answer each text of benchmark best, by text and source, in one job."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = LexicalIndex.build(docs, "doc_id", ["text", "source"], fresh_path(spark, "lexical"))
    found = index.search(table(spark, sf_dir, "benchmark"), K, "item_id", "text")
    return found.select(F.col("question_id").alias("item_id"), "rank", F.col("row_id").alias("doc_id"), "score", "hits")


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS)) + "]"
_SQUEEZED = "regexp_replace(" + _FOLD + ", '[^a-z0-9]', '', 'g')"


def _terms_sql(questions: str) -> str:
    """CTEs that end in terms (id, place, term, weight) of questions (id, q)."""
    return f"""WITH q AS ({questions}), loose AS (
  SELECT id, q, {_LOOSE.format('q')} AS f FROM q
), plain AS (
  SELECT *, list_filter(regexp_extract_all(f, '[a-z0-9/.\\-]+'), lambda w: NOT list_contains({_STOP}, w)) AS ws FROM loose
), grams AS (
  SELECT id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT id, ws, n, unnest(range(1, greatest(1, len(ws) - n + 2))) AS i FROM plain, (VALUES (5), (4), (3), (2)) s(n) WHERE len(ws) >= n)
), phrases AS (
  SELECT id, list(g ORDER BY n DESC, i)[1:6] AS ps FROM grams WHERE length(regexp_replace(g, '[^a-z0-9]', '', 'g')) >= 10 GROUP BY id
), words AS (
  SELECT p.id, list_transform(list_concat(list_concat(coalesce(ps, []), regexp_extract_all(lower(coalesce(q, '')), '[\\p{{L}}\\p{{N}}_/.\\-]+')), regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_/.\\-]+')), lambda w: regexp_replace(w, '^[._\\-]+|[._\\-]+$', '', 'g')) AS all_words
  FROM plain p LEFT JOIN phrases ON p.id = phrases.id
), fit AS (
  SELECT id, list_filter(all_words, lambda w: w <> '' AND NOT list_contains({_STOP}, w) AND (length(w) >= 3 OR contains(w, '/') OR regexp_matches(w, '^\\p{{Nd}}+$'))) AS ws FROM words
), folded AS (
  SELECT id, list_reduce(list_transform(ws, lambda w: [w, {_SQUEEZED.format('w')}, regexp_replace(w, '[^0-9]', '', 'g')]),
    lambda a, x: CASE WHEN len(a) >= 12 OR list_contains(a, x[1]) THEN a ELSE list_concat(list_concat(list_append(a, x[1]),
      CASE WHEN length(x[2]) >= 10 AND NOT list_contains(list_append(a, x[1]), x[2]) THEN [x[2]] ELSE [] END),
      CASE WHEN length(x[3]) >= 4 AND NOT list_contains(list_append(a, x[1]), x[3]) AND NOT (length(x[2]) >= 10 AND x[2] = x[3]) THEN [x[3]] ELSE [] END) END, CAST([] AS VARCHAR[])) AS ts FROM fit
), numbered AS (
  SELECT id, unnest(range(len(ts))) AS place, unnest(ts) AS term FROM folded
), terms AS (
  SELECT id, place, term, CASE WHEN contains(l, ' ') AND length(b) >= 10 THEN 2.4::DOUBLE WHEN regexp_full_match(l, '\\d{{4,}}') THEN 2.0::DOUBLE WHEN contains(l, '/') OR length(b) >= 12 THEN 1.8::DOUBLE WHEN length(l) >= 9 THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END AS weight, l, b
  FROM (SELECT *, {_LOOSE.format('term')} AS l, {_BARE.format('term')} AS b FROM numbered)
)"""


TERMS = _terms_sql("SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, text AS q FROM conversations WHERE role = 'user'") + " SELECT id AS question_id, CAST(place AS INTEGER) AS place, term, weight FROM terms"
BATCH = _terms_sql("SELECT item_id AS id, text AS q FROM benchmark") + f""", d AS (
  SELECT doc_id, lower(coalesce(text, '')) AS r1, lower(coalesce(source, '')) AS r2, {_NORM.format('text')} AS n1, {_NORM.format('source')} AS n2, {_BARE.format('text')} AS b1, {_BARE.format('source')} AS b2 FROM documents
), t AS (
  SELECT DISTINCT term, l, b FROM terms
), hit AS (
  SELECT doc_id, term FROM d JOIN t ON contains(r1, term) OR contains(r2, term) OR contains(n1, l) OR contains(n2, l) OR (b <> '' AND (contains(b1, b) OR contains(b2, b)))
), s AS (
  SELECT id, doc_id, round(sum(weight), 6) AS score, count(*) AS hits FROM hit JOIN terms USING (term) GROUP BY id, doc_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, hits DESC, doc_id) AS INTEGER) AS rank FROM s
)
SELECT id AS item_id, rank, doc_id, score, hits FROM r WHERE rank <= {K}"""

QUERIES = {"marker_hits": marker_hits, "lexical_terms": lexical_terms, "lexical_batch": lexical_batch}
SQL = {"marker_hits": MARKERS, "lexical_terms": TERMS, "lexical_batch": BATCH}
