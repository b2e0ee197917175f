"""Queries for outside calls, references to earlier messages, and scopes of a table of questions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.operators.calls import AnswerCache, answered, verdict_score
from kelpworks.operators.history import with_history
from kelpworks.operators.scopes import scoped
from kelpworks.plans.tables import table
from kelpworks.sources.scratch import fresh_path
from kelpworks.sources.store import ChunkStore

#: Characters that the judge of judged_answers takes, and rows of each question of scoped_rows.
MOST, K = 900, 5


def word_judge(requests: list[str]) -> list[str]:
    """A judge that needs no service: a sentence is supported if it shares a word with the question; too long texts fail."""
    out = []
    for request in map(json.loads, requests):
        if len(request["question"]) + len(request["answer"]) > MOST:
            raise ValueError("too long")
        known = set(request["question"].lower().split(" "))
        sentences = [s.lower().split(" ") for s in request["answer"].split(".") if s.strip(" \n")]
        out.append(json.dumps({"verdicts": [{"verdict": "yes" if known & set(s) - {""} else "no"} for s in sentences]}))
    return out


def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer of conversations against the question before it, asked in batches that split where one fails."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    asked = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    both = talk.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    request = F.to_json(F.struct("question", F.col("text").alias("answer")))
    found = answered(both, request, word_judge, AnswerCache(spark, fresh_path(spark, "answers")))
    return found.select("conv_id", "turn", verdict_score(F.col("answer")).alias("score"), F.col("error").isNotNull().alias("failed"))


JUDGED = f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), p AS (
  SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer FROM t a JOIN t q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant' AND q.role = 'user'
), s AS (
  SELECT *, length(question) + length(answer) > {MOST} AS failed,
    list_transform(list_filter(string_split(answer, '.'), lambda x: trim(x, chr(32) || chr(10)) <> ''), lambda x: len(list_intersect(list_filter(string_split(lower(x), ' '), lambda w: w <> ''), string_split(lower(question), ' '))) > 0) AS fine FROM p
)
SELECT conv_id, turn, CASE WHEN failed THEN NULL WHEN len(fine) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(fine, lambda x: x)) / len(fine), 6) END AS score, failed FROM s"""


def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long word that each message names, or that an earlier message does: of the user before others, or of anyone."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    thing = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), r"(\p{L}{12,})", 1), F.lit(""))
    one = with_history(talk, "thing", thing, when=F.contains("text", F.lit(",")), fallback=F.lit("none"))
    return with_history(one, "anyone", thing, any_role=True).select("conv_id", "turn", "thing", "anyone")


LOOKUP = """WITH t AS (SELECT conv_id, turn, role, text, nullif(regexp_extract(coalesce(text, ''), '(\\p{L}{12,})', 1), '') AS own FROM conversations),
u AS (SELECT a.conv_id, a.turn, max(b.turn) AS at FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE b.role = 'user' AND b.own IS NOT NULL GROUP BY ALL),
m AS (SELECT a.conv_id, a.turn, max(b.turn) AS at FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE b.role = 'assistant' AND b.own IS NOT NULL GROUP BY ALL),
e AS (SELECT a.conv_id, a.turn, max(b.turn) AS at FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE b.own IS NOT NULL GROUP BY ALL)
SELECT t.conv_id, t.turn, coalesce(t.own, CASE WHEN contains(t.text, ',') THEN coalesce(tu.own, tm.own, 'none') END) AS thing, coalesce(t.own, tu.own, te.own) AS anyone
FROM t LEFT JOIN u ON u.conv_id = t.conv_id AND u.turn = t.turn LEFT JOIN t tu ON tu.conv_id = u.conv_id AND tu.turn = u.at
LEFT JOIN m ON m.conv_id = t.conv_id AND m.turn = t.turn LEFT JOIN t tm ON tm.conv_id = m.conv_id AND tm.turn = m.at
LEFT JOIN e ON e.conv_id = t.conv_id AND e.turn = t.turn LEFT JOIN t te ON te.conv_id = e.conv_id AND te.turn = e.at"""


def scoped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's customers by the narrowest of seven scopes that holds three: nation for district, segment for year,
    rounded balance for document; some suppliers lack some of these."""
    segments = F.array(*(F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("district"), F.col("c_mktsegment").alias("plan_year"), F.floor(F.col("c_acctbal") / 100).alias("document_id"), F.concat("c_nationkey", F.lit("-"), "c_mktsegment", F.lit("-"), F.floor(F.col("c_acctbal") / 1000)).alias("dossier_code"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("district"), F.get(segments, (F.col("s_suppkey") % 7).cast("int")).alias("plan_year"), F.when(F.col("s_suppkey") % 3 == 0, F.floor(F.col("s_acctbal") / 100)).alias("document_id"))
    asked = s.withColumn("dossier_code", F.concat("district", F.lit("-"), "plan_year", F.lit("-"), F.col("s_suppkey") % 10))
    return scoped(rows, asked, "s_suppkey", "c_custkey", [F.col("c_custkey")], K, 3)


_FIELDS = (("dossier", ("dossier",)), ("district_year", ("district", "year")), ("district", ("district",)), ("document_year", ("document", "year")), ("document", ("document",)), ("year", ("year",)), ("planning", ()))
SCOPED = (
    """WITH r AS (SELECT c_custkey, c_nationkey AS district, c_mktsegment AS year, CAST(floor(c_acctbal / 100) AS BIGINT) AS document, c_nationkey || '-' || c_mktsegment || '-' || CAST(floor(c_acctbal / 1000) AS BIGINT) AS dossier FROM customer),
p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS district, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE'][CAST(s_suppkey % 7 + 1 AS INTEGER)] AS year, CASE WHEN s_suppkey % 3 = 0 THEN CAST(floor(s_acctbal / 100) AS BIGINT) END AS document FROM supplier),
q AS (SELECT *, district || '-' || year || '-' || (s_suppkey % 10) AS dossier FROM p), m AS ("""
    + " UNION ALL ".join(f"SELECT s_suppkey, {n} AS place, '{name}' AS scope, c_custkey FROM q JOIN r ON {' AND '.join(f'q.{f} = r.{f}' for f in fields) or 'true'}" for n, (name, fields) in enumerate(_FIELDS))
    + f"""), n AS (SELECT s_suppkey, place, count(*) AS n FROM m GROUP BY ALL),
c AS (SELECT s_suppkey, coalesce(min(place) FILTER (n >= 3), arg_min(place, place - n * 100)) AS place FROM n GROUP BY s_suppkey),
k AS (SELECT m.s_suppkey, scope, c_custkey, CAST(row_number() OVER (PARTITION BY m.s_suppkey ORDER BY c_custkey) AS INTEGER) AS rank FROM m JOIN c ON m.s_suppkey = c.s_suppkey AND m.place = c.place)
SELECT s_suppkey, scope, rank, c_custkey FROM k WHERE rank <= {K}"""
)

def store_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rebuilt into a collection in pages, toxic ones deleted, low ones replaced by a
    note, and what a second collection of the good ones lacks copied to it; that collection is read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    about = F.create_map(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")))
    chunk = lambda df, text: df.select(F.col("doc_id").cast("string").alias("chunk_id"), text.alias("content"), about.alias("meta"), F.lit(None).cast("array<float>").alias("embedding"))
    whole = F.coalesce("text", F.lit(""))
    store = ChunkStore(spark, fresh_path(spark, "store"))
    store.rebuild(docs, "all", "doc_id", "first", lambda df: chunk(df, whole), pages=4)
    toxic = labels.where("toxic = 1").select("doc_id")
    store.delete("all", "doc", toxic)
    low = labels.where("quality = 0").join(toxic, "doc_id", "left_anti").select("doc_id")
    store.upsert(chunk(docs.join(low, "doc_id", "left_semi"), F.lit("low")), "all", "doc")
    store.append(chunk(docs.join(labels.where("quality = 1"), "doc_id", "left_semi"), F.lit("label")), "some")
    store.copy_missing("all", "some", lambda df: df.withColumn("embedding", F.array(F.length("content").cast("float"))))
    return store.read("some").select("chunk_id", F.col("meta")["lang"].alias("lang"), F.col("meta")["source"].alias("source"), F.length("content").cast("long").alias("chars"), F.element_at("embedding", 1).cast("long").alias("vector"))


_LABELLED = "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND {})"
ROUNDS = f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, length(coalesce(text, '')) AS own,
  {_LABELLED.format('quality = 1')} AS good, {_LABELLED.format('quality = 0')} AS low, {_LABELLED.format('toxic = 1')} AS toxic FROM documents), e AS (
SELECT *, CASE WHEN good THEN 5 WHEN low THEN 3 ELSE own END AS chars FROM d WHERE good OR NOT toxic)
SELECT chunk_id, lang, source, chars, CASE WHEN NOT good THEN CAST(CAST(chars AS FLOAT) AS BIGINT) END AS vector FROM e"""

QUERIES = {"store_rounds": store_rounds, "judged_answers": judged_answers, "history_lookup": history_lookup, "scoped_rows": scoped_rows}
SQL = {"store_rounds": ROUNDS, "judged_answers": JUDGED, "history_lookup": LOOKUP, "scoped_rows": SCOPED}
