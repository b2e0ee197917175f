"""Text queries: normal forms, line classes, chunking, analysis of questions, context building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.functions.keys import body_key, content_digest, paged_key
from kelpworks.functions.planning import has_project_row, haystack, is_incomplete, is_toc_like, unit_headers
from kelpworks.functions.text import FROM, TO, clean_text, compact, format_number, hierarchy_level, is_heading, is_new_item, is_table_line, is_weak_chunk, normalize_loose, normalize_text, quality_of, repair_mojibake, sanitize, slug, year_in
from kelpworks.operators.chunking import chunked, split_rows
from kelpworks.operators.context import context_documents, first_by, overlap_score
from kelpworks.operators.intents import floor_filter, language_of, planning_intent, query_intents, postprocessed, query_profile, rewritten
from kelpworks.operators.listing import price_vnd, rooms, utility_groups
from kelpworks.plans.tables import table

_FOLD = f"translate(lower(coalesce(text, '')), '{FROM}', '{TO}')"
_NORMAL = f"trim(regexp_replace(regexp_replace({_FOLD}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the normal forms of whole texts."""
    hashed = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", hashed(normalize_text("text")).alias("plain"), hashed(normalize_loose("text")).alias("loose"), hashed(compact("text")).alias("tight"))


FORMS = f"SELECT doc_id, md5({_NORMAL}) AS plain, md5(trim(regexp_replace({_FOLD}, '\\s+', ' ', 'g'))) AS loose, md5(regexp_replace({_FOLD}, '[^a-z0-9]', '', 'g')) AS tight FROM documents"


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, F16: cleaned texts as digests, and their first 1200 characters' length."""
    c = clean_text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c.cast("binary")).alias("digest"), F.length(F.substring(c, 1, 1200)).alias("n"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
CLEANED = f"SELECT doc_id, md5({_CLEAN}) AS digest, CAST(length(substring({_CLEAN}, 1, 1200)) AS INTEGER) AS n FROM documents"


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document are tables, headings, of a level, or new items."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    line = F.col("line")
    return lines.groupBy("doc_id").agg(F.count_if(is_table_line(line)).alias("tables"), F.count_if(is_heading(line)).alias("headings"), F.count_if(hierarchy_level(line) == 1).alias("level_1"), F.count_if(hierarchy_level(line) == 2).alias("level_2"), F.count_if(is_new_item(line)).alias("items"))


_FLAT = f"trim(regexp_replace(lower(translate(line, '{FROM}', '{TO}')), '\\s+', ' ', 'g'))"
_L1 = "(regexp_matches(flat, '^phan\\s+[ivxlcdm]+\\b') OR regexp_matches(flat, '^chuong\\s+[ivxlcdm0-9]+\\b') OR regexp_matches(trim(line), '^[A-ZĐ]\\s+\\S+'))"
CLASSES = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT *, {_FLAT} AS flat,
len(regexp_extract_all(line, '\\p{{L}}')) AS letters, len(regexp_extract_all(line, '\\p{{Lu}}')) AS upper FROM l)
SELECT doc_id, count(*) FILTER (contains(line, '|') OR (len(regexp_extract_all(line, '\\d+[\\d.,]*')) >= 3 AND len(regexp_split_to_array(trim(line), '\\s+')) >= 6)) AS tables,
count(*) FILTER (length(trim(line)) > 0 AND (regexp_matches(flat, '^(chuong|phu luc|muc|phan|dieu)\\b') OR regexp_matches(flat, '^\\d+(\\.\\d+){{0,3}}\\b') OR (letters >= 8 AND upper >= 0.78 * letters AND length(trim(line)) <= 150))) AS headings,
count(*) FILTER ({_L1}) AS level_1, count(*) FILTER (NOT {_L1} AND (regexp_matches(flat, '^muc\\s+\\d+') OR regexp_matches(trim(line), '^[IVXLCDM]+\\s+\\S+'))) AS level_2,
count(*) FILTER (regexp_matches(flat, '^(\\d+[.)]|[a-z][.)]|[ivxlcdm]+[.)])\\s+\\S+')) AS items FROM f GROUP BY doc_id"""


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each text as one page, and whether it is too weak for a chunk."""
    return table(spark, sf_dir, "documents").select("doc_id", quality_of(F.col("text"), F.lit(1), F.when(F.length("text") >= 40, 1).otherwise(0)).alias("quality"), is_weak_chunk(F.col("text")).alias("weak"))


QUALITY = f"""WITH d AS (SELECT doc_id, text, substring(text, 1, 120000) AS s, translate(lower(text), '{FROM}', '{TO}') AS f FROM documents),
q AS (SELECT *, greatest(length(s), 1) AS n, 0.35::DOUBLE * CASE WHEN length(text) >= 40 THEN 1 ELSE 0 END + 0.35::DOUBLE * least(1.0::DOUBLE, length(text) / 900) AS b FROM d)
SELECT doc_id, CASE WHEN length(s) = 0 THEN 0.25::DOUBLE * CASE WHEN length(text) >= 40 THEN 1 ELSE 0 END ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (b + 0.30::DOUBLE * least(1.0::DOUBLE, len(regexp_extract_all(s, '\\p{{L}}')) / greatest(len(regexp_extract_all(s, '[^\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x{{85}}]')), 1) / 0.45::DOUBLE)) * (1 - 0.6::DOUBLE * least(1.0::DOUBLE, 18.0::DOUBLE * len(regexp_extract_all(s, chr(65533))) / n)))), 3) END AS quality,
len(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '')) = 0 OR (len(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '')) = 1 AND regexp_matches(trim(text), '^\\d+$'))
OR (len(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '')) <= 2 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 6 AND NOT regexp_matches(trim(regexp_replace(f, '\\s+', ' ', 'g')), '\\b\\d+([.,]\\d+)?\\s*(ha|m2|%|ty)\\b') AND NOT regexp_matches(trim(regexp_replace(f, '\\s+', ' ', 'g')), 'du an|cong trinh|thu hoi|quyet dinh|dieu ')) AS weak FROM q"""


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, K1b, K1f, H27: the first document of each key of normal content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    none = F.lit(None).cast("string")
    keyed = docs.withColumn("key", body_key(none, F.col("source"), none, F.col("text")))
    first = first_by(keyed, [F.col("key")], [F.col("doc_id")])
    return first.select("doc_id", F.sha1(F.col("key").cast("binary")).alias("key"), F.sha1(paged_key(none, F.col("source"), none, none, F.col("text")).cast("binary")).alias("paged"), content_digest(none, F.col("text")).alias("digest"))


KEYS = f"""WITH k AS (SELECT *, '|' || source || '||' || substring({_NORMAL}, 1, 280) AS key FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM k)
SELECT doc_id, sha1(key) AS key, sha1('|' || source || '|||' || {_NORMAL.replace("coalesce(text, '')", "coalesce(substring(text, 1, 120), '')")}) AS paged, sha1(text) AS digest FROM f WHERE n = 1"""


def question_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of user messages as counts by language."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("text")
    flags = q.select(language_of(F.col("text")).alias("lang"), planning_intent(F.col("text")).alias("planning"), query_profile(F.col("text")).alias("p"), query_intents(F.col("text")).alias("i"), year_in(F.col("text")).alias("year"))
    return flags.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("planning").alias("planning"), F.count_if("p.explanatory").alias("explanatory"), F.count_if("i.needs_price").alias("price"), F.count_if("i.study_work_query").alias("study"), F.count("year").alias("years"))


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6, X1."""
    return rewritten(table(spark, sf_dir, "conversations")).select("conv_id", "follow_up", F.md5(F.col("query").cast("binary")).alias("query"))


def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, rooms, floors and groups from texts made of each order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Căn hộ giá "), (k % 90 + 10) / 10, F.lit(" tỷ, "), k % 4 + 1, F.lit(" phòng ngủ, tầng "), k % 9 + 1, F.when(k % 2 == 0, F.concat(F.lit(" - "), k % 9 + 3)).otherwise(""), F.when(k % 3 == 0, " gần trường học và siêu thị").otherwise(" gần bến xe"))
    found = o.select(k, price_vnd(text).alias("price"), rooms(text, "phong ngu|pn").alias("bedrooms"), floor_filter(text).alias("f"), F.array_join(utility_groups(text), ",").alias("groups"), slug(F.col("o_orderpriority")).alias("slug"), format_number((k % 90 + 10) / 10).alias("shown"))
    return found.select("o_orderkey", F.round("price", 0).cast("long").alias("price"), "bedrooms", "f.floor_min", "f.floor_max", "f.floor", "groups", "slug", "shown")


FACTS = """WITH o AS (SELECT *, o_orderkey AS k FROM orders)
SELECT o_orderkey, CAST(round((k % 90 + 10) / 10 * 1e9) AS BIGINT) AS price, CAST(k % 4 + 1 AS INTEGER) AS bedrooms, CASE WHEN k % 2 = 0 THEN CAST(least(k % 9 + 1, k % 9 + 3) AS INTEGER) END AS floor_min, CASE WHEN k % 2 = 0 THEN CAST(k % 9 + 3 AS INTEGER) END AS floor_max,
CASE WHEN k % 2 <> 0 THEN CAST(k % 9 + 1 AS INTEGER) END AS floor, CASE WHEN k % 3 = 0 THEN 'education,shopping' ELSE 'transport' END AS groups, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
CASE WHEN (k % 90 + 10) % 10 = 0 THEN CAST((k % 90 + 10) // 10 AS VARCHAR) ELSE CAST((k % 90 + 10) // 10 AS VARCHAR) || '.' || CAST((k % 90 + 10) % 10 AS VARCHAR) END AS shown FROM o"""


def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context of four distinct documents for each source, compacted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = context_documents(docs, "source", F.md5(F.col("text").cast("binary")), [F.col("doc_id")], "text")
    return out.select("source", "n_docs", F.length("context").alias("n_chars"))


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each answer names of the words before it, and how long it is without what wasn't asked for."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    both = talk.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return both.select("conv_id", "turn", overlap_score(F.col("text"), F.col("question"), [F.lit("the")], F.array().cast("array<string>")).alias("score"), F.length(postprocessed(F.col("question"), F.col("text"))).alias("n"))


def planning_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of planning texts that are made of each order."""
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 5 == 0, "Mục lục\nPhần 1 .... 3\nPhần 2 .... 9\n").otherwise(""), F.when(k % 3 == 0, "Danh mục công trình").otherwise("Dự án xây dựng trạm tại phường Hàng Bài và phường Cửa Nam, 12,5 ha."))
    rows = table(spark, sf_dir, "orders").select(k, is_toc_like(text).alias("toc"), is_incomplete(text).alias("incomplete"), has_project_row(normalize_text(text)).alias("project"), unit_headers(normalize_text(text)).alias("units"), haystack(text, F.lit("Ba Đình")).alias("hay"))
    return rows.select("o_orderkey", "toc", "incomplete", "project", "units", F.startswith("hay", F.lit("ba dinh")).alias("placed"))


FEATURES = """SELECT o_orderkey, o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 AS toc, o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 AS incomplete, o_orderkey % 3 <> 0 AS project, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS units, true AS placed FROM orders"""


def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive splitting of every document."""
    return split_rows(table(spark, sf_dir, "documents"), profile="planning").select("doc_id", "piece", F.length("content").alias("n"), F.md5(F.col("content").cast("binary")).alias("digest"))


def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure-aware chunks of every document with their lines."""
    return chunked(table(spark, sf_dir, "documents"), mode="structured").select("doc_id", "global_index", "chunk_index", "chunk_type", "chunker", "page_number", "line_start", "line_end", F.length("content").alias("n"))


def hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mode, with heading paths."""
    return chunked(table(spark, sf_dir, "documents")).select("doc_id", "global_index", "chunk_type", "chunker", "hierarchy_level", F.length("content").alias("n"))


def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H3: texts that were decoded with the wrong codec are restored; others don't pass through Python."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    broken = F.when(F.col("doc_id") % 5 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    fixed = docs.select("doc_id", "lang", "text", repair_mojibake(broken).alias("r"))
    return fixed.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("r") == F.col("text")).alias("same"), F.sum(F.length(sanitize("r", 100))).alias("shown"))


QUERIES = {"planning_features": planning_features, "normal_forms": normal_forms, "cleaned": cleaned, "line_classes": line_classes, "text_quality": text_quality, "dedup_keys": dedup_keys, "question_profiles": question_profiles, "follow_ups": follow_ups, "extracted_facts": extracted_facts, "context_build": context_build, "answer_scores": answer_scores, "text_pieces": text_pieces, "structural_chunks": structural_chunks, "hierarchical_chunks": hierarchical_chunks, "repaired_texts": repaired_texts}
SQL = {"planning_features": FEATURES, "normal_forms": FORMS, "cleaned": CLEANED, "line_classes": CLASSES, "text_quality": QUALITY, "dedup_keys": KEYS, "extracted_facts": FACTS}
