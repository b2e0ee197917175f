"""Listing-style queries over the order tables: joins, ordered aggregates, inventories, windows, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.operators.context import first_by, keep_or_all, last_messages, line_blocks, merged_citations, reranked, running_index, sibling_index
from kelpworks.operators.filters import any_contains
from kelpworks.operators.listing import latest, listing_order, nearby_lines, ordered_names, ordered_union, semi_by_id, with_retry
from kelpworks.plans.tables import table
from kelpworks.sources.files import resume


def listing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders with their customer, nation, region and part names, by the listing order."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").where((F.col("o_orderstatus") == "O") & F.col("o_totalprice").between(50_000, 200_000))
    parts = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity").where("l_quantity >= 10").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    base = orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    joined = base.join(ordered_names(parts, "l_orderkey", "p_brand"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = listing_order(F.lit(None), F.col("n_regionkey"), F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey"), {"floor": 2, "cheap": True})
    return joined.orderBy(*order).limit(20).select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("names", F.lit("")).alias("brands"), F.round("o_totalprice", 2).alias("price"))


LISTING = """WITH p AS (SELECT l_orderkey, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS names FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 10 GROUP BY l_orderkey)
SELECT o_orderkey, c_name, n_name, r_name, coalesce(names, '') AS brands, round(o_totalprice, 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN p ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 50000 AND 200000 ORDER BY abs(n_regionkey - 2) NULLS LAST, o_totalprice NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 20"""


def latest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the newest order, if any."""
    orders = latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


LATEST = "SELECT c_custkey, c_name, o.o_orderkey, round(o.o_totalprice, 2) AS price FROM customer LEFT JOIN LATERAL (SELECT * FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true"


def nearby_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order its items as places: nearest first, sorted distinct categories."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    rows = items.select("l_orderkey", "p_name", "p_type", F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 50).alias("m"), F.when(F.col("l_linenumber") < 3, F.col("l_quantity") * 30).alias("s"))
    return nearby_lines(rows, "l_orderkey", "p_name", "p_type", "m", "s").select("l_orderkey", "lines", F.array_join("categories", ",").alias("categories"))


NEARBY = """WITH r AS (SELECT l_orderkey, p_name, p_type, CASE WHEN l_linenumber <> 3 THEN l_quantity * 50 END AS m, CASE WHEN l_linenumber < 3 THEN l_quantity * 30 END AS s FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT *, p_name || CASE WHEN m IS NULL THEN '' WHEN m >= 1000 THEN ' - ' || regexp_replace(format('{:.1f}', m / 1000), '\\.0$', '') || ' km' ELSE ' - ' || CAST(CAST(round(m) AS BIGINT) AS VARCHAR) || ' m' END || CASE WHEN s IS NULL THEN '' ELSE ' (' || CAST(CAST(ceil(s / 60) AS BIGINT) AS VARCHAR) || ' min)' END AS line FROM r)
SELECT l_orderkey, string_agg(line, chr(10) ORDER BY m IS NULL, m, p_name, line) AS lines, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS categories FROM t GROUP BY l_orderkey"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its rows, those of two kinds, text maxima and the range of lengths; a page of the list."""
    docs = table(spark, sf_dir, "documents")
    kinds = docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").contains("|")).alias("tables"), F.count_if(~F.col("text").contains("|")).alias("texts"), F.max("lang").alias("lang"), F.max(F.col("n_chars").cast("string")).alias("text_max"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    return kinds.orderBy(F.desc("n"), "source").offset(5).limit(10)


INVENTORY = """SELECT source, count(*) AS n, count(*) FILTER (contains(text, '|')) AS tables, count(*) FILTER (NOT contains(text, '|')) AS texts, max(lang) AS lang, max(CAST(n_chars AS VARCHAR)) AS text_max, min(n_chars) AS low, max(n_chars) AS high
FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10 OFFSET 5"""


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of lines and the first line of each order."""
    items = table(spark, sf_dir, "lineitem")
    counts = items.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    first = first_by(items.where("l_quantity > 20").select("l_orderkey", "l_linenumber", "l_partkey"), [F.col("l_orderkey")], [F.col("l_linenumber"), F.col("l_partkey")])
    return counts.join(first, "l_orderkey", "left").select("l_orderkey", "n", "l_partkey")


FIRST = """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), f AS (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 20 ORDER BY l_orderkey, l_linenumber, l_partkey)
SELECT c.l_orderkey, n, l_partkey FROM c LEFT JOIN f ON c.l_orderkey = f.l_orderkey"""


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of each conversation in the order of the talk."""
    return last_messages(table(spark, sf_dir, "conversations").where("role != 'system'"), 4).select("conv_id", "position", "turn", "role")


HISTORY = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system')
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position, turn, role FROM r WHERE n <= 4"""


def approved_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is labelled good; those whose id isn't given pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("post"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return semi_by_id(docs, good, "post")


SEMI = "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS VARCHAR) END AS post FROM documents WHERE doc_id % 7 = 0 OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label yet, by source."""
    left = resume(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")
    return left.groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"))


RESUME = "SELECT source, count(*) AS n, max(doc_id) AS last_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source"


def keep_if_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per conversation the turns that name a mark, or all where none does."""
    rows = table(spark, sf_dir, "conversations")
    return keep_or_all(rows, F.col("text").contains(":") & (F.length("text") > 200), "conv_id").select("conv_id", "turn")


KEEP = "WITH m AS (SELECT conv_id, turn, coalesce(contains(text, ':') AND length(text) > 200, false) AS k FROM conversations) SELECT conv_id, turn FROM (SELECT *, bool_or(k) OVER (PARTITION BY conv_id) AS a FROM m) WHERE k OR NOT a"


#: Items of an order have no unique number, so the part and the price settle its order.
_PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_RANK = "CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT)"


def chunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order numbered within their flag, in the order, and among those of even or odd suppliers."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *_PLACE, "l_returnflag", (F.col("l_suppkey") % 2).cast("string").alias("parent"))
    order = [F.col(c) for c in _PLACE]
    return sibling_index(running_index(items, "l_orderkey", "l_returnflag", order), "l_orderkey", "parent", order).drop("l_suppkey", "l_extendedprice")


_ORDER = ", ".join(_PLACE)
NUMBERS = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CAST(l_suppkey % 2 AS VARCHAR) AS parent, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {_ORDER}) - 1 AS INTEGER) AS chunk_index,
CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS INTEGER) AS global_index, CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY {_ORDER}) - 1 AS INTEGER) AS sibling_index FROM lineitem"""


def gaps_and_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of messages of one role as blocks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), F.when(F.length("text") > 400, "long").otherwise("short").alias("kind"), "role")
    return line_blocks(rows, "conv_id", "place", "kind", "role").select("conv_id", F.col("block").cast("long").alias("block"), "kind", "n_lines", F.regexp_replace("content", "\n", ",").alias("roles"))


ISLANDS = """WITH r AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END AS kind FROM conversations),
m AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) = kind THEN 0 ELSE 1 END AS s FROM r), b AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM m)
SELECT conv_id, block, first(kind) AS kind, count(*) AS n_lines, string_agg(role, ',' ORDER BY turn) AS roles FROM b GROUP BY conv_id, block"""


def citation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the first known flag and ship mode of its items, and all distinct suppliers in order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_RANK).alias("place"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"), (F.col("l_suppkey") % 5).alias("page"))
    merged = merged_citations(items, ["l_orderkey"], "place", ["flag"], ["page"])
    return merged.select("l_orderkey", "flag", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "first_rank")


CITATIONS = f"""WITH i AS (SELECT l_orderkey, {_RANK} AS place, nullif(l_returnflag, 'N') AS flag, l_suppkey % 5 AS page FROM lineitem),
p AS (SELECT l_orderkey, page, min(place) AS n FROM i GROUP BY l_orderkey, page), q AS (SELECT l_orderkey, string_agg(CAST(page AS VARCHAR), ',' ORDER BY n) AS pages FROM p GROUP BY l_orderkey)
SELECT i.l_orderkey, arg_min(flag, place) FILTER (flag IS NOT NULL) AS flag, any_value(pages) AS pages, min(place) AS first_rank FROM i JOIN q ON i.l_orderkey = q.l_orderkey GROUP BY i.l_orderkey"""


def citation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order: returned ones first, then by price, then as they stood."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("planning"), F.col("l_extendedprice").alias("score"), F.expr(_RANK).alias("index"))
    return reranked(items, "l_orderkey", "planning", "score", "index").where("place <= 2").select("l_orderkey", "l_linenumber", "place")


RANK = f"SELECT l_orderkey, l_linenumber, place FROM (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_extendedprice DESC, {_RANK}) AS INTEGER) AS place FROM lineitem) WHERE place <= 2"


def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one list before those of another, each once, up to 25."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    parts = [docs.where("source = 'src3'").orderBy("doc_id").limit(20), docs.where("lang = 'es'").orderBy("doc_id").limit(40)]
    return ordered_union(parts, F.col("doc_id"), "doc_id", 25).select("doc_id", "source", "lang", "part")


UNION = """WITH a AS (SELECT doc_id, source, lang, 0 AS part FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20), b AS (SELECT doc_id, source, lang, 1 AS part FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 40),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT doc_id, source, lang, part FROM u WHERE n = 1 ORDER BY part, doc_id LIMIT 25"""


def retry_without_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich customers of a segment in a nation that has none, so of all nations."""
    rows = table(spark, sf_dir, "customer").where(any_contains([F.col("c_mktsegment")], ["building"]))
    return with_retry(rows, F.col("c_nationkey") == 99, F.col("c_acctbal") > 9000).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("balance"))


RETRY = "SELECT c_custkey, c_name, round(c_acctbal, 2) AS balance FROM customer WHERE contains(lower(c_mktsegment), 'building') AND c_acctbal > 9000"


QUERIES = {"listing_search": listing_search, "latest_match": latest_match, "nearby_places": nearby_places, "inventory": inventory, "first_per_key": first_per_key, "chat_history": chat_history, "approved_semi_join": approved_semi_join, "resume_anti_join": resume_anti_join, "keep_if_any": keep_if_any, "chunk_numbers": chunk_numbers, "gaps_and_islands": gaps_and_islands, "citation_merge": citation_merge, "citation_rank": citation_rank, "fallback_union": fallback_union, "retry_without_city": retry_without_city}
SQL = {"listing_search": LISTING, "latest_match": LATEST, "nearby_places": NEARBY, "inventory": INVENTORY, "first_per_key": FIRST, "chat_history": HISTORY, "approved_semi_join": SEMI, "resume_anti_join": RESUME, "keep_if_any": KEEP, "chunk_numbers": NUMBERS, "gaps_and_islands": ISLANDS, "citation_merge": CITATIONS, "citation_rank": RANK, "fallback_union": UNION, "retry_without_city": RETRY}
