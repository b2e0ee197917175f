"""Queries over the lines of documents: heading paths and merged continuations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.functions.text import FROM, TO
from kelpworks.operators.structure import BLOCK, heading_level, heading_paths, merge_continuations
from kelpworks.plans.tables import table

#: Lines of a page in merged_blocks, whose documents have no pages of their own, and what stands between blocks in a digest.
PAGE_LINES, BETWEEN = 20, "\x1e"


def heading_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings in force at each line of each document. Only headings bring their text to the window."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    leveled = lines.withColumn("level", heading_level(F.col("line"))).withColumn("line", F.when(F.col("level").isNotNull(), F.trim("line")))
    found = heading_paths(leveled, ["doc_id"], "line_no")
    shown = F.array_join(F.transform("path", lambda h: F.concat_ws(":", h["level"], h["text"])), " > ")
    return found.select("doc_id", "line_no", "level", F.size("path").alias("depth"), shown.alias("path"))


def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document, each a block, after continuations have been merged: how many are left, and which."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    blocks = F.transform(lines, lambda x, i: F.struct(x.alias("content"), F.lit(None).cast("string").alias("chunk_type"), (F.floor(i / PAGE_LINES) + 1).cast("int").alias("page"), *(F.lit(None).cast("string").alias(c) for c in ("heading", "path", "chunker"))).cast(BLOCK))
    merged = table(spark, sf_dir, "documents").select("doc_id", merge_continuations(blocks).alias("blocks"))
    contents = F.transform("blocks", lambda b: b["content"])
    longest = F.coalesce(F.array_max(F.transform(contents, lambda c: F.size(F.split(c, "\n")))), F.lit(0))
    return merged.select("doc_id", F.size("blocks").alias("n_blocks"), longest.alias("longest"), F.md5(F.array_join(contents, BETWEEN).cast("binary")).alias("digest"))


def _flat(c: str) -> str:
    return f"trim(regexp_replace(lower(translate({c}, '{FROM}', '{TO}')), '\\s+', ' ', 'g'))"


_TABLE = "(contains(line, '|') OR (len(regexp_extract_all(line, '\\d+[\\d.,]*')) >= 3 AND len(regexp_split_to_array(trim(line), '\\s+')) >= 6))"
STACK = f"""WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), f AS (
  SELECT *, {_flat('line')} AS flat, trim(line) AS bare, len(regexp_extract_all(line, '\\p{{L}}')) AS letters, len(regexp_extract_all(line, '\\p{{Lu}}')) AS upper FROM l
), n AS (
  SELECT doc_id, line_no, bare,
    CASE WHEN regexp_matches(flat, '^phan\\s+[ivxlcdm]+\\b') OR regexp_matches(flat, '^chuong\\s+[ivxlcdm0-9]+\\b') OR regexp_matches(bare, '^[A-ZĐ]\\s+\\S+') THEN 1
         WHEN regexp_matches(flat, '^muc\\s+\\d+(\\.\\d+){{0,3}}\\b') OR regexp_matches(bare, '^[IVXLCDM]+\\s+\\S+') THEN 2
         WHEN regexp_matches(flat, '^\\d+\\.\\d+(\\.\\d+){{0,3}}\\b') THEN 3
         WHEN bare <> '' AND (regexp_matches(flat, '^(chuong|phu luc|muc|phan|dieu)\\b') OR regexp_matches(flat, '^\\d+(\\.\\d+){{0,3}}\\b') OR (letters >= 8 AND upper >= 0.78 * letters AND length(bare) <= 150))
              AND NOT regexp_matches(flat, '^(\\d+[.)]|[a-z][.)]|[ivxlcdm]+[.)])\\s+\\S+') AND NOT {_TABLE}
              AND NOT regexp_matches(flat, 'du an|cong trinh|thu hoi|dau gia|gpmb') AND NOT regexp_matches(flat, '\\b\\d+([.,]\\d+)?\\s*(ha|m2|m²)\\b') THEN 3 END AS level
  FROM f
), p AS (
  SELECT doc_id, line_no, level, max(line_no) FILTER (level = 1) OVER w AS p1, max(line_no) FILTER (level = 2) OVER w AS p2, max(line_no) FILTER (level = 3) OVER w AS p3
  FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), v AS (
  SELECT doc_id, line_no, level, p1, CASE WHEN p2 > coalesce(p1, -1) THEN p2 END AS p2, CASE WHEN p3 > coalesce(greatest(p1, p2), -1) THEN p3 END AS p3 FROM p
)
SELECT v.doc_id, CAST(v.line_no AS INTEGER) AS line_no, CAST(v.level AS INTEGER) AS level, CAST((v.p1 IS NOT NULL)::INT + (v.p2 IS NOT NULL)::INT + (v.p3 IS NOT NULL)::INT AS INTEGER) AS depth,
       concat_ws(' > ', '1:' || a.bare, '2:' || b.bare, '3:' || c.bare) AS path
FROM v LEFT JOIN n a ON a.doc_id = v.doc_id AND a.line_no = v.p1 LEFT JOIN n b ON b.doc_id = v.doc_id AND b.line_no = v.p2 LEFT JOIN n c ON c.doc_id = v.doc_id AND c.line_no = v.p3"""

_UNIT = "'\\b\\d+([.,]\\d+)?\\s*(ha|m2|%|ty)\\b'"
BLOCKS = f"""WITH RECURSIVE l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), c AS (
  SELECT doc_id, line_no // {PAGE_LINES} + 1 AS page, line_no, trim(regexp_replace(replace(line, chr(0), ''), '[ \\t]+', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l
), i AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, {_flat('line')} AS flat, {_TABLE} AS tabular FROM c WHERE line <> ''
), m AS (
  SELECT doc_id, k, 1 AS block, line AS content, page, CAST(tabular AS INTEGER) AS tables, 1 AS lines FROM i WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN on_ THEN block ELSE block + 1 END, CASE WHEN on_ THEN content || chr(10) || line ELSE line END, next_page, CASE WHEN on_ THEN tables ELSE 0 END + CAST(tabular AS INTEGER), CASE WHEN on_ THEN lines + 1 ELSE 1 END
  FROM (
    SELECT m.doc_id, i.k, m.block, m.content, i.page AS next_page, m.tables, m.lines, i.line, i.tabular,
      m.page = i.page AND NOT contains(m.content, '|') AND m.tables < greatest(2, m.lines // 2) AND NOT contains(i.line, '|')
      AND (regexp_matches({_flat('m.content')}, '(:|la|gom|cu the|trong do)$') OR regexp_matches(i.flat, '^([-+*]|\\d+[.)]?|(tong|trong do|cu the|gom|la|dat|du an|cong trinh|ha)\\b)')
           OR (regexp_matches(i.flat, {_UNIT}) AND NOT regexp_matches({_flat('m.content')}, {_UNIT}))) AS on_
    FROM m JOIN i ON i.doc_id = m.doc_id AND i.k = m.k + 1
  )
), b AS (
  SELECT doc_id, block, arg_max(content, k) AS content, max(lines) AS lines FROM m GROUP BY doc_id, block
)
SELECT d.doc_id, CAST(count(block) AS INTEGER) AS n_blocks, CAST(coalesce(max(lines), 0) AS INTEGER) AS longest, md5(coalesce(string_agg(content, chr(30) ORDER BY block), '')) AS digest
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id"""

QUERIES = {"heading_stack": heading_stack, "merged_blocks": merged_blocks}
SQL = {"heading_stack": STACK, "merged_blocks": BLOCKS}
