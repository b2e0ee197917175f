"""Line dedup with a log-template tree of fixed depth; built-in Spark functions only.

1. Tree: a line's tokens with a digit become a wildcard. Its leaf is its number of tokens and its leading tokens.
2. Generalisation: in leaves that enough documents share, a token after the leading ones stays where enough documents
   have it at its place, in any line of the leaf; else it is a variable field, as numbers are. What stays is the line's
   template.
3. Recurrence: a template has the documents of all lines that fit it, those of more particular templates included, and
   each document once. Lines go if enough documents have their template and enough of its tokens are fixed.

Documents are counted, not listed: only lines and templates of fewer than `min_docs` documents have their documents
looked at, so these lists are short however often a line recurs. A template is compared with the more particular ones
that hold the rarest of its tokens.

`group` (none unless given) names a column with the group of copies that a document belongs to, for a pipeline whose next
stage keeps one document of each: all documents of a group count as one, so a line that only copies share stays, while one
that different texts share goes from copies too. A null group is the document alone.

`copy` (off unless given) leaves documents of which at least this share of characters recurs whole.

Defined results: a null text stays null; blank lines stay; a document is never removed, though its text can shrink to
nothing; equal rows (same id and text) count as one document and get the same text; other columns are left alone,
whatever their names (with `report`, `dropped` and `copied` replace such columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.llm.shared import lasting, only_or_without, passing, row_key, stored, table

#: Documents that must share a template; leading tokens of a leaf; least share of fixed tokens.
MIN_DOCS, DEPTH, SIMILAR = 10, 3, 0.5
WILD = "<*>"
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
LINE, TOKEN, TEMPLATE = ["l1", "l2"], ["leaf", "at", "token"], ["t1", "t2"]


def clean(line: Column) -> Column:
    """Tokens with one space between, those with a digit as a wildcard."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in "\t\x0b\f\r":
        odd = odd | line.contains(c)
    spaced = F.when(odd, F.trim(F.regexp_replace(line, r"\s++", " "))).otherwise(line)
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, VARIABLE, WILD)).otherwise(spaced)


def leaf_of(line: Column, depth: int) -> Column:
    return F.xxhash64(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))), F.substring_index(line, " ", depth))


def _lines(docs: DataFrame, doc_id: str, text: str, group: str | None) -> DataFrame:
    """k1, k2, who (counts as one), place (from 0), line of every line that isn't blank. Lines are cleaned below the generator, so each once."""
    cleaned = F.transform(F.split(text, "\n"), clean)
    return docs.where(F.col(text).isNotNull()).select(*row_key(F.col(doc_id), F.col(text)), _who(doc_id, text, group), F.posexplode(cleaned).alias("place", "line")).where("line != ''")


def _who(doc_id: str, text: str, group: str | None) -> Column:
    own = row_key(F.col(doc_id), F.col(text))[0]
    return (own if group is None else F.coalesce(F.when(F.col(group).isNotNull(), F.xxhash64(F.lit("group"), F.col(group))), own)).alias("who")


def _places(df: DataFrame, tokens: str, *more: str) -> DataFrame:
    """A row (leaf, at, token) for each token that is no wildcard."""
    return df.select("leaf", *more, F.posexplode(tokens).alias("at", "token")).where("token != 0")


def _enough(holders: DataFrame, by: list[str], min_docs: int) -> DataFrame:
    """Those of `by` that so many different documents (k1) hold."""
    return holders.select(*by, "k1").distinct().groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(*by)


def recurring(docs: DataFrame, doc_id: str, text: str, min_docs: int, depth: int, similar: float, group: str | None = None, copies: DataFrame | None = None) -> DataFrame:
    """k1, k2, place of every line whose template recurs."""
    keyed = _lines(docs, doc_id, text, group).withColumns({"l1": F.xxhash64("line"), "l2": F.hash("line")})
    lines = stored(keyed.select("k1", "k2", *([] if group is None else ["who"]), "place", leaf_of(F.col("line"), depth).alias("leaf"), *LINE), "lines")
    counted_lines = lines if group is None else lines.withColumn("k1", F.col("who"))
    leaves = stored(_enough(counted_lines, ["leaf"], min_docs), "leaves")
    held = stored(counted_lines.join(leaves, "leaf").select("leaf", *LINE, "k1").distinct(), "held-lines")
    if copies is not None:
        theirs = stored(held.join(copies, "k1", "left").select("leaf", *LINE, F.coalesce("of", "k1").alias("k1")).distinct(), "lines-of-groups")
        held = stored(theirs.join(_enough(theirs, ["leaf"], min_docs), "leaf").select("leaf", *LINE, "k1"), "held-lines")
    counted = stored(held.groupBy("leaf", *LINE).agg(F.count("*").alias("docs")), "shared-lines")

    # the tokens of each different line; rest: hashes of those after the leading ones, 0 for a wildcard
    texts = only_or_without(keyed.select("line", *LINE), counted, "left_semi", LINE).groupBy(*LINE).agg(F.first("line").alias("line"))
    own = texts.join(counted, LINE).withColumn("own", F.split("line", " "))
    lead = F.size(F.filter(F.slice("own", 1, depth), lambda t: t != WILD))
    rest = F.transform(F.slice("own", F.lit(depth + 1), F.size("own")), lambda t: F.when(t == WILD, F.lit(0).cast("long")).otherwise(F.xxhash64(t)))
    parsed = stored(own.select("leaf", *LINE, "docs", F.size("own").alias("n"), lead.alias("lead"), rest.alias("rest")), "parsed")
    enough = F.col("lead") + F.size(F.filter("rest", lambda t: t != 0)) >= similar * F.col("n")
    whole = stored(parsed.where(F.col("docs") >= min_docs).where(enough).select("leaf", *LINE, "rest"), "whole-lines")
    rare = parsed.where(F.col("docs") < min_docs)
    holders = stored(held.join(rare.select(*LINE), LINE).select(*LINE, "k1"), "holders")

    # which tokens stay: at most the lines' documents together have them, and surely those of one line of enough
    bound = _places(parsed, "rest", "docs").groupBy(*TOKEN).agg(F.sum("docs").alias("total"), F.max("docs").alias("most"))
    bound = stored(bound.where(F.col("total") >= min_docs), "bounds")
    doubt = _places(rare, "rest", *LINE).join(bound.where(F.col("most") < min_docs).select(*TOKEN), TOKEN)
    fixed = stored(bound.where(F.col("most") >= min_docs).select(*TOKEN).unionByName(_enough(doubt.join(holders, LINE), TOKEN, min_docs)), "fixed")
    marked = rare.select("leaf", *LINE, "n", "lead", F.posexplode_outer("rest").alias("at", "token")).join(fixed.withColumn("stays", F.lit(True)), TOKEN, "left")
    marked = marked.withColumn("token", F.when(F.col("stays"), F.col("token")).otherwise(F.lit(0).cast("long")))
    listed = marked.groupBy("leaf", *LINE).agg(F.first("n").alias("n"), F.first("lead").alias("lead"), F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "token")))).alias("rest"))
    named = listed.withColumn("rest", F.col("rest.token")).where(enough)
    named = stored(named.withColumns({"t1": F.xxhash64("leaf", "rest"), "t2": F.hash("rest", "leaf")}).select("leaf", *LINE, "rest", *TEMPLATE), "templates")

    # documents of each template, then of those more particular
    having = stored(named.join(holders, LINE).select(*TEMPLATE, "k1").distinct(), "template-holders")
    common = stored(_enough(having, TEMPLATE, min_docs), "common")
    each = named.select("leaf", "rest", *TEMPLATE).distinct()
    others = each.join(common.withColumn("sure", F.lit(True)), TEMPLATE, "left").select("leaf", "rest", *TEMPLATE, F.coalesce("sure", F.lit(False)).alias("sure"))
    others = others.unionByName(whole.select("leaf", "rest", F.xxhash64("leaf", "rest").alias("t1"), F.hash("rest", "leaf").alias("t2"), F.lit(True).alias("sure")))
    others = stored(others, "every-template")
    open_ = others.where(~F.col("sure") & F.array_contains("rest", F.lit(0).cast("long")))
    uses = _places(others, "rest").groupBy(*TOKEN).agg(F.count("*").alias("uses"))
    rarest = _places(open_, "rest", *TEMPLATE).join(uses, TOKEN).groupBy(*TEMPLATE).agg(F.min(F.struct("uses", "at", "token")).alias("key"))
    asked = open_.join(rarest, TEMPLATE, "left").select("leaf", *TEMPLATE, F.col("rest").alias("asked"), F.coalesce("key.at", F.lit(-1)).alias("at"), F.coalesce("key.token", F.lit(0).cast("long")).alias("token"))
    keyless = others.select("leaf", F.col("t1").alias("s1"), F.col("t2").alias("s2"), "sure", "rest", F.lit(-1).alias("at"), F.lit(0).cast("long").alias("token"))
    offered = keyless.unionByName(others.select("leaf", F.col("t1").alias("s1"), F.col("t2").alias("s2"), "sure", "rest", F.posexplode("rest").alias("at", "token")).where("token != 0"))
    fits = F.forall(F.zip_with("asked", "rest", lambda a, b: (a == 0) | (a == b)), lambda x: x)
    more = stored(asked.join(offered, TOKEN).where(fits & (F.col("asked") != F.col("rest"))).select(*TEMPLATE, "s1", "s2", "sure"), "more-particular")
    sure = more.where("sure").select(*TEMPLATE).distinct()
    unsure = more.join(sure, TEMPLATE, "left_anti")
    theirs = unsure.join(having.select(F.col("t1").alias("s1"), F.col("t2").alias("s2"), "k1"), ["s1", "s2"]).select(*TEMPLATE, "k1")
    theirs = theirs.unionByName(having.join(unsure.select(*TEMPLATE).distinct(), TEMPLATE).select(*TEMPLATE, "k1"))
    common = common.unionByName(sure).unionByName(_enough(theirs, TEMPLATE, min_docs))

    dropped = stored(whole.select(*LINE).unionByName(named.join(common, TEMPLATE, "left_semi").select(*LINE)).distinct(), "dropped")
    return only_or_without(lines.select("k1", "k2", "place", *LINE), dropped, "left_semi", LINE).select("k1", "k2", "place")


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, similar: float = SIMILAR, copy: float | None = None, report: bool = False, group: str | None = None, copies: DataFrame | None = None) -> DataFrame:
    """docs without their recurring lines; with `report`, also `dropped` (their places) and `copied` (left whole)."""
    keys = ["k1", "k2"]
    with passing(docs.sparkSession):
        drops = recurring(docs, doc_id, text, min_docs, depth, similar, group, copies).groupBy(*keys).agg(F.array_sort(F.collect_set("place")).alias("places"))
        drops = lasting(drops, "drops")
    own = docs.select(*row_key(F.col(doc_id), F.col(text)), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    # merged at every size, not broadcast where it is small: places are lists without a bound
    both = own.join(drops.hint("merge"), keys, "left").withColumn("text", F.col("row").getField(text))
    both = both.withColumn("lines", F.when(F.col("places").isNotNull(), F.split("text", "\n")))
    lines, none = F.col("lines"), F.array().cast("array<int>")
    copied = F.lit(False)
    if copy is not None:
        gone = F.aggregate("places", F.lit(0), lambda a, i: a + F.length(F.get(lines, i)))
        copied = F.coalesce(gone >= copy * F.length(F.regexp_replace("text", "\n", "")), copied)
    both = both.withColumn("copied", copied)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places"), lambda i: F.get(lines, i)), "\n")
    left = F.when(F.col("places").isNull() | F.col("copied"), F.col("text")).otherwise(left)
    more = {"dropped": F.when(F.col("copied"), none).otherwise(F.coalesce("places", none)), "copied": F.col("copied")} if report else {}
    return both.select(*(left.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in more), *(v.alias(k) for k, v in more.items()))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without lines whose template recurs, as digests: how many lines were dropped, which, and what is left."""
    found = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return found.select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.transform("dropped", lambda i: i.cast("string")), ",").alias("dropped"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


#: The same in DuckDB, with texts of lines and templates instead of hashes, and documents counted outright.
OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, place, list_transform(list_filter(regexp_split_to_array(ls[place + 1], '[ \t\n\x0B\f\r]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS own
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS place FROM d)
), k AS (
  SELECT *, array_to_string(own, ' ') AS line, len(own) || '|' || array_to_string(own[1:{DEPTH}], ' ') AS leaf FROM l WHERE len(own) > 0
), held AS (
  SELECT DISTINCT leaf, line, own, doc_id FROM k WHERE leaf IN (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
), places AS (
  SELECT leaf, line, doc_id, i, own[i] AS token FROM (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM held)
), fixed AS (
  SELECT leaf, i, token FROM places WHERE token <> '<*>' GROUP BY leaf, i, token HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), named AS (
  SELECT p.leaf, p.line, list(f.token ORDER BY p.i) AS template
  FROM (SELECT DISTINCT leaf, line, i, token FROM places) p LEFT JOIN fixed f ON p.leaf = f.leaf AND p.i = f.i AND p.token = f.token
  GROUP BY p.leaf, p.line HAVING count(f.token) >= {SIMILAR} * count(*)
), having_it AS (
  SELECT DISTINCT n.leaf, n.template, h.doc_id FROM named n JOIN held h ON n.leaf = h.leaf AND n.line = h.line
), templates AS (
  SELECT leaf, template, count(*) AS docs FROM having_it GROUP BY leaf, template
), fits AS (
  SELECT a.leaf, a.template, b.template AS other FROM templates a JOIN templates b ON a.leaf = b.leaf
  WHERE a.docs < {MIN_DOCS} AND len(list_filter(range(1, len(a.template) + 1), lambda i: a.template[i] IS NOT NULL AND a.template[i] IS DISTINCT FROM b.template[i])) = 0
), common AS (
  SELECT leaf, template FROM templates WHERE docs >= {MIN_DOCS}
  UNION SELECT f.leaf, f.template FROM fits f JOIN having_it h ON f.leaf = h.leaf AND f.other = h.template GROUP BY f.leaf, f.template HAVING count(DISTINCT h.doc_id) >= {MIN_DOCS}
), dropped AS (
  SELECT n.leaf, n.line FROM named n JOIN common c ON n.leaf = c.leaf AND n.template = c.template
), gone AS (
  SELECT doc_id, list_sort(list(place)) AS places FROM k WHERE line IN (SELECT line FROM dropped) GROUP BY doc_id
), texts AS (
  SELECT d.doc_id, coalesce(places, []) AS places,
         CASE WHEN places IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(places, i)), lambda i: ls[i + 1]), chr(10)) END AS t
  FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
)
SELECT doc_id, CAST(len(places) AS BIGINT) AS n_dropped, array_to_string(places, ',') AS dropped, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM texts
"""
