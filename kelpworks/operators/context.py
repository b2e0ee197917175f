"""Shaping hits into context: deduplication, compaction, citation merge, filters that never empty a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpworks.functions.text import contains_any, evaluated, normalize_text


def first_by(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__first = 1").drop("__first")


def keep_or_all(rows: DataFrame, keep: Column, per: str) -> DataFrame:
    """per group the rows that fit, or all if none does. The groups with a fit are an aggregate of their own, so no
    group is sorted in one task; a null group is a group."""
    marked = rows.withColumn("__k", F.coalesce(keep, F.lit(False)))
    fits = marked.where("__k").select(F.col(per).alias("__per"), F.lit(True).alias("__any")).distinct()
    return marked.join(fits, F.col(per).eqNullSafe(F.col("__per")), "left").where(F.col("__k") | F.col("__any").isNull()).select(*rows.columns)


def last_messages(messages: DataFrame, n: int = 6, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each session; `position` runs in the order of the talk."""
    newest = messages.withColumn("__r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))).where(F.col("__r") <= n)
    return newest.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(turn))).drop("__r")


def running_index(rows: DataFrame, doc: str, kind: str, order: list[Column]) -> DataFrame:
    """chunk_index from 0 within a document's type, global_index from 1 within the document."""
    local, whole = Window.partitionBy(doc, kind).orderBy(*order), Window.partitionBy(doc).orderBy(*order)
    return rows.withColumn("chunk_index", F.row_number().over(local) - 1).withColumn("global_index", F.row_number().over(whole))


def line_blocks(lines: DataFrame, doc: str = "doc_id", place: str = "place", kind: str = "kind", text: str = "line") -> DataFrame:
    """Consecutive lines of one type as a block (gaps and islands)."""
    order = Window.partitionBy(doc).orderBy(place)
    turn = (F.lag(kind).over(order) != F.col(kind)) | F.lag(kind).over(order).isNull()
    marked = lines.withColumn("block", F.sum(turn.cast("int")).over(order))
    own = F.array_sort(F.collect_list(F.struct(place, text)))
    return marked.groupBy(doc, "block").agg(F.first(kind).alias(kind), F.count("*").alias("n_lines"), own.alias("__l")).withColumn("content", F.array_join(F.transform("__l", lambda x: x[text]), "\n")).drop("__l")


def sibling_index(rows: DataFrame, doc: str, parent: str, order: list[Column]) -> DataFrame:
    """From 0 within a parent path."""
    return rows.withColumn("sibling_index", F.row_number().over(Window.partitionBy(doc, F.coalesce(parent, F.lit(""))).orderBy(*order)) - 1)


def filled(lines: Column, most: int, characters: int, skip: bool = True) -> Column:
    """C2 (skips a line that doesn't fit) or C4 (stops at it): the greedy choice of lines within both limits."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a: Column, line: Column) -> Column:
        more = a["n"] + F.length(line) + 1
        fits = (F.size(a["out"]) < most) & (more <= characters) & ~a["done"]
        return F.struct(F.when(fits, F.concat(a["out"], F.array(line))).otherwise(a["out"]).alias("out"), F.when(fits, more).otherwise(a["n"]).alias("n"), (a["done"] | (~fits & F.lit(not skip))).alias("done"))

    return F.aggregate(lines, start, step, lambda a: F.array_join(a["out"], "\n"))


def compacted(content: Column, most: int = 28, characters: int = 1400) -> Column:
    """Lines whose normal form (220 characters) is new, filled greedily; lines over 200 are cut at sentences."""
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > 200, F.split(x, r"(?<=[.;])\s+")).otherwise(F.array(x))))
    keyed = F.transform(short, lambda x: F.struct(F.substring(normalize_text(x), 1, 220).alias("k"), x.alias("x")))
    once = F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y["k"]), x["k"]) == i + 1)
    return filled(F.transform(once, lambda x: x["x"]), most, characters)


def context_documents(rows: DataFrame, query: str, key: Column, order: list[Column], content: str, max_docs: int = 4, max_chars: int = 1400) -> DataFrame:
    """Per query the first documents of distinct keys, compacted, distinct again by content, joined by blank lines."""
    once = first_by(rows.withColumn("__key", key), [F.col(query), F.col("__key")], order)
    top = once.withColumn("__n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("__n") <= max_docs)
    shown = top.withColumn("__c", compacted(F.col(content), characters=max(400, max_chars)))
    again = first_by(shown, [F.col(query), normalize_text("__c")], [F.col("__n")])
    parts = F.array_sort(F.collect_list(F.struct("__n", "__c")))
    return again.groupBy(query).agg(F.count("*").alias("n_docs"), F.array_join(F.transform(parts, lambda p: p["__c"]), "\n\n").alias("context"))


def merged_citations(rows: DataFrame, keys: list[str], order: str, firsts: list[str], lists: list[str]) -> DataFrame:
    """Per entity the first value that isn't empty of some columns, and all distinct values, in order, of others."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))).alias(c) for c in firsts]
    every = [F.array_distinct(_values(order, c)).alias(f"{c}s") for c in lists]
    return rows.groupBy(*keys).agg(*first, *every, F.min(order).alias("first_rank"))


def _values(order: str, c: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda x: x[c])


def overlap_score(answer: Column, title: Column, places: list[Column], numbers: Column) -> Column:
    """2 a title word (of the first 20, 3 letters or more), 4 a place, 2 a number that the answer names."""
    words = F.slice(F.filter(F.split(normalize_text(title), " "), lambda w: F.length(w) >= 3), 1, 20)

    def scored(text: Column) -> Column:
        named = lambda w: F.contains(text, F.concat(F.lit(" "), w, F.lit(" ")))
        score = 2 * F.size(F.filter(words, named)) + 2 * F.size(F.filter(numbers, named))
        for place in places:
            score = score + evaluated(normalize_text(place), lambda flat: F.when((flat != "") & named(flat), 4).otherwise(0))
        return score

    return evaluated(F.concat(F.lit(" "), normalize_text(answer), F.lit(" ")), scored)


def reranked(rows: DataFrame, per: str, planning: str, score: str, index: str) -> DataFrame:
    """Planning first, then by score, then as they were; adds `place` from 1."""
    order = Window.partitionBy(per).orderBy(F.desc(planning), F.desc(score), index)
    return rows.withColumn("place", F.row_number().over(order))


#: Words of an answer about several listings, and of one about a single one.
SEVERAL, SINGLE = ("cac can", "nhung can", "mot so can", "danh sach", "lua chon", "phuong an"), "mot can"


def names_one_listing(question: Column, answer: Column) -> Column:
    """At most one link to a listing and no word of several; and one link, or a word of a single one on either side."""
    asked, flat = normalize_text(question), normalize_text(answer)
    links = F.regexp_count(F.coalesce(answer, F.lit("")), F.lit(r"(?i)/posts/\d+"))
    single = F.contains(F.concat_ws("\n", flat, asked), F.lit(SINGLE)) | (links == 1)
    return F.coalesce((flat != "") & (links <= 1) & ~contains_any(flat, SEVERAL) & single, F.lit(False))
