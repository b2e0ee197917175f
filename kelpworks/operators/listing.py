"""Listing search and rendering: joins with ordered text aggregates, conditional predicates, cards, nearby places."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpworks.functions.text import contains_any, evaluated, fold, format_distance, normalize_text, travel_minutes
from kelpworks.operators.search import folded

#: Groups of nearby places and the words that name them.
UTILITY_GROUPS = {
    "education": ("education", "giao duc", "truong", "truong hoc", "mau giao", "tieu hoc", "thcs", "thpt", "dai hoc", "hoc vien"),
    "shopping": ("commercial shopping", "shopping", "thuong mai", "sieu thi", "trung tam thuong mai", "mall", "aeon", "winmart", "vinmart"),
    "park": ("park plaza", "park", "cong vien", "quang truong"),
    "healthcare": ("healthcare", "y te", "benh vien", "phong kham"),
    "transport": ("transport", "giao thong", "xe buyt", "bus", "metro", "ben xe"),
    "finance": ("financial", "tai chinh", "ngan hang", "atm"),
    "dining": ("dining", "an uong", "nha hang", "cafe"),
    "entertainment": ("entertainment", "giai tri", "rap phim"),
    "sports": ("sports", "the thao", "san bong"),
    "parking": ("parking", "bai do xe"),
}
RENT, SALE = ("thue", "cho thue"), ("ban", "mua")


def ordered_names(rows: DataFrame, key: str, name: str, sep: str = ", ") -> DataFrame:
    """A3: the distinct names of a key in order, as one text; a group is as large as one entity's list."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), sep).alias("names"))


def nearby_lines(rows: DataFrame, key: str, name: str, category: str, metres: str, seconds: str) -> DataFrame:
    """A4: a line for each place, nearest first (unknown last), and the sorted distinct categories."""
    line = F.concat(F.col(name), F.when(F.col(metres).isNotNull(), F.concat(F.lit(" - "), format_distance(F.col(metres)))).otherwise(""), F.when(F.col(seconds).isNotNull(), F.concat(F.lit(" ("), travel_minutes(F.col(seconds)), F.lit(" min)"))).otherwise(""))
    item = F.struct(F.col(metres).isNull().alias("last"), F.col(metres).alias("m"), F.col(name).alias("name"), line.alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("lines"), F.array_sort(F.collect_set(category)).alias("categories"))


def latest(rows: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The newest row of each key (top-1 of a correlated subquery), by one aggregate and no sort."""
    whole = F.struct(when, tie, *(c for c in rows.columns if c not in (key, when, tie)))
    return rows.groupBy(key).agg(F.max(whole).alias("__r")).select(key, "__r.*")


def query_predicates(question: str, filters: dict) -> dict[str, object]:
    """What the text and the filters ask for; words count whole (a rent word before a sale word)."""
    text = f" {re.sub(r'[^a-z0-9 ]', ' ', folded(question))} "
    says = lambda words: any(f" {w} " in text for w in words)
    kind = filters.get("postType") or ("RENT" if says(RENT) else "SALE" if says(SALE) else None)
    low, high = filters.get("floorMin"), filters.get("floorMax")
    target = filters.get("floorNumber") if filters.get("floorNumber") is not None else int((low + high) / 2) if low is not None and high is not None else None
    return {"kind": kind, "priced": says(("gia", "trieu", "ty", "vnd", "re")), "cheap": says(("re", "gia re", "thap nhat")), "floor": target, "apartment": says(("chung cu", "can ho")), "lift": says(("thang may",))}


def listing_order(bedrooms: Column, floor: Column, price: Column, created: Column, tie: Column, want: dict) -> list[Column]:
    """Wanted bedrooms, wanted or nearest floor, cheap first if asked, newest, then the id."""
    order = []
    if want.get("bedrooms") is not None:
        order.append(F.when(bedrooms == want["bedrooms"], 0).otherwise(1))
    if want.get("floor") is not None:
        order.append(F.abs(floor - want["floor"]).asc_nulls_last())
    if want.get("cheap"):
        order.append(price.asc_nulls_last())
    return [*order, created.desc(), tie.asc()]


def with_retry(rows: DataFrame, strict: Column, relaxed: Column) -> DataFrame:
    """The rows that fit, or if there are none those that fit without the implied city; one job."""
    fit = rows.where(relaxed).withColumns({"__s": F.coalesce(strict, F.lit(False)), "__j": F.lit(1)})
    found = fit.agg(F.max("__s").alias("__any")).withColumn("__j", F.lit(1))  # one row
    return fit.join(F.broadcast(found), "__j").where(F.col("__s") | ~F.col("__any")).drop("__s", "__any", "__j")


def semi_by_id(docs: DataFrame, ids: DataFrame, key: str, null_passes: bool = True, unparsed_passes: bool = False) -> DataFrame:
    """Documents whose id is among the ids; null ids pass, and ids that are no number pass or not."""
    number = F.col(key).cast("string").try_cast("bigint")
    known = docs.withColumn("__id", number).join(ids.select(F.col(ids.columns[0]).cast("bigint").alias("__id")).distinct(), "__id", "left_semi").drop("__id")
    free = F.col(key).isNull() if null_passes else F.lit(False)
    if unparsed_passes:
        free = free | (F.col(key).isNotNull() & number.isNull())
    return known.select(*docs.columns).unionByName(docs.where(free))


def ordered_union(parts: list[DataFrame], key: Column, order: str, k: int) -> DataFrame:
    """The parts one after the other, each key once, up to k."""
    every = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("part", F.lit(i)))
    once = every.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("part", order))).where("__n = 1").drop("__n")
    return once.orderBy("part", order).limit(k)


def numeric_text(c: Column) -> Column:
    """Folded lower case in which . and , of numbers stay, so that 5,2 ty is 5.2."""
    return F.regexp_replace(F.lower(fold(c)), r"(\d),(\d)", "$1.$2")


def _extracted(c: Column, pattern: str) -> Column:
    """The pattern's first group where it is found, else null."""
    return evaluated(F.regexp_extract(c, pattern, 1), lambda x: F.when(x != "", x))


def price_vnd(c: Column) -> Column:
    """H8: the first price in billions or millions, in VND."""
    found = lambda text, unit: _extracted(text, rf"(\d+(?:\.\d+)?)\s*(?:{unit})\b").cast("double")
    return evaluated(numeric_text(c), lambda text: F.coalesce(found(text, "ty|ti") * 1e9, found(text, "trieu|tr") * 1e6))


def area_m2(c: Column) -> Column:
    return F.nullif(F.regexp_extract(numeric_text(F.translate(c, "²", "2")), r"(\d+(?:\.\d+)?)\s*m2\b", 1), F.lit("")).cast("double")


def rooms(c: Column, names: str) -> Column:
    """H8: bedrooms with names 'phong ngu|pn', bathrooms with 'phong tam|wc|vs|toilet'."""
    return _extracted(numeric_text(c), rf"(\d+)\s*(?:{names})\b").cast("int")


def direction(c: Column) -> Column:
    return F.nullif(F.regexp_extract(normalize_text(c), r"\bhuong\s+((?:dong|tay|nam|bac)(?:\s+(?:dong|tay|nam|bac))?)\b", 1), F.lit(""))


def utility_groups(c: Column) -> Column:
    """The groups that a text names, in order of their names."""
    named = lambda text: F.array(*(F.when(contains_any(text, words), F.lit(g)) for g, words in sorted(UTILITY_GROUPS.items())))
    return F.filter(evaluated(normalize_text(c), named), lambda g: g.isNotNull())


def nearby_choice(asked: Column, lines: Column, most: int = 6) -> tuple[Column, Column]:
    """Lines of asked groups, and the asked groups that no line has."""
    chosen = F.slice(F.filter(lines, lambda x: F.arrays_overlap(utility_groups(x), asked)), 1, most)
    return chosen, F.array_except(asked, F.flatten(F.transform(lines, utility_groups)))


def card(*rows: tuple[str, Column], least: int = 4) -> Column:
    """Name: value lines of what is known; null if they are too few."""
    lines = F.filter(F.array(*(F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in rows)), lambda x: x.isNotNull())
    return F.when(F.size(lines) >= least, F.array_join(lines, "\n"))


#: The names of a post type, and how it is shown.
POST_TYPES = {"Cho thue": ("rent", "cho thue", "thue"), "Can ban": ("sale", "can ban", "ban")}


def post_type_name(c: Column) -> Column:
    """H9: the shown name of a known post type, else the value itself; null where it is empty or has no letter or digit."""
    flat = normalize_text(c)
    known = F.coalesce(*(F.when(flat.isin(*names), F.lit(shown)) for shown, names in POST_TYPES.items()))
    return F.when(flat != "", F.coalesce(known, F.trim(c)))
