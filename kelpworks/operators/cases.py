"""Test cases and traces, target-aware ranking, probes up to a budget, listing texts, highlights, chat sessions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpworks.functions import vocabulary as v
from kelpworks.functions.text import contains_any, evaluated, format_distance, normalize_text, number_forms, year_in
from kelpworks.operators.search import folded

#: Lines of an expected output that instruct rather than state, and words that mark a fact.
DIRECTIVES = ("neu dung", "neu ro", "xac dinh dung", "xac dinh", "tra loi dung", "tra loi ro", "bot tra loi dung", "bot neu dung")
GUIDANCE_STARTS = ("khong suy doan", "khong tra loi", "khong bo sung", "khong them", "khong nham", "khong ke nham", "khong suy dien", "khong tu suy dien", "tranh nham", "tranh lan man", "tra loi ngan gon", "tra loi mot y", "chi tra loi", "chi can", "co the", "optional")
GUIDANCE_WORDS = ("neu can", "neu muon", "khong suy doan", "khong suy dien", "khong tra loi", "khong nham", "khong ke nham")
FACTS = ("gia", "dien tich", "phong ngu", "phong ve sinh", "huong", "noi that", "quan", "huyen", "thanh pho", "dossier", "planyear", "dong tien", "du an", "ke hoach", "cong bo", "thu hoi", "kiem tra", "giam sat", "xu ly vi pham", "bao cao", "dau gia", "gpmb", "chuyen tiep", "phuong")
#: Titles of stated facts by what a directive asks for, in order.
TITLES = ((("gia",), "Giá"), (("dien tich",), "Diện tích"), (("phong ngu",), "Số phòng ngủ"), (("phong ve sinh", "wc", "vs"), "Số phòng vệ sinh"), (("noi that",), "Nội thất"), (("huong",), "Hướng"), (("quan", "huyen", "thanh pho"), "Quận/Huyện/Thành phố"), (("thoi gian", "toi thieu"), "Thời gian thuê tối thiểu"), (("so tang", "tang toi da"), "Số tầng tối đa"), (("dong tien",), "Dòng tiền"))


def _starts(c: Column, words) -> Column:
    return c.rlike("^(?:" + "|".join(map(re.escape, words)) + ")")


def _guides(flat: Column) -> Column:
    return _starts(flat, GUIDANCE_STARTS) | contains_any(flat, GUIDANCE_WORDS)


def stated_facts(expected: Column) -> Column:
    """The lines of an expected output that state facts, each once; as it was if there are none.

    A directive with a colon becomes the fact behind it under a title; without one, what follows its first words.
    """

    def fact(line: Column) -> Column:
        cut = F.locate(":", line)
        parts = {"line": line, "flat": normalize_text(line), "cut": cut, "head": normalize_text(F.substring(line, 1, cut - 1)), "tail": F.trim(F.substring(line, cut + 1, 10_000))}
        return evaluated(F.struct(*(c.alias(n) for n, c in parts.items())), lambda p: decided(*(p[n] for n in parts)))

    def decided(line: Column, flat: Column, cut: Column, head: Column, tail: Column) -> Column:
        title = F.coalesce(*(F.when(contains_any(head, words), F.lit(f"{name}: ")) for words, name in TITLES), F.lit(""))
        count = F.coalesce(*(F.when(F.startswith(flat, F.lit(p)), F.lit(len(p.split()))) for p in sorted(DIRECTIVES, key=len, reverse=True)), F.lit(0))
        rest = F.regexp_replace(F.array_join(F.slice(F.split(line, r"\s+"), count + 1, 10_000), " "), r"(?i)^(?:(?:là|la|về|ve|day|đây|việc|viec|rằng|rang)\s+)+", "")
        plain = F.when(line.rlike(r"\d|\b[A-Z_]{3,}\b") | contains_any(flat, FACTS), line)
        directive = F.when((cut > 0) & _starts(head, DIRECTIVES), F.when((tail != "") & ~_guides(normalize_text(tail)), F.concat(title, tail)))
        return F.when(_guides(flat), F.lit(None)).when((cut > 0) & _starts(head, DIRECTIVES), directive).when(_starts(flat, DIRECTIVES), evaluated(rest, lambda r: F.when((r != "") & ~_guides(normalize_text(r)), r))).otherwise(plain)

    lines = F.transform(F.split(F.coalesce(expected, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[-*•]+\s*", ""), r"^\d+[.)]\s*", "")))
    facts = F.filter(F.transform(F.filter(lines, lambda x: x != ""), fact), lambda x: x.isNotNull())
    keyed = F.filter(F.transform(facts, lambda x: F.struct(normalize_text(x).alias("k"), x.alias("x"))), lambda x: x["k"] != "")
    firsts = lambda pairs, keys: F.transform(F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1), lambda x: x["x"])
    once = evaluated(keyed, lambda pairs: evaluated(F.transform(pairs, lambda x: x["k"]), lambda keys: firsts(pairs, keys)))
    return evaluated(once, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")).otherwise(expected))


def zipped(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Two lists by position."""
    return left.join(right, ordinal)


def cost_by_case(results: DataFrame, case: str, cost: str) -> DataFrame:
    """To eight digits; what is no number counts as none."""
    return results.groupBy(case).agg(F.round(F.sum(F.col(cost).cast("string").try_cast("double")), 8).alias("cost"))


def merged_results(batches: list[DataFrame], case: str, parts: int = 256) -> DataFrame:
    """Batches of results one after the other; cases are numbered on by case, a null first. Cases are numbered within
    parts that a sample of them bounds, and moved on by the counts of earlier parts, so no task sorts a whole batch."""
    whole = None
    for i, b in enumerate(batches):
        b = b.withColumn("batch", F.lit(i))
        whole = b if whole is None else whole.unionByName(b, allowMissingColumns=True)
    # the sample only balances the parts; positions are the same for any
    bounds = sorted({r[0] for r in whole.select(case).where(F.col(case).isNotNull()).orderBy(F.rand(1)).limit(parts - 1).collect()})
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(case))) if bounds else F.lit(0)
    whole = whole.withColumn("__part", F.when(F.col(case).isNull(), -1).otherwise(part))
    counts = whole.groupBy("batch", "__part").agg(F.count("*").alias("__n"))
    order = Window.orderBy("batch", "__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part and batch
    before = counts.select("batch", "__part", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("batch", "__part").orderBy(case)) - 1
    numbered = whole.withColumn("__place", place).join(F.broadcast(before), ["batch", "__part"])
    return numbered.withColumn("position", F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def within_budget(rows: DataFrame, per: str, order: str, content: str, docs: int, characters: int) -> DataFrame:
    """Per question the candidates in order until one of the budgets is reached (the row that reaches it stays)."""
    window = Window.partitionBy(per).orderBy(order)
    sofar = rows.withColumns({"__n": F.row_number().over(window) - 1, "__c": F.coalesce(F.sum(F.length(content)).over(window) - F.length(content), F.lit(0))})
    return sofar.where((F.col("__n") < docs) & (F.col("__c") < characters)).drop("__n", "__c")


def target_score(raw: Column, values: list, keys: dict[str, tuple[str, ...]] | None = None, accents: bool = False) -> Column:
    """What a document's text says of the target's values (5 a fraction, 2 a number from 100 on, 1.1 less; 2.4 a
    text of up to three words, 3.4 a longer one) and 0.55 for each marker of its keys. With accents, texts and markers are
    looked for in the text as it is written, else in its normal form too."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    flat = low if accents else normalize_text(raw)
    score = F.lit(0.0)
    for value in values:
        if value is None or isinstance(value, bool) or value == 0:
            continue
        if isinstance(value, (int, float)):
            text = f"{value:.6f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)
            hit = F.exists(number_forms(F.lit(text)), lambda x: F.contains(low, x))
            score = score + F.when(hit, 5.0 if value != int(value) else 2.0 if abs(value) >= 100 else 1.1).otherwise(0.0)
        elif len(plain := re.sub(r"[^a-z0-9 ]", " ", folded(str(value))).strip()) >= 3:
            hit = F.contains(low, F.lit(str(value).strip().lower())) | F.contains(flat, F.lit(re.sub(r"\s+", " ", plain)))
            score = score + F.when(hit, 2.4 if len(plain.split()) <= 3 else 3.4).otherwise(0.0)
    for markers in (keys or {}).values():
        score = score + reduce(lambda a, b: a + b, (F.when(F.contains(flat, F.lit(m)), 0.55).otherwise(0.0) for m in markers), F.lit(0.0))
    return score


def compact_planning(content: Column, header: list[tuple[str, Column]], fact: bool) -> Column:
    """Named header lines and the first 2200 characters for a fact, else 1200; null if there is no body."""
    body = F.trim(F.substring(F.coalesce(content, F.lit("")), 1, 2200 if fact else 1200))
    lines = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in header]
    return F.when(body != "", F.concat_ws("\n", *lines, body))


def plan_year(messages: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The year that the user named last, else anyone."""
    year = messages.withColumn("__y", year_in(F.col(text))).where("__y is not null")
    return year.groupBy(session).agg(F.coalesce(F.max_by("__y", F.when(F.col(role) == "user", F.col(turn))), F.max_by("__y", turn)).alias("plan_year"))


def highlights(question: Column, listed: Column, broad: bool = False) -> Column:
    """Of the highlights between bars those that a word of the question names, or that speak of its purpose."""
    items = F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    forms = F.transform(items, lambda x: F.struct(x.alias("x"), normalize_text(x).alias("flat")))
    return evaluated(normalize_text(question), lambda flat: evaluated(forms, lambda seen: _chosen(flat, seen, broad)))


def _chosen(flat: Column, items: Column, broad: bool) -> Column:
    """highlights by the question's normal form and each item with its own."""
    terms = F.slice(F.array_distinct(F.filter(F.split(flat, " "), lambda w: F.length(w) >= 3)), 1, 18)
    asks = lambda words: contains_any(flat, words)
    speaks = lambda words: F.filter(items, lambda x: contains_any(x["flat"], words))
    some = lambda c: evaluated(c, lambda x: F.when(F.size(x) > 0, x))
    fit = asks(v.SUITABILITY_MARKERS)
    named = evaluated(F.struct(terms.alias("terms"), fit.alias("fit")), lambda q: F.filter(items, lambda x: F.exists(q["terms"], lambda t: F.contains(x["flat"], t)) | (q["fit"] & contains_any(x["flat"], v.SUITABILITY_MARKERS))))
    purpose = F.when(fit & asks(v.STUDY_WORK_MARKERS), speaks(v.STUDY_WORK_MARKERS)).when(fit & (asks(v.BUSINESS_MARKERS) | asks(v.INVESTMENT_MARKERS)), speaks((*v.BUSINESS_MARKERS, *v.INVESTMENT_MARKERS)))
    choices = [named, purpose, *([speaks(("khong", *v.BUSINESS_MARKERS))] if broad else []), F.slice(items, 1, 4 if broad else 2)]
    return F.array_join(F.transform(F.slice(F.coalesce(*map(some, choices)), 1, 6 if broad else 4), lambda x: x["x"]), "; ")


def listing_text(row: dict[str, Column], amenities: Column, utilities: Column) -> Column:
    """A listing's text from its joined row; amenities are names, utilities structs of name, metres (30 at most)."""
    shown = lambda k, unit="": F.concat(F.coalesce(F.nullif(F.trim(row[k].cast("string")), F.lit("")), F.lit("N/A")), F.lit(unit))
    kind = F.when(row["post_type"] == "SALE", "Cần bán").when(row["post_type"] == "RENT", "Cho thuê").otherwise("Khác")
    names = (("Danh mục", "category"), ("Giá", "price"), ("Diện tích", "area"), ("Số phòng ngủ", "bedrooms"), ("Số tầng", "floor"), ("Quận/Huyện", "district"), ("Thành phố", "province"))
    head = [F.concat(F.lit("LISTING_ID: "), row["post_id"].cast("string")), F.concat(F.lit("Loại: "), kind), *(F.concat(F.lit(f"{k}: "), shown(c, " m²" if c == "area" else " VNĐ" if c == "price" else "")) for k, c in names if c in row)]
    near = F.transform(F.slice(F.filter(utilities, lambda u: F.coalesce(u["name"], F.lit("")) != ""), 1, 30), lambda u: F.concat(F.lit("• "), u["name"], F.when(u["metres"].isNotNull(), F.concat(F.lit(" - "), format_distance(u["metres"]))).otherwise("")))
    inside = F.transform(F.filter(amenities, lambda a: F.coalesce(F.trim(a), F.lit("")) != ""), lambda a: F.concat(F.lit("• "), a))
    blocks = [F.when(F.size(x) > 0, F.concat(F.array(F.lit(title)), x)).otherwise(F.array().cast("array<string>")) for title, x in (("--- TIỆN ÍCH NỘI KHU ---", inside), ("--- TIỆN ÍCH XUNG QUANH ---", near))]
    return F.array_join(F.concat(F.array(*head), *blocks), "\n")


def session_of(sessions: DataFrame, session_id: int | None, user: int) -> DataFrame:
    """The user's session of that id; empty if it is someone else's."""
    return sessions.where((F.col("id") == F.lit(session_id)) & (F.col("user_id") == F.lit(user))).limit(1)
