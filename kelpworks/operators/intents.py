"""Deterministic analysis of questions and answers: boolean profiles, entity extraction, follow-ups, clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpworks.functions import vocabulary as v
from kelpworks.functions.text import compact, contains_any, evaluated, hits, normalize_planning, normalize_text, said
from kelpworks.operators.listing import utility_groups
from kelpworks.operators.search import folded


def district_of(c: Column) -> Column:
    """The first district whose alias stands as a phrase, else whose compact name is contained, else whose ward is named; null if none."""

    def named(text: Column, tight: Column) -> Column:
        phrase = [F.when(F.contains(text, F.lit(f" {folded(d)} ")), F.lit(d)) for d in v.DISTRICTS]
        inside = [F.when(F.contains(tight, F.lit(folded(d).replace(" ", ""))), F.lit(d)) for d in v.DISTRICTS]
        ward = [F.when(F.contains(text, F.lit(f" {w} ")), F.lit(d)) for w, d in v.WARDS.items()]
        return F.coalesce(*phrase, *inside, *ward)

    forms = F.struct(F.concat(F.lit(" "), normalize_text(c), F.lit(" ")).alias("text"), compact(c).alias("tight"))
    return evaluated(forms, lambda f: named(f["text"], f["tight"]))


def matches_district(document: Column, haystack: Column, district: str) -> Column:
    """L4: the same district, its name as a phrase, or all its words of two letters or more."""
    name = folded(district)
    words = [w for w in name.split() if len(w) >= 2]
    padded = F.concat(F.lit(" "), haystack, F.lit(" "))
    return F.coalesce(document == district, F.lit(False)) | F.contains(padded, F.lit(f" {name} ")) | reduce(lambda a, b: a & b, (F.contains(padded, F.lit(f" {w} ")) for w in words), F.lit(bool(words)))


def matches_year(year: Column, haystack: Column, wanted: int) -> Column:
    return F.coalesce(year == wanted, F.lit(False)) | F.contains(haystack, F.lit(str(wanted)))


def planning_intent(question: Column) -> Column:
    """L1: a keyword; or, beside a place or a year, a land, structure or reason term; projects need both place and year."""
    year = F.regexp_like(F.coalesce(question, F.lit("")), F.lit(r"\b20\d{2}\b"))
    forms = F.struct(normalize_text(question).alias("q"), year.alias("year"), district_of(question).isNotNull().alias("district"))
    return evaluated(forms, lambda f: _planned(f["q"], f["year"], f["district"] | f["q"].rlike(r"\b(phuong|xa|thi tran)\b")))


def _planned(q: Column, year: Column, place: Column) -> Column:
    land = [m for m in v.LAND_ADMIN_TERMS if m not in v.PROJECT_TERMS]
    topical = contains_any(q, (*land, *v.REASON_TERMS, *v.STRUCTURAL_TERMS))
    return contains_any(q, v.PLANNING_KEYWORDS) | (topical & (place | year)) | (contains_any(q, v.PROJECT_TERMS) & place & year)


def query_profile(question: Column, intent: Column | None = None) -> Column:
    """L2: eight flags, all false for a question that isn't about planning (L1, unless intent says so)."""
    about = planning_intent(question) if intent is None else intent
    return evaluated(F.struct(normalize_planning(question).alias("q"), about.alias("about")), lambda f: _profiled(f["q"], f["about"]))


def _profiled(q: Column, about: Column) -> Column:
    says = lambda markers: contains_any(q, markers)
    structure = says(v.PROJECT_SUBJECTS) & says(v.PROJECT_STATES)
    focus = says(v.FOCUS_MARKERS) & q.rlike(r"(?:phuong|xa)\s+[a-z0-9]{2,}")
    demand = says(v.DEMAND_MARKERS) & (hits(q, v.SECTORS) >= 2)
    network = says(v.NETWORKS) & says((*v.TERRAIN, *v.NETWORK_REASONS))
    measured, amounts = says(v.ANALYTICAL_MARKERS), says(v.AMOUNT_MARKERS) | q.rlike(v.AMOUNT)
    # how it is made up, or how much it is; a question for reasons only if it names what a fact is made of
    analytical = says(v.HOW_MARKERS) & (measured | (amounts & ~says(v.REASONING_MARKERS)))
    explanatory = ~(structure | focus | demand | network | analytical) & says(v.EXPLANATORY_MARKERS)
    why = says(v.PROJECT_REASONS)
    carried = (hits(q, v.CARRY_FORWARD_MARKERS) >= 2) | says(v.RESULT_GROUPS)
    flags = {
        "fact": says(v.FACT_MARKERS) | explanatory, "explanatory": explanatory, "project_structure": structure, "focus_area_reason": focus, "sector_land_demand": demand,
        "drainage_transport": network, "carry_forward": structure & ~why & carried, "project_delay_reason": structure & why & says(v.DELAY_MARKERS),
    }
    return F.struct(*((f & about).alias(k) for k, f in flags.items()))


def query_intents(question: Column) -> Column:
    """Sixteen flags; short words (gia, ty, re) count whole."""
    return evaluated(normalize_text(question), _intents)


def _intents(q: Column) -> Column:
    any_ = lambda *m: contains_any(q, m)
    direction = q.rlike(r"\bhuong\b")
    flags = {
        "needs_price": q.rlike(r"\b(gia|trieu|ty|vnd|re|ngan sach|chi phi)\b") | any_("bao nhieu tien") | (any_("bao nhieu") & q.rlike(r"\b(ban|thue)\b")),
        "needs_area": any_("dien tich", "m2", "met vuong"), "needs_direction": direction, "needs_main_door_direction": direction & any_("cua chinh"),
        "needs_bedrooms": q.rlike(r"phong ngu|\d+\s*pn|pn\s*\d+|\bpn\b"), "needs_bathrooms": q.rlike(r"phong ve sinh|toilet|\bwc\b|\bvs\b|\d+\s*wc|\d+\s*vs"), "needs_furnishing": any_("noi that"),
        "needs_min_rental_period": any_("toi thieu", "bao lau", "thoi gian thue"), "needs_cashflow": any_("dong tien", "doanh thu", "thu nhap", "cashflow"), "needs_indoor_amenities": any_("trong nha", "noi that ben trong"),
        "needs_location": any_("vi tri", "o dau", "quan nao", "huyen nao", "thanh pho nao", *v.LOCATION_MARKERS), "suitability_query": any_(*v.SUITABILITY_MARKERS), "business_query": any_(*v.BUSINESS_MARKERS),
        "investment_query": any_(*v.INVESTMENT_MARKERS), "study_work_query": any_(*v.STUDY_WORK_MARKERS), "explanatory_query": any_("vi sao", "tai sao", "ly do", "duoc xem la", "nhu the nao", "ra sao"),
    }
    return F.struct(*(f.alias(k) for k, f in flags.items()))


def floor_filter(question: Column) -> Column:
    """Tang a den b as a range, khoang tang a as one either side, tang a as it is."""
    return evaluated(normalize_text(F.regexp_replace(question, r"(\d)\s*-\s*(\d)", "$1 den $2")), _floors)


def _floors(q: Column) -> Column:
    number = lambda p, i=1: F.nullif(F.regexp_extract(q, p, i), F.lit("")).cast("int")
    span, near, exact = r"\btang\s+(\d{1,2})\s+(?:den|toi)\s+(?:tang\s+)?(\d{1,2})\b", r"\b(?:khoang|tam|gan)\s+tang\s+(\d{1,2})\b", r"\btang\s+(\d{1,2})\b"

    def bounds(a: Column, b: Column, c: Column) -> Column:
        low, high = F.coalesce(F.least(a, b), c - 1), F.coalesce(F.greatest(a, b), c + 1)
        return F.struct(low.alias("floor_min"), high.alias("floor_max"), F.when(low.isNull(), number(exact)).alias("floor"))

    named = F.struct(number(span).alias("a"), number(span, 2).alias("b"), number(near).alias("c"))
    return evaluated(named, lambda n: bounds(n["a"], n["b"], n["c"]))


def sane_filters(rows: DataFrame) -> DataFrame:
    """Addresses aren't districts, bounds of rooms and floors, ranges in order, an exact floor yields to a range."""
    out = rows
    for c in ("city", "district"):
        if c in rows.columns:
            out = out.withColumn(c, F.when(~(F.col(c).rlike(r"\d") | F.contains(F.col(c), F.lit(","))), F.nullif(F.trim(c), F.lit(""))))
    for c, most in (("bedrooms", 20), ("floor", 100)):
        if c in rows.columns:
            out = out.withColumn(c, F.when(F.col(c).between(0, most), F.col(c)))
    for c in ("price", "area", "floor"):
        if f"{c}_min" in rows.columns:
            low, high = F.col(f"{c}_min"), F.col(f"{c}_max")
            wrong = low > high
            out = out.withColumns({f"{c}_min": F.when(wrong, high).otherwise(low), f"{c}_max": F.when(wrong, low).otherwise(high)})
    if {"floor", "floor_min"} <= set(rows.columns):
        out = out.withColumn("floor", F.when(F.col("floor_min").isNull() & F.col("floor_max").isNull(), F.col("floor")))
    return out


def rewritten(messages: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", look: int = 4, most: int = 500) -> DataFrame:
    """Each session's last user message; a follow-up gets the newest of the user's earlier ones that names a thing."""
    own = messages.where(F.col(role) == "user").withColumn("__r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))).where(F.col("__r") <= look + 1)
    q = F.concat(F.lit(" "), normalize_text(text), F.lit(" "))
    own = own.withColumns({"__follow": contains_any(q, v.FOLLOW_UP_MARKERS), "__rich": F.exists(F.array(*(F.lit(f" {m} ") for m in v.ANCHOR_MARKERS)), lambda m: F.contains(q, m))})
    earlier = F.col("__r") > 1
    per = own.groupBy(session).agg(F.max_by(text, F.when(F.col("__r") == 1, 1)).alias("message"), F.max_by("__follow", F.when(F.col("__r") == 1, 1)).alias("follow_up"), F.min_by(text, F.when(earlier & F.col("__rich"), F.col("__r"))).alias("rich"), F.min_by(text, F.when(earlier, F.col("__r"))).alias("newest"))
    anchor = F.coalesce("rich", "newest")
    return per.select(session, "follow_up", F.when(F.col("follow_up") & anchor.isNotNull(), F.substring(F.concat_ws("\n", anchor, F.col("message")), 1, most)).otherwise(F.col("message")).alias("query"))


def mentioned_post(c: Column) -> Column:
    """The id that a text names as a post."""
    return F.nullif(F.regexp_extract(normalize_text(c), r"\b(?:post|bai dang|tin|listing)\s*(?:id|so|ma)?\s*(\d+)\b", 1), F.lit("")).cast("bigint")


def language_of(c: Column) -> Column:
    """L12 without a classifier: vi by its letters or by two of its common words (one in a text of six), else en."""
    words = F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")
    count = F.struct(F.size(words).alias("words"), F.size(F.filter(words, lambda w: w.isin(*v.VIETNAMESE))).alias("markers"))
    common = evaluated(count, lambda n: n["markers"] >= F.when(n["words"] <= 6, 1).otherwise(2))
    return F.when(F.lower(c).rlike("[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]"), "vi").when(common, "vi").otherwise("en")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _rewritten_lines(answer: Column, wanted: Column, line_of) -> Column:
    """Where wanted, the answer with line_of for each line (null drops it), unless nothing changes or nothing is left."""

    def joined(a: Column, lines: Column, new: Column) -> Column:
        text = _stripped(F.regexp_replace(F.array_join(new, "\n"), r"\n{3,}", "\n\n"))
        return evaluated(text, lambda t: F.when((new != lines) & (t != ""), t).otherwise(a))

    def changed(a: Column) -> Column:
        lines = F.split(a, "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
        left = lambda x: F.filter(F.transform(x, line_of), lambda y: y.isNotNull())
        return evaluated(lines, lambda x: evaluated(left(x), lambda new: joined(a, x, new)))

    return evaluated(answer, lambda a: F.when(wanted, changed(a)).otherwise(a))


def _without_price(line: Column) -> Column:
    """A line that names a price: null, or what it says besides if that is a fact of another kind."""
    left = reduce(lambda c, p: F.regexp_replace(c, p, ""), v.PRICE_PARTS, line)
    left = F.regexp_replace(F.regexp_replace(left, r"(?U)\s{2,}", " "), r"^[ ,;-]+|[ ,;-]+$", "")
    kept = evaluated(left, lambda x: F.when(x != "", x))
    return evaluated(normalize_text(line), lambda flat: F.when(~said(flat, v.PRICE_LINES), line).when(contains_any(flat, v.PRICE_KEEPS), kept))


def postprocessed(question: Column, answer: Column) -> Column:
    """Listing marks as links; headers and closing phrases go, and so do lines on prices, contacts, other kinds of places
    or surroundings where the question is about something else. An answer is never emptied by its lines; null stays null.
    Price words count whole (B12). Lines are read as they are: repair_mojibake comes first where it is needed."""
    out = F.regexp_replace(_stripped(answer), v.LISTING_MARK, r"[Xem chi tiết](/posts/$1) ")
    out = reduce(lambda c, p: F.regexp_replace(c, p, ""), v.ANSWER_HEADERS, out)
    out = reduce(lambda c, t: _stripped(F.regexp_replace(c, rf"(?iU)\s*{t}[^.!?]*[.!?]?\s*$", "")), v.ANSWER_TAILS, out)
    flags = lambda q, intents: F.struct(
        (intents["suitability_query"] & ~intents["needs_price"]).alias("unpriced"), contains_any(q, v.CONTACTS).alias("contacts"), contains_any(q, v.SPACIOUS).alias("spacious")
    )
    asked = F.when(contains_any(normalize_text(question), v.NEARBY), utility_groups(question)).otherwise(F.array().cast("array<string>"))
    said_of = evaluated(normalize_text(question), lambda q: evaluated(_intents(q), lambda i: flags(q, i)))
    return evaluated(F.struct(said_of.alias("flags"), asked.alias("asked")), lambda w: _postprocessed(out, w["flags"], w["asked"]))


def _postprocessed(out: Column, wants: Column, asked: Column) -> Column:
    """postprocessed behind its patterns, by what the question wants and the groups of places that it asks for."""
    out = _rewritten_lines(out, wants["unpriced"], _without_price)
    contact = lambda x: contains_any(normalize_text(x), v.CONTACTS) | x.rlike(r"\b0\d{8,10}\b")
    out = _rewritten_lines(out, ~wants["contacts"], lambda x: F.when(~contact(x), x))
    other = lambda x: evaluated(utility_groups(x), lambda g: (F.size(g) > 0) & ~F.arrays_overlap(g, asked))
    out = _rewritten_lines(out, F.size(asked) > 0, lambda x: F.when(~other(x), x))
    extra = lambda x: evaluated(normalize_text(x), lambda flat: contains_any(flat, v.SPACIOUS_EXTRAS) & ~contains_any(flat, v.SPACIOUS_KEEPS))
    return _rewritten_lines(out, wants["spacious"], lambda x: F.when(~extra(x), x))
