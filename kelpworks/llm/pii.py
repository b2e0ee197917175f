"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Everything is a built-in Spark function. A span's position comes from cutting the text at the pattern: between
two matches lies one gap, so the lengths of gaps and matches add up to code-point offsets.

Defined results: a null or empty text has no spans; repeated rows each get their own result; any further columns
of the input stay as they are (a column named `spans` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.llm.shared import table

#: The contract's patterns, written so that Java needs linear time and no recursion (possessive
#: repeats; an e-mail's local part starts where a run of its characters starts or where the last match ended; a card's
#: run of digits is a whole one, and one of under 16 digits can't pass).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Words near a span that make its kind likelier.
CONTEXT = {
    "email": "mail|contact|write to|reach",
    "ip": r"\bip\b|address|host|server|login",
    "card": "card|visa|master|amex|payment|credit|debit",
    "phone": "phone|call|tel|mobile|fax|whatsapp",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "national_id": r"ssn|social security|national id|tax id|passport",
}
BASE = ("email", "ip", "card", "phone")
#: Matches are placed so many at a time: an array that grows by one would be copied each time.
CHUNK = 256
SPAN = "struct<kind:string,start:int,end:int,text:string,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Every second digit from the right counts double; a valid number's sum is a multiple of ten."""
    figures = F.split(F.reverse(_digits(m)), "")
    worth = F.transform(F.filter(figures, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(m: Column) -> Column:
    """ISO 7064: the number with its first four characters moved to the end, letters as 10 to 35, leaves 1."""
    flat = F.regexp_replace(m, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(flat, 5, 100), F.substring(flat, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.coalesce(step(a, c), a)) == 1


def _octets(m: Column) -> Column:
    trimmed = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(trimmed, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


#: kind: pattern, cheap test that a text may hold it, validator or None, score without and with a passed checksum, least score.
def _kinds() -> list[tuple]:
    n = lambda m: F.length(_digits(m))
    return [
        ("email", EMAIL, lambda t: t.contains("@"), None, 0.8, 0.0),
        ("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets, 0.7, 0.0),
        ("card", CARD, lambda t: t.rlike("[0-9]"), lambda m: n(m).between(16, 19) & luhn(m), 0.8, 0.0),
        ("phone", PHONE, lambda t: t.contains("+"), lambda m: n(m).between(8, 15), 0.7, 0.0),
        ("iban", IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), mod97, 0.8, 0.7),
        ("national_id", NATIONAL, lambda t: t.rlike("[0-9]{2}-[0-9]{4}"), None, 0.5, 0.6),
    ]


def _found(text: Column, kind: str, pattern: str, may, valid, score: float, least: float) -> Column:
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,text:string,near:string>>")
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("text")))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(x["text"])
        near = F.lower(F.right(x["gap"], F.lit(48)))
        one = F.struct(begin.alias("start"), end.alias("end"), x["text"].alias("text"), near.alias("near"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    def chunk(a: Column, c: Column) -> Column:
        inner = F.aggregate(F.slice(pairs, c, CHUNK), F.struct(a["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(a["out"], inner["out"]).alias("out"))

    first = F.sequence(F.lit(1), F.greatest(F.size(matches), F.lit(1)), F.lit(CHUNK))
    placed = F.aggregate(first, F.struct(F.lit(0).alias("at"), none.alias("out")), chunk, lambda a: a["out"])
    if valid is not None:
        placed = F.filter(placed, lambda s: valid(s["text"]))
    scored = F.transform(placed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.when(s["near"].rlike(CONTEXT[kind]), F.lit(min(1.0, score + 0.2))).otherwise(F.lit(score)).alias("score")))
    if least:
        scored = F.filter(scored, lambda s: s["score"] >= least)
    return F.when(may(text), scored).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans`: kind, start, end (code points, end exclusive), text and score of each; kinds in order, then by start.

    The four base kinds stay whatever their context; `iban` needs a passed mod-97 and `national_id` a context word.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("spans", F.concat(*(_found(whole, *kind) for kind in _kinds())))


def redact(docs: DataFrame, text: str = "text", mask: str = "[{}]") -> DataFrame:
    """docs with every found span replaced by its kind; spans that overlap an earlier one are covered by it."""
    found = find_pii(docs, text)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.format_string(mask.replace("{}", "%s"), s["kind"])).alias("out"))
    )
    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return found.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(F.col(text)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of documents."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
