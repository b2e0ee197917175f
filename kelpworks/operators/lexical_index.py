"""Lexical search for a table of questions (R2, R3, W10): terms as columns, and a stored index from terms to rows.

A term hits a row if a field holds it raw, normalised or compact (letters and digits only). Whatever a raw or normalised
form holds, the compact one holds too, so a row's compact forms, made once at ingest, decide for all terms with a letter
or digit; the others look in the raw form.

The index holds the postings of every term that was ever asked for. Terms that are new are looked up in the stored forms,
all at once in one pass (see markers.py), and their postings are added; known terms cost no pass over any text. Questions
then are one join of their terms with the postings, an aggregate within each row's partition, and a bounded rank.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpworks.functions.text import compact, normalize_loose
from kelpworks.operators.markers import match_markers
from kelpworks.operators.search import STOPWORDS

#: Longest and shortest phrase in words, least compact length of a phrase or compact form, phrases and terms of a
#: question, digits that make a term of their own, and least length of a word.
LONGEST, SHORTEST, COMPACT, PHRASES, TERMS, DIGITS, LEAST = 5, 2, 10, 6, 12, 4, 3
#: What a word is made of, as written and in phrases.
WORD, PLAIN = r"[\p{L}\p{N}_/.\-]+", r"[a-z0-9/.\-]+"
BETWEEN = "\n"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ngrams(tokens: Column, longest: int = LONGEST, shortest: int = SHORTEST) -> Column:
    """Runs of tokens joined by spaces, the longest first, each size from left to right."""
    sizes = F.array(*(F.lit(n) for n in range(longest, shortest - 1, -1)))

    def windows(t: Column) -> Column:
        of_size = lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(sizes, of_size))

    return F.transform(F.array(tokens), windows)[0]  # the lambda binds the tokens, so that they are made once


def terms_column(question: Column) -> Column:
    """The first phrases, then words as written and folded, each with its compact form and its digits, in order.

    Stopwords, and words under three characters that are no number and have no slash, are left out. The number of terms is
    tested after each word, so that it can pass the bound by the word's own forms. Null or empty questions have no terms.
    """
    return F.transform(F.array(normalize_loose(question)), lambda loose: _terms(question, loose))[0]


def _terms(question: Column, loose: Column) -> Column:
    stop = F.array(*(F.lit(w) for w in sorted(STOPWORDS)))
    plain = F.filter(_all(loose, PLAIN), lambda w: ~F.array_contains(stop, w))
    phrases = F.slice(F.filter(ngrams(plain), lambda p: F.length(F.regexp_replace(p, "[^a-z0-9]", "")) >= COMPACT), 1, PHRASES)
    words = F.concat(phrases, _all(F.lower(F.coalesce(question, F.lit(""))), WORD), _all(loose, WORD))
    clean = F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"^[._\-]+|[._\-]+$", "")))
    fit = F.filter(clean, lambda w: (w != "") & ~F.array_contains(stop, w) & ((F.length(w) >= LEAST) | F.contains(w, F.lit("/")) | w.rlike(r"^\p{Nd}+$")))

    def added(terms: Column, form: Column, least: int) -> Column:
        return F.when((F.length(form) < least) | F.array_contains(terms, form), terms).otherwise(F.concat(terms, F.array(form)))

    def step(terms: Column, word: Column) -> Column:
        one = added(terms, word, 1)
        forms = F.transform(F.array(one), lambda t: added(t, compact(word), COMPACT))[0]
        more = F.transform(F.array(forms), lambda t: added(t, F.regexp_replace(word, "[^0-9]", ""), DIGITS))[0]
        return F.when((F.size(terms) >= TERMS) | F.array_contains(terms, word), terms).otherwise(more)

    return F.aggregate(fit, F.array().cast("array<string>"), step)


def term_weight(term: Column) -> Column:
    """Ten times what a term's hit is worth, so that sums are exact."""
    norm, bare = normalize_loose(term), F.length(compact(term))
    return F.when(F.contains(norm, F.lit(" ")) & (bare >= 10), 24).when(norm.rlike(r"^\p{Nd}{4,}$"), 20).when(F.contains(norm, F.lit("/")) | (bare >= 12), 18).when(F.length(norm) >= 9, 14).otherwise(10)


def question_terms(questions: DataFrame, question_id: str = "question_id", question: str = "question") -> DataFrame:
    """question_id, place, term, weight (tenfold), needle (what is looked for) and raw (whether in the raw form)."""
    terms = questions.select(F.col(question_id).alias("question_id"), F.posexplode(terms_column(F.col(question))).alias("place", "term"))
    bare = compact("term")
    return terms.select("question_id", "place", "term", term_weight(F.col("term")).alias("weight"), F.when(bare != "", bare).otherwise(F.lower("term")).alias("needle"), (bare == "").alias("raw"))


class LexicalIndex:
    """Stored under a folder: forms (row_id, bare, raw), terms (needle, raw, term_no, batch) and postings by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, row_id: str, fields: list[str], path: str) -> LexicalIndex:
        """Make and store the forms of the fields, once. row_id should be unique; rows that share it are one row's parts."""
        index = cls(rows.sparkSession, path)
        bare = F.concat_ws(BETWEEN, *(compact(F.col(f).cast("string")) for f in fields))
        raw = F.concat_ws(BETWEEN, *(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields))
        rows.select(F.col(row_id).alias("row_id"), bare.alias("bare"), raw.alias("raw")).write.parquet(f"{index.path}/forms")
        kind = rows.schema[row_id].dataType.simpleString()
        index.spark.createDataFrame([], "needle string, raw boolean, term_no long, batch string").write.parquet(f"{index.path}/terms")
        index.spark.createDataFrame([], f"row_id {kind}, found array<bigint>, batch string").write.partitionBy("batch").parquet(f"{index.path}/postings")
        return index

    def forms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/forms")

    def terms(self) -> DataFrame:
        return self.spark.read.schema("needle string, raw boolean, term_no long, batch string").parquet(f"{self.path}/terms")

    def postings(self) -> DataFrame:
        kind = self.forms().schema["row_id"].dataType.simpleString()
        return self.spark.read.schema(f"row_id {kind}, found array<bigint>, batch string").parquet(f"{self.path}/postings")

    def extend(self, terms: DataFrame) -> int:
        """Add the postings of the terms (needle, raw) that the index lacks; how many they were.

        Postings are written before the terms that refer to their batch, so that a broken run leaves nothing that counts.
        """
        new = terms.select("needle", "raw").where("needle <> ''").distinct().join(self.terms().select("needle", "raw"), ["needle", "raw"], "left_anti")
        batch = uuid.uuid4().hex
        numbered = new.withColumn("term_no", F.monotonically_increasing_id())
        numbered.write.parquet(f"{self.path}/asked-{batch}")
        numbered = self.spark.read.parquet(f"{self.path}/asked-{batch}")
        if not (count := numbered.count()):
            return 0
        for raw, form in ((False, "bare"), (True, "raw")):
            asked = numbered.where(F.col("raw") == raw)
            if not asked.isEmpty():
                hits = match_markers(self.forms(), asked, "row_id", F.col(form), "term_no", "needle").where(F.size("found") > 0)
                hits.write.mode("append").parquet(f"{self.path}/postings/batch={batch}")
        numbered.select("needle", "raw", "term_no", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/terms")
        return count

    def search(self, questions: DataFrame, k: int, question_id: str = "question_id", question: str = "question", min_hits: int = 1) -> DataFrame:
        """question_id, rank (from 1), row_id, score and hits: each question's k best rows with at least min_hits of its terms.

        Equal scores go to more hits, then to the smaller row_id. Questions without terms or hits have no rows.
        """
        asked = question_terms(questions, question_id, question)
        self.extend(asked)
        wanted = asked.join(self.terms(), ["needle", "raw"]).groupBy("batch", "term_no", "question_id").agg(F.sum("weight").alias("weight"), F.count("*").alias("terms"))
        # A row's postings meet in one partition, so its scores need no further exchange.
        by_row = self.postings().repartition("row_id").select("row_id", "batch", F.explode("found").alias("term_no")).distinct()
        scored = by_row.join(wanted, ["batch", "term_no"]).groupBy("row_id", "question_id").agg(F.sum("weight").alias("tenfold"), F.sum("terms").alias("hits"))
        best = Window.partitionBy("question_id").orderBy(F.desc("tenfold"), F.desc("hits"), "row_id")
        ranked = scored.where(F.col("hits") >= max(1, min_hits)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("question_id", "rank", "row_id", (F.col("tenfold") / 10).alias("score"), "hits")
