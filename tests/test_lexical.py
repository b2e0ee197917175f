"""Markers against nested loops; terms of questions against the driver's; the stored index against scanning."""

import random
import re

from kelpworks.operators import lexical_index, markers
from kelpworks.operators.search import folded, terms_of, weight_of
from pyspark.sql import functions as F

QUESTIONS = [
    None, "", "  ", "va la cua", "Kế hoạch sử dụng đất quận Ba Đình năm 2024 theo QĐ 12/QĐ-UBND", "a.b._ -x- 12 7 ab", "8,6915 ha 8.6915 86915", "漢字漢字 / // ab/c",
    "thu hồi đất thu hồi đất", "Internationalisation " * 3, "một hai ba bốn năm sáu bảy tám chín mười mười một mười hai mười ba", "x" * 5_000, "12345 12345 ٣٤٥٦", "tên-miền.com/đường_dẫn",
]


def test_markers_agree_with_nested_loops(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcé 漢😀") for _ in range(r.choice([0, 1, 2, 3, 6])))
    marks = [(i, r.choice([word(), word(), None])) for i in range(300)] + [(None, "a"), (900, "ab"), (901, "ab")]
    texts = [(i, r.choice([None, "", word() * 3, " ".join(word() for _ in range(60))])) for i in range(80)] + [(500, "ab" * 50_000)]
    rows = spark.createDataFrame(texts, "id long, text string").withColumn("found", F.lit("old"))
    table = spark.createDataFrame(marks, "marker_id long, marker string")
    wanted = {i: sorted(n for n, m in marks if n is not None and m and m in (t or "")) for i, t in texts}
    for block in (10_000_000, 40):
        got = {i: [] for i, _ in texts}
        for x in markers.match_markers(rows, table, "id", F.col("text"), block_chars=block).collect():
            got[x.id] += x.found
        assert {i: sorted(x) for i, x in got.items()} == wanted
    nothing = markers.match_markers(rows, table.limit(0), "id", F.col("text")).collect()
    assert len(nothing) == len(texts) and not any(x.found for x in nothing)
    assert markers.match_markers(rows.limit(0), table, "id", F.col("text")).count() == 0


def test_ten_thousand_markers_take_one_pass(spark):
    table = spark.range(10_000).select(F.col("id").alias("marker_id"), F.concat(F.lit("m"), F.col("id"), F.lit("z")).alias("marker"))
    rows = spark.range(500).select("id", F.concat(F.lit("xm"), F.col("id") * 20, F.lit("zm"), F.col("id"), F.lit("z")).alias("text"))
    found = markers.match_markers(rows, table, "id", F.col("text"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert all(x.found == sorted({x.id, x.id * 20}) for x in found.collect())


def test_terms_of_a_table_are_those_of_each_question(spark):
    df = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")
    got = {i: {} for i in range(len(QUESTIONS))}
    for x in lexical_index.question_terms(df).collect():
        got[x.question_id][x.place] = (x.term, x.weight / 10)
    assert [[got[i][p] for p in sorted(got[i])] for i in got] == [[(t, weight_of(t)) for t in terms_of(q or "")] for q in QUESTIONS]


def test_terms_worked_out_by_hand():
    assert terms_of("Diện tích 8,6915 ha tại QĐ 12/2024.") == ["dien tich 8 6915 ha", "dientich86915ha", "86915", "tich 8 6915 ha qd", "tich86915haqd", "8 6915 ha qd 12/2024", "86915haqd122024", "86915122024", "dien tich 8 6915", "dientich86915", "tich 8 6915 ha", "tich86915ha"]
    assert terms_of("đất ở") == ["đất", "dat"] and terms_of("va la") == []


def scanned(rows, questions, k):
    """What the index must return, by looking at every row for every question."""
    def hit(term, fields):
        bare = re.sub("[^a-z0-9]", "", folded(term))
        norm = lambda s: re.sub("[^a-z0-9]+", " ", folded(s))
        return any(term in (f or "").lower() or (bare and bare in norm(f).replace(" ", "")) for f in fields)

    out = set()
    for q, text in questions:
        scores = []
        for i, *fields in rows:
            terms = [t for t in terms_of(text or "") if hit(t, fields)]
            if terms:
                scores.append((-sum(round(10 * weight_of(t)) for t in terms), -len(terms), i))
        out |= {(q, rank, i, -s / 10, -n) for rank, (s, n, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_index_agrees_with_scanning_and_looks_for_new_terms_only(spark, tmp_path, monkeypatch):
    r = random.Random(15)
    words = ["Kế hoạch", "đất", "quận", "ba đình", "12/QĐ", "8,6915", "漢字漢字", "internation", "alisation", "2024", "x-y", "AB/C", "mười hai"]
    rows = [(i, r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randint(1, 12)))]), r.choice(["src", None, "quận-ba"])) for i in range(90)]
    index = lexical_index.LexicalIndex.build(spark.createDataFrame(rows, "id long, text string, source string"), "id", ["text", "source"], f"{tmp_path}/index")
    asked = list(enumerate(QUESTIONS))
    table = lambda x: spark.createDataFrame(x, "question_id int, question string")
    first, rest = asked[:6], asked[4:]
    assert {tuple(x) for x in index.search(table(first), 5).collect()} == scanned(rows, first, 5)
    known = index.terms().count()
    assert {tuple(x) for x in index.search(table(rest), 7).collect()} == scanned(rows, rest, 7)
    assert index.terms().count() > known

    def refuse(*_):
        raise AssertionError("known terms were looked for again")

    monkeypatch.setattr(lexical_index, "match_markers", refuse)
    again = lexical_index.LexicalIndex(spark, f"{tmp_path}/index")
    assert {tuple(x) for x in again.search(table(asked), 7).collect()} == scanned(rows, asked, 7)
    assert again.search(table(asked).limit(0), 3).count() == 0


def test_scores_need_one_exchange_of_postings_and_bounded_ranks(spark, sf_dir):
    from kelpworks.plans import registry

    plan = registry.queries()["lexical_batch"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
