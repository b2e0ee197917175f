"""PII, decontamination, lines, top-k: the same as brute force, on tables and on odd cases."""


import brute
import pytest
from kelpworks.llm import decontaminate, line_dedup, pii, registry, topk
from oracle import same
from pyspark.sql import functions as F

ODD = [None, "", " \n ", "Ünïcödé ẞ 😀", "A" * 50_000, "word " * 20_000, "9" * 20_000, "a@" + "b." * 3_000 + "c", "\n" * 5_000]


def docs(spark, texts, extra=""):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.selectExpr("*", *extra.split(";")) if extra else df


def pairs(spark, sf_dir, name, key):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()]


def test_pii_query_agrees_with_brute_force(spark, sf_dir):
    texts = dict(pairs(spark, sf_dir, "documents", "doc_id"))
    for r in pii.op1_pii(spark, sf_dir).collect():
        wanted = brute.pii(texts[r.doc_id])
        assert r.base_sha256 == brute.digest(wanted) and r.n_email == sum(x.startswith("email") for x in wanted)


def test_pii_of_odd_texts(spark):
    texts = [*ODD[:5], ODD[7], "a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.0003.4", "a@b.c-_x@e.f..g@h.i.j,+1 (212) 555-1234", "é@é.fr aé@b.fr 😀 a@b.fr", "4111 1111 1111 1111 4111-1111-1111-1112 5 -4111111111111111"]
    for r in pii.find_pii(docs(spark, texts, "'old' as spans;1 as score")).collect():
        got = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE]
        assert got == brute.pii(r.text) and r.score == 1
        assert all(r.text[s.start : s.end] == s.text for s in r.spans)


def test_checksums_and_context_confirm_more_kinds(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432", "DE89370400440532013001", "SSN 123-45-6789", "part 123-45-6789"]
    rows = pii.find_pii(docs(spark, texts)).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in rows] == [["iban", "iban"], [], ["national_id"], []]
    assert rows[0].spans[0].score > rows[0].spans[1].score
    assert pii.redact(docs(spark, ["to a@b.de now", None])).orderBy("doc_id").select("text").collect()[0][0] == "to [email] now"


def test_contamination_query_agrees_with_brute_force(spark, sf_dir):
    wanted = brute.contamination(pairs(spark, sf_dir, "documents", "doc_id"), pairs(spark, sf_dir, "benchmark", "item_id"))
    assert any(x[1] for x in wanted.values())
    for r in decontaminate.op2_decontaminate(spark, sf_dir).collect():
        n, hit, items, bad = wanted[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), brute.digest(items), bad)


ITEMS = [(1, " ".join(f"w{i}" for i in range(20))), (2, "Short ITEM"), (3, ""), (4, None), (None, "no id here"), (10, " ".join(f"w{i}" for i in range(5, 25))), (11, "rare a a a a a a a a a a a a")]
TEXTS = [*ODD[:4], "x " * 30 + " ".join(f"W{i}" for i in range(3, 18)), "a short item, short item", "no id here", "a " * 500, "rare" + " a" * 40, "short", " ".join(f"w{i}" for i in range(25)), " ".join(f"w{i}" for i in range(25))]


@pytest.mark.parametrize("block", [1_000_000, 25])
def test_contamination_of_odd_texts_and_in_blocks(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = brute.contamination(list(enumerate(TEXTS)), ITEMS)
    found = decontaminate.verdicts(decontaminate.find_contamination(docs(spark, TEXTS, "1 as k1;'x' as items;2 as hits"), items, block_words=block)).collect()
    assert {r.id: (r.n_words, r.n_hit, r.items, r.contaminated) for r in found} == wanted and len(found) == len(TEXTS)


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.verdicts(decontaminate.find_contamination(docs(spark, ["a b"]), none)).collect()] == [0]
    assert decontaminate.find_contamination(docs(spark, ["a"]).limit(0), spark.createDataFrame(ITEMS, none.schema)).count() == 0
    kept = decontaminate.drop_contaminated(docs(spark, ["Short item", "clean", None, None], "1 as k1"), spark.createDataFrame(ITEMS, none.schema))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == ["doc_id", "text", "k1"]


def test_proximity_finds_terms_near_each_other(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    texts = ["gamma x beta alpha", "alpha x x x x x beta gamma", "alpha beta", "alpha beta gamma"]
    found = decontaminate.find_contamination(docs(spark, texts), item, slop=2).orderBy("id").collect()
    assert [r.near for r in found] == [["1"], [], [], ["1"]] and [r.items for r in found] == [[], [], [], ["1"]]


def test_proximity_query_finds_an_inserted_word_and_a_changed_order(spark, tmp_path):
    words = [f"w{i}" for i in range(13)]
    texts = [words, [*words[:5], "in", *words[5:]], words[6:] + words[:6], words[:12]]
    docs(spark, [" ".join(t) for t in texts]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = registry.queries()["op2_proximity"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_items, r.n_near) for r in rows] == [(1, 1), (0, 1), (0, 1), (0, 0)] and rows[1].near_sha256 == brute.digest(["7"])


def test_line_query_agrees_with_brute_force(spark, sf_dir):
    import hashlib

    wanted = brute.lines(pairs(spark, sf_dir, "documents", "doc_id"), line_dedup.MIN_DOCS)
    assert any(x[0] for x in wanted.values())
    for r in line_dedup.op3_line_dedup(spark, sf_dir).collect():
        at, text = wanted[r.doc_id]
        assert (r.dropped, r.text_sha256) == (",".join(map(str, at)), hashlib.sha256(text.encode()).hexdigest())


def test_templates_with_variable_fields_are_dropped(spark):
    names = ["ann", "bob", "cid", "dee", "eve", "fay", "gus", "hal"]
    texts = [f"{n * 3} said these {n} things alone, which nobody else has said before or will say\nlog in ok by {n} at {i}:00\n  log in ok by\t{n} at 7" for i, n in enumerate(names)]
    texts += ["log in ok by zed at 9", None, "", "\n\n", "x\n" * 3_000, "log in ok never seen"] + ["same whole copy\nof a text"] * 6
    wanted = brute.lines(list(enumerate(texts)), 5, copy=0.8)
    found = line_dedup.drop_lines(docs(spark, texts, "1 as place;2 as __x"), min_docs=5, copy=0.8, report=True).collect()
    assert {r.doc_id: (list(r.dropped), r.text) for r in found} == wanted
    assert wanted[0][0] == [1, 2] and wanted[len(texts) - 1][1] == texts[-1] and len(found) == len(texts)


def test_a_rare_variant_goes_with_its_template_and_a_single_document_keeps_its_list(spark):
    """One variant in many documents counts for the rare ones; lines of one document count once; copies go unless `copy` is given."""
    words = ["ann", "bob", "cid", "dee", "eve", "fay", "gus", "hal", "ian", "jon", "kay", "lee"]
    own = lambda i: f"text {words[i % 12]} {words[i // 12]} of its own, nothing like it"
    texts = [f"{own(i)}\nshare this article on facebook" for i in range(30)] + [f"{own(30 + i)}\nshare this article on {w}" for i, w in enumerate(words[:5])]
    texts += ["\n".join(f"go and see {w}" for w in words), "12 34\n56 7\n8 9"] + [f"{own(50 + i)}\n12 34" for i in range(12)] + [f"{own(70 + i)}\ngo and tell others" for i in range(3)]
    texts += ["all of these lines\nare in each document\nof the same group"] * 31
    wanted = brute.lines(list(enumerate(texts)), 10)
    found = {r.doc_id: (list(r.dropped), r.text) for r in line_dedup.drop_lines(docs(spark, texts), report=True).collect()}
    assert found == wanted
    assert all(wanted[i][0] == [1] for i in range(35)) and wanted[35][0] == wanted[36][0] == [] and all(wanted[i][1] == "" for i in range(52, 83))
    whole = line_dedup.drop_lines(docs(spark, texts), copy=0.8, report=True).where("copied").select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in whole) == list(range(52, 83)) and {r.text for r in whole} == {texts[-1]}


@pytest.mark.parametrize("seed", range(4))
def test_lines_of_a_small_vocabulary_agree_with_brute_force(spark, seed):
    """Leaves with many templates, some within others, and lines that several documents hold."""
    import random

    rng = random.Random(seed)
    line = lambda: " ".join(["a", "b", *(rng.choice(["c", "c", "d", "e", str(rng.randrange(9)), f"x{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]) for _ in range(rng.choice([2, 4])))])
    texts = ["\n".join(line() for _ in range(rng.randrange(6))) for _ in range(120)]
    wanted = brute.lines(list(enumerate(texts)), 6, depth=2)
    found = line_dedup.drop_lines(docs(spark, texts, "1 as k1;2 as places;3 as lines;4 as row;5 as copied"), min_docs=6, depth=2)
    assert found.columns == ["doc_id", "text", "k1", "places", "lines", "row", "copied"]
    assert {r.doc_id: r.text for r in found.collect()} == {d: x[1] for d, x in wanted.items()}
    assert 0 < sum(len(x[0]) for x in wanted.values()) < sum(len(t.split("\n")) for t in texts)


def test_repeated_rows_count_as_one_document_and_empty_tables_stay_empty(spark):
    twice = docs(spark, ["a b c d\ntext one"]).unionByName(docs(spark, ["a b c d\ntext one"]))
    assert [r.text for r in line_dedup.drop_lines(twice, min_docs=2).collect()] == ["a b c d\ntext one"] * 2
    assert line_dedup.drop_lines(twice.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("numbers", [2_000_000, 4])
def test_topk_of_ties_odd_vectors_and_query_blocks(spark, monkeypatch, numbers):
    monkeypatch.setattr(topk, "NUMBERS", numbers)
    rows = [(i, [float((i * 7) % 5), float(-(i % 3))]) for i in range(40)] + [(100, None), (101, [float("nan"), 1.0]), (102, [float("inf"), 1.0]), (None, [1.0, 1.0]), (103, [1.0]), (104, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    whole = df.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("embedding"), "score")
    got = topk.top_k(whole, whole.where("vec_id % 20 = 0 or vec_id > 100"), 5).collect()
    fine = {i: [int(256 * x) for x in (*v, 0.0)][:2] for i, v in rows if i is not None and v and all(abs(x) < 1e9 for x in v)}
    for q in (0, 20, 103, 104):
        best = sorted(((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q))[:5]
        assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(-s, i) for s, i in best]
    assert {r.query_id for r in got} == {0, 20, 103, 104}
    assert topk.top_k(whole, whole.limit(0), 5).count() == 0


def test_threshold_search_stops_early():
    import numpy as np

    rng = np.random.default_rng(0)
    x = (256 * rng.pareto(1.5, size=(4000, 4))).astype(np.int64)
    best = topk.Best(1, 5)
    took = topk.threshold_search(np.arange(4000), x, np.array([-1]), np.array([[1, 2, 1, 3]]), best)
    assert took < 1000 and best.ids[0].tolist() == sorted(range(4000), key=lambda i: (-int(x[i] @ [1, 2, 1, 3]), i))[:5]




def test_documents_of_a_group_count_as_one(spark):
    """A line counts by groups: 12 documents of one group are one; a null group is the document alone."""
    rows = [(i, "shared by copies only\nown words here", "g") for i in range(12)] + [(20 + i, f"in many texts\nelse {'abcdefghijkl'[i]} b c d", None) for i in range(10)] + [(40, "in many texts\nzz yy", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, of string")
    left = {r.doc_id: r.text for r in line_dedup.drop_lines(df, group="of").collect()}
    assert left[0] == rows[0][1] and all("in many" not in left[20 + i] for i in range(10)) and left[40] == "zz yy"
    alone = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert alone[0] == ""
