"""Outside calls with failing batches and a cache, references to earlier messages, scopes of a table of questions."""

import random

import pytest
from kelpworks.operators import calls, history, scopes
from pyspark.sql import functions as F

LOG = "calls.log"


def judge_at(path):
    def judge(requests):
        with open(f"{path}/{LOG}", "a") as log:
            log.write("\x1f".join(requests) + "\n")
        if any(r.startswith("bad") for r in requests):
            raise RuntimeError("rejected")
        return [r.upper() for r in requests]

    return judge


def test_a_failing_batch_is_halved_until_single_requests_fail():
    seen = []

    def judge(requests):
        seen.append(list(requests))
        if "x" in requests:
            raise RuntimeError("no")
        return requests

    out = calls.asked_in_halves(judge, list("abcdexfg"))
    assert [a for a, _, _ in out] == [*"abcde", None, *"fg"] and [e for _, e, _ in out].count("RuntimeError: no") == 1
    assert len(seen) <= 2 * 3 + 1 and max(n for _, _, n in out) == 4
    assert calls.asked_in_halves(judge, []) == [] and calls.asked_in_halves(judge, ["x"])[0][1] == "RuntimeError: no"
    assert calls.asked_in_halves(lambda r: r[:1], ["a", "b"]) == [("a", None, 2), ("b", None, 2)]


@pytest.fixture
def requests(spark):
    rows = [(i, f"r{i % 40}" if i % 9 else f"bad{i % 5}") for i in range(120)] + [(500, None), (501, "")]
    return spark.createDataFrame(rows, "id int, request string").withColumns({"answer": F.lit("old"), "error": F.lit(1)})


def test_no_request_is_asked_twice_and_failures_are_rows(spark, requests, tmp_path):
    cache = calls.AnswerCache(spark, f"{tmp_path}/cache")
    judge = judge_at(tmp_path)
    run = lambda: calls.answered(requests, F.col("request"), judge, cache, fallback=F.concat(F.lit("local "), "request"), batch=4).collect()
    got = run()
    for r in got:
        bad = r.request is None or r.request.startswith("bad")
        assert r.answer == ((None if r.request is None else f"local {r.request}") if bad else r.request.upper())
        assert (r.error is not None) == (bad and r.request is not None) and r.fell_back == bad
    asked = [x for line in open(f"{tmp_path}/{LOG}") for x in line.rstrip("\n").split("\x1f")]
    distinct = {r.request for r in got} - {None}
    single = [x for line in open(f"{tmp_path}/{LOG}") if "\x1f" not in line for x in [line.rstrip("\n")]]
    assert set(asked) == distinct and all(single.count(x) == 1 for x in distinct if x.startswith("bad"))
    before = open(f"{tmp_path}/{LOG}").read()
    assert len(run()) == len(got) and calls.answered(requests, F.col("request"), judge, calls.AnswerCache(spark, f"{tmp_path}/cache")).count() == len(got)
    assert open(f"{tmp_path}/{LOG}").read() == before


def test_waves_are_kept_when_a_later_one_breaks(spark, tmp_path):
    table = spark.range(60).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("q"), "id").alias("request"))
    cache = calls.AnswerCache(spark, f"{tmp_path}/cache")

    def dies(requests):
        import os

        if os.path.exists(f"{tmp_path}/fine"):
            return [r.upper() for r in requests]
        if "q7" in requests:
            raise SystemExit  # not the row's failure: the task's
        return [r.upper() for r in requests]

    with pytest.raises(Exception):  # noqa: B017, PT011
        cache.add(table, dies, batch=1, wave=15)
    kept = cache.read().count()
    (tmp_path / "fine").touch()
    cache.add(table, dies, batch=1, wave=15)
    rows = cache.read().collect()
    assert kept < 60 and len(rows) == 60 and all(r.answer == "Q" + r.key[1:] and r.calls == 1 for r in rows)


def test_scores_of_verdicts_and_prompts(spark):
    texts = ['{"verdicts": [{"verdict": "yes"}, {"verdict": "No"}, {"verdict": "YES"}]}', '{"verdicts": []}', "nonsense", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string").orderBy("i")
    assert [r[0] for r in df.select(calls.verdict_score(F.col("a"))).collect()] == [0.666667, 1.0, None, None]
    assert spark.range(1).select(calls.prompt("Do.", F.lit(" "), F.lit("q"))).first()[0] == "Do.\n\nq"


def test_posts_that_texts_name(spark):
    texts = ["xem /posts/123?x", "LISTING_ID: 7", "căn 45 đẹp", "Căn nhà #678", "bđs 12", "tin 9", "giá 2024", "bất động sản 33 và post 44", None, "căn 123456789012345678901234567890"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(history.named_post(F.col("t"))).collect()] == [123, 7, 45, 678, 12, None, None, 33, None, None]


def looked_up(rows, own, back, fallback):
    """L11 by the loop over each message's history."""
    out = {}
    for conv, turn, role, text in rows:
        past = sorted((t, r, x) for c, t, r, x in rows if c == conv and t < turn)[::-1]
        found = own(text)
        if found is None and back(text):
            for roles in (history.USER, history.MODEL):
                found = found if found is not None else next((own(x) for _, r, x in past if r in roles and own(x) is not None), None)
            found = fallback if found is None else found
        out[conv, turn] = found
    return out


def test_posts_in_context_agree_with_a_loop(spark):
    r = random.Random(17)
    parts = ["căn này giá bao nhiêu", "xem căn {}", "cảm ơn", "bài /posts/{}", "nhà này gần trường", "liên hệ chủ nhà"]
    rows = [(c, t, r.choice(["user", "assistant", "human", "ai", "tool"]), r.choice(parts).format(r.randint(10, 99))) for c in range(20) for t in range(12)]
    import re

    own = lambda x: (lambda m: int(m.group(1)) if m else None)(re.search(r"(\d+)", x))
    back = lambda x: "này" in x or "gần" in x or "liên hệ" in x
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(x.conv_id, x.turn): x.post_id for x in history.posts_in_context(df, fallback=F.lit(5)).collect()}
    assert got == looked_up(rows, own, back, 5)


def test_scopes_agree_with_trying_each_in_turn(spark):
    r = random.Random(9)
    pick = lambda *x: r.choice([None, *x])
    rows = [(i, pick("Ba Đình", "Đống Đa"), pick(2023, 2024), pick(1, 2, 3), pick("HN-BaDinh-KH2024")) for i in range(60)]
    asked = [(100 + i, pick("Ba Đình", "Đống Đa", "Long Biên"), pick(2023, 2024, 2030), pick(1, 2, 9)) for i in range(40)]
    names = "id int, district string, plan_year int, document_id int"
    table = spark.createDataFrame(rows, names + ", dossier_code string")
    questions = scopes.with_dossier(spark.createDataFrame(asked, names))
    codes = {x.id: x.dossier_code for x in questions.collect()}
    fields = ("district", "plan_year", "document_id", "dossier_code")
    for least in (1, 4, 1_000):
        wanted = set()
        for q, *own in asked:
            have = dict(zip(fields, [*own, codes[q]], strict=True))
            tried = [(name, [x[0] for x in rows if all(have[f] is not None and x[1 + fields.index(f)] == have[f] for f in wants)]) for name, wants in scopes.PLANNING]
            name, found = next((x for x in tried if len(x[1]) >= least), max(tried, key=lambda x: len(x[1])))
            wanted |= {(q, name, n, i) for n, i in enumerate(sorted(found)[:3], 1)}
        got = scopes.scoped(table.withColumnRenamed("id", "row"), questions, "id", "row", [F.col("row")], 3, least)
        assert {tuple(x) for x in got.collect()} == wanted
