"""Near copies, passages, language, quality, mixing, hosts and the pipeline."""

import itertools
import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from kelpworks.llm import language, mixing, near_dedup, quality, substring_dedup, url_filter
from kelpworks.llm.components import components
from kelpworks.llm.shared import row_key
from pyspark.sql import functions as F


def docs(spark, texts, extra="1 as extra"):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", *extra.split(";"))


def base(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_near_query_agrees_with_brute_force(spark, sf_dir):
    texts = base(spark, sf_dir)
    wanted, size = brute.near(texts, 2), {d: len(brute.shingles(t, 2)) for d, t in texts}
    assert len(set(wanted.values())) < len(wanted)
    for r in near_dedup.op7_near_dedup(spark, sf_dir).collect():
        assert (r.component_id, r.n_shingles, r.kept) == (wanted[r.doc_id], size[r.doc_id], wanted[r.doc_id] == r.doc_id)


def test_near_groups_of_a_star_a_chain_and_odd_rows(spark):
    rng = random.Random(5)
    core = prose(rng, 300)

    def changed(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = f"z{rng.randrange(10**9)}"
        return out

    texts = [" ".join(changed(core, 16)) for _ in range(40)] + [" ".join(core)]  # copies are further from each other than from the core
    chain = [prose(rng, 200)]
    for _ in range(6):
        chain.append(changed(chain[-1], 8))
    texts += [" ".join(x) for x in chain] + [None, "", "one", "ONE", "one", "two words", "x " * 5000]
    wanted = brute.near(list(enumerate(texts)), 2)
    df = docs(spark, texts, "1 as s1;'x' as node").unionByName(docs(spark, texts, "1 as s1;'x' as node").where("doc_id in (0, 43)"))
    found = near_dedup.near_groups(df, size=2).collect()
    assert {r.id: r.component for r in found} == wanted and len(found) == len(texts) + 2
    kept = near_dedup.drop_near(df, size=2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values())) and kept.columns == df.columns
    assert near_dedup.near_groups(df.limit(0)).count() == 0


def test_rows_without_an_id_follow_their_group(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e f"), (None, "quite another text here now")], "doc_id long, text string")
    found = {(r.id, r.component) for r in near_dedup.near_groups(df).collect()}
    assert found == {(None, 3), (3, 3), (None, None)}


@pytest.mark.parametrize("size", [2, 5])
def test_native_near_groups_agree_with_brute_force(spark, size):
    """Sets below and above FEW and at its border, links of every size from one changed word to the threshold, odd rows."""
    rng = random.Random(size)
    texts = [None, "", " \t", "one", "ONE", "two words", "a b c d e", "A b C\x0bd e", "Ä b c d e", "ä b c d e", "x " * 3_000]
    for n in (8, 40, 120, 150, 160, 185, 190, 400, 900):
        core = prose(rng, n)
        for changes in (0, 1, n // 60, n // 55, n // 50, n // 45, n // 20, n // 10):
            out = list(core)
            for i in rng.sample(range(n), changes):
                out[i] = f"z{rng.randrange(10**9)}"
            texts.append(" ".join(out).upper() if changes == 1 else " ".join(out))
    chain = [prose(rng, 200)]
    for _ in range(6):
        chain.append(list(chain[-1]))
        for i in rng.sample(range(200), 3):
            chain[-1][i] = f"z{rng.randrange(10**9)}"
    texts += [" ".join(x) for x in chain]
    wanted = brute.near(list(enumerate(texts)), size)
    found = near_dedup.near_groups(docs(spark, texts), size=size, native=True).collect()
    assert {r.id: r.component for r in found} == wanted and len(found) == len(texts)
    assert {r.id: r.n for r in found} == {i: len(brute.shingles(t, size)) for i, t in enumerate(texts)}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    every = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = every[:2000], every[500:2500]
    x, y = near_dedup.registers_of(a), near_dedup.registers_of(b)
    assert (near_dedup.merged(x, y) == near_dedup.registers_of(np.unique(np.concatenate([a, b])))).all()
    assert abs(near_dedup.likeliest(x[None], y[None], np.array([2000.0]), np.array([2000.0]))[0] - 0.6) < 0.12


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 150), (None, 1)], "a long, b long")
    found = {r.node: r.label for r in components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 150: 150, 200: 150}


def test_every_passage_over_fifty_words_is_found(spark, sf_dir):
    texts = {d: brute.lower(t).split() for d, t in base(spark, sf_dir)}
    held = {}
    for d, w in texts.items():
        for i in range(len(w) - 50):
            held.setdefault(tuple(w[i : i + 51]), set()).add(d)
    wanted = {d for s in held.values() if len(s) > 1 for d in s}
    rows = substring_dedup.op5_substring_dedup(spark, sf_dir).collect()
    assert wanted and wanted <= {r.doc_id for r in rows} | {r.other_id for r in rows}
    for r in rows:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.other_id][r.other_start : r.other_end]
        same = sum(n for _, _, n in __import__("difflib").SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert min(len(a), len(b)) >= 50 and r.other_id < r.doc_id and same >= r.matched >= 0.8 * max(len(a), len(b)) - 1


def test_common_words_of_stretches_and_copies_counted_after_their_join(spark):
    def plainly(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
        best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
        for i, x in enumerate(u):
            for j, y in enumerate(v):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        i, j, out = len(u), len(v), []
        while i and j:
            if u[i - 1] == v[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return [x for x, _ in out[::-1]], [y for _, y in out[::-1]]

    rng = np.random.default_rng(5)
    for _ in range(300):
        u, v = rng.integers(0, 12, rng.integers(0, 40)), rng.integers(0, rng.integers(1, 12), rng.integers(0, 90))
        words = set(u.tolist()) & set(v.tolist())  # words of one side only take no part
        own, other = ([n for n, w in enumerate(x.tolist()) if w in words] for x in (u, v))
        at, to = plainly([int(u[n]) for n in own], [int(v[n]) for n in other])
        assert [x.tolist() for x in substring_dedup.matched_in(u, v)] == [[own[n] for n in at], [other[n] for n in to]]

    text = " ".join(f"w{n}" for n in range(60))
    found = substring_dedup.find_passages(docs(spark, [text, text, "few words", "few words", "other"]))
    assert [tuple(r)[2:] for r in found.collect()] == [(0, 60, 0, 60, 60, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :].split("\n", 1)[1]
    assert "split(" in plan and "split(" not in below, "words are counted for every text, not for copies only"



def test_passages_of_planted_texts(spark):
    rng = random.Random(3)
    p = prose(rng, 90)
    fuzzy = [w if i % 15 else "other" for i, w in enumerate(p)]
    gap = p[:40] + ["in", "between"] + p[40:]
    short = prose(rng, 49)
    around = lambda x: " ".join(prose(rng, 70) + x + prose(rng, 70))
    texts = [around(p), around(fuzzy), around(gap), around(short), around(short), around(prose(rng, 50)), None, "", "das " * 300, " ".join(p), " ".join(p)]
    rows = substring_dedup.find_passages(docs(spark, texts, "1 as id;2 as n")).collect()
    assert {r.doc_id for r in rows} | {r.other_id for r in rows} == {0, 1, 2, 9, 10}
    assert {(r.doc_id, r.other_id) for r in rows if r["copy"]} == {(10, 9)}
    whole = next(r for r in rows if r.doc_id == 2)
    assert whole.start == 70 and whole.end == 162 and whole.matched == 90
    assert substring_dedup.find_passages(docs(spark, texts).limit(0)).count() == 0


def test_a_smaller_document_that_holds_a_seed_hides_no_passage(spark):
    """The smallest document holds all seeds of a passage of two others, but only 40 of its words."""
    rng = random.Random(11)
    seeds = lambda w: {v for size in (substring_dedup.LONG, substring_dedup.SHORT) for v in substring_dedup.seeds_of(substring_dedup.hashes_of(" ".join(w).encode()), *size)[0].tolist()}
    for _ in range(1000):
        p = prose(rng, 51)
        at = rng.randrange(12)
        a, b, c = prose(rng, 60) + p[at : at + 40] + prose(rng, 60), prose(rng, 60) + p + prose(rng, 60), prose(rng, 60) + p + prose(rng, 60)
        if (both := seeds(b) & seeds(c)) and both <= seeds(a):
            break
    assert both <= seeds(a)
    rows = substring_dedup.find_passages(docs(spark, [" ".join(x) for x in (a, b, c)])).collect()
    assert [(r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end, r.matched) for r in rows] == [(2, 1, 60, 111, 60, 111, 51)]


def passages(spark, texts):
    return substring_dedup.find_passages(docs(spark, texts, "1 as id;2 as seed;3 as other;'x' as start")).collect()


def test_pairs_with_a_smaller_holder_of_most_of_their_passage_are_all_found(spark):
    """52 exact words in two documents, of which a third, smaller one holds 47."""
    rng = random.Random(21)
    planted = [prose(rng, 52) for _ in range(30)]
    around = lambda x: " ".join(prose(rng, 60) + x + prose(rng, 60))
    texts = [around(p[2:49]) for p in planted] + [around(p) for p in planted for _ in range(2)]
    found = {(r.other_id, r.doc_id, r.start, r.end, r.matched) for r in passages(spark, texts)}
    assert found == {(i, i + 1, 60, 112, 52) for i in range(30, 90, 2)}


@pytest.mark.parametrize("quoted", [False, True])
def test_passages_with_changed_words_are_found_nine_times_in_ten(spark, quoted):
    """120 words of which every 12th differs, alone and with smaller documents that quote the runs between."""
    rng = random.Random(22)
    planted = [prose(rng, 120) for _ in range(40)]
    around = lambda x: " ".join(prose(rng, 90) + x + prose(rng, 90))
    texts = [around(p[a : a + 11]) for p in planted for a in range(0, 120, 12)] if quoted else []
    pairs = {(len(texts) + 2 * i, len(texts) + 2 * i + 1) for i in range(40)}
    for p in planted:
        texts += [around(p), around([w if (i + 1) % 12 else f"z{rng.randrange(10**9)}" for i, w in enumerate(p)])]
    found = {(r.other_id, r.doc_id) for r in passages(spark, texts)}
    assert len(found & pairs) >= 36 and found <= pairs


def test_repeats_within_a_document_and_rows_of_one_id(spark):
    rng = random.Random(23)
    p, q = prose(rng, 80), prose(rng, 70)
    texts = [" ".join(prose(rng, 30) + p + prose(rng, 40) + p + prose(rng, 9)), " ".join(prose(rng, 10) + q + prose(rng, 10)), " ".join(q + prose(rng, 60) + q), "das " * 300, "x " * 30_000]
    df = docs(spark, texts)
    rows = [tuple(r) for r in substring_dedup.find_passages(df.unionByName(df.where("doc_id < 2"))).collect()]
    assert sorted(rows) == [(0, 0, 150, 230, 30, 110, 80, False), (2, 1, 0, 70, 10, 80, 70, False), (2, 1, 130, 200, 10, 80, 70, False), (2, 2, 130, 200, 0, 70, 70, False)]
    both = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[0]), (2, texts[1])], "doc_id long, text string")
    one = [sorted(tuple(r) for r in substring_dedup.find_passages(x).collect()) for x in (both, both.orderBy(F.desc("text")))]
    assert one[0] == one[1] and {r[:2] for r in one[0] if r[0] != r[1]} == {(2, 1)}


@pytest.mark.parametrize(("words", "kind", "share", "least"), [(60, "change", 0.10, 54), (60, "change", 0.15, 50), (100, "change", 0.15, 54), (80, "each tenth goes", 0, 54), (80, "change, insert, delete", 0.10, 54)])
def test_passages_with_random_changes_are_found(spark, words, kind, share, least):
    """60 planted pairs, 90 random words on either side; a few draws have more changes than a passage may have."""
    r, rows, pairs = random.Random(f"{words}{kind}{share}"), [], set()
    for n in range(60):
        pick = lambda n=n: f"n{n}w{r.randrange(3000)}"
        passage, other = [pick() for _ in range(words)], []
        for at, w in enumerate(passage, 1):
            what = r.choice(kind.split(", ")) if r.random() < share else "delete" if kind == "each tenth goes" and at % 10 == 0 else "keep"
            other += {"keep": [w], "change": [pick()], "insert": [pick(), w], "delete": []}[what]
        around = lambda x, pick=pick: " ".join([*(pick() for _ in range(90)), *x, *(pick() for _ in range(90))])
        rows += [(2 * n, around(passage)), (2 * n + 1, around(other))]
        pairs.add((2 * n + 1, 2 * n))
    found = {(x.doc_id, x.other_id) for x in substring_dedup.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= pairs and len(found) >= least


def test_columns_go_once_through_both_sides():
    """Whatever the chain, a seed that ends before the one ahead of it included: each word has its column, in order."""
    r = np.random.default_rng(7)
    for _ in range(200):
        a, b = r.integers(1, 6, int(r.integers(30, 80))), r.integers(1, 6, int(r.integers(30, 80)))
        i, j = np.sort(r.choice(20, 3, False)), np.sort(r.choice(20, 3, False))
        k = r.integers(1, 9, 3)
        for x, y, n in zip(i, j, k, strict=True):
            b[y : y + n] = a[x : x + n]
        left, right, same = substring_dedup.aligned(a, b, i, j, k)
        assert (np.diff(left) >= 0).all() and (np.diff(right) >= 0).all() and (np.diff(left) + np.diff(right) > 0).all()
        assert left.min() >= 0 and left.max() < len(a) and right.max() < len(b) and (a[left[same]] == b[right[same]]).all()


def test_stretches_are_the_best_of_all(monkeypatch):
    """Against every pair of ends: the best stretch has enough words on both sides, begins and ends with two matches."""
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 40))
        same, step = r.random(n) < r.choice([0.5, 0.8, 0.95]), r.integers(0, 3, n)
        left, right = np.cumsum(step != 1), np.cumsum(step != 2)
        gain = np.where(same, 1.0, -4.0)
        fit = [(gain[x : y + 1].sum(), x, y + 1) for x in range(n) for y in range(x, n) if same[x : x + 2].all() and same[y - 1 : y + 1].all() and min(left[y] - left[x], right[y] - right[x]) >= 7]
        best = max((g for g, _, _ in fit if g >= 0), default=None)
        found = substring_dedup.passages_of(left, right, same, 8, 0.8)
        assert bool(found) == (best is not None) and (not found or np.isclose(gain[slice(*found[0])].sum(), best))
        assert all(same[x] and same[y - 1] and same[x:y].mean() >= 0.8 - 1e-9 for x, y in found)


def test_best_chain_is_the_best_of_all():
    rng = random.Random(8)
    for _ in range(30):
        m = [(rng.randrange(60), rng.randrange(60), 3) for _ in range(7)]
        i, j, k = (np.array(c) for c in zip(*m, strict=True))
        best = 0.0
        for n in range(1, 8):
            for c in itertools.combinations(sorted(range(7), key=lambda x: m[x]), n):
                if all(m[a][0] < m[b][0] and m[a][1] < m[b][1] for a, b in itertools.pairwise(c)):
                    best = max(best, score(m, c))
        got = max(score(m, c.tolist()) for c in substring_dedup.chains_of(i, j, k))
        assert got >= best - 1.5  # overlapping matches are scored after the best predecessor is taken


def score(m, c):
    total = float(m[c[0]][2])
    for a, b in itertools.pairwise(c):
        x, y = m[b][0] - m[a][0], m[b][1] - m[a][1]
        total += min(m[b][2], x, y) - substring_dedup.GAP * (x + y)
    return total


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op6_language(spark, d).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures_and_odd_texts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(table)
    en, de = ("\n".join(r.text for r in table.where(f"lang = '{k}' and n_chars < 2000").limit(8).collect())[:4000] for k in ("en", "de"))
    rows = language.predict(docs(spark, [en + de, en, None, "", "12 !?", "a" * 100_000], "'x' as lang_pred;1 as n"), *model).orderBy("doc_id").collect()
    assert set(rows[0].mixture) == {"en", "de"} and abs(rows[0].mixture["en"] - 0.5) < 0.15 and rows[1].lang_pred == "en" and len(rows[1].mixture) == 1
    assert [(r.lang_pred, r.score) for r in rows[2:5]] == [("und", 0.0)] * 3 and rows[5].lang_pred in model[0]
    nothing = language.train(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(docs(spark, ["a"]), *nothing).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality.op10_quality(spark, d).collect()
    held = [(label[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in label]
    won = [(a > b) + 0.5 * (a == b) for x, a, _ in held if x == 1 for y, b, _ in held if y == 0]
    assert sum(won) / len(won) > 0.95 and sum(x == p for x, _, p in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_texts_and_without_labels(spark):
    odd = docs(spark, [None, "", "\n", "ü" * 50_000, "a b " * 20_000], "0.5D as score;1 as x")
    labels = spark.createDataFrame([(0, 1, None), (3, 0, 1), (4, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(odd, quality.train(odd, labels)).where("score between 0 and 1").count() == 5
    assert quality.train(odd, labels.where("quality = 1")) is None and quality.train(odd.limit(0), labels) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5} and quality.score(odd.limit(0), None).count() == 0
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_mixing_meets_its_targets(spark):
    rows = mixing.op8_mixing(spark, "/root/testdata/sf0.01").toPandas()
    n = rows["tokens"].sum()
    for d, share in mixing.TARGETS.items():
        assert abs((rows["tokens"] * rows["rate"] * rows[f"p_{d}"]).sum() / n - share) < 0.01
    assert (rows["rate"] >= 0).all() and (abs(rows["copies"] - rows["rate"]) < 1).all()
    assert np.allclose(rows[[f"p_{d}" for d in mixing.TARGETS]].sum(axis=1), 1, atol=1e-4)


def test_mixing_of_odd_rows(spark):
    odd = docs(spark, [None, "", "good words here", "bad trash", "bad trash", "x" * 50_000], "'k' as domain;1 as k1")
    labels = spark.createDataFrame([(2, "good"), (3, "low"), (3, "low"), (None, "low"), (4, None)], "doc_id long, domain string")
    out = mixing.mix(odd, labels)
    assert out.columns == ["doc_id", "text", "k1", "domain", "rate", "copy"] and {r.doc_id: r.rate for r in out.collect()}[0] == 1.0
    assert mixing.mix(odd, labels.limit(0)).count() >= 4 and mixing.mix(odd.limit(0), labels).count() == 0


def test_posteriors_agree_with_naive_bayes_in_plain_python(spark, sf_dir):
    """The fitted weights and priors applied to each text's buckets; telling words tell, and columns keep their names and values."""
    table, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    priors, weights = mixing.bucket_weights(table, labels)
    rows = table.select("doc_id", "text", mixing.terms_of(mixing.words_of(F.col("text")), F.col("text")).alias("terms"))
    terms = {r.doc_id: r.terms for r in rows.select("doc_id", "terms").collect()}
    names = sorted(mixing.TARGETS)
    for r in mixing.with_posteriors(rows.select("doc_id", "text"), priors, weights, names).collect():
        raw = np.array([priors.get(d, -np.inf) + sum(weights[d][b] for b in terms[r.doc_id]) if d in priors else -np.inf for d in names])
        e = np.exp(raw - raw.max())
        assert np.allclose(r.posterior, e / e.sum(), atol=1e-9) and len(set(terms[r.doc_id])) == len(terms[r.doc_id])
    out = mixing.mix(docs(spark, ["good words here", "bad"], "'a' as tokens;'b' as posterior;'c' as row;'d' as n;'e' as w"), labels.limit(0))
    assert out.columns == ["doc_id", "text", "tokens", "posterior", "row", "n", "w", "domain", "rate", "copy"]
    assert {(r.tokens, r.posterior, r.row, r.n, r.w) for r in out.collect()} == {("a", "b", "c", "d", "e")}


def test_rates_are_the_least_squares_solution(spark):
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet((0.4, 0.4, 0.4), 12), rng.integers(1, 50, 12).astype(float)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    names, want = ["a", "b", "c"], {"a": 0.7, "b": 0.2, "c": 0.1}
    rate, start, _ = mixing.fit_rates(df, want, names, steps=300, ridge=0.05)
    got = np.array([r[0] for r in df.select(rate).collect()])
    w, target = t / t.sum(), np.array(list(want.values()))
    loss = lambda r: (((w * r) @ p - target) ** 2 / (2 * np.array(start))).sum() + 0.025 * (w * (r - 1) ** 2).sum()
    r = np.ones(12)
    for _ in range(20_000):  # plain projected gradient in the documents' own metric
        r = np.maximum(0, r - 2.0 * (w * (p @ (((w * r) @ p - target) / np.array(start))) + 0.05 * w * (r - 1)))
    assert loss(got) <= loss(r) + 1e-6


def test_rates_of_flat_posteriors_reach_the_targets(spark):
    """Steps move the shares by little where posteriors are near the prior; that is no reason to stop."""
    df = spark.createDataFrame([(10, [0.65, 0.35]), (10, [0.35, 0.65])], "tokens long, posterior array<double>")
    _, _, now = mixing.fit_rates(df, {"a": 0.52, "b": 0.48}, ["a", "b"], steps=200, ridge=0.0)
    assert abs(now[0] - 0.52) < 6e-5


def test_url_rules_and_parts(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in url_filter.op9_url_filter(spark, sf_dir).collect():
        rest = (urls[r.page_id] or "").partition("://")[2]
        host = rest.split("#")[0].split("?")[0].split("/")[0]
        path = rest[len(host) :].split("#")[0].split("?")[0]
        fit = [x for x in url_filter.RULES if (brute.lower(host) + "/").endswith(x.partition("/")[0] + "/") and ("." + brute.lower(host)).endswith("." + x.partition("/")[0]) and path.startswith("/" + x.partition("/")[2])]
        rule = max(fit, key=len) if fit else None
        assert (r.host, r.path, r.rule) == (brute.lower(host), path, rule) and (rule is None or r.verdict == url_filter.RULES[rule]) and r.verdict in ("allow", "block")


def test_trust_spreads_along_links_and_distrust_against(spark):
    link = lambda h: f'<a href="https://{h}/x">'
    pages = [(1, "http://good.net/de/", link("friend.aa") * 3), (2, "http://friend.aa/1", '<a href="/own">'), (3, "http://Linker.bb/1?x", link("bad.com")), (4, "http://bad.com/en/1", ""), (5, "http://alone.cc", None), (6, None, None), (7, "no scheme", ""), (8, "x://", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df.unionByName(df.where("page_id = 3")), url_filter.RULES).collect()}
    assert found[2] == ("friend.aa", "/1", None, "allow") and found[3] == ("linker.bb", "/1", None, "block") and found[4][3] == "block"
    assert [found[i] for i in (5, 6, 7, 8)] == [("alone.cc", "", None, "allow")] + [("", "", None, "allow")] * 3
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0


def test_ranks_agree_with_a_dense_iteration(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(0, 3, (6, 6))
    links = spark.createDataFrame([(f"h{a}", f"h{b}", int(n[a, b])) for a in range(6) for b in range(6)], "a string, b string, n long")
    seeds = spark.createDataFrame([("h0", 3, 0), ("h1", 1, 2), ("h5", 0, 4)], "host string, good long, bad long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread(links, seeds, close=1e-7, most=80).collect()}
    for side, m, s in ((0, n, [3, 1, 0, 0, 0, 0]), (1, n.T, [0, 2, 0, 0, 0, 4])):
        m = m.astype(float)
        m[np.diag_indices(6)] += m.sum(1) == 0
        m /= m.sum(1, keepdims=True)
        s = np.array(s) / sum(s)
        r = s
        for _ in range(300):
            r = 0.15 * s + 0.85 * r @ m
        assert np.allclose([got[f"h{i}"][side] for i in range(6)], r, atol=1e-3)


def test_small_and_far_hosts_get_converged_ranks(spark):
    """A host fed by one of 10,001 seed pages and a chain of 44 hosts: each rank, and the verdict it gives, is the solved one."""
    edges = [("big", "big", 50), ("big", "x", 1), ("x", "big", 1), ("mid", "tiny", 1), ("mid", "mid", 3)] + [(f"c{i:02}", f"c{i + 1:02}", 1) for i in range(44)] + [("c44", "tiny", 1), ("x", "c20", 1)]
    links = spark.createDataFrame(edges, "a string, b string, n long")
    seeds = spark.createDataFrame([("big", 10_000, 10_000), ("tiny", 0, 1), ("c05", 1, 0)], "host string, good long, bad long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread(links, seeds).collect()}
    hosts = sorted(got)
    n = np.zeros((len(hosts), len(hosts)))
    for a, b, k in edges:
        n[hosts.index(a), hosts.index(b)] += k
    solved = []
    for m, s in ((n.copy(), {"big": 10_000, "c05": 1}), (n.T.copy(), {"big": 10_000, "tiny": 1})):
        m[np.diag_indices(len(hosts))] += m.sum(1) == 0
        m /= m.sum(1, keepdims=True)
        s = np.array([s.get(h, 0) for h in hosts]) / sum(s.values())
        solved.append(np.linalg.solve(np.eye(len(hosts)) - 0.85 * m.T, 0.15 * s))
    for i, h in enumerate(hosts):
        assert np.allclose(got[h], (solved[0][i], solved[1][i]), rtol=1e-4, atol=0), h
        assert (got[h][1] > got[h][0]) == (solved[1][i] > solved[0][i])
    assert got["c00"][1] > got["c00"][0] == 0 and got["mid"][1] > got["mid"][0] == 0


def test_pipeline_stages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = stage(spark, out, sf_dir)
        assert out.columns == table.columns, name
        kept = out.select("doc_id").distinct().count()
        assert 0.8 * before.count() <= kept == out.count()
    texts = [tuple(r) for r in out.select("doc_id", "text").collect()]
    assert len(set(brute.near(texts, 5).values())) == len(texts)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(x[3] for x in brute.contamination(texts, items).values())
    assert out.where(F.length("text") != F.col("n_chars")).isEmpty()


def test_pipeline_cleans_boilerplate_and_keeps_one_copy(spark, sf_dir):
    """Texts of common lines are cleaned though most of each recurs; near copies stay whole until one of them is kept."""
    common = [f"common boilerplate line number {c} of every page here" for c in ("one", "two", "three", "four", "five", "six")]
    texts = ["\n".join([*common, " ".join(f"own{w}x{i:02}" for w in "abcdefgh")]) for i in range(40)]
    body = [" ".join(f"copied{w}{n}" for w in "abcdefghijkl") for n in "pqrstuvwxyz"]
    texts += ["\n".join([*body, f"ending{c}"]) for c in "abcdefghijklmno"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    cleaned = stages["line dedup"](spark, docs, sf_dir)
    left = {r.doc_id: r.text for r in cleaned.collect()}
    assert all("common" not in left[i] and "own" in left[i] for i in range(40))
    assert all(left[i] == texts[i] for i in range(40, 55))
    assert {r.doc_id for r in stages["near dedup"](spark, cleaned, sf_dir).collect()} == {*range(41)}


def test_line_stage_runs_no_python_and_clears_its_tables(spark, sf_dir, monkeypatch):
    """Groups of copies are found by built-in functions; of its tables, only those that the result reads are left."""
    import pathlib

    monkeypatch.setattr(near_dedup, "sketch", None)
    monkeypatch.setattr(near_dedup, "likeliest", None)
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.glob("kelpworks-*"))
    texts = ["\n".join([*(f"copied line {w} of this text alone" for w in "abcdefghijklmnop"), f"ending {'abcdefghijkl'[i]}"]) for i in range(12)]
    texts += [f"some text {w} of its own\nshare this page with all" for w in "abcdefghijkl"] + [None]
    rows = spark.createDataFrame([(None if i == 3 else i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, rows, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((r.doc_id, r.text.replace("\nshare this page with all", "") if r.text else None) for r in rows.collect()), key=str)
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.glob("kelpworks-*")) - before} == {"kelpworks-groups-of-rows", "kelpworks-drops"}


def test_pipeline_of_odd_rows(spark, sf_dir):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", None, 15), (4, "some words here", "en", "s", 15), (4, "some words here", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
        df.collect()


def test_row_keys_of_equal_rows_are_equal(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (1, None)], "i long, t string")
    assert df.select(*row_key(F.col("i"), F.col("t"))).distinct().count() == 3


@pytest.mark.parametrize("name", ["op1_pii", "op3_line_dedup", "op8_mixing"])
def test_native_operators_run_no_python(spark, sf_dir, name):
    from kelpworks.llm import registry

    text = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
