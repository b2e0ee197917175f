"""BPE, conversation repair and source divergence: the library's ids, brute force on tables, odd and random cases."""

import hashlib
import random

import brute_new
import public_tokenizers
import pytest
from kelpworks.llm import bpe, divergence, registry, turns
from oracle import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "e", "t", " ", "  ", "\n", "1", "23", "é", "ß", "漢", "😀", "'s", "'re", "the", "ing", "!", "..", "\t", "\x85", "　", "<|endoftext|>", "<|endof", "A", "aaaa", "====", "\x00", "\x1c", "​"]
ODD = [None, "", " ", "\n" * 5_000, "a" * 50_000, "word " * 20_000, "9" * 20_000, " é" * 10_000, "\U0001f600‍", "x<|endoftext|>y", "<|endoftext|>" * 3, "�"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_of_random_texts_are_the_librarys(vocabulary, library):
    r = random.Random(11)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(3_000)]
    texts += ["".join(chr(r.choice([r.randint(0, 0x7F), r.randint(0x80, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(25)) for _ in range(1_500)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert vocabulary.encoder.encode(text).tolist() == found.ids, repr(text)


def test_every_code_point_is_in_the_librarys_class(vocabulary, library):
    for c in range(0, 0x20000, 7):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1 {chr(c)}b"
            assert vocabulary.encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_a_words_ids_do_not_depend_on_what_is_remembered(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    encoder = bpe.Encoder(vocabulary)
    for text in ("abracadabra " * 5 + "unquestionably", "x" * 100 + " internationalisation"):
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder) <= 3


def test_encoding_of_odd_texts_there_and_back(spark, vocabulary, library):
    df = spark.createDataFrame([(i % 9, t) for i, t in enumerate(ODD + ODD)], "doc_id long, text string").selectExpr("*", "'old' as ids", "1 as decoded")
    back = bpe.decode(bpe.encode(df, vocabulary), vocabulary, text="decoded").collect()
    assert len(back) == 2 * len(ODD)
    for r in back:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode(df.limit(0), vocabulary).count() == 0


def test_decoding_of_odd_ids(spark, vocabulary, library):
    lists = [[464, 220, 50256], None, [], [None, 464], [-1, 70_000, 464], [158, 120], [13945, 110, 32]]
    got = [r.text for r in bpe.decode(spark.createDataFrame(list(enumerate(lists)), "k int, ids array<int>"), vocabulary).orderBy("k").collect()]
    known = [[i for i in x or [] if i is not None and 0 <= i < 50257] for x in lists]
    assert got == [library.decode(x, skip_special_tokens=False) for x in known]


def test_other_kinds_of_tokenizers_are_refused(vocabulary):
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_query_agrees_with_the_library(spark, sf_dir, library):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = registry.queries()["op11_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        wanted = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *wanted)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(spark, rows, **columns):
    df = turns.repair(conversations(spark, rows).withColumns({k: F.lit(v) for k, v in columns.items()}))
    out = {r.conv_id: tuple(r[1:]) for r in df.collect()}
    assert len(out) == df.count()
    return out


@pytest.mark.parametrize("name", ["op12_repair", "op13_divergence"])
def test_query_agrees_with_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_repair_query_agrees_with_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[1:]) for r in turns.op12_repair(spark, sf_dir).collect()}
    assert got == brute_new.op12(rows)


def test_repair_of_random_conversations(spark):
    r = random.Random(12)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Hi.", "Hi.", "So what", "", " \n", "Yes!", "ok?", "…", None, "a. "]
    rows = []
    for conv in range(150):
        size = r.choice([0, 1, 2, 4, 8, 14])
        rows += [(conv, r.choice([None, k, k, 3, -k, 10 * k]), r.choice(roles[: r.choice([2, 3, 6])]), r.choice(texts)) for k in range(size)]
    wanted = {}
    for conv in {x[0] for x in rows}:
        wanted[conv] = brute_new.repaired([(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv])
    assert found(spark, rows, audit="x", cost=1, block=2, fault="y") == wanted


def test_long_conversations_are_folded_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    rows = [(conv, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Go on.", "So.", "hm", "", f"T{t}."])) for conv in range(12) for t in range(0, 40, r.choice([1, 3]))]
    rows += [(None, t, "user", f"N{t}.") for t in range(30)] + [(None, None, "assistant", "N1.")]
    wanted = {c: brute_new.repaired([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}
    for block in (2, 7, 256):
        monkeypatch.setattr(turns, "BLOCK", block)
        assert found(spark, rows) == wanted


def test_repair_of_nothing(spark, tmp_path):
    assert turns.repair(conversations(spark, []).limit(0)).count() == 0
    rows = [(1, t, "user", "x") for t in range(3)] + [(2, None, None, None), (None, 1, "user", "a"), (7, 5, "system", "z.")]
    conversations(spark, rows + rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[1:]) for r in turns.op12_repair(spark, str(tmp_path)).collect()}
    assert got == brute_new.op12(rows + rows)


def test_repair_uses_no_python(spark, sf_dir):
    plan = turns.op12_repair(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def groups(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")


def test_divergence_of_random_groups(spark, monkeypatch):
    r = random.Random(13)
    words = ["alpha", "Beta", "gamma's", "délta", "x1y", "É", "ÉÉ", "漢字", "tie", "TIE2", *(f"w{c}" for c in "abcdef")]
    rows = []
    for _ in range(160):
        n = r.choice([0, 1, 5, 30])
        rows.append((r.choice([None, "", "12 - 3"]) if not n else " ".join(r.choice(words) for _ in range(n)), r.choice(["en", "de", "", None]), r.choice(["a", "b", "é", "B", None])))
    rows += [(None, "empty", "a"), ("", "empty", "b"), ("rare words only", "few", "z"), *[("hot " * 50, "en", "a")] * 40]
    wanted = brute_new.op13(rows)
    df = groups(spark, rows).selectExpr("*", "1 as term", "'x' as item", "2 as value", "3 as rank", "4 as n")
    for batch, pairs in ((3_000_000, 500_000), (20, 3)):
        monkeypatch.setattr(divergence, "BATCH", batch)
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        got = [tuple(x) for x in divergence.audit(df).collect()]
        assert set(got) == wanted and len(got) == len(wanted)


def test_divergence_of_nothing_and_of_long_texts(spark):
    assert divergence.audit(groups(spark, [("a", "b", "c")]).limit(0)).count() == 0
    rows = [("ab " * 30_000 + "q" * 50_000, "en", s) for s in "xy" for _ in range(5)]
    assert {tuple(r) for r in divergence.audit(groups(spark, rows)).collect()} == brute_new.op13(rows)


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.share(F.lit(10**13), F.lit(3 * 10**13), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)
