"""Heading paths against a stack, merged continuations against a loop, and rules worked out by hand."""

import random
import re

import pytest
from kelpworks.functions import text as t
from kelpworks.operators import structure
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

NAMES = ("content", "chunk_type", "page", "heading", "path", "chunker")


def one(spark, column, *values):
    return spark.range(1).select(column(*(F.lit(v) if v is not None else F.lit(None).cast("int") for v in values)).alias("x")).first().x


@pytest.mark.parametrize(
    ("args", "wanted"),
    [((3, 1, 2), "page:3,line:1-2"), ((3, 1, 1), "page:3,line:1"), ((3, 1, None), "page:3,line:1"), ((3, None, 9), "page:3"), ((None, 1, 2), "unknown")],
)
def test_locators(spark, args, wanted):
    assert one(spark, t.source_locator, *args) == wanted


def test_signatures(spark):
    assert one(spark, t.signature, "Chương I > Mục 2", 3) == "planning_hierarchy_chuong_i_muc_2_p3"
    assert one(spark, t.signature, "///", None) == "planning_hierarchy_root" and one(spark, t.signature, "", 1) == "planning_hierarchy_root_p1"
    assert len(one(spark, t.signature, "a" * 300, None)) == len("planning_hierarchy_") + 96


def test_weak_chunks_with_a_telling_word_stay(spark):
    weak = lambda s: spark.range(1).select(t.is_weak_chunk(F.lit(s)).alias("x")).first().x
    assert [weak(s) for s in ("Dự án mới", "Quyết định 12", "Điều 5", "Thu hồi", "Công trình", "chung", "12", "")] == [False] * 5 + [True] * 3


def stack(levels):
    """The reference for W6: a dict of levels, deeper ones dropped at each heading."""
    held, out = {}, []
    for i, level in enumerate(levels):
        if level:
            held = {k: v for k, v in held.items() if k < level} | {level: f"h{i}"}
        out.append(sorted(held.items()))
    return out


def test_heading_paths_are_those_of_a_stack(spark):
    r = random.Random(6)
    docs = {d: [r.choice([None, None, 1, 2, 3, 4, 5]) for _ in range(r.choice([0, 1, 3, 40]))] for d in range(60)}
    rows = [(d, i, level, f"h{i}" if level else None) for d, levels in docs.items() for i, level in enumerate(levels)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc long, n int, level int, line string").withColumn("extra", F.lit("x"))
    got = {(x.doc, x.n): [(p.level, p.text) for p in x.path] for x in structure.heading_paths(df, ["doc"], "n").collect()}
    assert got == {(d, i): p for d, levels in docs.items() for i, p in enumerate(stack(levels))}
    assert structure.heading_paths(df.limit(0), ["doc"], "n").count() == 0


def test_levels_that_open_a_heading(spark):
    lines = ["Chương II Đất", "Mục 3", "1.2 Khu A", "1. Mục con", "KẾ HOẠCH SỬ DỤNG ĐẤT", "Dự án 1.2", "a) nhỏ", "", "Điều 7", "chữ thường", "Phần IV", "2024 Dự án đất 5 ha"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    assert [r.n for r in df.orderBy("i").select(structure.heading_level(F.col("x")).alias("n")).collect()] == [1, 2, 3, None, 3, None, None, None, 3, None, 1, None]


def flat(s):
    return re.sub(r"\s+", " ", s.lower()).strip()


def clean(s):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", (s or "").replace("\0", ""))).strip()


def tabular(s):
    lines = [x for x in s.split("\n") if x.strip()]
    row = lambda x: len(re.findall(r"\d+[\d.,]*", x)) >= 3 and len(x.split()) >= 6
    return "|" in s or sum(map(row, lines)) >= max(2, len(lines) // 2)


def merged(blocks):
    """The reference for W8, block by block; texts here have no accents."""
    out = []
    for b in blocks:
        b = dict(zip(NAMES, b, strict=True)) | {"content": clean(b[0])}
        if not b["content"]:
            continue
        p = out[-1] if out else None
        unit = lambda s: bool(re.search(structure.UNIT, flat(s)))
        kind = lambda x: x["chunk_type"] or ("table" if tabular(x["content"]) else "text")
        if p and kind(p) == kind(b) == "text":
            near = (p["page"] is not None and p["page"] == b["page"]) or (p["heading"] and p["heading"] == b["heading"]) or (p["path"] and p["path"] == b["path"])
            lines = b["content"].split("\n")
            lead = re.match(r"[-+*]|\d|(?:tong|trong do|cu the|gom|la|dat|du an|cong trinh|ha)\b", flat(lines[0]))
            signal = flat(p["content"]).endswith((":", "la", "gom", "cu the", "trong do"))
            figures = (len(b["content"]) <= 260 or len(lines) <= 4) and unit(b["content"]) and not unit(p["content"])
            if near and (signal or lead or figures):
                p["content"] = clean(p["content"] + "\n" + b["content"])
                p["chunker"] = (p["chunker"] or "unknown") + "+ContinuationMerge"
                p["page"] = b["page"] if p["page"] is None else p["page"]
                p["heading"], p["path"] = p["heading"] or b["heading"], p["path"] or b["path"]
                continue
        out.append(b)
    return [tuple(b[n] for n in NAMES) for b in out]


def run(spark, cases):
    df = spark.createDataFrame(list(enumerate(cases)), f"k int, b array<{structure.BLOCK}>")
    rows = df.select("k", structure.merge_continuations(F.col("b")).alias("b")).orderBy("k").collect()
    return [None if r.b is None else [tuple(x) for x in r.b] for r in rows]


def test_a_chain_of_merges_looks_at_what_is_merged(spark):
    block = lambda s, page=1, **more: (s, more.get("kind"), page, more.get("heading"), more.get("path"), None)
    chain = [block("Gom:"), block("mot"), block("- hai"), block("- ba"), block("4. bon"), block("la"), block("sau"), block("bay 12 ha"), block("tam 13 ha")]
    (got,) = run(spark, [chain])
    assert got == merged(chain)
    assert [g[0] for g in got] == ["Gom:\nmot\n- hai\n- ba\n4. bon\nla\nsau\nbay 12 ha", "tam 13 ha"]
    assert got[0][5] == "unknown" + 7 * "+ContinuationMerge"


def test_random_merges_agree_with_the_loop(spark, monkeypatch):
    r = random.Random(8)
    parts = ["Gom:", "la", "- a", "2) b", "x", "dat 5 ha", "12", "ha them", "trong do", "a | b", "1 2 3 d e f", "4 5 6 g h i", "", " \n ", None, "w " * 200, "k\nl\nm\nn\no 7 %", "villa"]
    case = lambda: [(r.choice(parts), r.choice([None, None, "text", "table", ""]), r.choice([None, 1, 1, 2]), r.choice([None, "", "H"]), r.choice([None, "P", ""]), r.choice([None, "c"])) for _ in range(r.choice([0, 1, 5, 30]))]
    cases = [case() for _ in range(120)]
    for chunk in (256, 3):
        monkeypatch.setattr(structure, "CHUNK", chunk)
        assert run(spark, [*cases, None]) == [*map(merged, cases), None]


def test_neither_query_runs_python(spark, sf_dir):
    from kelpworks.plans import registry

    for name in ("heading_stack", "merged_blocks"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(AnalysisException):
        structure.heading_paths(spark.range(1), ["doc"], "n").count()


def test_edges_of_words_are_ascii(spark):
    from kelpworks.functions.text import is_heading, is_weak_chunk
    from kelpworks.operators.structure import heading_level, starts_continuation

    line = F.col("line")
    rows = spark.createDataFrame([("Dieüßver",), ("Dieuver",), ("Chuong IIß",), ("laß",), ("5 haß",)], "line string")
    found = rows.select(is_heading(line).alias("h"), heading_level(line).alias("l"), starts_continuation(line).alias("c"), is_weak_chunk(line).alias("w")).collect()
    assert [tuple(r) for r in found] == [(True, 3, False, True), (False, None, False, True), (True, 1, False, True), (False, None, True, True), (True, None, True, False)]
