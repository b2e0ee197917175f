"""The best match of each asked vector: one pass for many queries, odd vectors as in SQL, ties at six digits."""

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from kelpworks.operators import nearest
from kelpworks.operators.search import best_matches
from kelpworks.plans import registry
from oracle import duck
from pyspark.sql import functions as F

NAN, INF = math.nan, math.inf
PLAIN = [(i, [float(i % 7 - 3), float(i % 5), 1.0], i % 10) for i in range(1, 350) if i % 100]
ODD = {
    "nulls": [(0, [1.0, 2.0, 3.0], 1), (100, None, 2), (200, [3.0, 2.0, -1.0], None), (300, [3.0, 2.0, -1.0], 4), (400, None, 5), (None, [1.0, 2.0, 3.0], 6), (401, None, 7), *PLAIN],
    "only nulls": [(0, None, 1), (100, None, 2), (101, [1.0], 3)],
    "no length": [(0, [1.0, 2.0, 3.0], 1), (77000, [0.0, 0.0, 0.0], 2), (77100, [1.0, 0.0, 0.0], 3), *PLAIN],
    "not finite": [(0, [1.0, 2.0, 3.0], 1), (100, None, 1), (555, [NAN, 1.0, 1.0], 2), (400, [INF, 0.0, 1.0], 3), (88, [0.0, 0.0, 0.0], 3), *[r for r in PLAIN if r[0] != 88]],
    "asked twice": [(100, [1.0, 2.0, 3.0], 1), (100, [-1.0, 0.0, 0.0], 2), (0, [1.0, 2.0, 3.0], 1), *PLAIN],
    "empty": [(0, [], 1), (1, [], 2), (2, [], 3)],
    "alone": [(0, [1.0], 1)],
}


@pytest.mark.parametrize("case", ODD)
def test_odd_vectors_agree_with_sql(spark, tmp_path, case):
    ids, vectors, labels = (list(x) for x in zip(*ODD[case], strict=True))
    rows = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    found = registry.queries()["label_neighbours"](spark, str(tmp_path))
    names, wanted = duck(registry.oracle_sql()["label_neighbours"], str(tmp_path))
    assert found.columns == names
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(map(repr, wanted))


def test_a_thousand_queries_are_one_pass_of_matrices(spark):
    rows = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    plan = best_matches(rows, F.lit(True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan


def _brute(ids, x, query_id, q):
    """The smallest id of the highest score, rounded half up from terms added in order."""
    best = None
    for i, v in zip(ids, x, strict=True):
        if i != query_id:
            product, own, asked = (sum((a * b for a, b in zip(m, n, strict=True)), 0.0) for m, n in ((v, q), (v, v), (q, q)))
            score = int(Decimal(repr(product / math.sqrt(own * asked))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
            best = min(best or (-score, i), (-score, i))
    return -best[0], best[1]


@pytest.mark.parametrize("kind", ["signs", "copies", "close", "floats"])
def test_ties_at_six_digits_and_scores_between_them(monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = {
        "signs": lambda: np.where(np.arange(256) < rng.integers(1, 4, (90, 1)), -1.0, 1.0),  # 1 - n / 128 ends in a five at the seventh digit
        "copies": lambda: np.repeat(rng.normal(size=(6, 5)), 15, axis=0),
        "close": lambda: np.array([[1.0, 1e-4 * k] for k in rng.integers(-40, 40, 90)]),  # scores differ by about a unit
        "floats": lambda: rng.normal(size=(90, 64)).astype(np.float32).astype(np.float64),
    }[kind]()
    ids = rng.permutation(90)
    monkeypatch.setattr(nearest, "SCORES", 60)
    best = nearest.Nearest(ids[:20], x[:20])
    for at in range(0, 90, 37):
        best.add(ids[at : at + 37], x[at : at + 37])
    assert [(p, i) for p, i in zip(best.place, best.id, strict=True)] == [_brute(ids.tolist(), x.tolist(), ids[n], x[n].tolist()) for n in range(20)]


def test_blocks_of_queries_are_bounded_by_number_and_by_components():
    asked = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [3.0, 4.0])]
    sizes = lambda blocks: [sum(len(ids) for ids, _ in b.values()) for b in blocks]
    assert sizes(nearest.query_blocks(iter(asked), 2)) == [2, 2, 1] and sizes(nearest.query_blocks(iter(asked), 99, numbers=3)) == [4, 1]
    (block,) = nearest.query_blocks(iter(asked), 99)
    assert {w: ids.tolist() for w, (ids, _) in block.items()} == {2: [1, 5], None: [2, 3], 1: [4]}
    assert list(nearest.query_blocks(iter([]), 2)) == []


def test_rows_of_another_width_or_with_a_null_are_left_out():
    ids, x = nearest.of_width(np.arange(5), pa.array([[1.0, 2.0], None, [3.0], [4.0, None], [5.0, 6.0]], pa.list_(pa.float32())), 2)
    assert ids.tolist() == [0, 4] and x.tolist() == [[1.0, 2.0], [5.0, 6.0]]
