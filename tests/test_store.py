"""Several writers of one collection, and rebuilds that are interrupted."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from kelpworks.sources.commits import CommitLog
from kelpworks.sources.store import SCHEMA, ChunkStore, Conflict
from pyspark.sql import functions as F


def chunks(spark, ids, word="x", key="postId"):
    return spark.createDataFrame([(str(i), f"{word}{i}", {key: str(i)}, None) for i in ids], SCHEMA)


def ids(store, collection):
    return sorted(int(r.chunk_id) for r in store.read(collection).collect())


def test_a_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.numbers() == []
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.put(1, {"by": i}), range(24)))
    assert sum(won) == 1 and log.read(1) == {"by": won.index(True)} and log.numbers() == [1]
    assert log.put(2, {"name": "é"}) and log.read(2) == {"name": "é"}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.append(chunks(spark, range(10)), "c")
    tasks = [lambda i=i: store.append(chunks(spark, [100 + i]), "c") for i in range(3)]
    tasks += [lambda i=i: store.upsert(chunks(spark, [i], "new"), "c", "postId") for i in range(3)]
    tasks += [lambda: store.delete("c", "postId", spark.createDataFrame([(9,)], "k int"))]
    tasks += [lambda: store.append_missing(chunks(spark, [5, 200]), "c") for _ in range(3)]
    with ThreadPoolExecutor(len(tasks)) as pool:
        for done in [pool.submit(t) for t in tasks]:
            done.result()
    assert ids(store, "c") == [*range(9), 100, 101, 102, 200]
    assert {r.content for r in store.read("c", F.col("content").startswith("new")).collect()} == {"new0", "new1", "new2"}


def test_a_writer_that_is_always_late_says_so(spark, tmp_path):
    path = str(tmp_path / "store")
    other, late = ChunkStore(spark, path), ChunkStore(spark, path, tries=2)

    class Busy:
        columns = ["k"]

        def select(self, *_):
            return spark.createDataFrame([("1",)], "__k string")

    late._of = lambda c, f: (other.append(chunks(spark, [len(f) + 1]), c), other._of(c, f))[1]
    with pytest.raises(Conflict):
        late.delete("c", "postId", Busy())
    assert ids(other, "c") == [1, 2]


def test_few_keys_are_sent_and_many_are_not(spark, monkeypatch):
    from kelpworks.sources import store as module

    rows, keys = chunks(spark, range(9)), spark.createDataFrame([("1",), ("1",), (None,), ("300",)], "chunk_id string")
    hinted = lambda: "broadcast" in rows.join(module.sized(keys), "chunk_id", "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    assert hinted() and module.sized(keys.limit(0)).count() == 0
    for name, most in (("SMALL_KEYS", 2), ("SMALL_BYTES", 3)):
        with monkeypatch.context() as m:
            m.setattr(module, name, most)
            assert not hinted()
            assert rows.join(module.sized(keys), "chunk_id", "left_anti").count() == 8


def test_an_interrupted_rebuild_goes_on_and_ends_alike(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    keys = [None, *[7] * 30, *range(60), -4, 10**12]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "n int, k long")
    made = []

    def make(df, fail=None):
        made.append(df.count())
        if len(made) == fail:
            raise RuntimeError("stopped")
        return df.select(F.col("n").cast("string").alias("chunk_id"), F.lit("c").alias("content"), F.create_map(F.lit("k"), F.col("k").cast("string")).alias("meta"), F.lit(None).cast("array<float>").alias("embedding"))

    store.append(chunks(spark, [900]), "c")
    with pytest.raises(RuntimeError):
        store.rebuild(rows, "c", "k", "b", lambda df: make(df, 3), pages=5)
    assert ids(store, "c") == [900] and len(made) == 3
    store.append(chunks(spark, [901]), "c")
    store.rebuild(rows, "c", "k", "b", make, pages=5)
    assert ids(store, "c") == [*range(len(keys)), 901]
    pages = made[:2] + made[3:]
    assert sum(pages) == len(keys) and len(pages) > 2
    store.rebuild(rows, "c", "k", "b", make, pages=5)
    assert ids(store, "c") == [*range(len(keys)), 901] and len(made) == len(pages) + 1


def test_rebuilds_of_nothing_and_of_a_replaced_collection(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = chunks(spark, range(6)).withColumn("k", F.col("chunk_id").cast("int"))
    store.rebuild(rows.limit(0), "c", "k", "none")
    assert store.count("c") == 0
    store.append(chunks(spark, [1]), "c")

    def cleared(df):
        if store.count("c"):
            store.clear("c")
        return df

    with pytest.raises(Conflict):
        store.rebuild(rows, "c", "k", "late", cleared, pages=1)
    assert store.count("c") == 0
