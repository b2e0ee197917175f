import pytest
from kelpworks.sources import files, schema
from kelpworks.sources.store import SCHEMA, ChunkStore
from kelpworks.streaming.ingest import event_counts, ingest_stream
from pyspark.sql import functions as F


def chunks(spark, *rows):
    return spark.createDataFrame([(i, c, {"postId": p, "chunkingMode": m}, [1.0]) for i, c, p, m in rows], SCHEMA)


def test_store_is_scoped_to_a_collection(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert store.count("a") == 0
    for c in ("a", "b"):
        store.append(chunks(spark, ("1", "x", "p1", "m"), ("2", "y", "p2", "m")), c)
    store.delete("a", "postId", spark.createDataFrame([("p1",)], "k string"))
    assert (store.count("a"), store.count("b")) == (1, 2) and store.has("b", "postId", "p1") and not store.has("a", "postId", "p1")
    store.append(chunks(spark, ("4", "v", "p4", "m")), "a")
    store.upsert(chunks(spark, ("3", "z", "p2", "m")), "a", "postId")
    assert sorted(r.chunk_id for r in store.read("a").collect()) == ["3", "4"]
    store.copy_missing("b", "a", lambda df: df.withColumn("embedding", F.array(F.lit(2.0).cast("float"))))
    assert sorted(r.chunk_id for r in store.read("a").collect()) == ["1", "2", "3", "4"]
    store.append(chunks(spark, ("9", "x", "p", "other")), "c")
    with pytest.raises(ValueError):
        store.copy_missing("b", "c", lambda df: df)
    store.clear("b")
    assert store.count("b") == 0


def test_manifests_and_reports(spark, tmp_path):
    p = tmp_path / "posts.jsonl"
    p.write_text('{"postId": 1, "content": "é"}\n\n[1]\n')
    assert [r.content for r in files.read_jsonl(spark, str(p), files.POSTS).collect()] == ["é"]
    assert files.read_jsonl(spark, str(tmp_path / "none"), files.POSTS).count() == 0
    p.write_text('{"postId": 1,\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(p), files.POSTS).collect()
    c = tmp_path / "r.csv"
    c.write_text("﻿a,b\n1,2\n")
    assert files.read_csv(spark, str(c)).columns == ["a", "b"]
    files.write_report([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "b int, a int")], str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).columns == ["a", "b"]
    assert files.to_json_rows(spark.createDataFrame([(None, "é")], "a int, b string")).first()[0] == '{"a":null,"b":"é"}'


def test_pages_of_staged_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one \xff two " * 30)
    (tmp_path / "b.PDF").write_bytes(b"x")
    pages = files.read_pages(spark, str(tmp_path), {"pdf": lambda data: ["first", "second"]})
    assert {(r.kind, r.page) for r in pages.collect()} == {("txt", 1), ("pdf", 1), ("pdf", 2)}
    quality = {r.path.rsplit("/", 1)[1]: r.needs_ocr for r in files.document_quality(pages).collect()}
    assert quality["b.PDF"] and not quality["a.txt"]


def test_stream_upserts_and_counts(spark, sf_dir, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    source = str(tmp_path / "in")
    chunks(spark, ("1", "x", "p1", "m")).write.parquet(source)
    run = lambda: ingest_stream(spark.readStream.schema(SCHEMA).parquet(source), store, "s", "postId", str(tmp_path / "cp")).awaitTermination()
    run()
    chunks(spark, ("2", "y", "p1", "m")).write.mode("append").parquet(source)
    run()
    assert [r.chunk_id for r in store.read("s").collect()] == ["2"]
    batch = event_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert batch.agg(F.sum("n")).first()[0] == 1000


def test_tables_and_messages(spark, tmp_path):
    spark.sql(f"CREATE DATABASE service LOCATION '{tmp_path}/service'")
    assert schema.create_tables(spark, "service") == list(schema.TABLES) and schema.create_tables(spark, "service") == []
    for text in ("one", "two"):
        schema.add_message(spark, 1, "user", text, "service")
    assert [r.content for r in spark.table("service.chat_messages").orderBy("id").collect()] == ["one", "two"]
    (tmp_path / "a.json").write_text('{"a":\n 1}')
    assert schema.read_json(spark, str(tmp_path / "a.json"), "a int").first()[0] == 1
