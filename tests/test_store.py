"""The keyed write-once store: what it keeps, what it opens, and what a killed writer leaves."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from pricepanel.operators.cleaning import first_by
from pricepanel.session import scratch_path
from pricepanel.sources.store import KeyedStore
from pricepanel.streaming import jobs

KIND = "isbn string, used int, id long, note string"


def make(spark, **options):
    return KeyedStore(spark, scratch_path(spark, "keyed"), spark.createDataFrame([], KIND).schema, ("isbn", "used"), **options)


def batch(spark, start, stop):
    return spark.range(start, stop).selectExpr("concat('b', id % 700) AS isbn", "CAST(id % 3 AS INT) AS used", "id", "CAST(NULL AS STRING) AS note")


def test_first_write_of_each_key_stays(spark):
    store = make(spark, buckets=8, max_files=2)
    first = spark.createDataFrame([("a", 1, 5, "late"), ("a", 1, 2, "early"), (None, 1, 1, "no isbn"), (None, 1, 3, "x"), ("a", None, 4, "no use")], KIND)
    store.insert(first, ["id"])
    assert [r["note"] for r in rows(store.read(), "id")] == ["no isbn", "early", "no use"]
    for k in range(5):  # more inserts than files, so buckets are written anew
        store.insert(first.withColumn("note", F.lit("again")).unionByName(spark.createDataFrame([(f"n{k}", k, 10 + k, "new")], KIND)), ["id"])
    assert [r["note"] for r in rows(store.read(), "id")] == ["no isbn", "early", "no use"] + ["new"] * 5
    assert all(len(files) <= 2 + 1 for files in store.live_files().values())


def test_empty_store_and_empty_batch(spark):
    store = make(spark)
    assert store.read().count() == 0
    store.insert(batch(spark, 0, 0), ["id"])
    assert store.read().count() == 0


def test_files_opened_follow_the_batch_and_not_the_table(spark):
    store = make(spark, buckets=256, max_files=8)
    for k in range(4):
        store.insert(spark.range(4000 * k, 4000 * k + 4000).selectExpr("CAST(id AS STRING) AS isbn", "0 AS used", "id", "'x' AS note"), ["id"])
    assert sum(map(len, store.live_files().values())) >= 1000
    opened = []
    read = KeyedStore._read
    try:
        KeyedStore._read = lambda self, files: (opened.extend(files := list(files)), read(self, files))[1]
        store.insert(spark.createDataFrame([("5", 0, -1, "old"), ("new", 0, -1, "new")], KIND), ["id"])
    finally:
        KeyedStore._read = read
    assert 0 < len(opened) <= 2 * 8
    assert store.read().count() == 16001 and store.read().filter("note = 'old'").count() == 0


def test_a_killed_writer_leaves_nothing_and_a_retry_adds_once(spark, monkeypatch):
    store = make(spark, buckets=8, max_files=2)
    for k in range(3):
        store.insert(batch(spark, 500 * k, 500 * k + 600), ["id"], f"b{k}")
    want = rows(first_by(batch(spark, 0, 1600), ["isbn", "used"], ["id"]), "id")
    assert rows(store.read(), "id") == want
    with monkeypatch.context() as patch:
        patch.setattr(KeyedStore, "_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.insert(batch(spark, 1500, 2300), ["id"], "b3")
    assert rows(store.read(), "id") == want
    for _ in range(2):
        store.insert(batch(spark, 1500, 2300), ["id"], "b3")
        assert rows(store.read(), "id") == rows(first_by(batch(spark, 0, 2300), ["isbn", "used"], ["id"]), "id")
    store.insert(batch(spark, 0, 50), ["id"], "b1")  # an old name: not even looked at
    assert len(store._commits()) == 4


def test_stream_commits_each_micro_batch_once(spark, monkeypatch):
    path, checkpoint = scratch_path(spark, "in"), scratch_path(spark, "c")
    for k in range(3):
        batch(spark, 500 * k, 500 * k + 600).coalesce(1).write.mode("append").parquet(path)
    store = make(spark, buckets=8)
    run = lambda: jobs.keyed_ingest(jobs.file_stream(spark, path, store.schema, files_per_batch=1), store, ["id"], checkpoint).awaitTermination()
    mark, calls = KeyedStore._mark, []

    def dying(self, commit, number):
        calls.append(commit)
        mark(self, commit, number)
        if len(calls) == 2:
            raise RuntimeError("killed after the commit, before the stream knew")

    with monkeypatch.context() as patch:
        patch.setattr(KeyedStore, "_mark", dying)
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    assert rows(store.read(), "id") == rows(first_by(batch(spark, 0, 1600), ["isbn", "used"], ["id"]), "id")
    assert len(store._commits()) == 3 and len(calls) == 2
