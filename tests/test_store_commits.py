"""A store changes by whole commits: one that isn't finished is never seen."""

import pytest

from lattica.operators import store as stores, sync as syncing
from lattica.operators.store import GraphStore
from lattica.sources import mapping
from pyspark.sql import functions as F


def objects(spark, names):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos LONG, n STRING")
    return mapping.as_objects(rows, kind=F.lit("view"), schema=F.lit("s"), name=F.col("n"), body=F.col("n")).withColumnRenamed("__in", "pos")


def test_a_sync_that_dies_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "store"))
    syncing.sync(store, objects(spark, "abc"), "test", "1")
    before = sorted(r.qname for r in store.nodes.collect())
    monkeypatch.setattr(stores, "manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        syncing.sync(store, objects(spark, "bcd"), "test", "2")
    for seen in (store, GraphStore(spark, store.path)):
        assert sorted(r.qname for r in seen.nodes.collect()) == before == ["s.a", "s.b", "s.c"]
        assert seen.snapshots().count() == 1 and seen.last_snapshot().fingerprint == "1"
    monkeypatch.undo()
    done = syncing.sync(store, objects(spark, "bcd"), "test", "2")
    assert (done.upserted, done.deleted) == (1, 1) and sorted(r.qname for r in store.nodes.collect()) == ["s.b", "s.c", "s.d"]
    assert [store.snapshot_objects(r.id).count() for r in store.snapshots().collect()] == [3, 3]


def test_errors_other_than_a_missing_store_are_told(spark, tmp_path):
    (tmp_path / "store" / "_commits").mkdir(parents=True)
    (tmp_path / "store" / "_commits" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):
        GraphStore(spark, str(tmp_path / "store"))
    assert GraphStore(spark, str(tmp_path / "other")).nodes.count() == 0
