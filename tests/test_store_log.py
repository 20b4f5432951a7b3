"""The store's log: changes write what they change, reads merge them, and writers notice each other."""

import os

import pytest
from pyspark.sql import functions as F

from lattica.operators import snapshot, store as stores
from lattica.operators.store import ConflictError, GraphStore
from lattica.plans.log import CommitLog, Folder
from lattica.queries import edge_rows, node_rows
from tests.test_queries import rows


def some_nodes(spark, ids, said="x"):
    return node_rows(spark.createDataFrame([(i,) for i in ids], "k INT"), "view", F.concat(F.lit("s.n"), "k"), body=F.concat(F.lit(f"body {said} of "), "k"), comment=F.lit(said))


def some_edges(spark, pairs):
    made = spark.createDataFrame(list(pairs), "a INT, b INT")
    return edge_rows(made, "depends_on", ("view", F.concat(F.lit("s.n"), "a")), ("view", F.concat(F.lit("s.n"), "b")))


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def said(store, version=None):
    return {r.qname: r.payload.comment for r in store.read("nodes", version).collect()}


def test_a_change_writes_in_proportion_to_itself(spark, tmp_path):
    written = []
    for n in (50, 3000):
        store = GraphStore(spark, str(tmp_path / str(n)))
        store.replace(some_nodes(spark, range(n)), some_edges(spark, [(i, i + 1) for i in range(n - 1)]))
        before = files(store.path)
        store.apply(some_nodes(spark, range(5), "y"), some_nodes(spark, [7]).select("id"))
        after = files(store.path)
        assert {k: v for k, v in after.items() if k in before} == before  # nothing is rewritten
        written.append(sum(v for k, v in after.items() if k not in before))
        assert store.nodes.count() == n - 1 and store.edges.count() == n - 3
    assert written[1] < 1.2 * written[0]
    assert sum(before.values()) > 2 * written[1]


def test_reads_are_those_of_a_rewritten_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_CHANGES", 3)
    store, want, links = GraphStore(spark, str(tmp_path / "log")), {}, {}
    for step, (put, gone, edges) in enumerate([(range(8), [], [(1, 2), (2, 3), (4, 4)]), ([1, 2, 9], [3], [(9, 1)]), ([], [9, 5], []), ([3], [], [(3, 1), (1, 2)]), ([3, 0], [0], []), ([11], [1], [(11, 2)])]):
        store.apply(some_nodes(spark, put, f"v{step}"), some_nodes(spark, gone).select("id"))
        want = {k: v for k, v in want.items() if k not in gone} | dict.fromkeys(put, f"v{step}")
        links = {e for e in links if not {*e} & {*gone}} | {*edges}
        if edges:
            store.upsert(edges=some_edges(spark, edges))
        assert said(store) == {f"s.n{k}": v for k, v in want.items()}
        assert {(r.src, r.dst) for r in store.edges.collect()} == {(r.src, r.dst) for r in some_edges(spark, links).collect()}
        for table in ("nodes", "edges", "postings", "lengths"):
            assert len(store._segments(table)) <= 3 + 1
    plain = GraphStore(spark, str(tmp_path / "plain"))
    plain.replace(store.nodes, store.edges)
    for table in ("nodes", "edges", "postings", "lengths"):
        assert rows(store.read(table).toPandas()) == rows(plain.read(table).toPandas())
    for query in ("body v1", "s-n3", "v5 v0"):
        assert rows(store.search(query, limit=None).toPandas()) == rows(plain.search(query, limit=None).toPandas())
    again = GraphStore(spark, store.path)
    assert again.version == store.version and said(again) == said(store)


def test_earlier_versions_stay_readable_until_vacuum(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    for v in "abc":
        store.upsert(some_nodes(spark, [1], v))
    assert [said(store, n)["s.n1"] for n in (1, 2, 3)] == ["a", "b", "c"]
    store.compact("nodes", whole=True)
    assert said(store) == {"s.n1": "c"} == said(store, 4) and said(store, 2) == {"s.n1": "b"}
    store.take_snapshot("t", None, "f")
    (tmp_path / "s" / "nodes" / "left-by-a-dead-job").mkdir()
    assert store.vacuum(1) == 0 and store.vacuum(-1) > 0
    assert not (tmp_path / "s" / "nodes" / "left-by-a-dead-job").exists()
    assert said(GraphStore(spark, store.path)) == {"s.n1": "c"} and store.snapshots().count() == 1 and store.search("body").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        said(store, 2)


def test_disjoint_changes_of_two_writers_both_land(spark, tmp_path):
    one = GraphStore(spark, str(tmp_path / "s"))
    one.upsert(some_nodes(spark, range(4)), some_edges(spark, [(0, 1), (2, 3)]))
    two = GraphStore(spark, one.path)
    one.upsert(some_nodes(spark, [0], "one"))
    one.upsert(some_nodes(spark, [8], "one"))
    two.apply(some_nodes(spark, [1], "two"), some_nodes(spark, [3]).select("id"))  # knows nothing of one's
    two.set_meta("k", "v")
    one.set_meta("l", "w")
    two.refresh()
    for s in (one, two, GraphStore(spark, one.path)):
        assert said(s) == {"s.n0": "one", "s.n1": "two", "s.n2": "x", "s.n8": "one"} and s.edges.count() == 1
        assert s.meta("k") == "v" and s.meta("l") == "w"


def test_clashing_changes_of_two_writers_raise(spark, tmp_path):
    one = GraphStore(spark, str(tmp_path / "s"))
    one.replace(some_nodes(spark, range(4)), some_edges(spark, [(0, 1)]))

    def later(first, second):
        two = GraphStore(spark, one.path)
        first(one)
        before = one.version
        with pytest.raises(ConflictError):
            second(two)
        one.refresh()
        assert one.version == before
        second(two)  # having seen the other's, it may
        one.refresh()

    put = lambda k, v: lambda s: s.upsert(some_nodes(spark, [k], v))
    drop = lambda k: lambda s: s.delete(some_nodes(spark, [k]).select("id"))
    link = lambda a, b: lambda s: s.upsert(edges=some_edges(spark, [(a, b)]))
    later(put(1, "a"), put(1, "b"))
    later(put(1, "c"), lambda s: s.take_snapshot("t", None, "f"))
    later(lambda s: s.take_snapshot("t", None, "g"), put(2, "d"))
    later(drop(3), link(0, 3))
    later(link(2, 0), drop(0))
    later(lambda s: s.set_meta("k", "1"), lambda s: s.set_meta("k", "2"))
    one.refresh()
    assert said(one) == {"s.n1": "c", "s.n2": "d"} and one.meta("k") == "2"


def test_compaction_meets_changes_of_others(spark, tmp_path):
    one = GraphStore(spark, str(tmp_path / "s"))
    for v in "abc":
        one.upsert(some_nodes(spark, [1, 2], v))
    two, three = GraphStore(spark, one.path), GraphStore(spark, one.path)
    one.upsert(some_nodes(spark, [2], "later"))
    two.compact("nodes", whole=True)
    assert said(two) == {"s.n1": "c", "s.n2": "later"}
    three.compact("nodes")  # of rows that are together already: it changes nothing
    assert said(three) == said(two) == said(GraphStore(spark, one.path))
    one.replace(some_nodes(spark, [5]), some_edges(spark, []))
    assert said(one) == {"s.n5": "x"}


def test_a_number_is_given_once(spark, tmp_path):
    log = CommitLog(Folder(spark, str(tmp_path / "s")))
    assert log.after(0) == [] and log.put(1, {"a": 1}) and not log.put(1, {"a": 2}) and log.put(2, {"a": 3})
    assert [(c["version"], c["a"]) for c in log.after(0)] == [(1, 1), (2, 3)] and log.after(2) == []
    assert sorted(os.listdir(tmp_path / "s" / "_log")) == [f"{n:020d}.json" for n in (1, 2)] or all(x.endswith(".crc") or x.endswith(".json") for x in os.listdir(tmp_path / "s" / "_log"))
    for n in range(3, 50):
        log.put(n, {"a": n})
    assert [c["a"] for c in log.after(0)] == [1, 3, *range(3, 50)]  # many are read as a table


def test_snapshots_share_buckets_and_differences_read_unlike_ones(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    store.upsert(some_nodes(spark, range(200)).withColumn("body_hash", F.lit("x")))
    first = store.take_snapshot("t", None, "1")
    again = store.take_snapshot("t", None, "2")
    assert not (tmp_path / "s" / "snapshot_objects" / again).exists() and store.difference(first, again).count() == 0
    store.apply(some_nodes(spark, [3, 999]).withColumn("body_hash", F.lit("y")), some_nodes(spark, [5]).select("id"))
    third = store.take_snapshot("t", None, "3")
    written = {x for x in os.listdir(tmp_path / "s" / "snapshot_objects" / third) if x.startswith("bucket=")}
    assert 1 <= len(written) <= 3 < len([x for x in os.listdir(tmp_path / "s" / "snapshot_objects" / first) if x.startswith("bucket=")])
    found = store.difference(first, third)
    assert {(r.change, r.qname) for r in found.collect()} == {("changed", "s.n3"), ("added", "s.n999"), ("removed", "s.n5")}
    assert {x.split("/")[-2] for x in found.inputFiles()} == written
    assert [store.snapshot_objects(x).count() for x in (first, again, third)] == [200, 200, 200]
    assert {r.snapshot_id for r in store.snapshot_objects(third).collect()} == {third}
    assert store.vacuum(-1) >= 0 and store.snapshot_objects(again).count() == 200


def test_manifests_get_more_buckets_as_they_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "BUCKET_ROWS", 4)
    assert snapshot.buckets_for(10) == 16 and snapshot.buckets_for(300) == 128 and snapshot.buckets_for(200, 16) == 16 and snapshot.buckets_for(10**9) == 4096 == snapshot.buckets_for(10**12, 4096)
    store = GraphStore(spark, str(tmp_path / "s"))
    store.upsert(some_nodes(spark, range(20)))
    first = store.take_snapshot("t", None, "1")
    store.upsert(some_nodes(spark, range(400)))
    second = store.take_snapshot("t", None, "2")
    assert store.difference(first, second).groupBy("change").count().collect()[0][1] == 380
