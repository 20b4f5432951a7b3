"""Joins and shuffles that have to stay in proportion where a graph is large."""

from pyspark.sql import functions as F

from lattica.model import DEPENDENCY, REF
from lattica.operators import normalize as norm
from lattica.operators.normalize import struct_of
from lattica.operators.snapshot import delta
from lattica.plans.cut import discard, staged
from lattica.queries import node_rows
from lattica.sources import mapping


def test_ids_of_wide_rows_are_not_broadcast(spark):
    """Estimated by the widths of their types, the ids of a table of null payloads look like a few bytes."""
    nodes = staged(node_rows(spark.range(20_000), "table", F.concat(F.lit("t."), F.col("id").cast("string"))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300k")
    try:
        for df in delta(nodes, nodes.where("qname <> 't.7'")):
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        gone, fresh = delta(nodes, nodes.where("qname <> 't.7'"))
        assert gone.count() == 1 and fresh.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        discard(nodes)


def test_references_are_resolved_once(spark):
    """Also those to a column; the first object that names a missing one is told, whichever order rows come in."""
    n = spark.range(6).withColumn("pos", 5 - F.col("id"))
    kind = F.when(F.col("id") % 3 == 0, "column").when(F.col("id") % 3 == 1, "table").otherwise("procedure")
    target = F.when(F.col("id") % 3 == 0, "a.c").when(F.col("id") % 3 == 1, "none").otherwise("p")
    dep = struct_of(DEPENDENCY, target=struct_of(REF, kind=kind, schema=F.lit("s"), name=target), access=F.lit("read"), confidence=F.lit("parsed"))
    objects = norm.with_qname(mapping.as_objects(n, kind=F.lit("view"), schema=F.lit("v"), name=F.col("id").cast("string"), dependencies=F.array(dep)).withColumn("pos", 5 - F.col("name").cast("long")))
    real = node_rows(spark.range(1), "column", F.lit("s.a.c")).unionByName(node_rows(spark.range(1), "function", F.lit("s.p"))).unionByName(node_rows(spark.range(1), "view", F.lit("s.none")))
    found, stubs = norm.resolve(norm.references_of(objects), real, real.select("qname").limit(0))
    assert found._staged_at  # stubs and edges rest on rows that are written once
    by = {r.pos: r for r in found.collect()}
    ids = {(r.kind, r.qname): r.id for r in real.collect()}
    assert len(by) == 6 and all(by[p].real_id == ids["column", "s.a.c"] for p in (5, 2)) and all(by[p].dst == ids["function", "s.p"] for p in (3, 0))
    assert all(by[p].real_id is None and by[p].dst for p in (4, 1))
    (stub,) = stubs.collect()
    assert (stub.kind, stub.qname, stub.referenced_by, stub.reason) == ("table", "s.none", by[1].src, "missing")
