"""References move without hashes, and the ends of edges in half their bytes, each side once."""

import pytest
from pyspark.sql import functions as F

from lattica.model import CONSTRAINT
from lattica.operators import normalize as norm, scoring, shape
from lattica.operators.normalize import struct_of
from lattica.queries import edge_rows, node_rows
from lattica.sources import mapping


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def keyed(spark):
    """Two tables, one of which refers to the other by two columns, with every edge twice."""
    nodes = node_rows(spark.range(3), "table", F.concat(F.lit("s.t"), F.col("id").cast("string")))
    ends = ("table", F.lit("s.t2")), ("table", F.concat(F.lit("s.t"), F.col("id").cast("string")))
    rows = spark.range(2)
    edges = edge_rows(rows, "references", *ends, aggregate=F.lit(True), constraint_name=F.lit("fk"))
    for c in ("b", "a"):
        edges = edges.unionByName(edge_rows(rows, "references", *ends, src_column=F.lit(c), dst_column=F.lit("id"), constraint_name=F.lit("fk")))
    return nodes, edges


def test_entity_relations_are_shuffled_once_for_each_end(spark, sorted_joins):
    nodes, edges = keyed(spark)
    plain = lambda df, *ids: df.withColumns({c: F.substring(F.col(c), 1, 7) for c in ids})
    for n, e in ((nodes, edges), (plain(nodes, "id"), plain(edges, "src", "dst"))):
        found = shape.entity_relations(n, e.unionByName(e))
        assert [tuple(r) for r in found.collect()] == [("s.t0", "s.t2"), ("s.t1", "s.t2")]
        assert exchanges(shape.entity_relations(n, e)) == 5


def test_resolved_references_are_written_without_hashes(spark):
    fk = struct_of(CONSTRAINT, name=F.lit("fk"), type=F.lit("FK"), columns=F.array(F.lit("a"), F.lit("b")), references=F.struct(F.lit("s").alias("schema"), F.lit("t0").alias("table"), F.array(F.lit("x"), F.lit("y")).alias("columns")))
    objects = norm.with_qname(mapping.as_objects(spark.range(1), kind=F.lit("table"), schema=F.lit("s"), name=F.lit("t1"), constraints=F.array(fk)).withColumn("pos", F.lit(0).cast("long")))
    real = node_rows(spark.range(1), "table", F.lit("s.t0"))
    found, stubs = norm.resolve(norm.references_of(objects), real, real.select("qname").limit(0))
    assert {"src", "dst", "real_id"} <= {*found.columns} and not {"src", "dst", "real_id"} & {*spark.read.parquet(found._staged_at).columns}
    edges = norm.reference_edges(found).collect()
    assert sorted((r.attrs.src_column or "", r.attrs.dst_column or "", r.attrs.aggregate or False) for r in edges) == [("", "", True), ("a", "x", False), ("b", "y", False)]
    assert len({r.id for r in edges}) == 3 and {r.dst for r in edges} == {real.first().id} and stubs.count() == 0


def test_key_questions_are_shuffled_once_for_each_end(spark, sorted_joins):
    nodes, edges = keyed(spark)
    for n, e in ((nodes, edges), (nodes.withColumn("id", F.substring("id", 1, 7)), edges.withColumns({c: F.substring(c, 1, 7) for c in ("src", "dst")}))):
        found = scoring.fk_questions(n, e)
        assert sorted(tuple(r) for r in found.collect()) == [("fk", "s.t2", f"s.t{i}", ["a=id", "b=id"]) for i in range(2)]
        assert exchanges(scoring.fk_questions(n, e)) == 4
