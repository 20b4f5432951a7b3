"""Peeling to a core writes the ends of edges alone."""

from pyspark.sql import functions as F

from lattica.operators import shape


def test_only_packed_ends_are_written(spark, monkeypatch):
    name = lambda c: F.when(F.col(c) < 4, F.sha1(F.col(c).cast("string"))).otherwise(F.concat(F.lit("n"), F.col(c).cast("string")))
    pairs = [(a, b) for a in range(6) for b in range(a)] + [(6, 0), (7, 6), (6, 99)]
    edges = spark.createDataFrame(pairs, "a INT, b INT").select(name("a").alias("src"), name("b").alias("dst"), F.lit("wide").alias("kind"))
    nodes = spark.range(8).select(name("id").alias("id"))
    written, staged = [], shape.staged
    monkeypatch.setattr(shape, "staged", lambda df: (written.append(df.dtypes), staged(df))[1])
    kept, links = shape.min_degree_core(nodes, edges, 3)
    want = {r.id for r in spark.range(6).select(name("id").alias("id")).collect()}
    assert {r.id for r in kept.collect()} == want and links.count() == 15 and links.columns == ["src", "dst", "kind"]
    assert written and all(t == "binary" for columns in written for _, t in columns)
