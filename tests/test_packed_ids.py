"""Ids that are hashes take half their bytes while components are found."""

from pyspark.sql import functions as F

from lattica.operators import shape


def test_components_of_hashes_and_of_other_ids(spark, monkeypatch):
    types, real = [], shape.components
    monkeypatch.setattr(shape, "components", lambda links: types.append(links.schema["u"].dataType.simpleString()) or real(links))
    links = spark.createDataFrame([("1", "2"), ("2", "3"), ("4", "5"), ("6", "6"), (None, "1")], "src STRING, dst STRING")
    for of in (F.sha1, lambda c: F.concat(F.lit("n"), c)):
        ids = {r.k: r.id for r in spark.range(1, 8).select(F.col("id").cast("string").alias("k")).select("k", of(F.col("k")).alias("id")).collect()}
        nodes = spark.createDataFrame([(x,) for x in ids.values()], "id STRING")
        found = {r.id: r.component for r in shape.connected(nodes, links.select(of(F.col("src")).alias("src"), of(F.col("dst")).alias("dst"))).collect()}
        assert found == {ids[k]: min(ids[x] for x in group) for group in ("123", "45", "6", "7") for k in group}
    assert types == ["binary", "string"]
