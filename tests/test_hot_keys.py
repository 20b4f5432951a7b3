"""Keys with a large share of a join's rows are sliced, or left out where the other side hasn't them."""

from pyspark.sql import functions as F

from lattica.plans import hot


def test_hot_keys_lose_and_double_nothing(spark):
    many = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "common").when(F.col("id") % 4 == 1, "absent").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"))
    many = many.unionByName(spark.createDataFrame([(1000, None), (1001, "k3"), (1002, "common")], "id LONG, key STRING"))
    few = spark.createDataFrame([("common", 1), ("common", 2), ("k3", 3), ("k3", 4), ("k7", 5), ("nobody", 6), (None, 7)], "key STRING, x INT")
    want = sorted(tuple(r) for r in many.join(few, ["key"]).collect())
    assert len(want) == 407
    found = hot.met(many, few, ["key"], rows=20)
    assert sorted(tuple(r) for r in found.collect()) == want and found.columns == ["key", "id", "x"]
