"""What a store keeps for searches doesn't repeat nodes for every way to find them."""

from pyspark.sql import functions as F

from lattica.operators import search, store as stores
from lattica.operators.store import GraphStore
from lattica.queries import node_rows


def some(spark, n):
    return node_rows(spark.range(n), "table", F.concat(F.lit("s.customer_"), F.col("id").cast("string")))


def test_names_with_the_same_leading_letters_are_indexed_once(spark):
    nodes = some(spark, 40)
    index = search.typo_index(nodes)
    assert index.columns == ["bucket", "part", "lead"]
    assert index.count() == search.typo_index(nodes.limit(1)).count() <= 29
    found = search.suggest(index, nodes, spark.createDataFrame([("cusomer_7",)], "term STRING"), cap=100)
    assert {(r.qname, r.distance) for r in found.collect()} == {("s.customer_7", 1), *((f"s.customer_{i}", 2) for i in range(40) if i != 7 and (i < 10 or "7" in str(i)))}


def test_a_store_whose_index_held_ids_gets_the_new_one(spark, tmp_path, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(stores, "SCHEMA_VERSION", 4)
        m.setitem(stores._SCHEMAS, "typos", "bucket INT, part STRING, id STRING, qname STRING")
        m.setattr(stores, "typo_index", lambda nodes: search.typo_index(nodes).select("bucket", "part", F.lit("x").alias("id"), F.lit("s.x").alias("qname")))
        GraphStore(spark, str(tmp_path / "s")).upsert(some(spark, 5))
    store = GraphStore(spark, str(tmp_path / "s"))
    assert store.version == 2 and GraphStore(spark, store.path).version == 2
    assert {r.qname for r in store.suggest(["cusomer_3"]).where("distance = 1").collect()} == {"s.customer_3"}
    store.compact("typos", whole=True)
    store.delete(store.nodes.where("qname = 's.customer_3'").select("id"))
    assert {r.qname for r in store.suggest(["cusomer_3"]).collect()} == {f"s.customer_{i}" for i in (0, 1, 2, 4)}


def test_words_are_shuffled_as_texts(spark):
    """Positions of a word come from its own row, in order and by column."""
    rows = spark.createDataFrame([("a", "s.t", "one two", "two one two")], "id STRING, qname STRING, comment STRING, body STRING")
    found = search.postings(rows)
    assert {(r.term, r.col, *r.positions) for r in found.collect()} == {("s", "qname", 0), ("t", "qname", 1), ("one", "comment", 0), ("two", "comment", 1), ("two", "body", 0, 2), ("one", "body", 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") > plan.index("Generate explode")  # read from below: texts first, then their words
