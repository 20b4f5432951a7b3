"""A search reads its words for the counts and for the scores, and a comparison of two searches works out each once."""

from lattica.operators import search
from lattica.queries_graph import hits_and_unlike


def test_searches_are_worked_out_once(spark):
    rows = spark.createDataFrame([("a", "t.one", "urgent", ""), ("b", "t.two", "", "urgent low"), ("c", "t.three", "", "low"), ("d", "t.four", "", "")], "id STRING, qname STRING, comment STRING, body STRING")
    found = search.search(search.index(rows), "urgent low", limit=2)
    assert [(r.id, r.matched, r.total) for r in found.collect()] == [("b", "body", 3), ("a", "comment", 3)]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 3  # the hits, their counts, the number of texts
    x = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x INT")
    y = spark.createDataFrame([(1,), (3,), (None,)], "x INT")
    assert hits_and_unlike(x, y) == (4, x.exceptAll(y).count() + y.exceptAll(x).count()) == (4, 3)
    assert hits_and_unlike(x.where("x > 9"), y.where("x > 9")) == (0, 0)
