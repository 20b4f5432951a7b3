"""Paths of many pairs at once are those of one pair at a time."""

import random

from pyspark.sql import functions as F

from lattica.operators import graph
from lattica.plans.cut import staged
from lattica.queries import edge_rows, node_rows


def random_graph(spark, seed, n, m, inferred=()):
    rng = random.Random(seed)
    order = list(range(n))
    rng.shuffle(order)  # names don't follow ids
    nodes = node_rows(spark.createDataFrame([(i,) for i in order], "k INT"), "table", F.concat(F.lit("s.t"), "k"))
    pairs = spark.createDataFrame(sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)}), "a INT, b INT")
    ends = ("table", F.concat(F.lit("s.t"), "a")), ("table", F.concat(F.lit("s.t"), "b"))
    edges = edge_rows(pairs, "references", *ends, aggregate=F.lit(True)).unionByName(edge_rows(pairs, "references", *ends, src_column=F.concat(F.lit("c"), "b"), dst_column=F.lit("id")))
    return staged(nodes), staged(edges)


def test_many_pairs_are_each_pair(spark):
    for seed, n, m in ((1, 14, 16), (2, 10, 24)):
        nodes, edges = random_graph(spark, seed, n, m)
        ids = sorted(r.id for r in nodes.collect())
        rng = random.Random(seed)
        pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(6)} | {(ids[0], ids[0])})
        table = spark.createDataFrame([*pairs, *pairs[:3], (None, ids[0]), (ids[0], None)], "start STRING, end STRING")
        found = graph.join_paths(nodes, edges, table)
        hops = {}
        for r in found.columns(edges).collect():
            hops.setdefault((r.start, r.end), {})[r.hop] = (r.a, r.b, [tuple(c) for c in r.columns])
        apart = {(r.start, r.end) for r in found.apart.collect()}
        for pair in pairs:
            one = graph.join_path(nodes, edges, *pair)
            assert (pair in apart) == (not one.found)
            assert [hops.get(pair, {})[i] for i in sorted(hops.get(pair, {}))] == one.hops


def test_a_long_chain_is_met_in_the_middle(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(9)], "a INT, b INT")
    nodes = node_rows(spark.range(12).withColumnRenamed("id", "k"), "table", F.concat(F.lit("s.t"), F.col("k").cast("string")))
    edges = staged(edge_rows(pairs, "references", ("table", F.concat(F.lit("s.t"), "a")), ("table", F.concat(F.lit("s.t"), "b")), aggregate=F.lit(True)))
    at = {r.qname: r.id for r in nodes.collect()}
    asked = spark.createDataFrame([(at["s.t0"], at["s.t9"]), (at["s.t4"], at["s.t0"]), (at["s.t3"], at["s.t11"])], "start STRING, end STRING")
    found = graph.join_paths(nodes, edges, asked)
    name = {v: k for k, v in at.items()}
    assert [(name[r.a], name[r.b]) for r in found.hops.where(F.col("start") == at["s.t0"]).orderBy("hop").collect()] == [(f"s.t{i}", f"s.t{i + 1}") for i in range(9)]
    assert [(name[r.a], name[r.b]) for r in found.hops.where(F.col("start") == at["s.t4"]).orderBy("hop").collect()] == [(f"s.t{i}", f"s.t{i - 1}") for i in (4, 3, 2, 1)]
    assert [(name[r.start], name[r.end]) for r in found.apart.collect()] == [("s.t3", "s.t11")]
    assert graph.join_paths(nodes, edges, asked.limit(0)).hops.collect() == []


def test_starts_around_a_hub_dont_each_meet_the_others(spark, monkeypatch):
    n = 60
    pairs = spark.createDataFrame([*[(i, 100) for i in range(n)], *[(100 + i, 101 + i) for i in range(4)], (200, 201)], "a INT, b INT")
    nodes = node_rows(pairs.selectExpr("explode(array(a, b)) AS k").distinct(), "table", F.concat(F.lit("s.t"), "k"))
    edges = staged(edge_rows(pairs, "references", ("table", F.concat(F.lit("s.t"), "a")), ("table", F.concat(F.lit("s.t"), "b")), aggregate=F.lit(True)))
    at = {r.qname: r.id for r in nodes.collect()}
    sizes = []

    def counted(df):
        out = staged(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "staged", counted)
    found = graph.join_paths(nodes, edges, spark.createDataFrame([(at[f"s.t{i}"], at[end]) for i in range(n) for end in ("s.t104", "s.t200")], "start STRING, end STRING"))
    assert found.hops.count() == 5 * n and found.apart.count() == n
    assert max(sizes) <= 6 * n


def test_dead_ends_that_no_pair_asks_for_are_not_searched(spark, monkeypatch):
    """Two hubs between the ends, with dead ends around both; those that are asked for stay."""
    n = 50
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), *[(hub, 100 * hub + i) for hub in (1, 2) for i in range(n)]], "a INT, b INT")
    nodes = node_rows(pairs.selectExpr("explode(array(a, b)) AS k").distinct(), "table", F.concat(F.lit("s.t"), "k"))
    edges = staged(edge_rows(pairs, "references", ("table", F.concat(F.lit("s.t"), "a")), ("table", F.concat(F.lit("s.t"), "b")), aggregate=F.lit(True)))
    at = {r.qname: r.id for r in nodes.collect()}
    levels = []

    def counted(df):
        out = staged(df)
        if {"root", "node"} <= {*out.columns}:
            levels.append(out.count())
        return out

    monkeypatch.setattr(graph, "staged", counted)
    found = graph.join_paths(nodes, edges, spark.createDataFrame([(at["s.t0"], at["s.t3"]), (at["s.t100"], at["s.t3"]), (at["s.t0"], "no node")], "start STRING, end STRING"))
    name = {v: k for k, v in at.items()}
    way = {x: [(name[r.a], name[r.b]) for r in found.hops.where(F.col("start") == at[x]).orderBy("hop").collect()] for x in ("s.t0", "s.t100")}
    assert way == {x: [(x, "s.t1"), ("s.t1", "s.t2"), ("s.t2", "s.t3")] for x in way}
    assert [(name[r.start], r.end) for r in found.apart.collect()] == [("s.t0", "no node")]
    assert levels and max(levels) <= 6
