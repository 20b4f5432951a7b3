"""Registered queries look at all rows of their tables."""

from lattica import queries


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def test_core_of_all_parts(spark, tmp_path):
    links = [(p, s) for p in range(1, 31) for s in range(1, 29)] + [(31, s) for s in range(1, 26)] + [(p, 29) for p in range(1, 26)]
    sf = write(spark, tmp_path, part=([(p,) for p in range(1, 33)], "p_partkey LONG"), supplier=([(s,) for s in range(1, 31)], "s_suppkey LONG"), lineitem=(links * 2, "l_partkey LONG, l_suppkey LONG"))
    nodes, left = {*[("part", p) for p, _ in links], *[("supplier", s) for _, s in links]}, set(links)
    while True:
        keep = {(k, x) for k, x in nodes if sum(e[k == "supplier"] == x for e in left) >= 26}
        left = {(p, s) for p, s in left if ("part", p) in keep and ("supplier", s) in keep}
        if keep == nodes:
            break
        nodes = keep
    assert len(nodes) == 58
    assert sorted(r.qname for r in queries.degree_kcore(spark, sf).collect()) == sorted(f"{k}.{x}" for k, x in nodes)


def test_communities_and_view_of_all_kinds(spark, tmp_path):
    sf = write(
        spark, tmp_path, region=([(0,), (1,)], "r_regionkey LONG"), nation=([(n, n % 2) for n in range(4)], "n_nationkey LONG, n_regionkey LONG"),
        customer=([(c, c % 4) for c in range(12)], "c_custkey LONG, c_nationkey LONG"), supplier=([(s, s % 4) for s in range(6)], "s_suppkey LONG, s_nationkey LONG"),
        orders=([(o, o % 9, "F") for o in range(40)], "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING"),
    )
    found = queries.label_propagation(spark, sf).collect()
    assert sum(r["count"] for r in found) == 2 + 4 + 12 + 6 + 40
    drawn = queries.viewer_data(spark, sf).collect()
    assert sorted(r.i for r in drawn) == list(range(64))
    assert {k: sum(r.kind == k for r in drawn) for k in ("table", "view", "procedure", "function")} == {"table": 6, "view": 12, "procedure": 6, "function": 40}
    assert sum(r.degree for r in drawn) == 2 * (4 + 12 + 6 + 40)
    assert {r.community for r in drawn} == {r.community for r in found}
