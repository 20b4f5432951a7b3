import json

import pytest
from pyspark.sql import functions as F

from lattica.functions.ids import stable_json
from lattica.model import GraphError, Scope
from lattica.operators import graph, infer, precheck, scoring, search, shape, snapshot
from lattica.operators.normalize import normalize
from lattica.operators.store import GraphStore
from lattica.operators.sync import diff_last, drift, sync
from lattica.plans import api, present
from lattica.plans.cut import staged
from lattica.sources import catalog, mapping
from lattica.streaming import feed
from tests.fixtures import sqlite_file


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    found = catalog.read_sqlite(spark, sqlite_file(tmp_path_factory.mktemp("db") / "shop.db"))
    g = normalize(mapping.map_sqlite(found), "sqlite")
    return staged(g.nodes), staged(g.edges), g


def qnames(rows, kind=None):
    return sorted(r.qname for r in rows.collect() if kind is None or r.kind == kind)


def ids_of(nodes, *names):
    return nodes.where(F.col("qname").isin(*names) & F.col("kind").isin("table", "view", "column")).select("id")


def names(nodes):
    return {r.id: r.qname for r in nodes.collect()}


def edge_set(nodes, edges, kind):
    n = names(nodes)
    return {(n[r.src], n[r.dst]) for r in edges.where(F.col("kind") == kind).collect()}


def test_catalog_becomes_graph(shop):
    nodes, edges, g = shop
    kinds = {r.kind: r.n for r in snapshot.kind_counts(nodes).collect()}
    assert kinds == {"table": 5, "view": 2, "trigger": 3, "column": 15, "constraint": 8, "index": 4}
    assert g.stubs.count() == 0 and g.warnings.count() == 0 and g.omitted == ()
    assert edge_set(nodes, edges, "fires_on") == {("main.tr_people_added", "main.people"), ("main.tr_people_moved", "main.people"), ("main.tr_busy", "main.busy_people")}
    assert edge_set(nodes, edges, "writes_to") == {("main.tr_people_added", "main.log_lines"), ("main.tr_people_moved", "main.teams"), ("main.tr_busy", "main.people")}
    assert edge_set(nodes, edges, "depends_on") == {("main.busy_people", "main.people"), ("main.busy_people", "main.shifts"), ("main.team_sizes", "main.people")}
    refs = edges.where("kind = 'references'")
    assert refs.where("attrs.aggregate").count() == 2 and refs.where("NOT coalesce(attrs.aggregate, false)").count() == 3
    assert edges.where("kind = 'in_index'").count() == 4  # the expression gives none
    assert edges.select("id").distinct().count() == edges.count()
    known = {r.id for r in nodes.select("id").collect()}
    assert all(r.src in known and r.dst in known for r in edges.collect())
    pk = nodes.where("qname = 'main.lonely.pk_lonely'").first()
    assert pk.payload.columns == ["b", "a"]


def test_impact_path_and_neighbors(shop):
    nodes, edges, _ = shop
    n = names(nodes)
    found = graph.impact(nodes, edges, ids_of(nodes, "main.people"))
    chains = {tuple(n[i] for i in r.nodes): r.access for r in found.chains.collect()}
    assert chains == {
        ("main.people", "main.busy_people"): "read", ("main.people", "main.team_sizes"): "read", ("main.people", "main.shifts"): "read", ("main.people", "main.tr_busy"): "write",
    }
    assert found.truncated.count() == 0 and found.degraded.count() == 0
    by = {v: k for k, v in n.items()}
    path = graph.join_path(nodes, edges, by["main.shifts"], by["main.teams"])
    assert [(n[a], n[b], c) for a, b, c in path.hops] == [("main.shifts", "main.people", [("person_id", "person_id"), ("team_id", "team_id")]), ("main.people", "main.teams", [("team_id", "team_id")])]
    none = graph.join_path(nodes, edges, by["main.people"], by["main.lonely"])
    assert not none.found and sorted(n[i] for i in none.from_neighbors) == ["main.shifts", "main.teams"] and none.to_neighbors == []
    assert graph.join_path(nodes, edges, by["main.teams"], by["main.teams"]).found
    near = graph.neighbors(nodes, edges, by["main.teams"], ("references",)).collect()
    assert {(r.direction, r.qname) for r in near} == {("in", "main.people")}


def make(spark, links, dynamic=()):
    """A graph of nodes a, b, ... with links (kind, src, dst[, columns])."""
    from lattica.queries import edge_rows, node_rows

    rows = spark.createDataFrame([(*x, None) if len(x) == 3 else x for x in links], "kind STRING, src STRING, dst STRING, cols ARRAY<STRING>")
    ends = rows.select(F.col("src").alias("n")).union(rows.select("dst")).distinct()
    nodes = node_rows(ends, "table", F.col("n"), has_dynamic_sql=F.col("n").isin(*dynamic))
    edges = None
    for kind in {x[0] for x in links}:
        part = edge_rows(rows.where(F.col("kind") == kind), kind, ("table", F.col("src")), ("table", F.col("dst")), dst_columns=F.col("cols"))
        edges = part if edges is None else edges.unionByName(part)
    return staged(nodes), staged(edges)


def impact_chains(nodes, edges, start, depth=3):
    n = names(nodes)
    found = graph.impact(nodes, edges, nodes.where(F.col("qname") == start).select("id"), depth)
    return {n[r.node]: ([n[i] for i in r.nodes], list(r.kinds), r.access) for r in found.chains.collect()}, found


def test_impact_ties_cycles_and_depth(spark):
    nodes, edges = make(spark, [("reads_from", "p", "t"), ("writes_to", "p", "t"), ("calls", "q", "p"), ("reads_from", "t", "q"), ("reads_from", "far", "q"), ("references", "further", "far")], dynamic=["q"])
    chains, found = impact_chains(nodes, edges, "t")
    assert chains["p"] == (["t", "p"], ["reads_from"], "read")  # the smaller kind of two parallel edges
    assert set(chains) == {"p", "q", "far"} and chains["far"][0] == ["t", "p", "q", "far"]
    assert found.truncated.count() == 1
    n = names(nodes)
    assert [n[r.id] for r in found.degraded.collect()] == ["q"]
    assert impact_chains(nodes, edges, "t", 9)[1].truncated.count() == 0
    diamond, links = make(spark, [("reads_from", "x", "t"), ("reads_from", "y", "t"), ("writes_to", "z", "x"), ("reads_from", "z", "y")])
    chains, _ = impact_chains(diamond, links, "t")
    by = {v: k for k, v in names(diamond).items()}
    first = min("xy", key=lambda c: by[c])
    assert chains["z"][0] == ["t", first, "z"]


def test_impact_only_follows_its_kinds(spark):
    nodes, edges = make(spark, [("fires_on", "trg", "t"), ("has_index", "t2", "t"), ("in_index", "i", "t"), ("inferred_reference", "j", "t")])
    assert impact_chains(nodes, edges, "t")[0] == {}


def test_precheck_and_identifiers(shop):
    nodes, edges, _ = shop
    p = precheck.precheck(nodes, edges, 'ALTER TABLE [main].[people] ADD COLUMN x; DROP INDEX "ux" ON main.teams; drop index a.b')
    assert qnames(p.matched) == ["main.people", "main.teams"]
    got = {(r.bucket, r.qname) for r in p.affected.collect()}
    assert ("triggers", "main.tr_people_moved") in got and ("triggers", "main.tr_busy") in got and ("readers", "main.shifts") in got and ("readers", "main.people") in got
    assert [r.name for r in p.unmatched.collect()] == ["a.b", "ux", "x"]
    assert qnames(p.what_to_test) == sorted({q for _, q in got})


def test_search_and_typos(shop):
    nodes, _, _ = shop
    docs = search.index(search.text_rows(nodes))
    hits = search.search(docs, "people", limit=50).join(nodes.select("id", "qname", "kind"), "id").collect()
    assert {"main.people", "main.people.mail", "main.tr_busy"} <= {r.qname for r in hits}
    assert {r.qname: r.matched for r in hits}["main.tr_people_added"] == "body" and {r.qname: r.matched for r in hits}["main.people"] == "qname"
    assert all(r.total == len(hits) for r in hits)
    assert not any(r.kind == "view" and r.qname == "main.team_sizes" for r in hits)  # a view's body isn't searched
    assert search.search(docs, "peopl").count() == 0 and search.search(docs, "peopl", prefix=True).count() > 0
    assert search.search(docs, "full_name").count() == search.search(docs, "FULL_name").count() > 0
    assert search.search(docs, "  ").count() == 0
    page = search.search(docs, "people", limit=3, offset=2).collect()
    assert len(page) == 3
    near = search.suggestions(nodes, "peopel").collect()
    assert near[0].qname == "main.people" and near[0].distance == 2
    assert len(search.suggestions(nodes, "x").collect()) <= 5


def test_ranking_formula(spark):
    import math

    rows = [("1", "a", "", "red red blue"), ("2", "b", "", "blue"), ("3", "c", "red", "green"), ("4", "d", "", "grün"), ("5", "e", "", "")]
    docs = search.index(spark.createDataFrame(rows, "id STRING, qname STRING, comment STRING, body STRING"))
    got = {r.id: r.score for r in search.search(docs, "red").collect()}
    lens, tf = {"1": 4, "2": 2, "3": 3, "4": 2, "5": 1}, {"1": 2, "3": 1}
    idf, avg = math.log((5 - 2 + 0.5) / 2.5), sum(lens.values()) / 5
    for i, f in tf.items():
        assert got[i] == pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lens[i] / avg)))
    assert [r.id for r in search.search(docs, "GRUN").collect()] == ["4"]
    assert [r.id for r in search.search(docs, "red.blue").collect()] == ["1"]


def test_shaping(shop):
    nodes, edges, _ = shop
    kept, links = shape.collapse(nodes, edges)
    assert {r.kind for r in kept.collect()} == {"table", "view"}
    n = names(nodes)
    pairs = {(r.kind, n[r.src], n[r.dst]) for r in links.collect()}
    assert ("writes_to", "main.people", "main.log_lines") in pairs and ("references", "main.people", "main.teams") in pairs  # triggers fold into their tables
    assert all(a != b for _, a, b in pairs)
    few, _ = shape.collapse(nodes, edges, min_degree=1)
    assert "main.lonely" not in qnames(few)
    of, named = shape.communities(kept, links)
    groups = {r["name"]: r["count"] for r in named.collect()}
    assert sum(groups.values()) == 7 and groups.get("lonely") == 1 and of.count() == 7
    i, e, _ = shape.data_block(nodes, edges)
    assert [r.i for r in i.collect()] == list(range(7)) and e.count() == links.count()
    text = list(shape.entity_diagram(nodes, edges))
    assert text[:3] == ["erDiagram", '    "main.log_lines" {', "    }"] and text[-2:] == ['    "main.people" ||--o{ "main.shifts" : references', '    "main.teams" ||--o{ "main.people" : references']


def test_label_propagation_is_sequential(spark):
    import random

    rng = random.Random(3)
    links = sorted({tuple(sorted(rng.sample("abcdefghijklmnop", 2))) for _ in range(22)})
    nodes, edges = make(spark, [("references", a, b) for a, b in links])
    of, _ = shape.communities(nodes, edges)
    n = names(nodes)
    order = sorted(n)
    label = {i: k for k, i in enumerate(order)}
    by = {v: k for k, v in n.items()}
    around = {i: [] for i in order}
    for a, b in links:
        around[by[a]].append(by[b])
        around[by[b]].append(by[a])
    for _ in range(100):
        moved = False
        for i in order:
            votes = [label[j] for j in around[i]]
            new = min(set(votes), key=lambda x: (-votes.count(x), x))
            moved |= new != label[i]
            label[i] = new
        if not moved:
            break
    number = {}
    want = {i: number.setdefault(label[i], len(number)) for i in order}
    assert {r.id: r.community for r in of.collect()} == want


def test_store_sync_and_diff(spark, tmp_path, shop):
    store = GraphStore(spark, str(tmp_path / "store"))
    db = tmp_path / "a.db"
    found = catalog.read_sqlite(spark, sqlite_file(db))
    first = sync(store, mapping.map_sqlite(found), "sqlite", "f1")
    assert first.changed and first.upserted == 37 and store.nodes.count() == 37
    assert not sync(store, mapping.map_sqlite(found), "sqlite", "f1").changed
    assert not drift(store, "f1") and drift(store, "f2")
    assert diff_last(store)[0] == "too_few"
    import sqlite3

    con = sqlite3.connect(db)
    con.executescript("DROP VIEW team_sizes; CREATE VIEW team_sizes AS SELECT 1; CREATE TABLE fresh (x INT); DROP TABLE lonely;")
    con.close()
    second = sync(store, mapping.map_sqlite(catalog.read_sqlite(spark, str(db))), "sqlite", "f2")
    assert second.changed and second.deleted == 4
    state, changes = diff_last(store)
    got = {(r.change, r.qname) for r in changes.collect()}
    assert state == "ok" and ("changed", "main.team_sizes") in got and ("added", "main.fresh") in got and ("removed", "main.lonely") in got
    assert edge_set(store.nodes, store.edges, "depends_on") == {("main.busy_people", "main.people"), ("main.busy_people", "main.shifts")}
    same = snapshot.manifest(store.nodes, "x")
    assert snapshot.diff(same, same).count() == 0
    store.set_meta("k", "v")
    store.set_meta("k", "w")
    assert store.meta("k") == "w" and store.meta("none") is None
    assert GraphStore(spark, str(tmp_path / "store")).snapshots().count() == 2
    gone = store.nodes.where("qname = 'main.people'").select("id")
    assert store.delete(gone) == 1 and store.delete(gone) == 0
    assert not [e for e in edge_set(store.nodes, store.edges, "references")]
    assert store.node_by_qname("table", "MAIN.teams").count() == 1 and qnames(store.nodes_by_kind("table")) == ["main.fresh", "main.log_lines", "main.shifts", "main.teams"]


def test_change_feed(spark, tmp_path, shop):
    nodes, edges, _ = shop
    store = GraphStore(spark, str(tmp_path / "store"))
    store.replace(nodes, edges)
    one = nodes.where("qname = 'main.busy_people'").withColumn("body_hash", F.lit("new"))
    rows = one.select("*", F.lit("upsert").alias("op"), F.lit(2).cast("long").alias("seq")).unionByName(one.select("*", F.lit("delete").alias("op"), F.lit(1).cast("long").alias("seq")))
    rows = rows.unionByName(nodes.where("qname = 'main.lonely'").select("*", F.lit("delete").alias("op"), F.lit(1).cast("long").alias("seq")))
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    for _ in range(2):
        feed.start(feed.read_feed(spark, str(tmp_path / "in")), store, str(tmp_path / f"cp{_}")).awaitTermination()
    assert store.nodes.where("body_hash = 'new'").count() == 1 and store.nodes.where("qname = 'main.lonely'").count() == 0 and store.nodes.count() == nodes.count() - 1


def test_inference(spark):
    raw = {"engine": "mongodb", "objects": [
        {"kind": "collection", "schema": "db", "name": "orders", "fields": [{"name": n, "dataType": t, "frequency": 1.0} for n, t in (("_id", "objectId"), ("customerId", "objectId"), ("id_product", "objectId"), ("box_id", "string"))]},
        {"kind": "collection", "schema": "db", "name": "customers", "fields": [{"name": "_id", "dataType": "objectId", "frequency": 1.0}]},
        {"kind": "collection", "schema": "db", "name": "products", "fields": [{"name": "_id", "dataType": "objectId", "frequency": 1.0}], "constraints": [{"name": "pk", "type": "PK", "columns": ["_id"]}]},
        {"kind": "collection", "schema": "db", "name": "boxes", "fields": [{"name": "_id", "dataType": "objectId", "frequency": 1.0}]},
    ]}
    engine, objects = catalog_of(spark, raw)
    g = normalize(objects, engine)
    g.nodes, g.edges = staged(g.nodes), staged(g.edges)
    n = names(g.nodes)
    got = {(n[r.src], n[r.dst]): round(r.score, 9) for r in g.edges.where("kind = 'inferred_reference'").collect()}
    assert got == {("db.orders.customerId", "db.customers._id"): 0.8, ("db.orders.id_product", "db.products._id"): 0.9}
    assert infer.infer_references(g.nodes, g.edges, threshold=0.85).count() == 1
    by = {v: k for k, v in n.items()}
    assert not graph.join_path(g.nodes, g.edges, by["db.customers"], by["db.products"]).found
    path = graph.join_path(g.nodes, g.edges, by["db.customers"], by["db.products"], allow_inferred=True)
    assert path.inferred and [(n[a], n[b], c) for a, b, c in path.hops] == [("db.customers", "db.orders", [("_id", "customerId")]), ("db.orders", "db.products", [("id_product", "_id")])]


def catalog_of(spark, raw):
    import tempfile
    from pathlib import Path

    path = Path(tempfile.mkdtemp()) / "catalog.json"
    path.write_text(json.dumps(raw))
    return catalog.read_raw_catalog(spark, str(path))


def test_normalizer_rules(spark):
    fk = {"name": "FK", "type": "FK", "columns": ["b_id"], "references": {"schema": "x", "table": "hidden", "columns": ["id"]}}
    raw = {"engine": "mssql", "objects": [
        {"kind": "table", "schema": "[X]", "name": '"A"', "columns": [{"name": "B_ID", "dataType": "int", "nullable": True, "ordinal": 1}, {"name": "b_id", "dataType": "int", "nullable": True, "ordinal": 2}], "constraints": [fk], "indexes": []},
        {"kind": "table", "schema": "x", "name": "a", "comment": "again"},
        {"kind": "table", "schema": "x", "name": "hidden"},
        {"kind": "procedure", "schema": "x", "name": "p", "body": "a  \r\nb\n", "parameters": [{"name": "two", "dataType": "int", "direction": "in", "ordinal": 2}, {"name": "one", "dataType": "int", "direction": "out", "ordinal": 1}],
         "dependencies": [{"target": {"schema": "x", "name": "gone"}, "access": "write", "confidence": "parsed", "columns": ["z", "y", "z"]}, {"target": {"schema": "x", "name": "nobody", "kind": "function"}, "access": "read", "confidence": "declared"}]},
        {"kind": "trigger", "schema": "x", "name": "t", "trigger": {"timing": "AFTER", "events": ["INSERT", "UPDATE"], "table": {"schema": "x", "name": "v"}}},
        {"kind": "view", "schema": "x", "name": "v", "body": "select 1", "dependencies": [{"target": {"schema": "x", "name": "a"}, "access": "read", "confidence": "parsed"}]},
    ]}
    engine, objects = catalog_of(spark, raw)
    g = normalize(objects, engine, Scope(levels={"procedures": "full", "sequences": "off"}, exclude=("X.hidden",)))
    assert [w.warning for w in g.warnings.collect()] == ["Duplicate column skipped: column:x.a.b_id", "Duplicate object skipped: table:x.a"]
    n = names(g.nodes)
    assert {(r.qname, r.reason, n[r.referenced_by]) for r in g.stubs.collect()} == {("x.hidden", "excluded", "x.a"), ("x.gone", "missing", "x.p")}
    p = g.nodes.where("qname = 'x.p'").first()
    assert p.payload.body == "a\nb" and [x.name for x in p.payload.parameters] == ["one", "two"] and p.payload.has_dynamic_sql is False
    w = g.edges.where("kind = 'writes_to'").first()
    assert w.attrs.dst_columns == ["y", "z"] and w.confidence == "parsed"
    assert edge_set(g.nodes, g.edges, "fires_on") == {("x.t", "x.v")} and g.edges.where("kind = 'fires_on'").count() == 2
    assert edge_set(g.nodes, g.edges, "depends_on") == {("x.v", "x.a")} and g.edges.where("kind = 'calls'").count() == 0
    assert g.nodes.where("qname = 'x.v'").first().payload.body is None and g.nodes.where("qname = 'x.v'").first().body_hash is not None
    assert g.omitted == (("sequence", "not indexed by configuration"),)
    again = normalize(objects.repartition(3), engine, Scope(levels={"procedures": "full", "sequences": "off"}, exclude=("X.hidden",)))
    assert sorted(r.id for r in again.edges.collect()) == sorted(r.id for r in g.edges.collect())
    bad = json.loads(json.dumps(raw))
    bad["objects"][0]["constraints"][0]["columns"] = ["a", "b"]
    with pytest.raises(GraphError):
        normalize(catalog_of(spark, bad)[1], engine)
    with pytest.raises(GraphError):
        normalize(objects, "")


def test_answers(spark, tmp_path, shop):
    nodes, edges, _ = shop
    store = GraphStore(spark, str(tmp_path / "s"))
    store.replace(nodes, edges)
    store.take_snapshot("sqlite", None, "f", "2026-01-01T00:00:00.000Z")
    ask = api.GraphApi(store)
    assert ask.object("main.people").splitlines()[:8] == [
        "main.people  [table]  [4 idx, 2 trg!]", "─" * 20, "", "COLUMNS", "  person_id  INTEGER  [PK]", "  full_name  TEXT  [NN]", "  mail  TEXT", "  team_id  INTEGER  [FK→main.teams]  [NN]",
    ]
    assert "JOIN ON main.people.team_id = main.teams.team_id" in ask.path("main.people", "main.teams")
    assert "No join path" in ask.path("main.people", "main.lonely") and "same node" in ask.path("main.teams", "main.teams")
    assert "READ IMPACT\n  main.people → " in ask.impact("main.people") and "READ impact:   3 chains" in ask.impact("main.people", detail="brief")
    assert "TRIGGERS FIRING" in ask.precheck("alter table main.people add column x", "full") and "x  (no matching graph node)" in ask.precheck("alter table main.people add column x", "full")
    assert "(matched: body)" in ask.search("people", detail="full") and "[table]  main.people" in ask.search("peopel") and "No results" in ask.search("zzzzzzzzzz")
    assert "Drift:      none detected" in ask.status("f") and "table               5" in ask.status() and "never" not in ask.status()
    for detail in present.DETAILS:
        assert ask.explore("main.people", detail) and ask.related("main.people", detail) and ask.object("main.tr_busy", detail)
    with pytest.raises(GraphError):
        ask.explore("main.nothing")
    assert api.main(["--store", str(tmp_path / "s"), "search", "people"]) == 0
    assert api.main(["--store", str(tmp_path / "s"), "explore", "nope"]) == 1
    assert api.main(["--store", str(tmp_path / "s"), "nonsense"]) == 2
    assert api.main(["--store", str(tmp_path / "s2"), "sync", "sqlite", sqlite_file(tmp_path / "x.db")]) == 0


def test_configuration(monkeypatch):
    s = api.parse_source({"dialect": "pg", "location": "jdbc:x", "user": "u", "passwordEnv": "SECRET_OF_TEST", "levels": {"tables": "off"}, "exclude": ["a.*"]})
    assert s.scope.level("table") == "off" and s.scope.exclude == ("a.*",)
    with pytest.raises(GraphError):
        s.properties()
    monkeypatch.setenv("SECRET_OF_TEST", "p")
    assert s.properties() == {"user": "u", "password": "p"}
    for bad in ({"dialect": "oracle", "location": ""}, {"dialect": "pg", "location": "", "password": "x"}, {"dialect": "pg", "location": "", "levels": {"tables": "some"}}):
        with pytest.raises(GraphError):
            api.parse_source(bad)
    assert stable_json({"b": [2, {"d": 1, "c": None}], "a": "é"}) == '{"a":"é","b":[2,{"c":null,"d":1}]}'


def test_questions(shop):
    nodes, edges, _ = shop
    assert {(r.object): r.key for r in scoring.trigger_questions(nodes, edges).collect()} == {"main.people": ["main.tr_people_added", "main.tr_people_moved"], "main.busy_people": ["main.tr_busy"]}
    assert {r.object: r.key for r in scoring.view_questions(nodes, edges).collect()}["main.busy_people"] == ["main.people", "main.shifts"]
    assert {r.object: r.key for r in scoring.key_questions(nodes).collect()}["main.lonely"] == ["b", "a"]
    assert scoring.caller_questions(nodes, edges).count() == 0 and scoring.blind_spots(nodes).count() == 0
