"""Queries of rules, orders, the store, its answers and its shapes; where an order is promised, rows come with their number."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.ids import node_id, stable_text
from lattica.model import COLUMN, CONSTRAINT, DEPENDENCY, PARAMETER, REF, TRIGGER, GraphError, Scope
from lattica.operators import graph, infer, normalize as norm, precheck, search as text_search, shape, sync as syncing
from lattica.operators.normalize import struct_of
from lattica.operators.store import SCHEMA_VERSION, GraphStore
from lattica.plans import api
from lattica.plans.cut import staged
from lattica.plans.numbering import number_sorted
from lattica.queries import ORACLE_SQL, data_graph, distinct_keys, edge_rows, named, new_store, node_rows, order_objects, order_states, query, table
from lattica.sources import mapping


def numbered(sorted_rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of a sorted frame with their place in it."""
    return number_sorted(sorted_rows.select(*columns), "place").select("place", *columns)


def lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "place INT, line STRING")


def place_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers, as data_graph has them."""
    nodes, edges = data_graph(spark, sf_dir)
    return nodes.where("kind IN ('table', 'view')"), edges.where("kind IN ('references', 'depends_on')")


# Rules of the normalizer


@query("""
SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'object without a name' ELSE 'foreign key with unlike numbers of columns' END AS problem
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderstatus = 'P'""")
def invalid_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are null or blank, and foreign keys whose two sides differ in length."""
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, "  ").otherwise(k.cast("string"))
    to = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))
    fk = struct_of(CONSTRAINT, name=F.lit("f"), type=F.lit("FK"), columns=F.array(F.lit("a")), references=F.struct(F.lit("s").alias("schema"), F.lit("t").alias("table"), to.alias("columns")))
    rows = table(spark, sf_dir, "orders").withColumn("pos", k)
    return norm.invalid(mapping.as_objects(rows, kind=F.lit("table"), schema=F.lit("s"), name=name, constraints=F.array(fk)).withColumnRenamed("__in", "pos"))


@query(r"""
WITH o AS (SELECT o_orderkey AS k, ['procedure', 'function', 'trigger', 'view'][o_orderkey % 4 + 1] AS kind, o_orderstatus AS st, 'x  ' || o_orderkey || '  ' || chr(10) AS body FROM orders)
SELECT kind || '.' || k AS name, CASE kind WHEN 'function' THEN 'metadata' ELSE 'full' END AS level, CASE WHEN kind <> 'function' THEN sha1('x  ' || k) END AS body_hash, CASE WHEN kind IN ('procedure', 'trigger') THEN 'x  ' || k END AS body,
  CASE WHEN kind <> 'view' THEN (st = 'F')::VARCHAR END AS dynamic, CASE WHEN kind IN ('procedure', 'function') AND st <> 'P' THEN 'a1|b2' END AS parameters, CASE WHEN kind = 'trigger' THEN 'AFTER:INSERT' END AS fired FROM o""")
def node_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload by kind: bodies of routines and triggers at level full, parameters in order and none if empty."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    kind = F.get(F.array(*[F.lit(x) for x in ("procedure", "function", "trigger", "view")]), (k % 4).cast("int"))
    params = F.when(status != "P", F.array(*[struct_of(PARAMETER, name=F.lit(n), data_type=F.lit("int"), direction=F.lit("in"), ordinal=F.lit(i)) for n, i in (("b", 2), ("a", 1))])).otherwise(F.array().cast(f"array<{PARAMETER}>"))
    info = struct_of(TRIGGER, timing=F.lit("AFTER"), events=F.array(F.lit("INSERT")), table=F.struct(F.lit("s").alias("schema"), F.lit("t").alias("name")))
    body = F.concat(F.lit("x  "), k, F.lit("  \n"))
    rows = mapping.as_objects(table(spark, sf_dir, "orders"), kind=kind, schema=kind, name=k.cast("string"), body=body, parameters=params, trigger=info, has_dynamic_sql=F.when(status == "F", F.lit(True)))
    nodes = norm.primary_nodes(norm.with_qname(rows.withColumnRenamed("__in", "pos")), Scope(levels={"procedures": "full", "functions": "metadata", "triggers": "full"}))
    shown = F.array_join(F.transform("payload.parameters", lambda p: F.concat(p["name"], p["ordinal"].cast("string"))), "|")
    fired = F.when(F.col("payload.timing").isNotNull(), F.concat_ws(":", "payload.timing", F.array_join("payload.events", "+")))
    return nodes.select(F.col("qname").alias("name"), "level", "body_hash", F.col("payload.body").alias("body"), F.col("payload.has_dynamic_sql").cast("string").alias("dynamic"), shown.alias("parameters"), fired.alias("fired"))


@query("""
SELECT 'v.' || l_orderkey AS view_name, string_agg(DISTINCT 'p' || l_partkey, '|' ORDER BY 'p' || l_partkey) AS columns FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'w.' || o_orderkey, NULL FROM orders""")
def dependency_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a dependency, sorted and distinct; absent where there are none."""
    column = F.concat(F.lit("p"), "l_partkey")
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(column).alias("c")).select(F.lit("v").alias("s"), "k", "c")
    none = table(spark, sf_dir, "orders").select(F.lit("w").alias("s"), F.col("o_orderkey").alias("k"), F.array().cast("array<string>").alias("c"))
    rows = used.unionByName(none)
    dep = struct_of(DEPENDENCY, target=struct_of(REF, schema=F.lit("main"), name=F.lit("t")), access=F.lit("read"), confidence=F.lit("parsed"), columns=F.col("c"))
    objects = norm.with_qname(mapping.as_objects(rows, kind=F.lit("view"), schema=F.col("s"), name=F.col("k").cast("string"), dependencies=F.array(dep)).withColumn("pos", F.col("name").cast("long") * 2 + (F.col("schema") == "w").cast("long")))
    real = node_rows(spark.range(1), "table", F.lit("main.t"))
    found, _ = norm.resolve(norm.references_of(objects), real, real.select("qname").limit(0))
    of = objects.select(node_id(F.col("kind"), F.col("qname")).alias("src"), F.col("qname").alias("view_name"))
    return norm.reference_edges(found).join(of, "src").select("view_name", F.array_join("attrs.dst_columns", "|").alias("columns"))


def nation_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw table for every nation, with a key and a column that is named after the regions' table, and that table."""
    n = table(spark, sf_dir, "nation")
    col = lambda name, i: struct_of(COLUMN, name=F.lit(name), data_type=F.lit("int"), nullable=F.lit(False), ordinal=F.lit(i))
    pk = struct_of(CONSTRAINT, name=F.lit("pk"), type=F.lit("PK"), columns=F.array(F.lit("id")))
    fk = struct_of(CONSTRAINT, name=F.lit("fk"), type=F.lit("FK"), columns=F.array(F.lit("boss")), references=F.struct(F.lit("geo").alias("schema"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1) % 25).alias("table"), F.array(F.lit("id")).alias("columns")))
    rows = mapping.as_objects(n, kind=F.lit("table"), schema=F.lit("geo"), name=F.concat(F.lit("n"), "n_nationkey"), columns=F.array(col("id", 0), col("boss", 1), col("region_id", 2)), constraints=F.array(pk, fk)).withColumn("pos", F.substring("name", 2, 9).cast("long"))
    one = mapping.as_objects(spark.range(1), kind=F.lit("table"), schema=F.lit("geo"), name=F.lit("regions"), columns=F.array(col("id", 0)), constraints=F.array(pk)).withColumn("pos", F.lit(1000).cast("long"))
    return rows.unionByName(one).drop("__in")


@query("SELECT 'asked' AS scope, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'not asked', 0")
def inference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References are only inferred where the scope asks for it, or where there are documents."""
    out = []
    for scope in (True, False):
        edges = norm.normalize(nation_objects(spark, sf_dir), "test", Scope(infer_relationships=scope)).edges
        out.append(edges.agg(F.count_if(F.col("kind") == "inferred_reference").alias("n")).select(F.lit("asked" if scope else "not asked").alias("scope"), "n"))
    return out[0].unionByName(out[1])


@query("""
WITH c AS (SELECT 'geo.n' || n_nationkey || '.region_id' AS src, sha1('column geo.n' || n_nationkey || '.region_id') AS id FROM nation),
r AS (SELECT src, id, sha1('column geo.regions.id') AS dst FROM c)
SELECT 'all' AS rule, row_number() OVER (ORDER BY id, dst) - 1 AS place, src, 1.0::DOUBLE AS score FROM r
UNION ALL SELECT 'columns of declared ones left out', row_number() OVER (ORDER BY id, dst) - 1, src, 1.0 FROM r WHERE src <> 'geo.n3.region_id'
UNION ALL SELECT 'sources of declared ones left out', row_number() OVER (ORDER BY id, dst) - 1, src, 1.0 FROM r WHERE src <> 'geo.n4.region_id'""")
def inferred_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred references in their order; columns that a declared reference starts from, or names, give none."""
    g = norm.normalize(nation_objects(spark, sf_dir), "test")
    nodes, names = g.nodes, g.nodes.select(F.col("id").alias("src"), F.col("qname"))
    one = spark.range(1)
    by_name = edge_rows(one, "references", ("table", F.lit("geo.n3")), ("table", F.lit("geo.regions")), src_column=F.lit("REGION_ID"), dst_column=F.lit("id"))
    by_id = edge_rows(one, "references", ("column", F.lit("geo.n4.region_id")), ("column", F.lit("geo.regions.id")))
    out = None
    for rule, edges, grain in (("all", by_name, False), ("columns of declared ones left out", by_name, True), ("sources of declared ones left out", by_id, False)):
        rows = numbered(infer.ordered_inferred(infer.infer_references(nodes, edges, column_grain_dedup=grain)), "src", "score").join(names, "src")
        rows = rows.select(F.lit(rule).alias("rule"), "place", F.col("qname").alias("src"), F.round("score", 6).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
WITH n AS (
  SELECT 'table' AS kind, 'region.' || r_regionkey AS qname FROM region UNION ALL SELECT 'table', 'nation.' || n_nationkey FROM nation UNION ALL SELECT 'view', 'customer.' || c_custkey FROM customer
  UNION ALL SELECT 'procedure', 'supplier.' || s_suppkey FROM supplier UNION ALL SELECT 'function', 'orders.' || o_orderkey FROM orders
) SELECT row_number() OVER (ORDER BY kind, qname, sha1(kind || ' ' || qname)) - 1 AS place, kind, qname FROM n""")
def nodes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(norm.ordered_nodes(data_graph(spark, sf_dir)[0]), "kind", "qname")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, sha1('table orders.' || l_orderkey) AS src, sha1('table part.' || l_partkey) AS dst FROM lineitem),
e AS (SELECT DISTINCT src, dst, 'FK_' || l_linenumber AS con, 'L_' || l_linenumber AS col, sha1('references ' || src || ' ' || dst || ' L_' || l_linenumber || '>id') AS id FROM l
  UNION SELECT DISTINCT src, dst, 'FK_' || l_linenumber, '', sha1('references ' || src || ' ' || dst || ' aggregate') FROM l)
SELECT row_number() OVER (ORDER BY src, dst, con, col, id) - 1 AS place, src, dst, con, col FROM e""")
def edges_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by both ends, then constraint and column."""
    refs = norm.references_of(distinct_keys(order_objects(spark, sf_dir)))
    real = node_rows(table(spark, sf_dir, "part"), "table", named("part", "p_partkey"))
    found, _ = norm.resolve(refs, real, real.select("qname").limit(0))
    return numbered(norm.ordered_edges(norm.reference_edges(found)), "src", "dst", "attrs").select("place", "src", "dst", F.col("attrs.constraint_name").alias("con"), F.coalesce("attrs.src_column", F.lit("")).alias("col"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE '{"a":[' || o_orderkey || ',null,{"p":"' || o_orderpriority || '","q":false}],"b":{"x":"é' || o_orderstatus || '","y":true},"ba":-1}' END AS text FROM orders""")
def stable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys sorted at every depth, no blanks, letters as they are; what isn't JSON gives nothing."""
    k = F.col("o_orderkey").cast("string")
    said = F.concat(F.lit('{ "ba": -1, "b" :{"y":true ,"x":"\\u00e9'), "o_orderstatus", F.lit('"},\n"a":['), k, F.lit(', null, {"q":false,"p":"'), "o_orderpriority", F.lit('"}]}'))
    cut = F.when(F.col("o_orderkey") % 9 == 0, F.substring(said, 1, 30)).otherwise(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(stable_text(cut), F.lit("none")).alias("text"))


# Graph


@query("""
WITH e AS (SELECT 'depends_on' AS edge_kind, 'in' AS direction, 'customer.' || c_custkey AS qname FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT 'writes_to', 'in', 'supplier.' || s_suppkey FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'references', 'out', 'region.' || n_regionkey FROM nation WHERE n_nationkey = 3)
SELECT row_number() OVER (ORDER BY edge_kind, direction, qname) - 1 AS place, * FROM e""")
def neighbors_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbours of one nation."""
    hub = spark.range(1).select(node_id(F.lit("table"), F.lit("nation.3"))).first()[0]
    return numbered(graph.neighbors(*data_graph(spark, sf_dir), hub), "edge_kind", "direction", "qname")


@query("""
SELECT 'from' AS side, 'region.' || n_regionkey AS qname FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'from', 'nation.' || n_nationkey FROM nation WHERE n_nationkey = -1
UNION ALL SELECT 'to', 'part.' || p_partkey FROM part WHERE p_size = 7""")
def no_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no route links two tables, what each of them is linked with."""
    nodes, edges = place_graph(spark, sf_dir)
    p = table(spark, sf_dir, "part").where("p_size = 7")
    nodes = nodes.unionByName(node_rows(p, "table", named("part", "p_partkey"))).unionByName(node_rows(spark.range(1), "table", F.lit("main.sizes")))
    whole = edge_rows(table(spark, sf_dir, "nation"), "references", ("table", named("nation", "n_nationkey")), ("table", named("region", "n_regionkey")), aggregate=F.lit(True))
    edges = whole.unionByName(edge_rows(p, "references", ("table", named("part", "p_partkey")), ("table", F.lit("main.sizes")), aggregate=F.lit(True)))
    a, b = (spark.range(1).select(node_id(F.lit("table"), F.lit(x))).first()[0] for x in ("nation.3", "main.sizes"))
    found = graph.join_path(nodes, edges, a, b)
    rows = [("from", i) for i in found.from_neighbors] + [("to", i) for i in found.to_neighbors]
    return spark.createDataFrame(rows, "side STRING, id STRING").join(nodes.select("id", "qname"), "id").select("side", "qname")


@query("""
SELECT 'customer.' || c_custkey AS qname, 'one' AS query, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 'body' WHEN c_mktsegment = 'BUILDING' THEN 'comment' ELSE 'qname' END AS matched FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'customer.' || c_custkey, 'two', CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'body' ELSE 'comment' END FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0
UNION ALL SELECT 'customer.' || c_custkey, 'two, each in its column', CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 'body' WHEN c_mktsegment = 'BUILDING' THEN 'comment' ELSE 'qname' END FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0
UNION ALL SELECT 'customer.' || c_custkey, 'name', 'qname' FROM customer WHERE c_custkey = 7""")
def matched_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a match is told to be: in the body, else the comment, else the name; only the first term is bound to the column."""
    k, building = F.col("c_custkey"), F.col("c_mktsegment") == "BUILDING"
    view = F.when(building & (k % 2 == 0), "the Building,").otherwise("nothing")
    note = F.concat_ws(" ", F.when(building & (k % 2 == 1), "a building"), F.lit("here"))
    c = table(spark, sf_dir, "customer").withColumn("third", F.when(k % 3 == 0, F.lit("triple")).otherwise(""))
    nodes = node_rows(c, "view", named("customer", "c_custkey"), body=view, comment=note, definition=F.col("third"))
    nodes = nodes.withColumn("qname", F.when(F.col("payload.definition") != "", F.concat("qname", F.lit(" triple"))).otherwise(F.col("qname")))
    docs = staged(text_search.index(text_search.text_rows(nodes)))
    names = nodes.select("id", F.split_part("qname", F.lit(" "), F.lit(1)).alias("qname"))
    out = None
    for name, text, exact in (("one", "BUILDING", False), ("two", "building triple", False), ("two, each in its column", "building triple", True), ("name", "customer.7", False)):
        hits = text_search.search(docs, text, limit=None, exact_column=exact).join(names, "id").select("qname", F.lit(name).alias("query"), "matched")
        out = hits if out is None else out.unionByName(hits)
    return out


@query("""
SELECT 'matched' AS part, row_number() OVER (ORDER BY q) - 1 AS place, q AS qname FROM (SELECT 'nation.' || n_nationkey AS q FROM nation WHERE n_nationkey < 4 UNION ALL SELECT 'region.1')
UNION ALL SELECT 'unmatched', row_number() OVER (ORDER BY q) - 1, q FROM (VALUES ('gone.b'), ('main.nowhere'), ('x')) v(q)
UNION ALL SELECT 'test', row_number() OVER (ORDER BY q) - 1, q FROM (SELECT DISTINCT q FROM (
  SELECT 'nation.' || n_nationkey AS q FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT 'customer.' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 OR n_nationkey < 4 UNION ALL SELECT 'supplier.' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 OR n_nationkey < 4
  UNION ALL SELECT 'orders.' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 OR n_nationkey < 4))""")
def precheck_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a script touches, each once, those that nothing is named, and all that should be tested."""
    nodes, edges = data_graph(spark, sf_dir)
    ddl = "ALTER TABLE [Region].[1] ADD COLUMN x; " + "".join(f'alter table "nation".{i} drop column X; ' for i in (3, 2, 1, 0, 3)) + "create index gone.b on main.nowhere"
    p = precheck.precheck(nodes, edges, ddl)
    parts = [numbered(df, c).select(F.lit(part).alias("part"), "place", F.col(c).alias("qname")) for part, df, c in (("matched", p.matched, "qname"), ("unmatched", p.unmatched, "name"), ("test", p.what_to_test, "qname"))]
    none = precheck.precheck(nodes, edges, "")
    empty = none.matched.select(F.lit("empty").alias("part"), F.lit(0).cast("long").alias("place"), "qname").unionByName(none.what_to_test.select(F.lit("empty").alias("part"), F.lit(0).cast("long").alias("place"), "qname"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(empty)


# Store


@query("""
SELECT 'all nodes' AS what, row_number() OVER (ORDER BY q, sha1(k || ' ' || q)) - 1 AS place, q AS qname FROM (SELECT 'table' AS k, 'nation.' || n_nationkey AS q FROM nation UNION ALL SELECT 'table', 'region.' || r_regionkey FROM region UNION ALL SELECT 'view', 'customer.' || c_custkey FROM customer)
UNION ALL SELECT 'by kind', row_number() OVER (ORDER BY q) - 1, q FROM (SELECT 'nation.' || n_nationkey AS q FROM nation UNION ALL SELECT 'region.' || r_regionkey FROM region)
UNION ALL SELECT 'by name', 0, 'nation.3' UNION ALL SELECT 'by id', 0, 'region.1'
UNION ALL SELECT 'all edges', row_number() OVER (ORDER BY kind, sha1(a), sha1(b)) - 1, split_part(a, ' ', 2) FROM (
  SELECT 'references' AS kind, 'table nation.' || n_nationkey AS a, 'table region.' || n_regionkey AS b FROM nation UNION ALL SELECT 'depends_on', 'view customer.' || c_custkey, 'table nation.' || c_nationkey FROM customer)""")
def store_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written graph read back: whole, in order, and by kind, name and id."""
    store = new_store(spark)
    store.replace(*place_graph(spark, sf_dir))
    one = spark.range(1).select(node_id(F.lit("table"), F.lit("region.1"))).first()[0]
    names = store.nodes.select(F.col("id").alias("src"), "qname")
    parts = [(w, numbered(df, "qname")) for w, df in (("all nodes", store.all_nodes()), ("by kind", store.nodes_by_kind("table")), ("by name", store.node_by_qname("table", "NATION.3")), ("by id", store.node(one)))]
    parts.append(("all edges", numbered(store.all_edges(), "src").join(names, "src").select("place", "qname")))
    out = [df.select(F.lit(w).alias("what"), "place", "qname") for w, df in parts]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


@query("""
SELECT 'orders.' || o_orderkey AS qname, CASE WHEN o_orderstatus = 'F' THEN 'x' || o_orderkey ELSE '' END AS body, o_orderpriority AS comment FROM orders WHERE o_orderstatus <> 'P'""")
def text_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search sees: nothing of objects that are off, names and comments of others, bodies at level full."""
    o = table(spark, sf_dir, "orders")
    nodes = node_rows(o, "procedure", named("orders", "o_orderkey"), body=F.concat(F.lit("x"), "o_orderkey"), comment=F.col("o_orderpriority"), method=F.col("o_orderstatus"))
    level = F.when(F.col("payload.method") == "F", "full").when(F.col("payload.method") == "O", "metadata").otherwise("off")
    store = new_store(spark)
    store.upsert(nodes.withColumn("level", level))
    return store.text().select("qname", "body", "comment")


@query("""
SELECT 1 AS seq, 'orders.' || o_orderkey AS qname, row_number() OVER (ORDER BY 'orders.' || o_orderkey) - 1 AS place, '1' AS mark FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 2, 'orders.' || o_orderkey, row_number() OVER (ORDER BY 'orders.' || o_orderkey) - 1, '2' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0""")
def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots with their manifests of visible objects, and what was noted besides."""
    store = new_store(spark)
    o = table(spark, sf_dir, "orders")
    nodes = node_rows(o, "view", named("orders", "o_orderkey"), missing=F.col("o_orderstatus") == "O", method=F.col("o_orderstatus"), comment=(F.col("o_orderkey") % 3).cast("string"))
    store.upsert(nodes.withColumn("excluded", F.col("payload.method") == "P"))
    ids = [store.take_snapshot("test", None, "f1")]
    store.delete(store.nodes.where("payload.comment = '0'").select("id"))
    ids.append(store.take_snapshot("test", "9", "f2"))
    store.set_meta("mark", "0")
    out = None
    for r in store.snapshots().collect():
        store.set_meta("mark", str(int(store.meta("mark")) + 1))
        rows = numbered(store.snapshot_objects(r.id), "qname").select(F.lit(r.seq).cast("int").alias("seq"), "qname", "place", F.lit(store.meta("mark")).alias("mark"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
SELECT 'newer' AS store, 'refused' AS outcome, 0::BIGINT AS words UNION ALL SELECT 'same', 'opened', 0 UNION ALL SELECT 'none yet', 'opened', 0
UNION ALL SELECT 'older', 'opened', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that a newer library wrote isn't opened; an older one, without an index of words, gets it."""
    out = []
    for name, version in (("newer", SCHEMA_VERSION + 1), ("same", SCHEMA_VERSION), ("none yet", None), ("older", 2)):
        store, words = new_store(spark), 0
        if name == "older":  # of before the log, where a table of records named folders
            place_graph(spark, sf_dir)[0].where("kind = 'table'").write.partitionBy("kind").parquet(f"{store.path}/nodes/first")
            spark.createDataFrame([("nodes", 1, "first", version)], "table STRING, version LONG, folder STRING, schema_version INT").write.parquet(f"{store.path}/_commits")
        elif version is not None:
            store._log.put(1, {"schema": version, "base": {}, "delta": {}, "add": {}, "merged": {}, "touched": None, "scopes": [], "whole": False})
        try:
            opened = GraphStore(spark, store.path)
            words = opened.read("lengths").count() if name == "older" else 0
            out.append((name, "opened", words))
        except GraphError:
            out.append((name, "refused", words))
    return spark.createDataFrame(out, "store STRING, outcome STRING, words LONG")


@query("""
SELECT 'whole words' AS query, count(*)::BIGINT AS hits, 0::BIGINT AS unlike FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F'
UNION ALL SELECT 'phrase', count(*), 0 FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' UNION ALL SELECT 'beginnings', count(*), 0 FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') UNION ALL SELECT 'nothing', 0, 0""")
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of the kept words, after changes: how many hits, and how many differ from a search of all texts."""
    store, o = new_store(spark), table(spark, sf_dir, "orders")
    nodes = node_rows(o, "procedure", named("orders", "o_orderkey"), body=F.concat_ws(" ", F.lit("Order of"), "o_orderpriority"), comment=F.when(F.col("o_orderstatus") == "F", "finished"))
    stale = nodes.withColumn("payload", F.col("payload").withField("body", F.lit("urgent urgent stale")))
    store.upsert(stale.where("payload.comment IS NULL").unionByName(node_rows(spark.range(1), "procedure", F.lit("gone.1"), body=F.lit("urgent"))))
    store.apply(nodes, spark.range(1).select(node_id(F.lit("procedure"), F.lit("gone.1")).alias("id")))
    docs, out = staged(text_search.index(store.text())), []
    for name, query_, prefix in (("whole words", "urgent finished", False), ("phrase", "not-specified", False), ("beginnings", "urg lo", True), ("nothing", "stale", False)):
        own, plain = (r.select("id", F.round("score", 9).alias("score"), "matched", "total") for r in (store.search(query_, limit=None, prefix=prefix), text_search.search(docs, query_, limit=None, prefix=prefix)))
        out.append((name, *hits_and_unlike(own, plain)))
    return spark.createDataFrame(out, "query STRING, hits LONG, unlike LONG")


def hits_and_unlike(own: DataFrame, plain: DataFrame) -> tuple[int, int]:
    """How many rows own has, and how many one of the two has more often than the other; both are worked out once."""
    both = own.withColumn("__own", F.lit(1)).unionByName(plain.withColumn("__own", F.lit(-1)))
    rows = both.groupBy(*own.columns).agg(F.count_if(F.col("__own") > 0).alias("hits"), F.abs(F.sum("__own")).alias("unlike"))
    return tuple(rows.agg(F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum("unlike"), F.lit(0))).first())


@query("""
WITH n AS (SELECT o_orderkey AS k FROM orders), v AS (SELECT unnest(range(1, 5)) AS version)
SELECT version::INT AS version, part, count(*)::BIGINT AS nodes, sum(k)::BIGINT AS keys FROM (
  SELECT version, CASE WHEN version >= 2 AND k % 7 = 0 AND NOT (version >= 4 AND k % 5 = 0) THEN 'changed' WHEN version >= 4 AND k % 5 = 0 THEN 'again' ELSE 'first' END AS part, k FROM v, n WHERE NOT (version >= 3 AND k % 11 = 0) OR (version >= 4 AND k % 5 = 0)) GROUP BY version, part
UNION ALL SELECT version, 'edges', count(*), sum(k) FROM v, n WHERE NOT (version >= 3 AND k % 11 = 0) GROUP BY version
UNION ALL SELECT 5, CASE WHEN k % 5 = 0 THEN 'again' WHEN k % 7 = 0 THEN 'changed' ELSE 'first' END AS part, count(*), sum(k) FROM n WHERE k % 11 <> 0 OR k % 5 = 0 GROUP BY part
UNION ALL SELECT 5, 'edges', count(*), sum(k) FROM n WHERE k % 11 <> 0""")
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after each of four changes, of which each wrote its own rows alone, and after those were put together."""
    store, k = new_store(spark), F.substring_index("qname", ".", -1).cast("long")
    o = table(spark, sf_dir, "orders")
    nodes = node_rows(o, "view", named("orders", "o_orderkey"), comment=F.lit("first"))
    edges = edge_rows(o, "depends_on", ("view", named("orders", "o_orderkey")), ("table", named("customer", "o_custkey")))
    said = lambda x: nodes.withColumn("payload", F.col("payload").withField("comment", F.lit(x)))
    store.upsert(nodes, edges)
    store.upsert(said("changed").where(k % 7 == 0))
    store.delete(nodes.where(k % 11 == 0).select("id"))
    store.upsert(said("again").where(k % 5 == 0))
    names = nodes.select(F.col("id").alias("src"), k.alias("k"))

    def state(version: int, at: int | None) -> DataFrame:
        parts = store.read("nodes", at).groupBy(F.col("payload.comment").alias("part")).agg(F.count("*").alias("nodes"), F.sum(k).alias("keys"))
        links = store.read("edges", at).join(names, "src").groupBy(F.lit("edges").alias("part")).agg(F.count("*").alias("nodes"), F.sum("k").alias("keys"))
        return parts.unionByName(links).select(F.lit(version).alias("version"), "part", "nodes", "keys")

    out = [state(v, v) for v in range(1, 5)]
    for t in ("nodes", "edges"):
        store.compact(t, whole=True)
    for more in (*out[1:], state(5, None)):
        out[0] = out[0].unionByName(more)
    return out[0]


@query(ORACLE_SQL["manifest_diff"])
def stored_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What manifest_diff finds, between two snapshots of a store; buckets that are alike aren't read."""
    before, after = order_states(spark, sf_dir)
    store = new_store(spark)
    store.upsert(before)
    first = store.take_snapshot("test", None, "a")
    store.apply(after, before.join(after, "id", "left_anti").select("id"))
    return store.difference(first, store.take_snapshot("test", None, "b")).select("qname", "change")


def view_objects(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Orders as raw views over customers' tables; later some are gone, some new, some changed."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    o = o.where(k % 10 != (2 if later else 1))
    body = F.concat("o_orderpriority", F.when((k % 7 == 0) & F.lit(later), F.lit(" changed")).otherwise(F.lit("")))
    dep = struct_of(DEPENDENCY, target=struct_of(REF, schema=F.lit("customer"), name=F.col("o_custkey").cast("string")), access=F.lit("read"), confidence=F.lit("parsed"))
    return mapping.as_objects(o, kind=F.lit("view"), schema=F.lit("orders"), name=k.cast("string"), body=body, dependencies=F.array(dep)).withColumn("pos", F.col("name").cast("long")).drop("__in")


@query("""
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 2),
ca AS (SELECT DISTINCT o_custkey FROM a), cb AS (SELECT DISTINCT o_custkey FROM b),
n AS (SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM ca) AS first, (SELECT count(*) FROM b WHERE o_orderkey % 10 = 1 OR o_orderkey % 7 = 0) + (SELECT count(*) FROM cb WHERE o_custkey NOT IN (SELECT o_custkey FROM ca)) AS again,
  (SELECT count(*) FROM a WHERE o_orderkey % 10 = 2) + (SELECT count(*) FROM ca WHERE o_custkey NOT IN (SELECT o_custkey FROM cb)) AS gone)
SELECT 'first: upserted' AS what, first::BIGINT AS n FROM n UNION ALL SELECT 'second: upserted', again FROM n UNION ALL SELECT 'second: deleted', gone FROM n UNION ALL SELECT 'same state: changed', 0 UNION ALL SELECT 'snapshots', 2
UNION ALL SELECT 'edges', (SELECT count(*) FROM b) UNION ALL SELECT 'views', (SELECT count(*) FROM b) UNION ALL SELECT 'stubs', (SELECT count(*) FROM cb) UNION ALL SELECT 'commits of a sync', 1""")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first sync, one after changes and one without any: what each did, and what the store holds then."""
    store = new_store(spark)
    first = syncing.sync(store, view_objects(spark, sf_dir, False), "test", "a")
    before = store.version
    second = syncing.sync(store, view_objects(spark, sf_dir, True), "test", "b")
    after = store.version
    third = syncing.sync(store, view_objects(spark, sf_dir, True), "test", "b")
    rows = [("first: upserted", first.upserted), ("second: upserted", second.upserted), ("second: deleted", second.deleted), ("same state: changed", int(third.changed)), ("snapshots", store.snapshots().count()), ("commits of a sync", after - before)]
    rows += [("edges", store.edges.count()), ("views", store.nodes.where("NOT missing").count()), ("stubs", store.nodes.where("missing").count())]
    return spark.createDataFrame(rows, "what STRING, n LONG")


@query("""
SELECT CASE WHEN o_orderkey % 10 = 1 THEN 'added' WHEN o_orderkey % 10 = 2 THEN 'removed' ELSE 'changed' END AS change, 'orders.' || o_orderkey AS qname, 'ok' AS state FROM orders WHERE o_orderkey % 10 IN (1, 2) OR o_orderkey % 7 = 0
UNION ALL SELECT '', '', 'too_few' UNION ALL SELECT '', '', 'no_manifest'""")
def last_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two snapshots compared; with fewer, or without a manifest, there is only a state."""
    store = new_store(spark)
    syncing.sync(store, view_objects(spark, sf_dir, False), "test", "a")
    few, _ = syncing.diff_last(store)
    syncing.sync(store, view_objects(spark, sf_dir, True), "test", "b")
    state, changes = syncing.diff_last(store)
    bare = new_store(spark)
    for mark in "ab":
        bare.take_snapshot("test", None, mark)
    none, _ = syncing.diff_last(bare)
    states = spark.createDataFrame([("", "", few), ("", "", none)], "change STRING, qname STRING, state STRING")
    return changes.select("change", "qname", F.lit(state).alias("state")).unionByName(states)


# Shapes


@query("""
WITH n AS (SELECT 'table' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'column', count(*) FROM customer UNION ALL SELECT 'constraint', count(*) FROM orders UNION ALL SELECT 'view', count(*) FROM supplier)
SELECT 'default' AS option, kind, n::BIGINT AS n FROM n WHERE kind IN ('table', 'view') UNION ALL SELECT 'columns', kind, n FROM n WHERE kind <> 'constraint' UNION ALL SELECT 'full', kind, n FROM n
UNION ALL SELECT 'kinds', kind, n FROM n WHERE kind = 'column' UNION ALL SELECT 'schema', kind, n FROM n WHERE kind = 'view'""")
def kept_by_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each kind stay, by option."""
    n, c, o, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "supplier"))
    nodes = node_rows(n, "table", named("nation", "n_nationkey")).unionByName(node_rows(c, "column", named("customer", "c_custkey"))).unionByName(node_rows(o, "constraint", named("orders", "o_orderkey"))).unionByName(node_rows(s, "view", named("supplier", "s_suppkey"), schema=F.lit("other")))
    edges = edge_rows(c, "has_column", ("table", named("nation", "c_nationkey")), ("column", named("customer", "c_custkey")))
    out = None
    for name, options in (("default", {}), ("columns", {"columns": True}), ("full", {"full": True}), ("kinds", {"kinds": ["column"]}), ("schema", {"schema": "other"})):
        rows = shape.collapse(nodes, edges, **options)[0].groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(name).alias("option"), "kind", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def stars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A star for every customer, of the orders that read it."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nodes = node_rows(c, "view", named("customer", "c_custkey"), schema=F.lower("c_mktsegment")).unionByName(node_rows(o, "function", named("orders", "o_orderkey"), schema=F.lit("orders")))
    return nodes, edge_rows(o, "reads_from", ("function", named("orders", "o_orderkey")), ("view", named("customer", "o_custkey")))


_STARS_SQL = """
WITH m AS (SELECT c_custkey AS star, 'customer.' || c_custkey AS qname, 'view' AS kind, sha1('view customer.' || c_custkey) AS id, lower(c_mktsegment) AS schema FROM customer
  UNION ALL SELECT o_custkey, 'orders.' || o_orderkey, 'function', sha1('function orders.' || o_orderkey), 'orders' FROM orders),
s AS (SELECT star, min(id) AS first, count(*) AS n, min(schema) FILTER (schema <> 'orders') AS own FROM m GROUP BY star),
g AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS community FROM s)
"""


@query(_STARS_SQL + "SELECT community, CASE WHEN n = 1 THEN own WHEN n = 2 THEN least(own, 'orders') ELSE 'orders' END AS name, n::BIGINT AS count FROM g")
def star_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label propagation makes one community of each star, numbered by its first member and named after its commonest schema."""
    return shape.communities(*map(staged, stars(spark, sf_dir)))[1]


@query(_STARS_SQL + """, d AS (SELECT m.qname, m.kind, g.community, row_number() OVER (ORDER BY qname, id) - 1 AS i, CASE WHEN kind = 'view' THEN g.n - 1 ELSE 1 END AS degree, m.star FROM m JOIN g USING (star))
SELECT 'node' AS what, i AS a, community AS b, degree::BIGINT AS c, qname AS label, kind FROM d
UNION ALL SELECT 'edge', row_number() OVER (ORDER BY x.i, y.i) - 1, x.i, y.i, '', 'reads_from' FROM d x JOIN d y ON x.star = y.star AND x.kind = 'function' AND y.kind = 'view'""")
def star_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a viewer draws: nodes by name with degree and community, and edges between their numbers, in order."""
    nodes, drawn, _ = shape.data_block(*stars(spark, sf_dir))
    nodes = nodes.select(F.lit("node").alias("what"), F.col("i").alias("a"), F.col("community").alias("b"), F.col("degree").alias("c"), "label", "kind")
    edges = number_sorted(drawn, "place").select(F.lit("edge").alias("what"), F.col("place").alias("a"), F.col("s").alias("b"), F.col("t").alias("c"), F.lit("").alias("label"), "kind")
    return nodes.unionByName(edges)


# Answers


def answering(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> api.GraphApi:
    store = new_store(spark)
    store.replace(nodes, edges)
    return api.GraphApi(store)


def _lines_sql(*parts: str) -> str:
    """Numbered lines of parts (order, line), with the blank line that ends a text."""
    return "SELECT (row_number() OVER (ORDER BY part, nth) - 1)::INT AS place, line FROM (" + " UNION ALL ".join(f"SELECT {i} AS part, * FROM ({p}) t{i}(nth, line)" for i, p in enumerate((*parts, "VALUES ('', ''), (' ', '')"))) + ")"


@query(_lines_sql("VALUES ('', 'nation.3  [table]')", "VALUES ('', repeat('─', 17))", "SELECT '', '  ' || rpad('depends_on', 22, ' ') || ' ' || count(*) || ' in' FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0", "VALUES ('', '  ' || rpad('references', 22, ' ') || ' 1 out')", "SELECT '', '  ' || rpad('writes_to', 22, ' ') || ' ' || count(*) || ' in' FROM supplier WHERE s_nationkey = 3 HAVING count(*) > 0"))
def explored_in_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, answering(spark, *data_graph(spark, sf_dir)).explore("Nation.3", "brief"))


@query(_lines_sql(
    "VALUES ('', 'geo.n3  [table]')", "VALUES ('', repeat('─', 15))", "VALUES ('', '')", "VALUES ('a', 'COLUMNS'), ('b', '  id  int  [PK]'), ('c', '  boss  int  [FK→geo.n4]  [NN]'), ('d', '  region_id  int  [NN]')", "VALUES ('', '')",
    "VALUES ('a', 'CONSTRAINTS'), ('b', '  [FK]  fk  (boss → geo.n4)'), ('c', '  [PK]  pk  (id)')",
    "VALUES ('a', ''), ('b', '  has_column'), ('c', '    out:'), ('d', '      → geo.n3.boss  [column]'), ('e', '      → geo.n3.id  [column]'), ('f', '      → geo.n3.region_id  [column]')",
    "VALUES ('a', ''), ('b', '  has_constraint'), ('c', '    out:'), ('d', '      → geo.n3.fk  [constraint]'), ('e', '      → geo.n3.pk  [constraint]')",
    "VALUES ('a', ''), ('b', '  references'), ('c', '    out:'), ('d', '      → geo.n4  [table]'), ('e', '    in:')", "SELECT 'n' || n_nationkey, '      ← geo.n' || n_nationkey || '  [table]' FROM nation WHERE (n_nationkey + 1) % 25 = 3",
))
def explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with the marks of its columns, its constraints and all its neighbours."""
    g = norm.normalize(nation_objects(spark, sf_dir), "test")
    return lines(spark, answering(spark, g.nodes, g.edges).explore("geo.n3"))


@query(_lines_sql(
    "VALUES ('', 'IMPACT: region.1  [table]')", "VALUES ('', repeat('─', 23))", "VALUES ('a', ''), ('b', 'READ IMPACT')",
    "SELECT '1' || sha1('table nation.' || n_nationkey), '  region.1 → nation.' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '2' || sha1('table nation.' || n_nationkey) || sha1('view customer.' || c_custkey), '  region.1 → nation.' || n_nationkey || ' → customer.' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
    "VALUES ('a', ''), ('b', 'WRITE IMPACT')", "SELECT '2' || sha1('table nation.' || n_nationkey) || sha1('procedure supplier.' || s_suppkey), '  region.1 → nation.' || n_nationkey || ' → supplier.' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1",
    "VALUES ('a', ''), ('b', '  ⚠  Result truncated at depth limit — full impact may be larger')",
))
def impact_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains by access, in the order of discovery, and that more lies beyond."""
    return lines(spark, answering(spark, *data_graph(spark, sf_dir)).impact("region.1", depth=2))


@query(_lines_sql("VALUES ('', 'PATH: geo.n3  →  geo.n5')", "VALUES ('', repeat('─', 20))", "SELECT n_nationkey::VARCHAR || x, CASE x WHEN 0 THEN '  geo.n' || n_nationkey || '  →  geo.n' || (n_nationkey + 1) ELSE '      JOIN ON geo.n' || n_nationkey || '.boss = geo.n' || (n_nationkey + 1) || '.id' END FROM nation, (VALUES (0), (1)) v(x) WHERE n_nationkey IN (3, 4)"))
def path_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = norm.normalize(nation_objects(spark, sf_dir), "test")
    return lines(spark, answering(spark, g.nodes, g.edges).path("geo.n3", "geo.n5"))


@query("""SELECT command, code::INT AS code FROM (VALUES ('explore nation.3', 0), ('explore nowhere', 1), ('impact region.1', 0), ('search zzzzzzzzzzzz', 1), ('related', 2), ('--help', 0)) v(command, code)""")
def command_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of commands that find something, find nothing, or can't be understood."""
    store = answering(spark, *place_graph(spark, sf_dir)).store
    out = []
    for command in ("explore nation.3", "explore nowhere", "impact region.1", "search zzzzzzzzzzzz", "related", "--help"):
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            out.append((command, int(api.main(["--store", store.path, *command.split()]))))
    return spark.createDataFrame(out, "command STRING, code INT")


__all__ = ["nation_objects", "new_store", "numbered", "stars"]
