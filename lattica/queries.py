"""One query for each operator family over the test tables, with its SQL.

Catalog operators run on graphs and row families that are derived from whole tables: rows become nodes, keys become edges,
and names, bodies and types are built from columns, so the same plans run at any scale.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import naming, text
from lattica.functions.ids import canonical_qname, edge_id, node_id
from lattica.model import COLUMN, CONSTRAINT, DEPENDENCY, INDEX, PAYLOAD, REF, TRIGGER, Scope
from lattica.operators import graph, infer, normalize as norm, precheck, sampling, scoring, search as text_search, shape, snapshot
from lattica.operators.normalize import struct_of
from lattica.operators.store import GraphStore
from lattica.plans import hot
from lattica.plans.cut import shared_folder, staged
from lattica.sources import catalog, mapping

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_store(spark: SparkSession) -> GraphStore:
    return GraphStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def node_rows(df: DataFrame, kind: str, qname: Column, name: Column | None = None, schema: Column | None = None, body_hash: Column | None = None, level: str = "full", missing: Column | None = None, **payload: Column) -> DataFrame:
    q = F.lower(qname)
    return df.select(
        node_id(F.lit(kind), q).alias("id"), F.lit(kind).alias("kind"), (F.lit("data") if schema is None else schema).alias("schema"), (text.local_name(q) if name is None else name).alias("name"), q.alias("qname"), F.lit(level).alias("level"),
        (F.lit(False) if missing is None else missing).alias("missing"), F.lit(False).alias("excluded"), (F.lit(None).cast("string") if body_hash is None else body_hash).alias("body_hash"), struct_of(PAYLOAD, **payload).alias("payload"),
    )


def edge_rows(df: DataFrame, kind: str, src: tuple[str, Column], dst: tuple[str, Column], **attrs: Column) -> DataFrame:
    a, b = (node_id(F.lit(k), F.lower(q)) for k, q in (src, dst))
    return norm.make_edges(df, F.lit(kind), a, b, **attrs)


def named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + "."), F.col(key).cast("string"))


def data_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions and nations (tables), customers (views), suppliers (procedures), orders (functions) and what links them."""
    r, n, c, s, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders"))
    nodes = node_rows(r, "table", named("region", "r_regionkey"))
    for df, kind, q, payload in (
        (n, "table", named("nation", "n_nationkey"), {}), (c, "view", named("customer", "c_custkey"), {}), (s, "procedure", named("supplier", "s_suppkey"), {}),
        (o, "function", named("orders", "o_orderkey"), {"has_dynamic_sql": F.col("o_orderstatus") == "F"}),
    ):
        nodes = nodes.unionByName(node_rows(df, kind, q, **payload))
    edges = edge_rows(n, "references", ("table", named("nation", "n_nationkey")), ("table", named("region", "n_regionkey")), src_column=F.lit("n_regionkey"), dst_column=F.lit("r_regionkey"))
    edges = edges.unionByName(edge_rows(c, "depends_on", ("view", named("customer", "c_custkey")), ("table", named("nation", "c_nationkey"))))
    edges = edges.unionByName(edge_rows(s, "writes_to", ("procedure", named("supplier", "s_suppkey")), ("table", named("nation", "s_nationkey"))))
    return nodes, edges.unionByName(edge_rows(o, "reads_from", ("function", named("orders", "o_orderkey")), ("view", named("customer", "o_custkey"))))


# Identity


@query("SELECT n_nationkey, 'tpch.' || lower(n_name) AS qname, sha1('table ' || 'tpch.' || lower(n_name)) AS id FROM nation")
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = canonical_qname(F.lit("[TPCH]"), F.concat(F.lit('"'), "n_name", F.lit('"')))
    return table(spark, sf_dir, "nation").select("n_nationkey", q.alias("qname"), node_id(F.lit("table"), q).alias("id"))


@query("SELECT c_custkey, sha1('references ' || sha1('view customer.' || c_custkey) || ' ' || sha1('table nation.' || c_nationkey) || ' c_nationkey>n_nationkey') AS id FROM customer")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = node_id(F.lit("view"), named("customer", "c_custkey")), node_id(F.lit("table"), named("nation", "c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", edge_id(F.lit("references"), a, b, F.lit("c_nationkey>n_nationkey")).alias("id"))


@query("""
SELECT kind, count(*)::BIGINT AS n FROM (SELECT 'table' AS kind FROM region UNION ALL SELECT 'table' FROM nation UNION ALL SELECT 'view' FROM customer
  UNION ALL SELECT 'procedure' FROM supplier UNION ALL SELECT 'function' FROM orders) GROUP BY kind""")
def nodes_by_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.kind_counts(data_graph(spark, sf_dir)[0])


# Graph queries


@query("""
WITH e AS (
  SELECT 'nation.' || n_nationkey AS src, 'region.' || n_regionkey AS dst, 'references' AS k FROM nation
  UNION ALL SELECT 'customer.' || c_custkey, 'nation.' || c_nationkey, 'depends_on' FROM customer
  UNION ALL SELECT 'supplier.' || s_suppkey, 'nation.' || s_nationkey, 'writes_to' FROM supplier
), b AS (SELECT src AS node, k AS edge_kind, 'out' AS direction, dst AS other FROM e UNION ALL SELECT dst, k, 'in', src FROM e)
SELECT node, edge_kind, direction, count(*)::BIGINT AS n, min(other) AS first FROM b WHERE node LIKE 'nation.%' GROUP BY ALL""")
def neighbors_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = data_graph(spark, sf_dir)
    index = graph.neighbor_groups(graph.neighbor_index(nodes, edges))
    own = nodes.where("startswith(qname, 'nation.')").select(F.col("id").alias("node"), F.col("qname").alias("name"))
    return index.join(own, "node").select(F.col("name").alias("node"), "edge_kind", "direction", F.size("neighbors").cast("long").alias("n"), F.col("neighbors")[0]["qname"].alias("first"))


_IMPACT_SQL = """
WITH n AS (SELECT 'region.' || n_regionkey AS start, 'read' AS access, 1 AS depth, n_nationkey FROM nation),
c AS (SELECT n.start, 'read' AS access, 2 AS depth, c_custkey FROM customer JOIN n ON c_nationkey = n_nationkey),
s AS (SELECT n.start, 'write' AS access, 2 AS depth FROM supplier JOIN n ON s_nationkey = n_nationkey),
o AS (SELECT c.start, 'read' AS access, 3 AS depth, o_orderstatus FROM orders JOIN c ON o_custkey = c_custkey)
"""


@query(_IMPACT_SQL + "SELECT start, access, depth, count(*)::BIGINT AS n FROM (SELECT start, access, depth FROM n UNION ALL SELECT start, access, depth FROM c UNION ALL SELECT * FROM s UNION ALL SELECT start, access, depth FROM o) GROUP BY ALL")
def impact_region_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = data_graph(spark, sf_dir)
    pivots = nodes.where("startswith(qname, 'region.')").select("id", F.col("qname").alias("name"))
    chains = graph.impact(nodes, edges, pivots.select("id")).chains
    return chains.join(pivots, F.col("pivot") == F.col("id")).groupBy(F.col("name").alias("start"), "access", "depth").agg(F.count("*").alias("n"))


@query(_IMPACT_SQL + "SELECT DISTINCT start FROM o")
def impact_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = data_graph(spark, sf_dir)
    pivots = nodes.where("startswith(qname, 'region.')").select("id", F.col("qname").alias("name"))
    cut = graph.impact(nodes, edges, pivots.select("id"), depth=2).truncated
    return cut.join(pivots, F.col("pivot") == F.col("id")).select(F.col("name").alias("start"))


@query(_IMPACT_SQL + "SELECT start, count(*)::BIGINT AS n FROM o WHERE o_orderstatus = 'F' GROUP BY start")
def impact_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = data_graph(spark, sf_dir)
    pivots = nodes.where("startswith(qname, 'region.')").select("id", F.col("qname").alias("name"))
    found = graph.impact(nodes, edges, pivots.select("id")).degraded
    return found.join(pivots.select(F.col("id").alias("pivot"), "name"), "pivot").groupBy(F.col("name").alias("start")).agg(F.count("*").alias("n"))


@query("""
WITH uses AS (
  SELECT o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT'
) SELECT CASE WHEN o_orderstatus = 'O' THEN 'unnamed' ELSE 'named' END AS how, count(*)::BIGINT AS n FROM uses GROUP BY how""")
def impact_column_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column's impact: views that name it, or name no columns at all; those that name others are left out."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    one = spark.range(1)
    nodes = node_rows(one, "table", F.lit("main.customer")).unionByName(node_rows(one, "column", F.lit("main.customer.c_custkey"))).unionByName(node_rows(o, "view", named("orders", "o_orderkey")))
    cols = F.when(F.col("o_orderstatus") != "O", F.array(F.lit("C_CUSTKEY"), F.lit("c_name"))).when(F.col("o_orderpriority") != "1-URGENT", F.array(F.lit("c_name")))
    edges = edge_rows(one, "has_column", ("table", F.lit("main.customer")), ("column", F.lit("main.customer.c_custkey")))
    edges = edges.unionByName(edge_rows(o, "depends_on", ("view", named("orders", "o_orderkey")), ("table", F.lit("main.customer")), dst_columns=cols))
    chains = graph.impact(nodes, edges, nodes.where("kind = 'column'").select("id")).chains
    names = nodes.select(F.col("id").alias("node"), "qname").join(o.select(named("orders", "o_orderkey").alias("qname"), "o_orderstatus"), "qname")
    how = F.when(F.col("o_orderstatus") == "O", "unnamed").otherwise("named")
    return chains.join(names, "node").groupBy(how.alias("how")).agg(F.count("*").alias("n"))


def row_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and orders as tables, each with a reference to the one above it."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    nodes, edges = node_rows(r, "table", named("region", "r_regionkey")), None
    for df, child, key, parent, up, to in ((n, "nation", "n_nationkey", "region", "n_regionkey", "r_regionkey"), (c, "customer", "c_custkey", "nation", "c_nationkey", "n_nationkey"), (o, "orders", "o_orderkey", "customer", "o_custkey", "c_custkey")):
        nodes = nodes.unionByName(node_rows(df, "table", named(child, key)))
        ends = ("table", named(child, key)), ("table", named(parent, up))
        for extra in ({"aggregate": F.lit(True)}, {"src_column": F.lit(up), "dst_column": F.lit(to)}):
            rows = edge_rows(df, "references", *ends, **extra)
            edges = rows if edges is None else edges.unionByName(rows)
    return nodes, edges


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and parts as tables, with a reference for each line item."""
    objects = distinct_keys(order_objects(spark, sf_dir))
    parts = node_rows(table(spark, sf_dir, "part"), "table", named("part", "p_partkey"))
    found, _ = norm.resolve(norm.references_of(objects), parts, parts.select("qname").limit(0))
    orders = node_rows(table(spark, sf_dir, "lineitem").select("l_orderkey").distinct(), "table", named("orders", "l_orderkey"))
    return orders.unionByName(parts), norm.reference_edges(found)


def distinct_keys(objects: DataFrame) -> DataFrame:
    """Objects, each of its own name, whose line items may repeat a key: every key once, so no two edges are the same."""
    return objects.withColumn("constraints", F.array_distinct("constraints"))


@query("""
WITH o AS (SELECT min(o_orderkey) AS k FROM orders), w AS (SELECT o_orderkey AS k, c_custkey AS c, c_nationkey AS n, n_regionkey AS r FROM orders JOIN o ON o_orderkey = k JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT 0 AS hop, 'region.' || r || '.r_regionkey=nation.' || n || '.n_regionkey' AS columns FROM w UNION ALL SELECT 1, 'nation.' || n || '.n_nationkey=customer.' || c || '.c_nationkey' FROM w
UNION ALL SELECT 2, 'customer.' || c || '.c_custkey=orders.' || k || '.o_custkey' FROM w""")
def join_path_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join path from a region down to the first order of its customers."""
    nodes, edges = row_links(spark, sf_dir)
    first = table(spark, sf_dir, "orders").agg(F.min_by(F.struct("o_orderkey", "o_custkey"), "o_orderkey").alias("o")).select("o.*")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    ends = first.join(c, first.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).select(node_id(F.lit("table"), named("region", "n_regionkey")), node_id(F.lit("table"), named("orders", "o_orderkey"))).first()
    found = graph.join_path(nodes, edges, *ends)
    hops = spark.createDataFrame([(i, a, b, x, y) for i, (a, b, cols) in enumerate(found.hops) for x, y in cols], "hop INT, a STRING, b STRING, x STRING, y STRING")
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("qname").alias(f"{c}_name"))
    return hops.join(of("a"), "a").join(of("b"), "b").select("hop", F.concat("a_name", F.lit("."), "x", F.lit("="), "b_name", F.lit("."), "y").alias("columns"))


@query("""
WITH RECURSIVE up AS (SELECT 'customer.' || c_custkey AS a, 'nation.' || c_nationkey AS b, 'c_nationkey=n_nationkey' AS x, 'n_nationkey=c_nationkey' AS y FROM customer UNION ALL SELECT 'nation.' || n_nationkey, 'region.' || n_regionkey, 'n_regionkey=r_regionkey', 'r_regionkey=n_regionkey' FROM nation),
link AS (SELECT a, b, x FROM up UNION ALL SELECT b, a, y FROM up),
walk(start, node, trail, seen, n) AS (SELECT 'customer.' || c_custkey, 'customer.' || c_custkey, '', ['customer.' || c_custkey], 0 FROM customer
  UNION ALL SELECT start, b, trail || ' ' || a || '>' || b || ':' || x, list_append(seen, b), n + 1 FROM walk JOIN link ON a = node WHERE n < 3 AND NOT list_contains(seen, b) AND b NOT LIKE 'customer.%'),
best AS (SELECT start, node, min(n) AS n, arg_min(trail, n) AS trail FROM walk WHERE node LIKE 'nation.%' GROUP BY start, node)
SELECT 'customer.' || c_custkey AS start, 'nation.' || n_nationkey AS finish, coalesce(n, 0)::INT AS hops, coalesce(trim(trail), 'none') AS trail
FROM customer CROSS JOIN nation LEFT JOIN best ON start = 'customer.' || c_custkey AND node = 'nation.' || n_nationkey""")
def join_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join paths of every customer with every nation, with their columns, in one run; nations of other regions are out of reach."""
    nodes, edges = row_links(spark, sf_dir)
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    pairs = c.select(named("customer", "c_custkey").alias("start")).crossJoin(n.select(named("nation", "n_nationkey").alias("finish")))  # the pairs that are asked for
    ids = [node_id(F.lit("table"), F.col(x)).alias(y) for x, y in (("start", "start"), ("finish", "end"))]
    found = graph.join_paths(nodes, edges, pairs.select(*ids))
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("qname").alias(f"{c}_name"))
    hops = found.columns(edges).join(of("a"), "a").join(of("b"), "b")
    said = F.concat("a_name", F.lit(">"), "b_name", F.lit(":"), F.concat_ws("&", F.transform("columns", lambda p: F.concat(p["from"], F.lit("="), p["to"]))))
    trails = hops.groupBy("start", "end").agg(F.count("*").cast("int").alias("hops"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", said.alias("said")))), lambda h: h["said"]), " ").alias("trail"))
    trails = trails.unionByName(found.apart.select("start", "end", F.lit(0).alias("hops"), F.lit("none").alias("trail")))
    return trails.join(of("start"), "start").join(of("end"), "end").select(F.col("start_name").alias("start"), F.col("end_name").alias("finish"), "hops", "trail")


@query("""
WITH k AS (SELECT 'customer.' || c_custkey AS name, 'view' AS kind FROM customer UNION ALL SELECT 'nation.' || n_nationkey, 'table' FROM nation),
q AS (SELECT DISTINCT 'CUSTOMER.' || o_custkey AS name FROM orders UNION ALL SELECT 'Nation.' || n_nationkey FROM nation UNION ALL SELECT 'nowhere.1')
SELECT q.name, k.kind FROM q JOIN k ON lower(q.name) = k.name""")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = data_graph(spark, sf_dir)
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("CUSTOMER."), "o_custkey").alias("name")).distinct()
    names = names.union(table(spark, sf_dir, "nation").select(F.concat(F.lit("Nation."), "n_nationkey"))).union(spark.range(1).select(F.lit("nowhere.1")))
    return graph.resolve_names(nodes, names).select("name", "kind")


# Normalization


@query("""
SELECT 'customer.' || o_custkey AS qname, CASE WHEN c_mktsegment = 'BUILDING' THEN 'excluded' ELSE 'missing' END AS reason,
  sha1('view orders.' || min(o_orderkey)) AS referenced_by
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE c_custkey IS NULL OR c_mktsegment = 'BUILDING' GROUP BY ALL""")
def resolve_or_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to customers; those of one segment are excluded, so they become stubs, named by the first order."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    gone = F.col("c_mktsegment") == "BUILDING"
    real = node_rows(c.where(~gone), "table", named("customer", "c_custkey"))
    target = struct_of(REF, schema=F.lit("customer"), name=F.col("o_custkey").cast("string"))
    objects = mapping.as_objects(o, kind=F.lit("view"), schema=F.lit("orders"), name=F.col("o_orderkey").cast("string"), dependencies=F.array(struct_of(DEPENDENCY, target=target, access=F.lit("read"), confidence=F.lit("parsed"))))
    objects = norm.with_qname(objects.withColumn("pos", F.col("name").cast("long")))
    _, stubs = norm.resolve(norm.references_of(objects), real, c.where(gone).select(named("customer", "c_custkey").alias("qname")))
    return stubs.select("qname", "reason", "referenced_by")


@query("""SELECT c_mktsegment || '.' || c_custkey AS name FROM customer
WHERE NOT (starts_with(lower(c_mktsegment || '.' || c_custkey), 'building.') OR lower(c_mktsegment || '.' || c_custkey) = 'machinery.7')""")
def exclude_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = mapping.as_objects(table(spark, sf_dir, "customer"), kind=F.lit("table"), schema=F.col("c_mktsegment"), name=F.col("c_custkey").cast("string"))
    kept, _ = norm.split_excluded(objects, Scope(exclude=("BUILDING.*", "Machinery.7")))
    return kept.select(F.concat("schema", F.lit("."), "name").alias("name"))


@query("""SELECT lower(trim(text)) IS NOT NULL AS ok, min(doc_id) AS pos, count(*)::BIGINT - 1 AS skipped FROM documents GROUP BY lower(text), ok HAVING count(*) > 1""")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of objects with the same name the first stays; how many are skipped for each."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.lit("table").alias("kind"), F.lower("text").alias("qname"))
    first, again = norm._first(d, "pos")
    skipped = again.groupBy("qname").agg(F.count("*").alias("skipped"))
    return first.join(skipped, "qname").select(F.lit(True).alias("ok"), "pos", "skipped")


@query(r"""
WITH b AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(replace(text || '  ' || chr(13) || chr(10) || chr(9) || chr(10), chr(13) || chr(10), chr(10)), chr(10)),
  lambda x: regexp_replace(x, '[\s]+$', '')), chr(10)), '\n$', '') AS body FROM documents)
SELECT doc_id, sha1(body) AS body_hash FROM b""")
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with Windows line ends, blanks at line ends and a last empty line, normalized and hashed."""
    body = text.normalized_body(F.concat("text", F.lit("  \r\n\t\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(body).alias("body_hash"))


def order_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a raw table whose columns, keys and index come from its line items."""
    item = table(spark, sf_dir, "lineitem")
    own = lambda x: F.concat(F.lit("L_"), x["n"])
    col = lambda x: struct_of(COLUMN, name=own(x), data_type=F.lit("INT"), nullable=x["flag"] == "R", ordinal=x["n"])
    part = lambda x: struct_of(CONSTRAINT, name=F.concat(F.lit("FK_"), x["n"]), type=F.lit("FK"), columns=F.array(own(x)), references=F.struct(F.lit("part").alias("schema"), x["part"].cast("string").alias("table"), F.array(F.lit("id")).alias("columns")))
    listed = lambda value: F.transform(F.array_sort(F.transform("items", lambda x: F.struct(x["n"].alias("n"), value(x).alias("v")))), lambda x: x["v"])
    rows = item.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))).alias("items"))
    rows = rows.select("l_orderkey", listed(col).alias("columns"), listed(part).alias("constraints"))
    names = F.transform("columns", lambda c: c["name"])
    index = F.array(struct_of(INDEX, name=F.lit("IX"), unique=F.lit(False), columns=F.concat(names, F.array(F.lit("(expr)")))))
    objects = mapping.as_objects(rows, kind=F.lit("table"), schema=F.lit("orders"), name=F.col("l_orderkey").cast("string"), columns=F.col("columns"), constraints=F.col("constraints"), indexes=index)
    return norm.with_qname(objects.withColumn("pos", F.col("name").cast("long")))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT kind, count(*)::BIGINT AS n FROM (
  SELECT 'column' AS kind FROM l UNION ALL SELECT 'constraint' FROM l UNION ALL SELECT DISTINCT 'index' || '' FROM l WHERE false
  UNION ALL SELECT 'index' FROM (SELECT DISTINCT l_orderkey FROM l)) GROUP BY kind""")
def child_nodes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    children, _ = norm._first(norm.child_nodes(order_objects(spark, sf_dir), Scope()), "pos", "section", "idx")
    return snapshot.kind_counts(children)


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS o FROM l)
SELECT sha1('in_index ' || sha1('index orders.' || l_orderkey || '.ix') || ' ' || sha1('column orders.' || l_orderkey || '.l_' || l_linenumber) || ' ' || o) AS id, o::INT AS ordinal FROM r""")
def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """in_index edges; the expression in each index gives none. Line items that repeat a number count once."""
    objects = order_objects(spark, sf_dir)
    objects = objects.withColumn("indexes", F.transform("indexes", lambda i: i.withField("columns", F.array_distinct(i["columns"]))))
    kept, _ = norm._first(norm.child_nodes(objects, Scope()), "pos", "section", "idx")
    return norm.index_edges(objects, kept).select("id", "attrs.ordinal")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem)
SELECT sha1('references ' || sha1('table orders.' || l_orderkey) || ' ' || sha1('table part.' || l_partkey) || ' L_' || l_linenumber || '>id') AS id, 'pair' AS grain FROM l
UNION SELECT sha1('references ' || sha1('table orders.' || l_orderkey) || ' ' || sha1('table part.' || l_partkey) || ' aggregate'), 'whole' FROM l""")
def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = norm.references_of(order_objects(spark, sf_dir))
    real = node_rows(table(spark, sf_dir, "part"), "table", named("part", "p_partkey"))
    found, _ = norm.resolve(refs, real, real.select("qname").limit(0))
    return norm.reference_edges(found).select("id", F.when(F.col("attrs.aggregate"), "whole").otherwise("pair").alias("grain")).distinct()


@query("""
SELECT sha1('fires_on ' || sha1('trigger trg.' || o_orderkey) || ' ' || sha1(CASE WHEN c_custkey % 2 = 0 THEN 'table' ELSE 'view' END || ' customer.' || o_custkey) || ' ' || e) AS id, e AS event
FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('INSERT'), ('DELETE')) v(e)""")
def fires_on_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers on tables, or on views where there is no table of the name."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    info = struct_of(TRIGGER, timing=F.lit("AFTER"), events=F.array(F.lit("INSERT"), F.lit("DELETE")), table=F.struct(F.lit("customer").alias("schema"), F.col("o_custkey").cast("string").alias("name")))
    objects = norm.with_qname(mapping.as_objects(o, kind=F.lit("trigger"), schema=F.lit("trg"), name=F.col("o_orderkey").cast("string"), trigger=info).withColumn("pos", F.col("name").cast("long")))
    real = node_rows(c.where("c_custkey % 2 = 0"), "table", named("customer", "c_custkey")).unionByName(node_rows(c.where("c_custkey % 2 = 1"), "view", named("customer", "c_custkey")))
    found, _ = norm.resolve(norm.references_of(objects), real, real.select("qname").limit(0))
    return norm.reference_edges(found).select("id", "attrs.event")


@query("""
WITH d AS (SELECT l_orderkey, l_suppkey, l_returnflag, l_linenumber FROM lineitem WHERE l_returnflag <> 'A' OR l_suppkey % 2 = 0)
SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'writes_to' ELSE 'reads_from' END AS kind, l_orderkey, l_suppkey FROM d""")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes, reads and calls; a call whose routine isn't real gives neither an edge nor a stub."""
    flag = F.col("l_returnflag")
    target = struct_of(REF, schema=F.lit("supplier"), name=F.col("l_suppkey").cast("string"), kind=F.when(flag == "A", "procedure"))
    dep = struct_of(DEPENDENCY, target=target, access=F.when(flag == "R", "write").otherwise("read"), confidence=F.lit("parsed"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(mapping.ordered_list(["l_linenumber"], dep).alias("d"))
    objects = norm.with_qname(mapping.as_objects(rows, kind=F.lit("procedure"), schema=F.lit("p"), name=F.col("l_orderkey").cast("string"), dependencies=F.col("d")).withColumn("pos", F.col("name").cast("long")))
    s = table(spark, sf_dir, "supplier")
    real = node_rows(s, "table", named("supplier", "s_suppkey")).unionByName(node_rows(s.where("s_suppkey % 2 = 0"), "procedure", named("supplier", "s_suppkey")))
    found, _ = norm.resolve(norm.references_of(objects), real, real.select("qname").limit(0))
    edges = norm.reference_edges(found).select("kind", "src", "dst").distinct()
    of = objects.select(norm.node_id(F.col("kind"), F.col("qname")).alias("src"), F.col("name").cast("long").alias("l_orderkey"))
    return edges.join(of, "src").join(real.select(F.col("id").alias("dst"), F.col("name").cast("long").alias("l_suppkey")), "dst").select("kind", "l_orderkey", "l_suppkey")


@query("""
SELECT ['view', 'procedure', 'function', 'sequence'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 4 >= 2 THEN 'not indexed by configuration' ELSE '' END AS reason,
  CASE WHEN o_orderkey % 4 >= 2 THEN 0 ELSE count(*) END::BIGINT AS n FROM orders GROUP BY o_orderkey % 4 UNION ALL SELECT 'index', 'not indexed by configuration', 0""")
def omitted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects of four kinds, of which two are off: what the graph has of each, and what it says it left out."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("view", "procedure", "function", "sequence")]), (k % 4).cast("int"))
    objects = mapping.as_objects(o, kind=kind, schema=F.lit("s"), name=k.cast("string")).withColumn("pos", F.col("name").cast("long")).drop("__in")
    g = norm.normalize(objects, "test", Scope(levels=dict.fromkeys(("functions", "sequences", "indexes", "sampling"), "off")))
    there = g.nodes.groupBy("kind").agg(F.count("*").alias("n"))
    out = spark.createDataFrame(list(g.omitted), "kind STRING, reason STRING")
    return there.join(out, "kind", "full_outer").select("kind", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("n", F.lit(0)).alias("n"))


# Inference


@query("""
WITH n AS (SELECT lower(p_type) AS e, p_partkey FROM part)
SELECT p_partkey, e || '|' || e || 's|' || e || 'es' || CASE WHEN e LIKE '%y' THEN '|' || left(e, -1) || 'ies' ELSE '' END ||
  CASE WHEN e LIKE '%ies' THEN '|' || left(e, -3) || 'y' WHEN e LIKE '%es' THEN '|' || left(e, -2) WHEN e LIKE '%s' THEN '|' || left(e, -1) ELSE '' END AS names FROM n""")
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(naming.candidate_names(F.lower("p_type")), "|").alias("names"))


@query("""
WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '_ID' WHEN 1 THEN event_type || 'Id' WHEN 2 THEN 'id_' || event_type WHEN 3 THEN '_id' ELSE event_type || 'id' END AS name, event_type AS t FROM events)
SELECT event_id, CASE WHEN event_id % 5 < 3 THEN lower(t) END AS entity, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 END::DOUBLE AS conv FROM c""")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("event_type"), F.col("event_id") % 5
    name = F.when(k == 0, F.concat(t, F.lit("_ID"))).when(k == 1, F.concat(t, F.lit("Id"))).when(k == 2, F.concat(F.lit("id_"), t)).when(k == 3, F.lit("_id")).otherwise(F.concat(t, F.lit("id")))
    e = naming.entity(name)
    return table(spark, sf_dir, "events").select("event_id", e["entity"].alias("entity"), e["conv"].alias("conv"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'str' WHEN 2 THEN 'oid' WHEN 3 THEN 'uuid' WHEN 4 THEN 'varchar(20)' ELSE 'int' END AS family FROM part""")
def type_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("BigInt", "NVARCHAR", "objectId", "UUID", "varchar(20)", "serial")])
    return table(spark, sf_dir, "part").select("p_partkey", naming.type_family(F.get(kinds, F.col("p_size") % 6)).alias("family"))


@query("""
SELECT 'orders.' || o_orderkey || '.customer_id' AS src, 'main.customers.' || k AS dst, CASE WHEN k = 'id' THEN 1.0 ELSE 0.8 END::DOUBLE AS score
FROM orders, (VALUES ('id'), ('parent')) v(k) WHERE o_orderstatus <> 'P'""")
def infer_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column customer_id in every order's table: to the key and to another integer of customers; other types don't fit."""
    o, one = table(spark, sf_dir, "orders"), spark.range(1)
    own = F.concat(named("orders", "o_orderkey"), F.lit(".customer_id"))
    nodes = node_rows(o, "column", own, data_type=F.when(F.col("o_orderstatus") == "P", "uuid").otherwise("BIGINT"))
    for name, kind in (("id", "int"), ("parent", "integer"), ("label", "text")):
        nodes = nodes.unionByName(node_rows(one, "column", F.lit(f"main.customers.{name}"), data_type=F.lit(kind)))
    nodes = nodes.unionByName(node_rows(one, "constraint", F.lit("main.customers.pk"), type=F.lit("PK"), columns=F.array(F.lit("ID"))))
    edges = infer.infer_references(nodes, spark.createDataFrame([], norm.EDGES))
    a, b = (nodes.select(F.col("id").alias(c), F.col("qname").alias(f"{c}_name")) for c in ("src", "dst"))
    rows = hot.met(edges.select("src", "dst", "score"), b, ["dst"]).join(a, "src")  # all point to a column or two
    return rows.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), F.round("score", 6).alias("score"))


# Text


@query(r"""
WITH b AS (SELECT o_orderkey, 'INSERT INTO dbo.T_' || o_custkey || ' SELECT ''it''''s update fake'' FROM x; Update [s].[U] set y=1; merge into m_' || o_orderkey || ' ; truncate TABLE z' AS body FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(['dbo.t_' || regexp_extract(body, 'T_(\d+)', 1), 's.u', 'm_' || o_orderkey, 'into', 'z'])), '|') AS targets FROM b""")
def mask_and_write_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("INSERT INTO dbo.T_"), "o_custkey", F.lit(" SELECT 'it''s update fake' FROM x; Update [s].[U] set y=1; merge into m_"), "o_orderkey", F.lit(" ; truncate TABLE z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.write_targets(text.canonical(text.mask_strings(body))), "|").alias("targets"))


@query("""SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS mssql, o_orderkey % 4 = 1 AS pg, o_orderkey % 4 IN (1, 2) AS mysql FROM orders""")
def dynamic_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = F.array(*[F.lit(x) for x in ("BEGIN EXEC (@sql) END", "declare x; EXECUTE ('a')", "PREPARE s FROM @q", "create trigger EXECUTE_ON; select executes")])
    body = F.get(bodies, F.col("o_orderkey").cast("int") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[text.dynamic_sql(body, d).alias(d) for d in ("mssql", "pg", "mysql")])


@query(r"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(['dbo.t' || o_custkey, 'c' || o_orderkey, 'ix', 'dbo.u', 'old', 'a.b'])), '|') AS names FROM orders""")
def ddl_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = F.concat(F.lit("ALTER TABLE [dbo].[T"), "o_custkey", F.lit("] ADD COLUMN c"), "o_orderkey", F.lit('; create unique index IX on "dbo"."U"; alter table dbo.u DROP  COLUMN old; drop index a.b; drop index ix ON dbo.u'))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.ddl_identifiers(ddl), "|").alias("names"))


@query("""
SELECT 'orders.' || o_orderkey AS view_name, 'write' AS access, 'customer.' || o_custkey AS target FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
UNION ALL SELECT 'orders.' || o_orderkey, 'read', 'customer.' || o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'""")
def body_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that mention customers' tables, met by an equi-join on words; writes told from reads."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    verb = F.when(F.col("o_orderstatus") == "F", "update Customer.C").otherwise("select '' from Customer.C")
    body = F.concat(verb, "o_custkey", F.lit(" x -- customer.c999999999\n"), F.lit("where y = 'customer.c1'"))
    bodies = o.select(F.lit("orders").alias("schema"), F.col("o_orderkey").cast("string").alias("name"), body.alias("body"))
    names = c.select(F.lit("customer").alias("schema"), F.concat(F.lit("c"), "c_custkey").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("rank"))
    deps = mapping.body_dependencies(bodies, names, "sqlite", strip_comments=True).select("schema", "name", F.explode("dependencies").alias("d"))
    return deps.select(F.concat("schema", F.lit("."), "name").alias("view_name"), "d.access", F.concat("d.target.schema", F.lit("."), F.regexp_replace("d.target.name", "^c", "")).alias("target"))


@query("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scoring.token_estimate(F.col("text")).alias("tokens"))


# Mapping of row families


@query("""SELECT l_orderkey, string_agg(l_partkey::VARCHAR, '|' ORDER BY l_linenumber, l_partkey::VARCHAR) AS columns FROM lineitem GROUP BY l_orderkey""")
def pk_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key columns grouped in their order: parts of an order by line number."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(mapping.ordered_list(["l_linenumber"], F.col("l_partkey").cast("string")).alias("c"))
    return rows.select("l_orderkey", F.array_join("c", "|").alias("columns"))


@query("""
SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus || ':' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'not null' ELSE 'null' END, '|' ORDER BY o_orderkey) AS columns FROM orders GROUP BY o_custkey""")
def columns_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.lit("s").alias("schema"), F.col("o_custkey").alias("table"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("data_type"), (F.col("o_orderpriority") != "1-URGENT").alias("nullable"), F.lit(None).cast("string").alias("default"), F.col("o_orderkey").cast("int").alias("ordinal"), F.lit(None).cast("string").alias("comment"))
    shown = F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["data_type"], F.when(c["nullable"], "null").otherwise("not null")))
    return mapping.columns_list(rows).select(F.col("table").alias("o_custkey"), F.array_join(shown, "|").alias("columns"))


@query("""
SELECT event_id, CASE WHEN event_id & 64 <> 0 THEN 'INSTEAD OF' WHEN event_id & 2 <> 0 THEN 'BEFORE' ELSE 'AFTER' END AS timing,
  concat_ws('|', CASE WHEN event_id & 4 <> 0 THEN 'INSERT' END, CASE WHEN event_id & 16 <> 0 THEN 'UPDATE' END, CASE WHEN event_id & 8 <> 0 THEN 'DELETE' END) AS events FROM events""")
def trigger_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = mapping.trigger_bits(F.col("event_id").cast("int"))
    return table(spark, sf_dir, "events").select("event_id", bits["timing"].alias("timing"), F.array_join(bits["events"], "|").alias("events"))


@query("""SELECT o_orderkey, 'a:in:' || CASE WHEN d >= 2 THEN 'd' ELSE '' END || '|b:out:|:inout:' || CASE WHEN d >= 1 THEN 'd' ELSE '' END AS params FROM (SELECT o_orderkey, o_orderkey % 3 AS d FROM orders)""")
def routine_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter arrays decoded: the result column is dropped, defaults belong to the last that take input."""
    arrays = [F.array(*[F.lit(x) for x in xs]) for xs in (("int", "text", "date", "int"), ("i", "o", "b", "t"))]
    params = mapping.pg_parameters(*arrays, F.array(F.lit("a"), F.lit("b"), F.lit(None), F.lit("r")), (F.col("o_orderkey") % 3).cast("int"))
    shown = F.transform(params, lambda p: F.concat_ws(":", p["name"], p["direction"], F.when(p["has_default"], "d").otherwise("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(shown, "|").alias("params"))


@query("""
SELECT l_orderkey, l_suppkey, count(DISTINCT l_partkey)::BIGINT AS n, 'declared' AS confidence FROM lineitem GROUP BY ALL
UNION ALL SELECT DISTINCT l_orderkey, -1, 0, 'parsed' FROM lineitem""")
def view_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View dependencies gain the columns that usage rows tell, and count as declared then."""
    item = table(spark, sf_dir, "lineitem").select(F.lit("v").alias("schema"), F.col("l_orderkey").cast("string").alias("name"), F.lit("s").alias("target_schema"), F.col("l_suppkey").cast("string").alias("target_name"), F.col("l_partkey").cast("string").alias("column"))
    dep = lambda name: struct_of(DEPENDENCY, target=struct_of(REF, schema=F.lit("s"), name=name), access=F.lit("read"), confidence=F.lit("parsed"))
    deps = item.groupBy("schema", "name").agg(F.collect_set("target_name").alias("t")).select("schema", "name", F.transform(F.concat("t", F.array(F.lit("-1"))), dep).alias("dependencies"))
    rich = mapping.enriched(deps, item).select(F.col("name").cast("long").alias("l_orderkey"), F.explode("dependencies").alias("d"))
    return rich.select("l_orderkey", F.col("d.target.name").cast("long").alias("l_suppkey"), F.coalesce(F.size("d.columns"), F.lit(0)).cast("long").alias("n"), "d.confidence")


@query("""
SELECT DISTINCT 'events' AS collection, 'k' AS name, 'numeric' AS data_type, 1.0::DOUBLE AS frequency, false AS nullable FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def field_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select(F.lit("events").alias("collection"), F.col("props").alias("doc"))
    return sampling.fields(docs)


@query("""
WITH n AS (SELECT role, count(*) AS n, count(CASE WHEN turn % 2 = 0 THEN 1 END) AS even FROM conversations GROUP BY role)
SELECT role AS collection, 'conv._id' AS name, 'objectId' AS data_type, 1.0::DOUBLE AS frequency, false AS nullable FROM n
UNION ALL SELECT role, 'tags[].t', 'numeric', 1.0, false FROM n
UNION ALL SELECT role, 'turn', CASE WHEN even = 0 THEN 'string' WHEN even = n THEN 'numeric' ELSE 'numeric|string' END, 1.0, false FROM n
UNION ALL SELECT role, 'even', 'bool', round(even / n, 9), even < n FROM n WHERE even > 0""")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents, arrays, wrapped ids, and a field of two types that some documents lack."""
    turn = F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise(F.concat(F.lit('"'), "turn", F.lit('"')))
    even = F.when(F.col("turn") % 2 == 0, F.lit(',"even":true')).otherwise(F.lit(""))
    doc = F.concat(F.lit('{"conv":{"_id":{"$oid":"'), "conv_id", F.lit('"}},"tags":[{"t":1},{"u":2}],"turn":'), turn, even, F.lit("}"))
    found = sampling.fields(table(spark, sf_dir, "conversations").select(F.col("role").alias("collection"), doc.alias("doc")))
    return found.withColumn("frequency", F.round("frequency", 9))


# Store, snapshots


def order_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of orders at two times: some are gone, some new, some changed, and finished ones have no hash at all."""
    o = table(spark, sf_dir, "orders")
    hash_ = lambda extra: F.when(F.col("o_orderstatus") != "P", F.sha1(F.concat("o_orderpriority", F.lit(extra))))
    before = node_rows(o.where("o_orderkey % 10 <> 1"), "view", named("orders", "o_orderkey"), body_hash=hash_(""))
    changed = F.when(F.col("o_orderkey") % 7 == 0, hash_("x")).otherwise(hash_(""))
    return before, node_rows(o.where("o_orderkey % 10 <> 2"), "view", named("orders", "o_orderkey"), body_hash=changed)


@query("""
SELECT 'orders.' || o_orderkey AS qname, CASE WHEN o_orderkey % 10 = 1 THEN 'added' WHEN o_orderkey % 10 = 2 THEN 'removed' ELSE 'changed' END AS change FROM orders
WHERE o_orderkey % 10 IN (1, 2) OR (o_orderkey % 7 = 0 AND o_orderstatus <> 'P')""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = order_states(spark, sf_dir)
    return snapshot.diff(snapshot.manifest(before, "a"), snapshot.manifest(after, "b")).select("qname", "change")


@query("""
SELECT 'delete' AS op, sha1('view orders.' || o_orderkey) AS id FROM orders WHERE o_orderkey % 10 = 2
UNION ALL SELECT 'upsert', sha1('view orders.' || o_orderkey) FROM orders WHERE o_orderkey % 10 = 1 OR (o_orderkey % 10 <> 2 AND o_orderkey % 7 = 0 AND o_orderstatus <> 'P')""")
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone, fresh = snapshot.delta(*order_states(spark, sf_dir))
    return gone.select(F.lit("delete").alias("op"), "id").union(fresh.select(F.lit("upsert"), "id"))


@query("""
SELECT CASE WHEN o_orderkey % 10 <> 2 THEN 'new' ELSE 'old' END AS version, count(*)::BIGINT AS n FROM orders GROUP BY version""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the second state replace those of the first with the same id."""
    before, after = order_states(spark, sf_dir)
    store = new_store(spark)
    store.upsert(before.withColumn("level", F.lit("old")))
    store.upsert(after.withColumn("level", F.lit("new")))
    return store.nodes.groupBy(F.col("level").alias("version")).agg(F.count("*").alias("n"))


@query("""
SELECT k AS kind, count(*)::BIGINT AS n FROM (
  SELECT 'references' AS k FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 'depends_on' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0
  UNION ALL SELECT 'writes_to' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0 UNION ALL SELECT 'reads_from' FROM orders) GROUP BY k""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region and its nations are deleted; all edges at them go too."""
    nodes, edges = data_graph(spark, sf_dir)
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(named("nation", "n_nationkey").alias("qname")).union(spark.range(1).select(F.lit("region.0")))
    ids = nodes.join(gone, "qname", "left_semi").select("id")
    store = new_store(spark)
    store.replace(nodes, edges)
    store.delete(ids)
    return store.edges.groupBy("kind").agg(F.count("*").alias("n"))


@query("""
SELECT sha256(concat_ws('|', (strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')), count(*)::VARCHAR, count(DISTINCT o_custkey)::VARCHAR)) AS fingerprint FROM orders""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return snapshot.fingerprint(o, F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss"), F.count("*"), F.count_distinct("o_custkey"))


@query("""
SELECT 'count' AS part, 'view' AS name, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'excluded', 'orders.' || o_orderkey, 1 FROM orders WHERE o_orderstatus = 'P'""")
def store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = node_rows(table(spark, sf_dir, "orders"), "view", named("orders", "o_orderkey"), method=F.col("o_orderstatus"))
    return snapshot.status(nodes.withColumn("excluded", F.col("payload.method") == "P"))


# Search


@query("""
SELECT 'part.' || lower(p_name) AS qname, levenshtein(lower(p_name), w)::INT AS distance
FROM part, (SELECT replace(lower(min(p_name)), 'a', 'e') AS w FROM part) WHERE levenshtein(lower(p_name), w) <= 2 ORDER BY distance, qname, sha1('table part.' || lower(p_name)) LIMIT 5""")
def typo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    term = p.agg(F.replace(F.lower(F.min("p_name")), F.lit("a"), F.lit("e"))).first()[0]
    nodes = node_rows(p, "table", F.concat(F.lit("part."), "p_name"))
    return text_search.suggestions(nodes, term).select("qname", "distance")


@query("""
WITH q AS (SELECT DISTINCT replace(lower(p_name), 'e', 'i') AS term FROM part JOIN supplier ON p_partkey = s_suppkey),
n AS (SELECT lower(p_name) AS name, sha1('table part.' || lower(p_name)) AS id FROM part),
d AS (SELECT DISTINCT term, 'part.' || name AS qname, id, levenshtein(name, term)::INT AS distance FROM q JOIN n ON abs(length(name) - length(term)) <= 2 WHERE levenshtein(name, term) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY distance, qname, id) AS n FROM d)
SELECT term, qname, distance FROM r WHERE n <= 5""")
def typos_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names near many misspelt ones at once, from the index that a store keeps."""
    p, store = table(spark, sf_dir, "part"), new_store(spark)
    store.upsert(node_rows(p, "table", F.concat(F.lit("part."), "p_name")))
    terms = p.join(table(spark, sf_dir, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left_semi").select(F.replace(F.lower("p_name"), F.lit("e"), F.lit("i")).alias("term"))
    return store.suggest(terms).select("term", "qname", "distance")


def _tokens_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(strip_accents({column})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


_BM25_SQL = f"""
WITH t AS (SELECT doc_id, {_tokens_sql("text")} AS w FROM documents),
f AS (SELECT doc_id, len(w) + 2 AS len, len(list_filter(w, lambda x: x = 'the')) AS f0,
  len(list_filter(range(1, len(w)), lambda i: w[i] = 'license' AND w[i + 1] = 'version')) AS f1 FROM t),
s AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f),
r AS (SELECT doc_id, f0, f1, len, a, CASE WHEN ln((n - d0 + 0.5) / (d0 + 0.5)) > 0 THEN ln((n - d0 + 0.5) / (d0 + 0.5)) ELSE 1e-6 END AS i0,
  CASE WHEN ln((n - d1 + 0.5) / (d1 + 0.5)) > 0 THEN ln((n - d1 + 0.5) / (d1 + 0.5)) ELSE 1e-6 END AS i1 FROM f, s WHERE f0 > 0 OR f1 > 0)
SELECT 'doc.' || doc_id AS qname, round(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a)), 6) AS score,
  'body' AS matched, (SELECT count(*) FROM r)::BIGINT AS total
FROM r ORDER BY i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a)) DESC, sha1('procedure doc.' || doc_id) LIMIT 20"""


@query(_BM25_SQL)
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as procedure bodies; a word and a two-word phrase, ranked, one page."""
    nodes = node_rows(table(spark, sf_dir, "documents"), "procedure", named("doc", "doc_id"), body=F.col("text"))
    hits = text_search.search(text_search.index(text_search.text_rows(nodes)), "the license,version")
    return hits.join(nodes.select("id", "qname"), "id").select("qname", F.round("score", 6).alias("score"), "matched", "total")


# Precheck


@query("""
SELECT 'readers' AS bucket, 'nation' AS what, count(*)::BIGINT AS n FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'readers', 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'readers', 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'writers', 'nation', count(DISTINCT n_nationkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'writers', 'supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1""")
def precheck_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = data_graph(spark, sf_dir)
    # Access is that of a chain's last hop and counts for all on it, so a nation that a supplier writes to is a writer too.
    found = precheck.precheck(nodes, edges, "ALTER TABLE region.1 ADD COLUMN nowhere; DROP INDEX x.y").affected
    return found.groupBy("bucket", F.substring_index("qname", ".", 1).alias("what")).agg(F.count("*").alias("n"))


# Shaping


@query("""
SELECT 'nation.' || n AS src, 'supplier.' || s AS dst FROM (SELECT DISTINCT c_nationkey AS n, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)""")
def rewire_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders fold into customers, customers into nations; what orders refer to is then what nations refer to."""
    n, c, o, s, i = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "supplier", "lineitem"))
    nodes = node_rows(n, "table", named("nation", "n_nationkey")).unionByName(node_rows(c, "column", named("customer", "c_custkey"))).unionByName(node_rows(o, "constraint", named("orders", "o_orderkey"))).unionByName(node_rows(s, "view", named("supplier", "s_suppkey")))
    edges = edge_rows(c, "has_column", ("table", named("nation", "c_nationkey")), ("column", named("customer", "c_custkey")))
    edges = edges.unionByName(edge_rows(o, "has_constraint", ("column", named("customer", "o_custkey")), ("constraint", named("orders", "o_orderkey"))))
    edges = edges.unionByName(edge_rows(i.select("l_orderkey", "l_suppkey").distinct(), "references", ("constraint", named("orders", "l_orderkey")), ("view", named("supplier", "l_suppkey"))))
    kept, links = shape.collapse(nodes, edges)
    a, b = (kept.select(F.col("id").alias(x), F.col("qname").alias(f"{x}_name")) for x in ("src", "dst"))
    return links.where("kind = 'references'").join(a, "src").join(b, "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    nodes = node_rows(table(spark, sf_dir, "part"), "table", named("part", "p_partkey")).unionByName(node_rows(table(spark, sf_dir, "supplier"), "view", named("supplier", "s_suppkey")))
    return nodes, edge_rows(i, "reads_from", ("view", named("supplier", "l_suppkey")), ("table", named("part", "l_partkey")))


@query("""
WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT 'part.' || p_partkey AS qname, count(p)::BIGINT AS degree FROM part LEFT JOIN e ON p_partkey = p GROUP BY p_partkey
UNION ALL SELECT 'supplier.' || s_suppkey, count(s) FROM supplier LEFT JOIN e ON s_suppkey = s GROUP BY s_suppkey""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = part_graph(spark, sf_dir)
    return shape.degrees(nodes, edges).join(nodes.select("id", "qname"), "id").select("qname", "degree")


def _core_sql(least: int, rounds: int) -> str:
    sql = "WITH e0 AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)"
    for i in range(rounds):
        sql += f", e{i + 1} AS (SELECT p, s FROM e{i} WHERE p IN (SELECT p FROM e{i} GROUP BY p HAVING count(*) >= {least}) AND s IN (SELECT s FROM e{i} GROUP BY s HAVING count(*) >= {least}))"
    return sql + f" SELECT DISTINCT 'part.' || p AS qname FROM e{rounds} UNION ALL SELECT DISTINCT 'supplier.' || s FROM e{rounds}"


@query(_core_sql(26, 12))
def degree_kcore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 26-core of all parts and suppliers; the SQL peels twelve times, more than it takes on these tables."""
    nodes, edges = part_graph(spark, sf_dir)
    return shape.min_degree_core(nodes, edges, 26)[0].select("qname")


@query("""
WITH m AS (SELECT n_regionkey AS r, sha1('view customer.' || c_custkey) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, sha1('table nation.' || n_nationkey) FROM nation UNION ALL SELECT r_regionkey, sha1('table region.' || r_regionkey) FROM region
  UNION ALL SELECT n_regionkey, sha1('procedure supplier.' || s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, sha1('function orders.' || o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT min(id) AS component, count(*)::BIGINT AS n FROM m GROUP BY r""")
def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = data_graph(spark, sf_dir)
    return shape.connected(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))


@query()
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of all kept kinds; sequential by definition, so no SQL."""
    kept, links = shape.collapse(*data_graph(spark, sf_dir))
    return shape.communities(staged(kept), staged(links))[1]


@query()
def viewer_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered nodes with their degrees and communities."""
    nodes, edges = data_graph(spark, sf_dir)
    return shape.data_block(nodes, edges)[0].drop("id")


@query("SELECT DISTINCT 'part.' || l_partkey AS parent, 'orders.' || l_orderkey AS child FROM lineitem")
def entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables with a reference for each of their parts."""
    return shape.entity_relations(*order_graph(spark, sf_dir))


# Questions and scores


@query("SELECT DISTINCT 'FK_' || l_linenumber AS constraint_name, 'orders.' || l_orderkey AS src, 'part.' || l_partkey AS dst, 'L_' || l_linenumber || '=id' AS pairs FROM lineitem")
def fk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fk_questions(*order_graph(spark, sf_dir)).withColumn("pairs", F.array_join("pairs", "|"))


@query("""
SELECT 'nation.' || n_nationkey AS object, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation
WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'region.' || n_regionkey, count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'customer.' || o_custkey, count(*) FROM orders GROUP BY o_custkey""")
def impact_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every object that others read, write or depend on, how many do."""
    return scoring.impact_questions(*data_graph(spark, sf_dir)).select("object", F.size("key").cast("long").alias("n"))


@query("""SELECT o_orderkey, o_orderstatus <> 'P' AS correct FROM orders""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as sets, lists, types and orders; those of one status are wrong."""
    k, wrong = F.col("o_orderkey") % 4, F.col("o_orderstatus") == "P"
    family = F.get(F.array(*[F.lit(x) for x in ("impact", "constraint-semantics", "column-type", "plan-order")]), k.cast("int"))
    good = F.get(F.array(*[F.lit(x) for x in ("b, [A] ,a", "a,b", "int", "c,a,b")]), k.cast("int"))
    said = F.concat(F.lit("text\nanswer: no\nANSWER: "), good, F.when(wrong, ", z").otherwise(""))
    key = F.when(k == 2, F.array(F.lit("INTEGER"))).when(k == 3, F.array(*map(F.lit, "abc"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    before = F.array(F.struct(F.lit("c").alias("first"), F.lit("b").alias("then")))
    fixed = F.when(k == 1, F.lit("a,b")).otherwise(good)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", family.alias("family"), said.alias("text"), key.alias("key"), before.alias("before"), fixed.alias("fixed"))
    return scoring.score(rows).select("o_orderkey", "correct")


@query("""
WITH l AS (SELECT * FROM lineitem), u AS (SELECT DISTINCT l_orderkey, l_linenumber FROM l)
SELECT 'node' AS what, 'table' AS kind, (SELECT count(DISTINCT l_orderkey) + count(DISTINCT l_partkey) FROM l)::BIGINT AS n
UNION ALL SELECT 'node', unnest(['column', 'constraint']), (SELECT count(*) FROM u) UNION ALL SELECT 'node', 'index', (SELECT count(DISTINCT l_orderkey) FROM l)
UNION ALL SELECT 'edge', unnest(['has_column', 'has_constraint']), (SELECT count(*) FROM u) UNION ALL SELECT 'edge', 'has_index', (SELECT count(DISTINCT l_orderkey) FROM l)
UNION ALL SELECT 'edge', 'in_index', (SELECT count(*) FROM l) UNION ALL SELECT 'edge', 'references', (SELECT 2 * count(*) FROM l)
UNION ALL SELECT 'stub', 'table', (SELECT count(DISTINCT l_partkey) FROM l)
UNION ALL SELECT 'warning', unnest(['column', 'constraint']), (SELECT count(*) FROM l) - (SELECT count(*) FROM u)""")
def normalized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole normalizer over a table for every order, whose parts are missing and become stubs."""
    g = norm.normalize(order_objects(spark, sf_dir).drop("qname"), "test")
    count = lambda df, what, kind: df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    parts = count(g.nodes, "node", F.col("kind")).unionByName(count(g.edges, "edge", F.col("kind"))).unionByName(count(g.stubs, "stub", F.col("kind")))
    return parts.unionByName(count(g.warnings, "warning", F.regexp_extract("warning", "Duplicate (\\w+)", 1)))


@query("SELECT 'depends_on' AS kind, sha1('view customer.' || c_custkey) AS src FROM customer WHERE c_nationkey = 3")
def inbound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = data_graph(spark, sf_dir)
    hub = spark.range(1).select(node_id(F.lit("table"), F.lit("nation.3")).alias("id")).first().id
    return graph.edges_to(edges, hub, ("depends_on", "references")).select("kind", "src")


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'BEFORE' WHEN 1 THEN 'AFTER' ELSE 'INSTEAD OF' END AS timing,
  CASE WHEN o_orderkey % 2 = 0 THEN 'UPDATE' ELSE 'INSERT|DELETE' END AS events, 't' || o_custkey AS target,
  'BEGIN update x set y = ''END''; insert into z values (' || o_orderkey || '); end' AS action FROM orders""")
def trigger_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing, events, table and action block of trigger texts; words in the block and in literals don't count."""
    k = F.col("o_orderkey")
    timing = F.when(k % 3 == 0, "before").when(k % 3 == 1, "After").otherwise("instead  of")
    events = F.when(k % 2 == 0, "update of a").otherwise("insert or DELETE")
    block = F.concat(F.lit("BEGIN update x set y = 'END'; insert into z values ("), k.cast("string"), F.lit("); end"))
    sql = F.concat(F.lit("CREATE TRIGGER trg "), timing, F.lit(" "), events, F.lit(" ON t"), F.col("o_custkey").cast("string"), F.lit(" FOR EACH ROW "), block, F.lit(";"))
    info = mapping.trigger_info(sql, F.lit("other"))
    return table(spark, sf_dir, "orders").select("o_orderkey", info["timing"].alias("timing"), F.array_join(info["events"], "|").alias("events"), info["table"]["name"].alias("target"), text.action_part(sql).alias("action"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '{"autoIncrement":true}' WHEN 1 THEN '{"generated":true,"generationKind":"STORED","generationExpression":"' || p_brand || '"}'
  WHEN 2 THEN '{"generated":true,"generationKind":"VIRTUAL","generationExpression":"' || p_brand || '"}' END AS extra FROM part""")
def column_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*[F.lit(x) for x in ("auto_increment", "STORED GENERATED", "VIRTUAL GENERATED", "on update")]), F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", mapping.mysql_column_extra(said, F.col("p_brand")).alias("extra"))


@query("""SELECT conv_id, string_agg(replace(text, chr(10), ' '), '' ORDER BY turn, text) AS value FROM conversations WHERE replace(text, chr(10), ' ') NOT SIMILAR TO '\\s*' GROUP BY conv_id""")
def reassembled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as the chunks of one printed value, with a client's header, rule and row count around them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("line"))
    noise = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(x).alias("line")) for n, x in ((-2, "JSON_F52E2B61-18A1"), (-1, "-----"), (10**9, "(3 rows affected)"), (10**9 + 1, " "))])).alias("x")).select("conv_id", "x.*")
    return catalog.reassemble_chunks(c.unionByName(noise), key="conv_id")


@query("""SELECT event_id, event_id % 2 = 1 AS flag, CASE WHEN event_id % 3 <> 0 THEN user_id::INT ELSE -1 END AS number FROM events""")
def checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loosely typed values brought to their types; absent ones are null."""
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 < 2, (F.col("event_id") % 2).cast("string")).otherwise((F.col("event_id") % 2 == 1).cast("string")).alias("flag"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("number"))
    return catalog.checked_rows(raw, "event_id LONG, flag BOOLEAN, number INT").withColumn("number", F.coalesce("number", F.lit(-1)))


@query("""SELECT item_id, '{"required":["a"],"properties":{"n":' || length(text) || '}}' AS extra FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, NULL FROM benchmark WHERE item_id % 2 = 1""")
def validator_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.concat(F.lit('{"$jsonSchema":{"title":"t","required":["a"],"properties":{"n":'), F.length("text"), F.lit("}}}"))
    own = F.when(F.col("item_id") % 2 == 0, has).otherwise(F.lit('{"$jsonSchema":{"title":"t"}}'))
    return table(spark, sf_dir, "benchmark").select("item_id", mapping.validator_extra(own).alias("extra"))


@query("""SELECT 'upsert' AS op, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 10 <> 2 AND (o_orderkey % 10 = 1 OR (o_orderkey % 7 = 0 AND o_orderstatus <> 'P') OR o_orderkey % 11 = 0)""")
def payload_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With payloads in the hash, a change of type counts as well."""
    before, after = order_states(spark, sf_dir)
    typed = after.withColumn("payload", F.col("payload").withField("data_type", F.when(F.substring_index("qname", ".", -1).cast("long") % 11 == 0, F.lit("new"))))
    _, fresh = snapshot.delta(before, typed, include_payload=True)
    return fresh.agg(F.count("*").alias("n")).select(F.lit("upsert").alias("op"), "n")


FLAGSHIP: Query = impact_region_depth3
