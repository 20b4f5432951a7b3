"""Queries of the catalog mappings: row families of each engine, made of whole tables, become raw objects.

Customers, nations and suppliers stand for tables, views and routines; their orders and customers for columns.
"""

from __future__ import annotations

import sqlite3
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.model import Scope
from lattica.queries import query, table
from lattica.sources import catalog, mapping

FULL = Scope(levels=dict.fromkeys(("procedures", "functions"), "full"))


def _named(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _of(k: Column, *values: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


def _int(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("int")


def shown_columns(columns: str) -> Column:
    """name:type:null or not null:default:ordinal:comment of each, by |."""
    return F.array_join(F.transform(columns, lambda c: F.concat_ws(":", c["name"], c["data_type"], F.when(c["nullable"], "null").otherwise("not null"), c["default"], c["ordinal"].cast("string"), c["comment"])), "|")


def shown_constraints(constraints: str) -> Column:
    """name:type:columns:target:definition of each, by |."""
    target = lambda r: F.when(r.isNotNull(), F.concat(r["schema"], F.lit("."), r["table"], F.lit("("), F.array_join(r["columns"], "+"), F.lit(")")))
    return F.array_join(F.transform(constraints, lambda c: F.concat_ws(":", c["name"], c["type"], F.array_join(c["columns"], "+"), target(c["references"]), c["definition"])), "|")


def shown_indexes(indexes: str) -> Column:
    return F.array_join(F.transform(indexes, lambda i: F.concat_ws(":", i["name"], F.when(i["unique"], "unique").otherwise("plain"), F.array_join(i["columns"], "+"))), "|")


def shown_parameters(parameters: str) -> Column:
    return F.array_join(F.transform(parameters, lambda p: F.concat_ws(":", p["name"], p["data_type"], p["direction"], F.when(p["has_default"], "default"), p["ordinal"].cast("string"))), "|")


def shown_dependencies(dependencies: str) -> Column:
    return F.array_join(F.transform(dependencies, lambda d: F.concat_ws(":", d["target"]["schema"], d["target"]["name"], d["target"]["kind"], d["access"], d["confidence"], F.array_join(d["columns"], "+"))), "|")


def shown_tables(objects: DataFrame) -> DataFrame:
    return objects.where("kind = 'table'").select("name", "comment", shown_columns("columns").alias("columns"), shown_constraints("constraints").alias("constraints"), shown_indexes("indexes").alias("indexes"))


def shown_modules(objects: DataFrame) -> DataFrame:
    t = F.col("trigger")
    fired = F.when(t.isNotNull(), F.concat_ws(":", t["timing"], F.array_join(t["events"], "+"), t["table"]["schema"], t["table"]["name"]))
    return objects.where("kind NOT IN ('table', 'sequence')").select(
        "name", "kind", F.coalesce(fired, F.lit("")).alias("fired"), F.coalesce(shown_parameters("parameters"), F.lit("")).alias("parameters"), F.coalesce(shown_dependencies("dependencies"), F.lit("")).alias("dependencies"),
        F.coalesce("has_dynamic_sql", F.lit(False)).alias("dynamic"), F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce("extra", F.lit("")).alias("extra"),
    )


# SQL Server


def mssql_families(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c, o, s, r = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier", "region"))
    dbo, of_table, own = F.lit("dbo").alias("schema_name"), _named("c", "o_custkey").alias("table_name"), _named("o", "o_orderkey").alias("column_name")
    c_table = _named("c", "c_custkey").alias("table_name")
    status, k = F.col("o_orderstatus"), F.col("s_suppkey")
    module = _named("s", "s_suppkey").alias("object_name")
    kind = _of(k, "V", "P ", "FN", "IF", "TF", "TR", "X")
    body = F.when(k % 2 == 0, F.concat(F.lit("update dbo.c"), k, F.lit(" set x = 'update dbo.c0'; exec (@q)"))).otherwise(F.concat(F.lit("select 1 from c"), k))
    pairs = F.explode(F.array(F.struct(F.lit("a").alias("l"), F.lit("x").alias("f"), F.lit(2).alias("n")), F.struct(F.lit("b").alias("l"), F.lit("y").alias("f"), F.lit(1).alias("n")))).alias("p")
    refs = F.posexplode(F.array(
        F.struct(F.lit("dbo").alias("rs"), _named("c", k).alias("ro"), F.lit("U").alias("rt")), F.struct(F.lit(None).cast("string").alias("rs"), F.lit("gone").alias("ro"), F.lit("U").alias("rt")),
        F.struct(F.lit("dbo").alias("rs"), _named("s", k + 1).alias("ro"), _of(k + 1, "V", "P ", "FN", "IF", "TF", "TR", "X").alias("rt")),
    ))
    args = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(t).alias("t"), F.lit(out).alias("o"), F.lit(d).alias("d")) for i, n, t, out, d in ((0, "", "int", True, False), (9, "@b", "text", True, False), (7, "@a", "int", False, True))]))
    events = F.posexplode(F.array(F.lit("INSERT"), F.lit("update"), F.lit("TRUNCATE"), F.lit("INSERT")))
    object_id = (k + 1_000_000_000).alias("object_id")
    on_table = c.select(F.col("c_custkey").alias("pos"), dbo, _named("c", "c_custkey").alias("object_name"), F.lit(0).alias("column_id"), F.lit(None).cast("string").alias("column_name"), F.col("c_mktsegment").alias("description"))
    on_column = o.select(F.col("o_orderkey").alias("pos"), dbo, _named("c", "o_custkey").alias("object_name"), _int(F.col("o_orderkey") + 1).alias("column_id"), own, status.alias("description"))
    return {
        "tables": c.select(F.col("c_custkey").alias("pos"), dbo, c_table, F.col("c_custkey").alias("object_id")),
        "columns": o.select(dbo, of_table, _int(F.col("o_orderkey") + 1).alias("column_id"), own, F.col("o_orderpriority").alias("data_type"), (status == "F").alias("is_nullable"), F.when(status == "O", "(0)").alias("default_definition")),
        "key-constraints": o.where(status != "P").select(dbo, of_table, F.concat(F.when(status == "F", "pk").otherwise("uq"), of_table).alias("constraint_name"), F.when(status == "F", "PK").otherwise("UQ").alias("constraint_type"), own, _int(2_000_000_000 - F.col("o_orderkey")).alias("key_ordinal")),
        "foreign-keys": c.select(dbo, c_table, F.concat(F.lit("fk"), c_table).alias("constraint_name"), F.col("c_custkey").alias("fk_id"), F.lit("geo").alias("ref_schema_name"), _named("n", "c_nationkey").alias("ref_table_name"), pairs).select("*", F.col("p.l").alias("local_column"), F.col("p.f").alias("ref_column"), F.col("p.n").alias("constraint_column_id")),
        "check-constraints": c.where("c_mktsegment = 'BUILDING'").select(dbo, c_table, F.concat(F.lit("ck"), c_table).alias("constraint_name"), F.col("c_mktsegment").alias("definition")),
        "indexes": o.select(dbo, of_table, F.concat(F.lit("ix"), of_table).alias("index_name"), (F.col("o_custkey") % 2 == 0).alias("is_unique"), own, _int("o_orderkey").alias("index_column_id"), (status == "P").alias("is_included_column")),
        "modules": s.select(k.alias("pos"), dbo, module, kind.alias("object_type"), object_id, body.alias("definition")),
        "dependencies": s.select("s_suppkey", dbo, module, kind.alias("object_type"), refs).select((F.col("s_suppkey") * 3 + F.col("pos")).alias("pos"), "schema_name", "object_name", "object_type", F.col("col.rs").alias("ref_schema_name"), F.col("col.ro").alias("ref_object_name"), F.col("col.rt").alias("ref_object_type")),
        "parameters": s.select(dbo, module, object_id, args).select("schema_name", "object_name", "object_id", F.col("col.i").alias("parameter_id"), F.col("col.n").alias("parameter_name"), F.col("col.t").alias("data_type"), F.col("col.o").alias("is_output"), F.col("col.d").alias("has_default_value")),
        "trigger-events": s.where(kind == "TR").select("s_suppkey", object_id, module, events).select((F.col("s_suppkey") * 4 + F.col("pos")).alias("pos"), F.col("object_id").alias("trigger_id"), F.when(F.col("s_suppkey") % 4 < 2, F.col("s_suppkey")).otherwise(-1).alias("parent_object_id"), (F.col("s_suppkey") % 2 == 0).alias("is_instead_of_trigger"), F.col("col").alias("event_type")),
        "sequences": r.select(F.lit("geo").alias("schema_name"), _named("r", "r_regionkey").alias("sequence_name"), F.lit("int").alias("data_type"), F.col("r_regionkey").cast("string").alias("start_value"), F.lit("1").alias("increment"), F.lit("0").alias("minimum_value"), F.lit("9").alias("maximum_value"), (F.col("r_regionkey") % 2 == 0).alias("is_cycling")),
        "extended-properties": on_table.unionByName(on_column),
        "view-referenced-columns": s.where(kind == "V").select(F.lit("dbo").alias("referencing_schema"), _named("s", k).alias("referencing_view"), F.lit("dbo").alias("referenced_schema"), _named("c", k).alias("referenced_entity"), F.explode(F.array(F.lit("x"), F.lit("a"))).alias("referenced_column")),
    }


@query("""
WITH col AS (SELECT o_custkey AS k, string_agg(concat_ws(':', 'o' || o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE 'not null' END, CASE WHEN o_orderstatus = 'O' THEN '(0)' END, o_orderkey + 1, o_orderstatus), '|' ORDER BY o_orderkey) AS s FROM orders GROUP BY k),
con AS (
  SELECT o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'pkc' ELSE 'uqc' END || o_custkey AS name, CASE o_orderstatus WHEN 'F' THEN 'PK:' ELSE 'UNIQUE:' END || string_agg('o' || o_orderkey, '+' ORDER BY o_orderkey DESC) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey, o_orderstatus
  UNION ALL SELECT c_custkey, 'fkc' || c_custkey, 'FK:b+a:geo.n' || c_nationkey || '(y+x)' FROM customer UNION ALL SELECT c_custkey, 'ckc' || c_custkey, 'CHECK::BUILDING' FROM customer WHERE c_mktsegment = 'BUILDING'
), cons AS (SELECT k, string_agg(name || ':' || s, '|' ORDER BY name) AS s FROM con GROUP BY k),
ix AS (SELECT o_custkey AS k, 'ixc' || o_custkey || ':' || CASE WHEN o_custkey % 2 = 0 THEN 'unique' ELSE 'plain' END || ':' || coalesce(string_agg('o' || o_orderkey, '+' ORDER BY o_orderkey) FILTER (o_orderstatus <> 'P'), '') AS s FROM orders GROUP BY o_custkey)
SELECT 'c' || c_custkey AS name, c_mktsegment AS comment, coalesce(col.s, '') AS columns, cons.s AS constraints, coalesce(ix.s, '') AS indexes
FROM customer LEFT JOIN col ON col.k = c_custkey JOIN cons ON cons.k = c_custkey LEFT JOIN ix ON ix.k = c_custkey""")
def mssql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with comments, keys and foreign keys in key order, checks, and indexes without their included columns."""
    return shown_tables(mapping.map_mssql(mssql_families(spark, sf_dir)))


@query("""
WITH s AS (SELECT s_suppkey AS k, ['V', 'P', 'FN', 'IF', 'TF', 'TR', 'X'][s_suppkey % 7 + 1] AS t, ['V', 'P', 'FN', 'IF', 'TF', 'TR', 'X'][(s_suppkey + 1) % 7 + 1] AS u FROM supplier),
m AS (SELECT *, CASE t WHEN 'V' THEN 'view' WHEN 'P' THEN 'procedure' WHEN 'TR' THEN 'trigger' ELSE 'function' END AS kind, CASE u WHEN 'P' THEN 'procedure' ELSE 'function' END AS other, k % 2 = 0 AS even FROM s WHERE t <> 'X')
SELECT 's' || k AS name, kind, CASE WHEN t = 'TR' THEN CASE WHEN even THEN 'INSTEAD OF' ELSE 'AFTER' END || ':INSERT+UPDATE:dbo:' || CASE WHEN k % 4 < 2 THEN 'c' ELSE 's' END || k ELSE '' END AS fired,
  CASE WHEN kind IN ('procedure', 'function') THEN '@a:int:in:default:1|@b:text:out:2' ELSE '' END AS parameters,
  'dbo:c' || k || CASE WHEN even THEN ':write' ELSE ':read' END || CASE WHEN t = 'V' THEN ':declared:a+x' ELSE ':parsed' END || '|dbo:s' || (k + 1) ||
    CASE WHEN kind IN ('procedure', 'function') AND u IN ('P', 'FN', 'IF', 'TF') THEN ':' || other || ':read:declared' ELSE ':read:parsed' END AS dependencies,
  even AS dynamic, '' AS comment, CASE WHEN kind = 'function' THEN '{"functionType":"' || t || '"}' ELSE '' END AS extra FROM m""")
def mssql_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module types as kinds, events and parents of triggers, parameters, dependencies by their bodies or declared."""
    return shown_modules(mapping.map_mssql(mssql_families(spark, sf_dir)))


@query("""
WITH m AS (
  SELECT 3 AS rank, 'table' AS kind, 'dbo' AS schema, 'c' || c_custkey AS name FROM customer UNION ALL SELECT 9, 'sequence', 'geo', 'r' || r_regionkey FROM region
  UNION ALL SELECT CASE s_suppkey % 7 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 5 THEN 7 ELSE 6 END, CASE s_suppkey % 7 WHEN 0 THEN 'view' WHEN 1 THEN 'procedure' WHEN 5 THEN 'trigger' ELSE 'function' END, 'dbo', 's' || s_suppkey FROM supplier WHERE s_suppkey % 7 <> 6
) SELECT row_number() OVER (ORDER BY rank, schema, name) - 1 AS pos, kind, name,
  CASE WHEN kind = 'sequence' THEN '{"data_type":"int","start_value":"' || substr(name, 2) || '","increment":"1","minimum_value":"0","maximum_value":"9","is_cycling":' || CASE WHEN substr(name, 2)::INT % 2 = 0 THEN 'true' ELSE 'false' END || '}' END AS sequence FROM m""")
def mssql_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog in order, sequences with what is known of them."""
    return mapping.map_mssql(mssql_families(spark, sf_dir)).select("pos", "kind", "name", F.when(F.col("kind") == "sequence", F.col("extra")).alias("sequence"))


# PostgreSQL


def pg_families(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c, n, s, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier", "region"))
    geo, t = F.lit("geo").alias("schema_name"), _named("n", "n_nationkey").alias("table_name")
    none = lambda kind="string": F.lit(None).cast(kind)
    places = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(_int(F.col("c_custkey") + 1))).alias("p"))
    own = n.join(places.withColumnRenamed("k", "n_nationkey"), "n_nationkey", "left").withColumn("next", (F.col("n_nationkey") + 1) % 25).join(places.toDF("next", "q"), "next", "left")
    p, q = F.coalesce("p", F.array().cast("array<int>")), F.coalesce("q", F.array().cast("array<int>"))
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), pos.alias("pos"), there.alias("there"), d.alias("d")) for a, pos, there, d in (
        ("p", F.concat(F.reverse(p), F.array(F.lit(99_999_999))), none("array<int>"), none()), ("u", F.slice(p, 2, 1), none("array<int>"), none()), ("f", F.slice(p, 1, 2), F.slice(q, 1, 2), none()),
        ("c", F.slice(p, 1, 1), none("array<int>"), F.lit("CHECK (x)")), ("x", p, none("array<int>"), none()),
    )]))
    k = F.col("s_suppkey")
    routine = F.concat(F.lit("begin update geo.n"), F.col("s_nationkey"), F.lit(" set x = 'geo.n0'; "), F.when(k % 2 == 0, F.lit("execute q; ")).otherwise(F.lit("execute function f(); ")), F.lit("perform v"), k % 5, F.lit("; end"))
    names = c.select(geo, _named("n", "c_nationkey").alias("table_name"), _int(F.col("c_custkey") + 1).alias("attnum"), _named("c", "c_custkey").alias("column_name"))
    return {
        "tables": n.select(F.col("n_nationkey").cast("long").alias("pos"), geo, t, F.col("n_name").alias("comment")),
        "columns": c.select(geo, _named("n", "c_nationkey").alias("table_name"), _int(F.col("c_custkey") + 1).alias("ordinal"), _named("c", "c_custkey").alias("column_name"), F.col("c_mktsegment").alias("data_type"), (F.col("c_custkey") % 3 == 0).alias("is_nullable"), none().alias("default_expr"), none().alias("comment")),
        "column-names": names,
        "constraints": own.select(geo, t, "next", kinds).select("schema_name", "table_name", F.concat("col.a", F.lit("k"), "table_name").alias("constraint_name"), F.col("col.a").alias("constraint_type"), F.col("col.pos").alias("column_positions"), F.col("col.there").alias("fk_ref_positions"), F.when(F.col("col.a") == "f", "geo").alias("fk_ref_schema"), F.when(F.col("col.a") == "f", _named("n", "next")).alias("fk_ref_table"), F.col("col.d").alias("constraint_def")),
        "indexes": own.select(geo, t, F.explode(F.array(F.lit("ia"), F.lit("ib"))).alias("index_name"), (F.col("n_nationkey") % 2 == 0).alias("is_unique"), F.concat(F.array(F.lit(0)), p).alias("key_columns"), F.lit(3).alias("n_key_atts")).withColumn("is_primary", F.col("index_name") == "ib"),
        "views": r.select(F.col("r_regionkey").cast("long").alias("pos"), geo, _named("v", "r_regionkey").alias("view_name"), F.concat(F.lit("select * from geo.n"), "r_regionkey", F.lit(" join n"), F.col("r_regionkey") + 5, F.lit(" -- 'geo.n9'")).alias("view_def"), F.when(F.col("r_regionkey") % 2 == 0, "m").otherwise("v").alias("rel_kind"), F.col("r_name").alias("comment")),
        "routines": s.select(k.alias("pos"), geo, _named("f", k).alias("routine_name"), F.when(k % 3 == 0, "p").otherwise("f").alias("routine_kind"), routine.alias("routine_def"), none().alias("comment"), F.array(F.lit("a"), F.lit("b"), F.lit("r")).alias("arg_names"), F.array(F.lit("i"), F.lit("o"), F.lit("t")).alias("arg_modes"), F.array(F.lit("int"), F.lit("text"), F.lit("date")).alias("arg_type_names"), _int(k % 2).alias("num_defaults")),
        "triggers": n.select(F.col("n_nationkey").cast("long").alias("pos"), geo, t, _named("t", "n_nationkey").alias("trigger_name"), _int(F.col("n_nationkey") * 2 + 4).alias("tgtype"), F.lit("create trigger x execute procedure y()").alias("trigger_def")),
        "sequences": r.where("false").select(geo, F.lit("s").alias("sequence_name"), F.lit("1").alias("start_value"), none().alias("comment")),
        "view-column-usage": r.select(F.lit("geo").alias("view_schema"), _named("v", "r_regionkey").alias("view_name"), F.lit("geo").alias("table_schema"), _named("n", "r_regionkey").alias("table_name"), F.explode(F.array(F.lit("y"), F.lit("x"))).alias("column_name")),
    }


@query("""
WITH p AS (SELECT n_nationkey AS k, n_name, coalesce(list(c_custkey ORDER BY c_custkey) FILTER (c_custkey IS NOT NULL), []) AS p FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
x AS (SELECT a.*, coalesce(b.p, []) AS q, (a.k + 1) % 25 AS next FROM p a LEFT JOIN p b ON b.k = (a.k + 1) % 25),
y AS (SELECT *, list_transform(p, lambda i: 'c' || i) AS names, list_transform(q, lambda i: 'c' || i) AS there FROM x),
col AS (SELECT c_nationkey AS k, string_agg(concat_ws(':', 'c' || c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE 'not null' END, c_custkey + 1), '|' ORDER BY c_custkey) AS s FROM customer GROUP BY k)
SELECT 'n' || k AS name, n_name AS comment, coalesce(col.s, '') AS columns,
  'ckn' || k || ':CHECK::CHECK (x)|fkn' || k || ':FK:' || array_to_string(names[1:2], '+') || ':geo.n' || next || '(' || array_to_string(there[1:2], '+') || ')|pkn' || k || ':PK:' || array_to_string(list_append(list_reverse(names), 'col_99999999'), '+') ||
    '|ukn' || k || ':UNIQUE:' || array_to_string(names[2:2], '+') AS constraints,
  'ia:' || CASE WHEN k % 2 = 0 THEN 'unique' ELSE 'plain' END || ':' || array_to_string(names[1:2], '+') AS indexes FROM y LEFT JOIN col USING (k)""")
def pg_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, keys by column numbers of both tables, checks, and key columns of indexes that aren't primary."""
    return shown_tables(mapping.map_pg(pg_families(spark, sf_dir)))


@query("""
WITH v AS (SELECT r_regionkey AS k, r_name FROM region), s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT 'v' || k AS name, 'view' AS kind, '' AS fired, '' AS parameters, 'geo:n' || k || ':read:declared:x+y|geo:n' || (k + 5) || ':read:parsed' AS dependencies, false AS dynamic, r_name AS comment, CASE WHEN k % 2 = 0 THEN '{"materialized":true}' ELSE '' END AS extra FROM v
UNION ALL SELECT 'f' || k, CASE WHEN k % 3 = 0 THEN 'procedure' ELSE 'function' END, '', 'a:int:in:' || CASE WHEN k % 2 = 1 THEN 'default:' ELSE '' END || '1|b:text:out:2', 'geo:n' || n || ':write:parsed|geo:v' || (k % 5) || ':read:parsed', k % 2 = 0, '', '' FROM s
UNION ALL SELECT 't' || k, 'trigger', CASE WHEN b & 64 <> 0 THEN 'INSTEAD OF' WHEN b & 2 <> 0 THEN 'BEFORE' ELSE 'AFTER' END || ':' || concat_ws('+', CASE WHEN b & 4 <> 0 THEN 'INSERT' END, CASE WHEN b & 16 <> 0 THEN 'UPDATE' END, CASE WHEN b & 8 <> 0 THEN 'DELETE' END) || ':geo:n' || k, '', '', false, '', ''
  FROM (SELECT n_nationkey AS k, n_nationkey * 2 + 4 AS b FROM nation)""")
def pg_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the columns that they use, routines with arguments and what their bodies mention, triggers from bits."""
    out = shown_modules(mapping.map_pg(pg_families(spark, sf_dir), FULL))
    return out


# MySQL


def mysql_families(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c, n, s, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier", "region"))
    db, t = F.lit("db").alias("table_schema"), _named("n", "n_nationkey").alias("table_name")
    of, own = _named("n", "c_nationkey").alias("table_name"), _named("c", "c_custkey").alias("column_name")
    k = F.col("s_suppkey")
    back = _int(2_000_000_000 - F.col("c_custkey"))
    kind = F.when(F.col("c_custkey") % 2 == 0, "PRIMARY KEY").otherwise("UNIQUE")
    args = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("n"), F.lit(mode).alias("m"), F.lit(d).alias("d")) for i, name, mode, d in ((0, None, None, "int"), (5, "b", "inout", "text"), (3, "a", None, "int"), (8, "c", "OUT", "date"))]))
    body = F.concat(F.lit("begin "), F.when(k % 2 == 0, F.lit("prepare q from 'x'; ")).otherwise(F.lit("")), F.lit("replace into `db`.`n"), F.col("s_nationkey"), F.lit("` values (1); call p"), k + 1, F.lit("(); end"))
    return {
        "tables": n.select(F.col("n_nationkey").cast("long").alias("pos"), db, t, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("table_comment")),
        "columns": c.select(db, of, own, F.col("c_mktsegment").alias("column_type"), F.when(F.col("c_custkey") % 3 == 0, "YES").otherwise("NO").alias("is_nullable"), F.when(F.col("c_custkey") % 4 == 0, "0").alias("column_default"), _int(F.col("c_custkey") + 1).alias("ordinal_position"), F.lit("").alias("column_comment")),
        "pk-uk-columns": c.select(db, of, F.when(kind == "UNIQUE", "uq").otherwise("PRIMARY").alias("constraint_name"), kind.alias("constraint_type"), own, back.alias("ordinal_position")),
        "fk-columns": c.select(db, of, F.lit("fk").alias("constraint_name"), own, _int("c_custkey").alias("ordinal_position"), F.lit("db").alias("referenced_table_schema"), F.concat(F.lit("n"), (F.col("c_nationkey") + 1) % 25).alias("referenced_table_name"), F.when(F.col("c_custkey") % 2 == 0, _named("r", "c_custkey")).alias("referenced_column_name")),
        "check-constraints": n.select(db, t, F.lit("ck").alias("constraint_name"), F.col("n_name").alias("check_clause")),
        "statistics": c.select(db, of, F.lit("ix").alias("index_name"), _int(F.col("c_nationkey") % 2).alias("non_unique"), back.alias("seq_in_index"), F.when(F.col("c_custkey") % 5 != 0, own).alias("column_name")),
        "views": r.select(F.col("r_regionkey").cast("long").alias("pos"), db, _named("v", "r_regionkey").alias("table_name"), F.concat(F.lit("select `x` from `db`.`n"), "r_regionkey", F.lit("`")).alias("view_definition")),
        "routines": s.select(k.alias("pos"), F.lit("db").alias("routine_schema"), _named("p", k).alias("routine_name"), F.when(k % 3 == 0, "FUNCTION").otherwise("PROCEDURE").alias("routine_type"), body.alias("routine_definition"), F.lit("").alias("routine_comment")),
        "parameters": s.select(F.lit("db").alias("routine_schema"), _named("p", k).alias("routine_name"), args).select("routine_schema", "routine_name", F.col("col.i").alias("ordinal_position"), F.col("col.n").alias("parameter_name"), F.col("col.m").alias("parameter_mode"), F.col("col.d").alias("data_type")),
        "triggers": n.select(F.col("n_nationkey").cast("long").alias("pos"), F.lit("db").alias("trigger_schema"), _named("t", "n_nationkey").alias("trigger_name"), _of(F.col("n_nationkey"), "INSERT", "DELETE").alias("event_manipulation"), _of(F.col("n_nationkey"), "AFTER", "BEFORE", "AFTER").alias("action_timing"), t.alias("event_object_table"), F.lit("set x = 1").alias("action_statement")),
    }


@query("""
WITH g AS (
  SELECT c_nationkey AS k, string_agg(concat_ws(':', 'c' || c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE 'not null' END, CASE WHEN c_custkey % 4 = 0 THEN '0' END, c_custkey + 1), '|' ORDER BY c_custkey) AS col,
    string_agg('c' || c_custkey, '+' ORDER BY c_custkey) AS own, string_agg(CASE WHEN c_custkey % 2 = 0 THEN 'r' || c_custkey ELSE '' END, '+' ORDER BY c_custkey) AS there,
    string_agg('c' || c_custkey, '+' ORDER BY c_custkey DESC) FILTER (c_custkey % 2 = 0) AS pk, string_agg('c' || c_custkey, '+' ORDER BY c_custkey DESC) FILTER (c_custkey % 2 = 1) AS uq,
    string_agg('c' || c_custkey, '+' ORDER BY c_custkey DESC) FILTER (c_custkey % 5 <> 0) AS ix FROM customer GROUP BY k)
SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS comment, coalesce(col, '') AS columns,
  concat_ws('|', 'ck:CHECK::' || n_name, 'fk:FK:' || own || ':db.n' || ((n_nationkey + 1) % 25) || '(' || there || ')', 'PRIMARY:PK:' || pk, 'uq:UNIQUE:' || uq) AS constraints,
  CASE WHEN own IS NULL THEN '' ELSE 'ix:' || CASE WHEN n_nationkey % 2 = 0 THEN 'unique' ELSE 'plain' END || ':' || coalesce(ix, '') END AS indexes FROM nation LEFT JOIN g ON k = n_nationkey""")
def mysql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in key order, composite foreign keys, checks, and indexes whose expressions give no column."""
    return shown_tables(mapping.map_mysql(mysql_families(spark, sf_dir)))


@query("""
SELECT 'v' || r_regionkey AS name, 'view' AS kind, '' AS fired, '' AS parameters, 'db:n' || r_regionkey || ':read:parsed' AS dependencies, false AS dynamic, '' AS comment, '' AS extra FROM region
UNION ALL SELECT 'p' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'function' ELSE 'procedure' END, '', 'a:int:in:1|b:text:inout:2|c:date:out:3',
  'db:n' || s_nationkey || ':write:parsed' || CASE WHEN s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) THEN '|db:p' || (s_suppkey + 1) || CASE WHEN (s_suppkey + 1) % 3 = 0 THEN ':function' ELSE ':procedure' END || ':read:parsed' ELSE '' END, s_suppkey % 2 = 0, '', '' FROM supplier
UNION ALL SELECT 't' || n_nationkey, 'trigger', CASE n_nationkey % 3 WHEN 1 THEN 'BEFORE' ELSE 'AFTER' END || ':' || CASE n_nationkey % 2 WHEN 0 THEN 'INSERT' ELSE 'DELETE' END || ':db:n' || n_nationkey, '', '', false, '', '' FROM nation""")
def mysql_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, routines with parameters and what they mention, and triggers of one event each."""
    return shown_modules(mapping.map_mysql(mysql_families(spark, sf_dir), FULL))


# SQLite


@query("""
WITH t AS (SELECT r_regionkey AS k, r_name FROM region), n AS (SELECT * FROM nation),
col AS (SELECT n_regionkey AS k, string_agg('c' || n_nationkey || ':TEXT:' || CASE WHEN n_nationkey % 2 = 0 THEN 'not null' ELSE 'null' END || ':' || (rn + 1), '|' ORDER BY rn) AS s, string_agg('c' || n_nationkey, '+' ORDER BY rn DESC) AS keys
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM n) GROUP BY k)
SELECT 'r' || k AS name, 'table' AS kind, 'id:INTEGER:null:0|' || 'boss:INTEGER:null:1|' || s AS columns,
  'pk_r' || k || ':PK:id|fk_r' || k || '_0:FK:boss:main.r' || ((k + 1) % 5) || '(id)|ux' || k || ':UNIQUE:boss' AS constraints, 'ux' || k || ':unique:boss|ix' || k || ':plain:boss+(expr)' AS indexes, '' AS fired, '' AS dependencies FROM t JOIN col USING (k)
UNION ALL SELECT 'v' || k, 'view', '', '', '', '', 'main:r' || k || ':read:parsed' FROM t
UNION ALL SELECT 't' || k, 'trigger', '', '', '', CASE WHEN k % 2 = 0 THEN 'AFTER:INSERT' ELSE 'BEFORE:DELETE' END || ':main:r' || k, CASE WHEN (k + 1) % 5 = 0 THEN 'main:r0:write:parsed|main:r' || k || ':read:parsed' ELSE 'main:r' || least(k, (k + 1) % 5) || ':' || 'read:parsed|main:r' || (k + 1) % 5 || ':write:parsed' END FROM t""")
def sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQLite file with a table, a view and a trigger for every region is scanned by its pragmas and mapped.

    SQLite lists the newest index first, and a scan is the driver's, as a schema is small.
    """
    keys: dict[int, list[int]] = {r.r_regionkey: [] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        keys[r.n_regionkey].append(r.n_nationkey)
    with tempfile.TemporaryDirectory() as folder:
        con = sqlite3.connect(Path(folder, "scan.db"))
        for k, cols in sorted(keys.items()):
            more = "".join(f", c{c} TEXT{' NOT NULL' if c % 2 == 0 else ''}" for c in cols)
            con.executescript(f"""
CREATE TABLE r{k} (id INTEGER PRIMARY KEY, boss INTEGER{more}, FOREIGN KEY (boss) REFERENCES r{(k + 1) % 5}(id));
CREATE INDEX ix{k} ON r{k}(boss, lower(boss)); CREATE UNIQUE INDEX ux{k} ON r{k}(boss);
CREATE VIEW v{k} AS SELECT id FROM r{k} /* not r{(k + 2) % 5} */ WHERE 'r{(k + 3) % 5}' <> '' -- nor r{(k + 4) % 5}
;""")
        for k in sorted(keys):
            when = "AFTER INSERT" if k % 2 == 0 else "BEFORE DELETE"
            con.executescript(f"CREATE TRIGGER t{k} {when} ON r{k} BEGIN UPDATE r{(k + 1) % 5} SET boss = 1 WHERE id IN (SELECT id FROM r{k}); END;")
        con.close()
        objects = mapping.map_sqlite(catalog.read_sqlite(spark, str(Path(folder, "scan.db"))))
        t = F.col("trigger")
        fired = F.when(t.isNotNull(), F.concat_ws(":", t["timing"], F.array_join(t["events"], "+"), t["table"]["schema"], t["table"]["name"]))
        texts = (shown_columns("columns").alias("columns"), shown_constraints("constraints").alias("constraints"), shown_indexes("indexes").alias("indexes"), fired.alias("fired"), shown_dependencies("dependencies").alias("dependencies"))
        return objects.select("name", "kind", *texts).na.fill("")


# Documents


@query("""
WITH d AS (SELECT role, turn % 5 AS f, count(*) AS n FROM conversations GROUP BY ALL)
SELECT role AS name, string_agg('f' || f || ':int:' || n || ':' || CASE WHEN f % 2 = 0 THEN 'null' ELSE 'not null' END, '|' ORDER BY f) AS fields, 'a:unique:z+k|b:plain:' || role AS indexes, '{"required":["f0"]}' AS extra FROM d GROUP BY role""")
def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections with fields, indexes listed twice, validators; system collections are left out."""
    c = table(spark, sf_dir, "conversations")
    fields = c.groupBy(F.col("role").alias("collection"), (F.col("turn") % 5).alias("f")).agg(F.count("*").cast("double").alias("frequency")).select("collection", _named("f", "f").alias("name"), F.lit("int").alias("data_type"), "frequency", (F.col("f") % 2 == 0).alias("nullable"))
    system = fields.limit(1).withColumn("collection", F.explode(F.array(F.lit("system.views"), F.lit("config"))))
    roles = c.select(F.col("role").alias("collection")).distinct()
    one = roles.select("collection", F.lit("b").alias("name"), F.array("collection").alias("keys"), F.lit(None).cast("boolean").alias("unique"))
    indexes = one.unionByName(one).unionByName(roles.select("collection", F.lit("a").alias("name"), F.array(F.lit("z"), F.lit("k")).alias("keys"), F.lit(True).alias("unique")))
    validators = roles.select("collection", F.lit('{"$jsonSchema":{"required":["f0"]}}').alias("validator"))
    objects = mapping.map_documents("shop", fields.unionByName(system), indexes, validators, Scope(levels={"collections": "full"}))
    shown = F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["data_type"], f["frequency"].cast("long").cast("string"), F.when(f["nullable"], "null").otherwise("not null")))
    return objects.select("name", F.array_join(shown, "|").alias("fields"), shown_indexes("indexes").alias("indexes"), "extra")


@query("SELECT least(100, count(*))::BIGINT AS n, least(100, count(*))::BIGINT AS known, 1::BIGINT AS least FROM documents")
def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample has as many documents as asked for, each once and from the table; of none asked for it has one."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    some = catalog.sample(d, 100)
    known = some.distinct().join(d.distinct(), "doc_id", "left_semi")
    return some.agg(F.count("*").alias("n")).crossJoin(known.agg(F.count("*").alias("known"))).crossJoin(catalog.sample(d, 0).agg(F.count("*").alias("least")))
