"""Queries of the catalog data source: families made of whole tables are exported, asked for through it, and mapped."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.sync import diff_last
from lattica.plans.cut import shared_folder, staged
from lattica.queries import ORACLE_SQL, new_store, query, table
from lattica.queries_mapping import FULL, mssql_families, mysql_families, pg_families, shown_modules, shown_tables
from lattica.sources import datasource


def exported(families: Mapping[str, DataFrame], folder: str) -> str:
    for name, df in families.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def folder_of(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"


def source_of(folder: str, dialect: str, **options: str) -> dict[str, str]:
    return {"dialect": dialect, "connect": "lattica.sources.standin:connect", "args": json.dumps({"folder": folder, "dialect": dialect, "database": options.get("database", "")}), **options}


def scanned(spark: SparkSession, families: Mapping[str, DataFrame], dialect: str) -> DataFrame:
    folder = exported(families, folder_of(spark))
    return datasource.objects_of(staged(datasource.read_catalog(spark, source_of(folder, dialect, families=",".join(families)))), dialect, FULL)


@query(ORACLE_SQL["mssql_tables"])
def scanned_mssql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of mssql_tables, asked for through the source."""
    return shown_tables(scanned(spark, mssql_families(spark, sf_dir), "mssql"))


@query(ORACLE_SQL["mssql_modules"])
def scanned_mssql_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules of mssql_modules; what views take of others comes from a call for each view."""
    return shown_modules(scanned(spark, mssql_families(spark, sf_dir), "mssql"))


@query(ORACLE_SQL["pg_tables"])
def scanned_pg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_tables(scanned(spark, pg_families(spark, sf_dir), "pg"))


@query(ORACLE_SQL["mysql_tables"])
def scanned_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_tables(scanned(spark, mysql_families(spark, sf_dir), "mysql"))


@query("""
WITH n AS (SELECT role, count(*) AS n FROM conversations GROUP BY role),
f AS (SELECT role, 'turn' AS name, 'numeric' AS kind, count(*) AS c FROM conversations GROUP BY role UNION ALL SELECT role, 'said.text', 'string', count(*) FROM conversations WHERE text IS NOT NULL GROUP BY role
  UNION ALL SELECT role, 'said.f' || turn % 5, 'bool', count(*) FROM conversations GROUP BY role, turn % 5)
SELECT role AS collection, name, kind AS data_type, round(c / n, 9) AS frequency, c < n AS nullable, '_id_:unique:_id|by_turn:plain:turn+said.text' AS indexes, '{"required":["turn"]}' AS extra FROM f JOIN n USING (role)""")
def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each role's turns as a collection of documents, all of them sampled: fields, indexes and validators."""
    c = table(spark, sf_dir, "conversations")
    flag = F.concat(F.lit('"f'), (F.col("turn") % 5).cast("string"), F.lit('":true'))
    said = F.concat_ws(",", F.when(F.col("text").isNotNull(), F.concat(F.lit('"text":'), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2))), flag)
    doc = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"said":{'), said, F.lit("}}"))
    folder = folder_of(spark)
    c.select(doc.alias("document"), F.col("role").alias("collection")).write.partitionBy("collection").parquet(folder)
    args = {"folder": folder, "indexes": {"by_turn": ["turn", "said.text"], "_id_": ["_id"]}, "validator": {"$jsonSchema": {"required": ["turn"]}}}
    options = {"dialect": "documents", "connect": "lattica.sources.standin:connect_documents", "args": json.dumps(args), "sample": str(10**9)}
    objects = datasource.objects_of(staged(datasource.read_catalog(spark, options)), "documents", database="shop")
    index = F.array_join(F.transform("indexes", lambda x: F.concat_ws(":", x["name"], F.when(x["unique"], "unique").otherwise("plain"), F.array_join(x["columns"], "+"))), "|")
    rows = objects.select(F.col("name").alias("collection"), F.explode("fields").alias("f"), index.alias("indexes"), "extra")
    return rows.select("collection", "f.name", "f.data_type", F.round("f.frequency", 9).alias("frequency"), "f.nullable", "indexes", "extra")


@query("""
SELECT 'first: tables' AS what, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'first: columns', count(*)::BIGINT FROM customer
UNION ALL SELECT 'unchanged: commits', 0 UNION ALL SELECT 'changed: commits', 1 UNION ALL SELECT 'changed: tables', count(*) FROM nation WHERE n_nationkey % 10 <> 3
UNION ALL SELECT 'added', 0 UNION ALL SELECT 'removed', (SELECT count(*) FROM nation WHERE n_nationkey % 10 = 3) + (SELECT count(*) FROM customer WHERE c_nationkey % 10 = 3)""")
def followed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that follows a source as a stream: at first, with nothing new, and after tables went."""
    all_ = mysql_families(spark, sf_dir)
    folder, store = folder_of(spark), new_store(spark)
    options = source_of(folder, "mysql", families="tables,columns")

    def step(families: Mapping[str, DataFrame] | None) -> int:
        if families is not None:
            exported(families, folder)
        before = store.version
        datasource.follow(store, options, f"{folder}-checkpoint").awaitTermination()
        store.refresh()
        return store.version - before

    kinds = lambda: {r.kind: r.n for r in store.nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    some = {k: all_[k] for k in ("tables", "columns")}
    step(some)
    first = kinds()
    same = step(None)
    less = F.regexp_extract("table_name", r"(\d+)$", 1).cast("long") % 10 != 3
    changed = step({k: df.where(less) for k, df in some.items()})
    moved = {r.change: r.n for r in diff_last(store)[1].groupBy("change").agg(F.count("*").alias("n")).collect()}
    rows = [("first: tables", first["table"]), ("first: columns", first["column"]), ("unchanged: commits", same), ("changed: commits", changed), ("changed: tables", kinds()["table"]), ("added", moved.get("added", 0)), ("removed", moved.get("removed", 0))]
    return spark.createDataFrame(rows, "what STRING, n LONG")
