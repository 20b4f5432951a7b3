"""What a DDL statement would touch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import ddl_identifiers
from lattica.operators.graph import DEPTH, impact, resolve_names


@dataclass
class Precheck:
    """matched (qname, kind), affected (bucket, qname, kind, has_dynamic_sql), what_to_test (qname), unmatched (name)."""

    matched: DataFrame
    affected: DataFrame
    what_to_test: DataFrame
    unmatched: DataFrame


def identifiers(spark, ddl: str) -> DataFrame:
    return spark.createDataFrame([(ddl,)], "ddl STRING").select(F.explode(ddl_identifiers(F.col("ddl"))).alias("name"))


def precheck(nodes: DataFrame, edges: DataFrame, ddl: str, depth: int = DEPTH) -> Precheck:
    """Names in the DDL, their nodes, and all that those nodes' impact reaches, by role, each once.

    One traversal serves all matched nodes. A name is matched by its exact qname, with the first kind.
    """
    names = identifiers(nodes.sparkSession, ddl)
    found = resolve_names(nodes, names)
    matched = found.select("id", "qname", "kind").dropDuplicates(["qname"])
    reached = impact(nodes, edges, matched.select("id"), depth).chains.select("access", F.explode(F.slice("nodes", 2, 2**30)).alias("id")).distinct()
    rows = reached.join(nodes.select("id", "qname", "kind", F.coalesce("payload.has_dynamic_sql", F.lit(False)).alias("has_dynamic_sql")), "id")
    bucket = F.when(F.col("kind") == "trigger", F.lit("triggers")).when(F.col("kind").isin("index", "constraint"), F.lit("constraints_and_indexes")).when(F.col("access") == "write", F.lit("writers")).otherwise(F.lit("readers"))
    affected = rows.select(bucket.alias("bucket"), "qname", "kind", "has_dynamic_sql").dropDuplicates(["bucket", "qname"])
    return Precheck(matched.select("qname", "kind").orderBy("qname"), affected.orderBy("bucket", "qname"), affected.select("qname").distinct().orderBy("qname"), names.join(found, "name", "left_anti").select("name").distinct().orderBy("name"))
