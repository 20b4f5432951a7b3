"""References that nobody declared, inferred from names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.ids import edge_id
from lattica.functions.naming import candidate_names, entity, type_family
from lattica.functions.text import local_name
from lattica.plans import hot

# Weights of convention, type and key, and the least score.
BY_NAME, BY_TYPE, BY_KEY, LEAST = 0.5, 0.3, 0.2, 0.5


def parent_of(qname: Column) -> Column:
    """All before the last dot; null without one."""
    return F.when(F.instr(qname, ".") > 1, F.regexp_replace(qname, r"\.[^.]*$", ""))


def key_columns(nodes: DataFrame) -> DataFrame:
    """(parent, column) of every primary key."""
    pk = nodes.where("kind = 'constraint' AND payload.type = 'PK'").select(parent_of(F.col("qname")).alias("parent"), F.explode("payload.columns").alias("column"))
    return pk.select("parent", F.lower("column").alias("column")).distinct()


def targets(nodes: DataFrame) -> DataFrame:
    """(table, id, column, data_type, is_pk): columns and fields by their table's local name, all schemas together."""
    rows = nodes.where("kind IN ('column', 'field') AND payload.data_type <> ''")
    rows = rows.withColumn("parent", parent_of(F.col("qname")))
    keys = key_columns(nodes).withColumn("is_pk", F.lit(True))
    rows = rows.join(keys, (rows.parent == keys.parent) & (F.lower(rows.name) == keys.column), "left").drop(keys.parent).drop(keys.column)
    return rows.select(F.lower(local_name(F.col("parent"))).alias("table"), "id", F.col("name").alias("dst_column"), F.col("payload.data_type").alias("dst_type"), F.coalesce("is_pk", F.lit(False)).alias("is_pk"))


def infer_references(nodes: DataFrame, edges: DataFrame, threshold: float = LEAST, column_grain_dedup: bool = False) -> DataFrame:
    """inferred_reference edges, column to column, for names that follow a convention and types of one family.

    Columns that are the source of a declared reference are left out. Declared references lead from table to table, so
    that only bites for edges made by hand; column_grain_dedup leaves out columns named by declared references instead.
    """
    src = nodes.where("kind IN ('column', 'field')").withColumn("src_type", F.col("payload.data_type")).where("src_type <> ''")
    linked = edges.where("kind = 'references'")
    src = src.join(linked.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    if column_grain_dedup:
        tables = nodes.select(F.col("id").alias("src"), F.col("qname").alias("table"))
        named = linked.where("attrs.src_column IS NOT NULL").join(tables, "src").select(F.concat("table", F.lit("."), F.lower("attrs.src_column")).alias("qname")).distinct()
        src = src.join(named, "qname", "left_anti")
    match = entity(F.col("name"))
    src = src.select(F.col("id").alias("src"), F.col("name").alias("src_column"), "src_type", match.alias("m")).where("m IS NOT NULL")
    src = src.select("src", "src_column", type_family(F.col("src_type")).alias("family"), F.col("m.conv").alias("conv"), F.explode(candidate_names(F.col("m.entity"))).alias("table"))
    to = targets(nodes).withColumn("family", type_family(F.col("dst_type")))
    score = F.lit(BY_NAME) * F.col("conv") + F.lit(BY_TYPE) + F.lit(BY_KEY) * F.col("is_pk").cast("double")
    rows = hot.met(src, to, ["table", "family"]).withColumn("score", score).where(F.col("score") >= threshold)
    kind = F.lit("inferred_reference")
    none = F.lit(None)
    attrs = F.struct(
        F.col("src_column"), F.col("dst_column"), none.cast("string").alias("event"), none.cast("boolean").alias("aggregate"), none.cast("int").alias("ordinal"), none.cast("string").alias("constraint_name"), none.cast("array<string>").alias("dst_columns")
    )
    return rows.select(edge_id(kind, F.col("src"), F.col("id"), F.concat("src_column", F.lit(">"), "dst_column")).alias("id"), kind.alias("kind"), "src", F.col("id").alias("dst"), F.lit("inferred").alias("confidence"), "score", attrs.alias("attrs"))


def ordered_inferred(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst", F.desc("score"), "attrs.src_column", "id")
