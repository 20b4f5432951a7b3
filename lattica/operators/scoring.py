"""Questions derived from a graph, and scoring of answers to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.ids import packed
from lattica.operators.graph import IMPACT_KINDS
from lattica.plans.cut import large


def answer(text: Column) -> Column:
    """What follows the last line that begins with ANSWER:, trimmed; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?im)^\s*answer:[ \t]*(.*)$"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def names(text: Column) -> Column:
    """Comma-separated names, quotes removed, lower-cased, distinct, in order."""
    parts = F.transform(F.split(text, ","), lambda x: F.lower(F.trim(F.regexp_replace(x, r'[\[\]"`]', ""))))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def type_token(text: Column) -> Column:
    low = F.upper(F.trim(text))
    return F.when(low == "INT", "INTEGER").otherwise(low)


def same_set(given: Column, key: Column) -> Column:
    return (F.size(F.array_except(given, key)) == 0) & (F.size(F.array_except(key, given)) == 0)


def same_list(given: Column, key: Column) -> Column:
    return given == key


def valid_order(given: Column, items: Column, before: Column) -> Column:
    """given has all items once, and each pair (first, then) of before in that order."""
    return same_set(given, items) & (F.size(given) == F.size(items)) & F.forall(before, lambda p: F.array_position(given, p["first"]) < F.array_position(given, p["then"]))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def score(rows: DataFrame) -> DataFrame:
    """rows (family, text, key, before) with correct: families by set, plan-order by order, constraints and types as lists."""
    given = names(answer(F.col("text")))
    ordered = F.col("family") == "constraint-semantics"
    types = F.col("family") == "column-type"
    typed = F.transform(given, type_token) == F.transform(F.col("key"), type_token)
    plan = F.col("family") == "plan-order"
    correct = F.when(plan, valid_order(given, F.col("key"), F.col("before"))).when(types, typed).when(ordered, same_list(given, F.col("key"))).otherwise(same_set(given, F.col("key")))
    return rows.withColumn("correct", F.coalesce(correct, F.lit(False)))


def fk_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(constraint_name, src, dst, pairs): of each foreign key its ends and column pairs."""
    pair = edges.where("kind = 'references' AND attrs.src_column IS NOT NULL")
    # Rows meet by their source alone, both to be grouped and to be named, with ids in half their bytes.
    pair = pair.select(packed("src").alias("src"), packed("dst").alias("dst"), "attrs.constraint_name", F.concat("attrs.src_column", F.lit("="), "attrs.dst_column").alias("pair")).repartition("src")
    rows = pair.groupBy("constraint_name", "src", "dst").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
    a, b = (nodes.select(packed("id").alias(c), F.col("qname").alias(f"{c}_name")) for c in ("src", "dst"))
    return rows.join(large(a), "src").drop("src").join(large(b), "dst").select("constraint_name", F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "pairs")


def _by_target(nodes: DataFrame, edges: DataFrame, kind: str, of: str, other: str) -> DataFrame:
    a, b = nodes.select(F.col("id").alias(of), F.col("qname").alias("object")), nodes.select(F.col("id").alias(other), F.col("qname").alias("answer"))
    return edges.where(F.col("kind") == kind).join(a, of).join(b, other).groupBy("object").agg(F.array_sort(F.collect_set("answer")).alias("key"))


def trigger_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _by_target(nodes, edges, "fires_on", "dst", "src")


def view_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _by_target(nodes, edges, "depends_on", "src", "dst")


def caller_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _by_target(nodes, edges, "calls", "dst", "src")


def blind_spots(nodes: DataFrame) -> DataFrame:
    return nodes.where("payload.has_dynamic_sql").select("qname").orderBy("qname")


def key_questions(nodes: DataFrame) -> DataFrame:
    """(object, key): primary-key columns in order."""
    rows = nodes.where("kind = 'constraint' AND payload.type = 'PK'")
    return rows.select(F.regexp_replace("qname", r"\.[^.]*$", "").alias("object"), F.transform("payload.columns", F.lower).alias("key")).orderBy("object")


def impact_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(object, key): what directly depends on each object."""
    a, b = nodes.select(F.col("id").alias("dst"), F.col("qname").alias("object")), nodes.select(F.col("id").alias("src"), F.col("qname").alias("answer"))
    return edges.where(F.col("kind").isin(*IMPACT_KINDS)).join(a, "dst").join(b, "src").groupBy("object").agg(F.array_sort(F.collect_set("answer")).alias("key"))
