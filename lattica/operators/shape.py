"""Shaping the graph for display: collapse, pruning, communities, entity diagrams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.ids import SHA1, packed
from lattica.plans.components import components
from lattica.plans.cut import discard, large, staged
from lattica.plans.labels import propagated
from lattica.plans.numbering import with_row_numbers

# Kinds that stay on top by default, those of columns, and the heavy ones.
STRUCTURAL = ("database", "schema", "table", "view", "procedure", "function", "sequence", "collection")
GRAIN = ("column", "field")
HEAVY = ("constraint", "index", "trigger")


def kept_kinds(kinds: Sequence[str] | None = None, columns: bool = False, full: bool = False) -> tuple[str, ...]:
    if kinds is not None:
        return tuple(kinds)
    if full:
        return STRUCTURAL + GRAIN + HEAVY
    return STRUCTURAL + (GRAIN if columns else ())


def parents(edges: DataFrame) -> DataFrame:
    """(id, parent) by containment, and of a trigger by what it fires on; of several the edge with the smallest id."""
    down = edges.where("kind IN ('has_column', 'has_constraint', 'has_index')").select(F.col("dst").alias("id"), F.col("src").alias("parent"), F.col("id").alias("edge"))
    up = edges.where("kind = 'fires_on'").select(F.col("src").alias("id"), F.col("dst").alias("parent"), F.col("id").alias("edge"))
    return down.unionByName(up).groupBy("id").agg(F.min_by("parent", "edge").alias("parent"))


def kept_ancestors(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str], depth: int = 3) -> DataFrame:
    """(id, kept): the nearest node up the parents, the node itself first, that is of a kept kind; none without one.

    The model nests at most three deep, so that many lookups do.
    """
    keep = F.col("kind").isin(*kinds)
    own = nodes.select("id", F.when(keep, F.col("id")).alias("kept"), F.col("id").alias("at"))
    up = parents(edges).select(F.col("id").alias("at"), "parent")
    kept = nodes.where(keep).select(F.col("id").alias("hit"))
    real = nodes.select(F.col("id").alias("parent"))
    for _ in range(depth):
        open_ = own.where("kept IS NULL").join(up, "at").join(real, "parent", "left_semi")
        step = open_.join(kept, F.col("parent") == F.col("hit"), "left").select("id", F.col("hit").alias("kept"), F.col("parent").alias("at"))
        own = own.where("kept IS NOT NULL").unionByName(step)
    return own.where("kept IS NOT NULL").select("id", "kept")


def collapse(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] | None = None, columns: bool = False, full: bool = False, schema: str | None = None, min_degree: int = 0) -> tuple[DataFrame, DataFrame]:
    """Kept nodes, and edges between their nearest kept ancestors: no loops, and one of each kind and pair, by the smallest id."""
    keep = kept_kinds(kinds, columns, full)
    nodes_kept = nodes.where(F.col("kind").isin(*keep))
    if schema is not None:
        nodes_kept = nodes_kept.where(F.col("schema") == schema)
    up = kept_ancestors(nodes, edges, keep)
    if schema is not None:
        up = up.join(nodes_kept.select(F.col("id").alias("kept")), "kept", "left_semi")
    ends = edges.join(up.select(F.col("id").alias("src"), F.col("kept").alias("s")), "src").join(up.select(F.col("id").alias("dst"), F.col("kept").alias("t")), "dst").where("s <> t")
    first = F.row_number().over(Window.partitionBy("kind", "s", "t").orderBy("id"))
    rewired = ends.withColumn("__n", first).where("__n = 1").select("id", "kind", F.col("s").alias("src"), F.col("t").alias("dst"), "confidence", "score", "attrs")
    return min_degree_core(nodes_kept, rewired, min_degree) if min_degree > 0 else (nodes_kept, rewired)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def min_degree_core(nodes: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of at least that many edge ends, again and again until none goes; only the ends of edges are written meanwhile."""
    count, alive = nodes.count(), nodes.select(packed("id").alias("id"))
    links, core = staged(edges.select(packed("src").alias("src"), packed("dst").alias("dst"))), None
    while True:
        left = staged(degrees(alive, links).where(F.col("degree") >= least).select("id"))
        n = left.count()
        if n == count:
            break
        old, alive, core, count = links, left, left, n
        links = staged(links.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
        discard(old)
    discard(links)
    if core is None:
        return nodes, edges
    within = lambda df, c: df.join(core.select(F.col("id").alias("__in")), packed(c) == F.col("__in"), "left_semi")
    return within(nodes, "id"), within(within(edges, "src"), "dst")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable."""
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if ends.agg(F.bool_and(F.col("u").rlike(SHA1) & F.col("v").rlike(SHA1))).first()[0]:  # half the bytes, in the same order
        found = components(ends.select(F.unhex("u").alias("u"), F.unhex("v").alias("v")))
        found = found.select(F.lower(F.hex("node")).alias("id"), F.lower(F.hex("component")).alias("component"))
    else:
        found = components(ends).withColumnRenamed("node", "id")
    return staged(nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def communities(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, community) and (community, name, count), by label propagation.

    The propagation is sequential by definition; `plans/labels.py` works out together what doesn't depend on one another. A
    community's number is its place by its smallest member id; its name the commonest schema of its members, or if all
    share one schema the commonest first part of their names, ties to the smaller.
    """
    order = with_row_numbers(nodes.select("id"), ["id"], "v")  # as ids do, so the smaller label is that of the node that comes first
    ends = edges.where("src <> dst").join(large(order.select(F.col("id").alias("src"), F.col("v").alias("a"))), "src").select("dst", "a")
    ends = ends.join(large(order.select(F.col("id").alias("dst"), F.col("v").alias("b"))), "dst").groupBy("a", "b").agg(F.count("*").alias("w"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy(F.col("a").alias("v"), F.col("b").alias("u"))
    links = staged(both.agg(F.sum("w").alias("w")))
    labels = staged(order.join(large(propagated(links)), "v", "left").select("id", "v", F.coalesce("label", "v").alias("label")))
    discard(links)
    first = labels.groupBy("label").agg(F.min("v").alias("first"))
    number = with_row_numbers(first, ["first"], "community").select("label", "community")
    of = labels.join(number, "label").select("id", "community")
    several = nodes.select(F.count_distinct("schema") > 1).first()[0]
    key = F.coalesce("schema", F.lit("")) if several else F.split_part("name", F.lit("_"), F.lit(1))
    members = of.join(nodes.select("id", key.alias("key")), "id")
    best = members.where("key <> ''").groupBy("community", "key").agg(F.count("*").alias("n"))
    best = best.groupBy("community").agg(F.min_by("key", F.struct(-F.col("n"), F.col("key"))).alias("name"))
    sizes = of.groupBy("community").agg(F.count("*").alias("count"))
    return of, sizes.join(best, "community", "left").select("community", F.coalesce("name", F.concat(F.lit("community-"), "community")).alias("name"), "count").orderBy("community")


def data_block(nodes: DataFrame, edges: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a viewer draws: (i, id, label, kind, community, degree), edges as (s, t, kind) of node numbers, and communities."""
    kept, links = collapse(nodes, edges, **options)
    kept, links = staged(kept), staged(links)
    of, named = communities(kept, links)
    numbered = with_row_numbers(kept, ["qname", "id"], "i").join(of, "id", "left").join(degrees(kept, links), "id").select("i", "id", F.col("qname").alias("label"), "kind", F.coalesce("community", F.lit(0)).alias("community"), "degree")
    at = numbered.select("id", "i")
    drawn = links.join(at.select(F.col("id").alias("src"), F.col("i").alias("s")), "src").join(at.select(F.col("id").alias("dst"), F.col("i").alias("t")), "dst").select("s", "t", "kind").orderBy("s", "t", "kind")
    return numbered.orderBy("i"), drawn, named


def entity_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, child): tables by references from the child, distinct."""
    tables = nodes.where("kind = 'table'").select(packed("id").alias("id"), "qname")
    # The edges of one pair stand together and come to one task by its child, where they are made one; only then parents are looked up.
    ends = edges.where("kind = 'references'").select(packed("src").alias("src"), packed("dst").alias("dst")).repartition("src").distinct()
    rows = ends.join(large(tables.select(F.col("id").alias("src"), F.col("qname").alias("child"))), "src").select("dst", "child")
    rows = rows.join(large(tables.select(F.col("id").alias("dst"), F.col("qname").alias("parent"))), "dst").select("parent", "child")
    # Ranges in order, sorted within: one shuffle for both what is distinct and the order.
    return rows.repartitionByRange("parent", "child").distinct().sortWithinPartitions("parent", "child")


def entity_diagram(nodes: DataFrame, edges: DataFrame) -> Iterator[str]:
    """Lines of a Mermaid entity diagram: every table, then every relation."""
    yield "erDiagram"
    for r in nodes.where("kind = 'table'").select("qname").orderBy("qname").toLocalIterator():
        yield f'    "{r.qname}" {{'
        yield "    }"
    for r in entity_relations(nodes, edges).toLocalIterator():
        yield f'    "{r.parent}" ||--o{{ "{r.child}" : references'
