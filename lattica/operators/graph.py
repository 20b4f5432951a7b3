"""Graph queries: neighbours, impact, join paths, and finding a node by its name.

Traversals take a table of pivots, so many start points share one run: a round is one join of the frontier with the
edges, an anti-join with what was visited, and a window that keeps the first discoverer. The frontier is never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.model import NODE_KINDS
from lattica.plans.cut import discard, large, staged
from lattica.plans.numbering import with_row_numbers

# Edge kinds that carry impact against their direction, those that write, and the depth.
IMPACT_KINDS = ("writes_to", "reads_from", "depends_on", "references", "calls")
WRITE_KINDS = ("writes_to",)
DEPTH = 3


def edges_from(edges: DataFrame, node: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    rows = edges.where(F.col("src") == node)
    return (rows.where(F.col("kind").isin(*kinds)) if kinds else rows).orderBy("kind", "dst", "id")


def edges_to(edges: DataFrame, node: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    rows = edges.where(F.col("dst") == node)
    return (rows.where(F.col("kind").isin(*kinds)) if kinds else rows).orderBy("kind", "src", "id")


def neighbor_index(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(node, edge_kind, direction, edge_id, id, kind, qname) of both ends of every edge; ends that aren't nodes give none."""
    used = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    ends = used.select("src", "dst", F.col("kind").alias("edge_kind"), F.col("id").alias("edge_id"))
    out = ends.select(F.col("src").alias("node"), "edge_kind", F.lit("out").alias("direction"), "edge_id", F.col("dst").alias("id"))
    into = ends.select(F.col("dst").alias("node"), "edge_kind", F.lit("in").alias("direction"), "edge_id", F.col("src").alias("id"))
    return out.unionByName(into).join(nodes.select("id", "kind", "qname"), "id").select("node", "edge_kind", "direction", "edge_id", "id", "kind", "qname")


def neighbors(nodes: DataFrame, edges: DataFrame, node: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The neighbours of one node, by edge kind and direction, each by (qname, id)."""
    near = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return neighbor_index(nodes, near, kinds).where(F.col("node") == node).orderBy("edge_kind", "direction", F.expr("qname COLLATE UNICODE"), "id", "edge_id")


def neighbor_groups(index: DataFrame) -> DataFrame:
    """One row for each node, edge kind and direction, with its neighbours as an array by (qname, id, edge)."""
    return index.groupBy("node", "edge_kind", "direction").agg(F.array_sort(F.collect_list(F.struct("qname", "id", "edge_id", "kind"))).alias("neighbors"))


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in NODE_KINDS]), kind)


def resolve_names(nodes: DataFrame, names: DataFrame, prefer_real: bool = False) -> DataFrame:
    """(name, id, kind, qname, others) for names (name): the node of that qname with the first kind.

    prefer_real puts nodes that aren't missing first; others lists the kinds of the further matches, null ones none.
    """
    hit = names.join(nodes.select("id", "kind", "qname", "missing", "payload"), F.lower("name") == F.col("qname"))
    real = [F.col("missing")] if prefer_real else []
    w = Window.partitionBy("name").orderBy(*real, kind_rank(F.col("kind")), "id")
    rank = hit.withColumn("__n", F.row_number().over(w)).withColumn("others", F.collect_list("kind").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rank.where("__n = 1").select("name", "id", "kind", "qname", "missing", "payload", F.slice("others", 2, 2**30).alias("others"))


@dataclass
class Impact:
    """chains (pivot, node, nodes, kinds, access, depth), truncated (pivot), degraded (pivot, id)."""

    chains: DataFrame
    truncated: DataFrame
    degraded: DataFrame


def pivots_of(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(pivot, start, column): a column starts at the table that has it, the first by id."""
    wanted = ids.select(F.col("id").alias("pivot")).distinct()
    owner = edges.where("kind = 'has_column'").select(F.col("dst").alias("pivot"), "src").join(wanted, "pivot", "left_semi").groupBy("pivot").agg(F.min("src").alias("owner"))
    rows = wanted.join(owner, "pivot", "left")
    kinds = nodes.select(F.col("id").alias("pivot"), F.col("kind").alias("pivot_kind"), F.col("name").alias("pivot_name"))
    rows = rows.join(kinds, "pivot", "left")
    owned = (F.col("pivot_kind") == "column") & F.col("owner").isNotNull()
    return rows.select("pivot", F.when(owned, F.col("owner")).otherwise(F.col("pivot")).alias("start"), F.when(owned, F.col("pivot_name")).alias("column"))


def impact(nodes: DataFrame, edges: DataFrame, ids: DataFrame, depth: int = DEPTH) -> Impact:
    """What each of ids (id) would affect: breadth first over inbound edges, one chain for each node that is reached.

    Of several discoverers the frontier node with the smallest id wins; of its parallel edges the smallest kind. From a
    column, the first hop follows dependencies that name the column or none at all, before other edges.
    """
    inbound = edges.where(F.col("kind").isin(*IMPACT_KINDS)).select(F.col("id").alias("edge"), F.col("kind").alias("edge_kind"), F.col("src").alias("next"), F.col("dst").alias("node"), F.col("attrs.dst_columns").alias("columns"))
    start = staged(pivots_of(nodes, edges, ids))
    frontier = start.select("pivot", F.col("start").alias("node"), "column", F.array("start").alias("nodes"), F.array().cast("array<string>").alias("kinds"))
    visited = start.select("pivot", F.col("start").alias("seen"))
    levels = []
    for hop in range(depth):
        step = frontier.join(inbound, "node")
        depends = F.col("edge_kind") == "depends_on"
        if hop == 0:
            named = F.array_contains(F.transform("columns", F.lower), F.lower("column"))
            step = step.where(F.col("column").isNull() | ~depends | F.col("columns").isNull() | named)
        step = step.join(visited, (step.pivot == visited.pivot) & (step.next == visited.seen), "left_anti")
        first = F.when(F.col("column").isNotNull() & depends, 0).otherwise(1)
        order = Window.partitionBy("pivot", "next").orderBy("node", first, "edge_kind", "edge")
        step = step.withColumn("__n", F.row_number().over(order)).where("__n = 1")
        frontier = staged(step.select("pivot", F.col("next").alias("node"), F.lit(None).cast("string").alias("column"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("kinds", F.array("edge_kind")).alias("kinds")))
        levels.append(frontier)
        visited = visited.unionByName(frontier.select("pivot", F.col("node").alias("seen")))
        if hop + 1 < depth and frontier.isEmpty():
            break
    chains = frontier.limit(0) if not levels else levels[0]
    for level in levels[1:]:
        chains = chains.unionByName(level)
    write = F.element_at("kinds", -1).isin(*WRITE_KINDS)
    chains = chains.select("pivot", "node", "nodes", "kinds", F.when(write, F.lit("write")).otherwise(F.lit("read")).alias("access"), F.size("kinds").alias("depth"))
    edge = frontier if len(levels) == depth else frontier.limit(0)
    more = edge.join(inbound, "node")
    truncated = more.join(visited, (more.pivot == visited.pivot) & (more.next == visited.seen), "left_anti").select("pivot").distinct()
    closure = chains.select("pivot", F.explode("nodes").alias("id")).distinct()
    degraded = closure.join(nodes.where("payload.has_dynamic_sql").select("id"), "id").select("pivot", "id").orderBy("pivot", "id")
    return Impact(chains, truncated, degraded)


@dataclass
class Path:
    """hops: (from, to, columns as (from, to) pairs); without a path, the neighbours of both ends."""

    found: bool
    hops: list[tuple[str, str, list[tuple[str, str]]]]
    from_neighbors: list[str]
    to_neighbors: list[str]
    inferred: bool = False


def inferred_links(edges: DataFrame) -> DataFrame:
    """(src, dst, src_column, dst_column): inferred references, from the tables that have their columns."""
    owner = edges.where("kind = 'has_column'").select(F.col("src").alias("table"), F.col("dst").alias("column"))
    rows = edges.where("kind = 'inferred_reference'").select("src", "dst", "attrs.src_column", "attrs.dst_column")
    rows = rows.join(owner.toDF("a", "src"), "src").join(owner.toDF("b", "dst"), "dst")
    return rows.select(F.col("a").alias("src"), F.col("b").alias("dst"), "src_column", "dst_column")


def join_steps(edges: DataFrame, allow_inferred: bool = False) -> DataFrame:
    """(a, b): tables that a whole reference links, both ways, distinct."""
    whole = edges.where("kind = 'references' AND attrs.aggregate").select("src", "dst")
    if allow_inferred:
        whole = whole.union(inferred_links(edges).select("src", "dst"))
    ends = whole.toDF("a", "b")
    return ends.union(whole.select("dst", "src")).where("a <> b").distinct()


def join_path(nodes: DataFrame, edges: DataFrame, start: str, end: str, allow_inferred: bool = False, max_hops: int | None = None) -> Path:
    """The shortest join path between two tables, with the columns of each hop.

    Undirected, breadth first; of several discoverers the first by (qname, id). Each level is staged, so the path is read
    back by one lookup for each hop; it goes on until nothing new is found, or for max_hops if given. allow_inferred also follows inferred references, which by default is not done.
    """
    if start == end:
        return Path(True, [], [], [])
    names = nodes.select("id", "qname")
    steps = staged(join_steps(edges, allow_inferred).join(names.select(F.col("id").alias("a"), F.col("qname").alias("a_name")), "a").join(names.select(F.col("id").alias("b"), F.col("qname").alias("b_name")), "b"))
    frontier = names.where(F.col("id") == start).select(F.col("id").alias("node"), F.col("qname").alias("name"))
    visited, levels = frontier.select("node"), []
    while max_hops is None or len(levels) < max_hops:
        step = frontier.join(steps, F.col("node") == F.col("a")).select("a", "a_name", F.col("b").alias("node"), F.col("b_name").alias("name"))
        step = step.join(visited, "node", "left_anti")
        found = staged(step.groupBy("node", "name").agg(F.min_by("a", F.struct(F.expr("a_name COLLATE UNICODE"), "a")).alias("before")))
        if found.isEmpty():
            break
        levels.append(found)
        if not found.where(F.col("node") == end).isEmpty():
            return _hops(edges, levels, end, allow_inferred)
        visited = visited.union(found.select("node"))
        frontier = found.select("node", "name")
    near = [_one_hop(edges, x) for x in (start, end)]
    return Path(False, [], *near)


@dataclass
class Paths:
    """hops (start, end, hop, a, b) of each pair that a path joins; apart (start, end) of the others."""

    hops: DataFrame
    apart: DataFrame

    def columns(self, edges: DataFrame, allow_inferred: bool = False) -> DataFrame:
        """(start, end, hop, a, b, columns): the hops with their column pairs, sorted; inferred ones where none is declared."""
        steps = self.hops.select("a", "b").distinct().withColumn("hop", F.struct("a", "b"))
        links = edges.where("kind = 'references' AND attrs.src_column IS NOT NULL").select("src", "dst", "attrs.src_column", "attrs.dst_column", F.lit(0).alias("guess"))
        if allow_inferred:
            links = links.unionByName(inferred_links(edges).withColumn("guess", F.lit(1)))
        found = hop_columns(links, steps, "guess").groupBy("hop").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("columns"))
        found = found.select(F.col("hop.a").alias("a"), F.col("hop.b").alias("b"), "columns")
        return self.hops.join(found, ["a", "b"], "left").select("start", "end", "hop", "a", "b", "columns")


def join_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, allow_inferred: bool = False) -> Paths:
    """The shortest join path of each of many pairs (start, end), the one that join_path() gives.

    Searches go breadth first from all starts and from all ends, always a level of that side whose next level has fewer steps:
    pairs that share an end share its search, so a few ends of many pairs are searched from, not the many starts that would
    each meet a hub's neighbours; ends whose pairs are all settled stop. Where the two searches of a pair meet,
    nodes of its shortest paths are marked back to the end; the path then goes from the end to the marked node first by
    (qname, id), and behind the meeting point to the first discoverer, as one search from the start would. Dead ends that
    no pair asks for are left out first; the nodes that stay are numbered in the order of (qname, id), and the searches carry
    numbers alone. Levels are staged, frontiers stay distributed; a yes or no and two sums a level reach the driver. Equal ends
    have no hops, null ones are left out.
    """
    given = staged(pairs.select("start", "end").where("start IS NOT NULL AND end IS NOT NULL AND start <> end").distinct())
    asked = staged(given.select(F.col("start").alias("node")).union(given.select("end")).distinct())
    steps = _on_ways(staged(join_steps(edges, allow_inferred)), asked)
    used = asked.union(steps.select("a")).distinct()
    names = nodes.select(F.col("id").alias("node"), "qname").join(large(used), "node", "left_semi").groupBy("node").agg(F.min("qname").alias("qname"))
    numbers = with_row_numbers(names, [F.expr("qname COLLATE UNICODE"), "node"], "n").select("node", "n")
    of = lambda id_, n: numbers.select(F.col("node").alias(id_), F.col("n").alias(n))
    links = staged(steps.join(large(of("a", "x")), "a").join(large(of("b", "y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    discard(steps)
    given = staged(given.join(large(of("start", "s")), "start", "left").join(large(of("end", "e")), "end", "left"))
    open_ = staged(given.where("s IS NOT NULL AND e IS NOT NULL").select(F.col("s").alias("start"), F.col("e").alias("end")))
    degrees = staged(links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")))
    with_ways = lambda level: staged(level.join(degrees, "node", "left").select("root", "node", "before", F.coalesce("n", F.lit(0)).alias("n")))
    wanted = lambda: {key: staged(open_.select(F.col(key).alias("root")).distinct()) for key in ("start", "end")}
    want = wanted()
    ahead, back = [[with_ways(want[key].select("root", F.col("root").alias("node"), F.lit(None).cast("long").alias("before")))] for key in ("start", "end")]
    ways = lambda level, key: level.join(want[key], "root", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hops = []
    while True:
        side, key = min(((ahead, "start"), (back, "end")), key=lambda x: ways(x[0][-1], x[1]))
        step = side[-1].join(want[key], "root", "left_semi").join(links, F.col("node") == F.col("a")).select("root", "a", F.col("b").alias("node"))
        # Neighbours of a level are in the one before it, in itself or new.
        for seen in side[-2:]:
            step = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        side.append(with_ways(step.groupBy("root", "node").agg(F.min("a").alias("before"))))
        met = open_.join(ahead[-1].select(F.col("root").alias("start"), "node"), "start").join(back[-1].select(F.col("root").alias("end"), "node"), ["end", "node"])
        met = staged(met.select("start", "end", "node"))
        if not met.isEmpty():
            hops.append(_walked(met, links, ahead, back))
            open_ = staged(open_.join(met.select("start", "end").distinct(), ["start", "end"], "left_anti"))
            want = wanted()
        if side[-1].isEmpty() or open_.isEmpty():
            break
    out = hops[0] if hops else open_.select("start", "end", F.lit(0).alias("hop"), F.col("start").alias("a"), F.col("end").alias("b")).limit(0)
    for more in hops[1:]:
        out = out.unionByName(more)
    for end in ("a", "b"):
        out = out.withColumnRenamed(end, "__n").join(large(of(end, "__n")), "__n").drop("__n")
    ids = given.select("start", "end", F.col("s"), F.col("e"))
    out = out.withColumnsRenamed({"start": "s", "end": "e"}).join(large(ids), ["s", "e"]).select("start", "end", "hop", "a", "b")
    known = F.col("s").isNotNull() & F.col("e").isNotNull()
    apart = given.where(known).join(large(open_.withColumnsRenamed({"start": "s", "end": "e"})), ["s", "e"], "left_semi").unionByName(given.where(~known)).select("start", "end")
    return Paths(staged(out), staged(apart))


def _on_ways(steps: DataFrame, asked: DataFrame) -> DataFrame:
    """steps (a, b) without those of dead ends: a node with one neighbour lies on no path but its own, so it goes unless asked for.

    Nodes that are dead ends then go as well, as long as a round takes a tenth of the steps.
    """
    while True:
        ends = steps.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
        ends = staged(ends.join(large(asked), "node", "left_anti"))
        if 20 * ends.count() < steps.count():
            return steps
        left = steps.join(large(ends), F.col("a") == F.col("node"), "left_anti").join(large(ends), F.col("b") == F.col("node"), "left_anti")
        left = staged(left)
        discard(steps, ends)
        steps = left
        if steps.isEmpty():
            return steps


def _walked(met: DataFrame, links: DataFrame, ahead: list[DataFrame], back: list[DataFrame]) -> DataFrame:
    """(start, end, hop, a, b) of pairs whose searches meet in met (start, end, node), the last levels of both; nodes are numbers in the order of (qname, id)."""
    steps = links.select(F.col("a").alias("from"), F.col("b").alias("node"))
    marked, ways = met, []
    for level in back[-2:0:-1]:  # towards the end, without it; which neighbours are nearer to it is the same for all starts
        near = marked.select("end", F.col("node").alias("from")).distinct().join(steps, "from").join(level.select(F.col("root").alias("end"), "node"), ["end", "node"])
        ways.append(staged(marked.select("start", "end", F.col("node").alias("from")).join(near, ["end", "from"])))
        marked = ways[-1].select("start", "end", "node").distinct()
    n, hops = len(ahead) + len(back) - 2, []
    at = met.select("start", "end", F.col("end").alias("at")).distinct()

    def hop(rows: DataFrame) -> DataFrame:
        rows = staged(rows)
        hops.append(rows.select("start", "end", F.lit(n - len(hops) - 1).alias("hop"), F.col("node").alias("a"), F.col("at").alias("b")))
        return rows.select("start", "end", F.col("node").alias("at"))

    if len(back) > 1:
        at = hop(marked.groupBy("start", "end").agg(F.min("node").alias("node")).withColumn("at", F.col("end")))
        for way in reversed(ways):
            step = at.join(way.withColumnRenamed("node", "at"), ["start", "end", "at"])
            at = hop(step.groupBy("start", "end", "at").agg(F.min("from").alias("node")))
    for level in ahead[:0:-1]:
        at = hop(at.join(level.select(F.col("root").alias("start"), F.col("node").alias("at"), F.col("before").alias("node")), ["start", "at"]))
    out = hops[0]
    for more in hops[1:]:
        out = out.unionByName(more)
    return staged(out)


def _one_hop(edges: DataFrame, node: str) -> list[str]:
    rows = edges.where("kind = 'references'").where((F.col("src") == node) | (F.col("dst") == node))
    other = rows.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id"))
    return [r.id for r in other.where(F.col("id") != node).distinct().orderBy("id").collect()]


def _hops(edges: DataFrame, levels: list[DataFrame], end: str, allow_inferred: bool) -> Path:
    at, way = end, [end]
    for level in reversed(levels):
        at = level.where(F.col("node") == at).first().before
        way.insert(0, at)
    pairs = list(zip(way[:-1], way[1:], strict=True))
    hops = F.broadcast(edges.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "hop INT, a STRING, b STRING"))  # as many rows as hops
    declared = edges.where("kind = 'references' AND attrs.src_column IS NOT NULL").select("src", "dst", "attrs.src_column", "attrs.dst_column")
    cols: dict[int, list[tuple[str, str]]] = {}
    for r in hop_columns(declared, hops).collect():
        cols.setdefault(r.hop, []).append((r["from"], r["to"]))
    guessed: dict[int, list[tuple[str, str]]] = {}
    if allow_inferred and len(cols) < len(pairs):
        for r in hop_columns(inferred_links(edges), hops).collect():
            if r.hop not in cols:
                guessed.setdefault(r.hop, []).append((r["from"], r["to"]))
    known = cols | guessed
    return Path(True, [(a, b, sorted(known.get(i, []))) for i, (a, b) in enumerate(pairs)], [], [], inferred=bool(guessed))


def hop_columns(links: DataFrame, hops: DataFrame, *first: str) -> DataFrame:
    """(hop, from, to) for hops (hop, a, b): the column pairs of all links (src, dst, src_column, dst_column) from a to b, else those back, swapped.

    first: columns of links whose smallest values alone count, before the direction.
    """
    there = hops.join(links, (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst"))).select("hop", F.struct(*first, F.lit(0).alias("back")).alias("back"), F.col("src_column").alias("from"), F.col("dst_column").alias("to"))
    back = hops.join(links, (F.col("b") == F.col("src")) & (F.col("a") == F.col("dst"))).select("hop", F.struct(*first, F.lit(1).alias("back")).alias("back"), F.col("dst_column").alias("from"), F.col("src_column").alias("to"))
    both = there.unionByName(back)
    use = F.min("back").over(Window.partitionBy("hop"))
    return both.withColumn("use", use).where("back = use").select("hop", "from", "to").distinct()
