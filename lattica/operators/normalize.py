"""Raw catalog objects become nodes and edges.

Every step is one relation: children are exploded, references are resolved by joins on (kind, qname), stubs are what an
anti-join leaves. "First wins" follows pos, the order of the source, and the place inside an object.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.functions.ids import SHA1, canonical_qname, edge_id, node_id
from lattica.model import ATTRS, EDGES, LEVEL_KEY, NODES, PAYLOAD, Graph, GraphError, Scope
from lattica.operators.infer import infer_references
from lattica.plans.cut import large, staged

OMITTED = "not indexed by configuration"
#: Children by section: kind, list in the raw object, kind of the edge from the parent.
CHILDREN = (("column", "columns", "has_column"), ("constraint", "constraints", "has_constraint"), ("index", "indexes", "has_index"), ("field", "fields", "has_column"))


def struct_of(ddl: str, **given: Column) -> Column:
    """A struct of the type, its fields given by name or null."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(ddl).fields
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def with_qname(objects: DataFrame) -> DataFrame:
    return objects.withColumn("qname", canonical_qname(F.col("schema"), F.col("name")))


def invalid(objects: DataFrame) -> DataFrame:
    """(pos, problem) of objects that no graph can be made of."""
    empty = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("object without a name"))
    arity = F.exists("constraints", lambda c: (c["type"] == "FK") & c["references"].isNotNull() & (F.size(c["columns"]) != F.size(c["references"]["columns"])))
    problem = F.coalesce(empty, F.when(arity, F.lit("foreign key with unlike numbers of columns")))
    return objects.select("pos", problem.alias("problem")).where("problem IS NOT NULL")


def validate(objects: DataFrame, engine: str) -> None:
    if not engine:
        raise GraphError("catalog without an engine")
    bad = invalid(objects).orderBy("pos").limit(1).collect()
    if bad:
        raise GraphError(f"object {bad[0].pos}: {bad[0].problem}")


def matches_any(qname: Column, patterns: Sequence[str]) -> Column:
    """schema.* for all of a schema, else the exact name; patterns are few and lower-cased."""
    out = F.lit(False)
    for p in (p.lower() for p in patterns):
        out = out | (qname.startswith(p[:-1]) if p.endswith(".*") else qname == p)
    return out


def split_excluded(objects: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Included objects, and (qname) of excluded ones."""
    named = with_qname(objects)
    out = matches_any(F.col("qname"), scope.exclude)
    if scope.honour_include and scope.include:
        out = out | ~matches_any(F.col("qname"), scope.include)
    return named.where(~out), named.where(out).select("qname").distinct()


def level_of(kind: Column, scope: Scope) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in LEVEL_KEY for x in (k, scope.level(k))]), kind), F.lit("metadata"))


def _first(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each (kind, qname), and the others."""
    n = df.withColumn("__n", F.row_number().over(Window.partitionBy("kind", "qname").orderBy(*order)))
    return n.where("__n = 1").drop("__n"), n.where("__n > 1").drop("__n")


def _null_if_empty(x: Column) -> Column:
    return F.when(F.size(x) > 0, x)


def primary_nodes(objects: DataFrame, scope: Scope) -> DataFrame:
    """A node for each object whose kind isn't off, with pos; duplicates are still there."""
    level = level_of(F.col("kind"), scope)
    routine, trigger = F.col("kind").isin("procedure", "function"), F.col("kind") == "trigger"
    body = F.when((level == "full") & (F.col("body") != ""), text.normalized_body(F.col("body")))
    payload = struct_of(
        PAYLOAD,
        comment=F.col("comment"),
        signature=F.when(routine, F.col("signature")),
        returns=F.when(routine, F.col("returns")),
        body=F.when(routine | trigger, F.col("b")),
        has_dynamic_sql=F.when(routine | trigger, F.coalesce("has_dynamic_sql", F.lit(False))),
        parameters=F.when(routine, _null_if_empty(F.array_sort("parameters", lambda a, b: a["ordinal"] - b["ordinal"]))),
        timing=F.when(trigger, F.col("trigger.timing")),
        events=F.when(trigger, F.col("trigger.events")),
    )
    rows = objects.withColumn("level", level).where("level <> 'off'").withColumn("b", body)
    return rows.select(
        "pos", node_id(F.col("kind"), F.col("qname")).alias("id"), "kind", "schema", F.lower("name").alias("name"), "qname", "level",
        F.lit(False).alias("missing"), F.lit(False).alias("excluded"), F.sha1("b").alias("body_hash"), payload.alias("payload"),
    )


def child_nodes(objects: DataFrame, scope: Scope) -> DataFrame:
    """Nodes of columns, constraints, indexes and fields, with pos, section, idx and their parent's kind, name and id."""
    out = None
    for section, (kind, items, edge) in enumerate(CHILDREN):
        level = scope.level(kind)
        if level == "off":
            continue
        rows = objects.select("pos", "schema", F.col("qname").alias("parent"), F.col("kind").alias("parent_kind"), node_id(F.col("kind"), F.col("qname")).alias("parent_id"), F.posexplode(items).alias("idx", "x"))
        payload = {
            "column": dict(data_type="x.data_type", nullable="x.nullable", ordinal="x.ordinal", default="x.default", comment="x.comment"),
            "constraint": dict(type="x.type", columns="x.columns", definition="x.definition"),
            "index": dict(unique="x.unique", columns="x.columns", method="x.method"),
            "field": dict(data_type="x.data_type", frequency="x.frequency", nullable="x.nullable"),
        }[kind]
        name = F.col("x.name") if kind == "field" else F.lower("x.name")
        qname = F.concat("parent", F.lit("."), name)
        rows = rows.select(
            "pos", F.lit(section).alias("section"), "idx", "parent_kind", "parent", "parent_id", F.lit(edge).alias("edge"), node_id(F.lit(kind), qname).alias("id"), F.lit(kind).alias("kind"), "schema", name.alias("name"),
            qname.alias("qname"), F.lit(level).alias("level"), F.lit(False).alias("missing"), F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("body_hash"),
            struct_of(PAYLOAD, **{k: F.col(v) for k, v in payload.items()}).alias("payload"), (F.col("x.ordinal") if kind == "column" else F.lit(None).cast("int")).alias("ordinal"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        empty = objects.sparkSession.createDataFrame([], "pos LONG, section INT, idx INT, parent_kind STRING, parent STRING, parent_id STRING, edge STRING, " + NODES + ", ordinal INT")
        return empty
    return out


def make_edges(df: DataFrame, kind: Column, src: Column, dst: Column, discriminator: Column | None = None, confidence: Column | None = None, score: Column | None = None, **attrs: Column) -> DataFrame:
    """Rows of the edge schema, with the columns that order them kept aside for callers by select."""
    return df.select(
        edge_id(kind, src, dst, discriminator).alias("id"), kind.alias("kind"), src.alias("src"), dst.alias("dst"),
        (F.lit("declared") if confidence is None else confidence).alias("confidence"), (F.lit(None) if score is None else score).cast("double").alias("score"), struct_of(ATTRS, **attrs).alias("attrs"),
    )


def index_edges(objects: DataFrame, kept: DataFrame) -> DataFrame:
    """in_index from kept index nodes to columns of the same parent; what isn't a column (an expression, a field) gives none.

    A column is only met if it was kept before the index, which holds within one object.
    """
    indexes = kept.where("kind = 'index'").select(F.col("id").alias("index_id"), F.expr("substring(qname, 1, length(qname) - length(name) - 1)").alias("parent"), F.posexplode("payload.columns").alias("ordinal", "c"))
    columns = kept.where("kind = 'column'").select(F.col("id").alias("column_id"), F.col("qname").alias("column_qname"))
    rows = indexes.join(large(columns), F.concat("parent", F.lit("."), F.lower("c")) == F.col("column_qname"))
    return make_edges(rows, F.lit("in_index"), F.col("index_id"), F.col("column_id"), F.col("ordinal").cast("string"), ordinal=F.col("ordinal"))


def references_of(objects: DataFrame) -> DataFrame:
    """Every place where an object names another: (pos, step, idx, src_qname, src_kind, target_kind, target_schema, target_name, target, ...).

    step orders foreign keys, then triggers, then dependencies, as they are resolved.
    """
    base = objects.select("pos", F.col("qname").alias("src_qname"), F.col("kind").alias("src_kind"), "constraints", "trigger", "dependencies")
    fk = base.select("pos", F.lit(0).alias("step"), "src_qname", "src_kind", F.posexplode("constraints").alias("idx", "c")).where("c.type = 'FK' AND c.references IS NOT NULL")
    fk = fk.select(
        "pos", "step", "idx", "src_qname", "src_kind", F.lit("table").alias("target_kind"), F.col("c.references.schema").alias("target_schema"), F.col("c.references.table").alias("target_name"),
        F.col("c.name").alias("constraint_name"), F.col("c.columns").alias("own_columns"), F.col("c.references.columns").alias("columns"), F.lit(None).cast("string").alias("access"), F.lit("declared").alias("confidence"), F.lit(None).cast("array<string>").alias("events"),
    )
    trigger = base.where("src_kind = 'trigger' AND trigger IS NOT NULL").select(
        "pos", F.lit(1).alias("step"), F.lit(0).alias("idx"), "src_qname", "src_kind", F.lit("table").alias("target_kind"), F.col("trigger.table.schema").alias("target_schema"), F.col("trigger.table.name").alias("target_name"),
        F.lit(None).cast("string").alias("constraint_name"), F.lit(None).cast("array<string>").alias("own_columns"), F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("string").alias("access"), F.lit("declared").alias("confidence"), F.col("trigger.events").alias("events"),
    )
    deps = base.select("pos", F.lit(2).alias("step"), "src_qname", "src_kind", F.posexplode("dependencies").alias("idx", "d")).select(
        "pos", "step", "idx", "src_qname", "src_kind", F.coalesce("d.target.kind", F.lit("table")).alias("target_kind"), F.col("d.target.schema").alias("target_schema"), F.col("d.target.name").alias("target_name"),
        F.lit(None).cast("string").alias("constraint_name"), F.lit(None).cast("array<string>").alias("own_columns"), F.col("d.columns").alias("columns"), F.col("d.access").alias("access"), F.col("d.confidence").alias("confidence"), F.lit(None).cast("array<string>").alias("events"),
    )
    out = fk.unionByName(trigger).unionByName(deps)
    return out.withColumn("target", canonical_qname(F.col("target_schema"), F.col("target_name")))


def resolve(refs: DataFrame, real: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References with dst (null where there is neither a target nor a stub), and stubs as (node columns, reason, referenced_by).

    The references are written once, as both rest on them.

    A routine must be real: a procedure, else a function. A trigger's target is a real table, else a real view, else a
    stub table. All others are the real node of the kind, else a stub, named by the first that refers to it.
    """
    routine = F.col("target_kind").isin("procedure", "function")
    wanted = F.when(routine, F.array(F.lit("procedure"), F.lit("function"))).when(F.col("step") == 1, F.array(F.lit("table"), F.lit("view"))).otherwise(F.array("target_kind"))
    # A name has a node of a kind or two; references meet them once, and keep their other columns.
    # Ids are hashes, larger than all else in a row; they are worked out where they are read, not moved or written.
    known = real.groupBy(F.col("qname").alias("real_qname")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    hit = F.get(F.filter(wanted, lambda k: F.array_contains("kinds", k)), F.lit(0))
    found = refs.join(large(known), F.col("target") == F.col("real_qname"), "left").withColumn("real_kind", hit)
    rows = staged(found.drop("real_qname", "kinds"))
    real_id = node_id(F.col("real_kind"), F.col("target"))
    dst = F.coalesce(real_id, F.when(~routine, node_id(F.col("target_kind"), F.col("target"))))
    found = rows.withColumns({"src": node_id(F.col("src_kind"), F.col("src_qname")), "real_id": real_id, "dst": dst}).drop("src_qname", "real_kind")
    found._staged_at = rows._staged_at
    missing = rows.where(F.col("real_kind").isNull() & ~routine).groupBy("target_kind", "target")
    missing = missing.agg(F.min_by(F.struct("target_schema", "target_name", "src_kind", "src_qname"), F.struct("pos", "step", "idx")).alias("__first")).select("target_kind", "target", "__first.*")
    gone = excluded.select(F.col("qname").alias("gone"))
    missing = missing.join(large(gone), F.col("target") == F.col("gone"), "left")
    out = F.col("gone").isNotNull()
    stubs = missing.select(
        node_id(F.col("target_kind"), F.col("target")).alias("id"), F.col("target_kind").alias("kind"), F.col("target_schema").alias("schema"), F.lower("target_name").alias("name"), F.col("target").alias("qname"),
        F.lit("off").alias("level"), (~out).alias("missing"), out.alias("excluded"), F.lit(None).cast("string").alias("body_hash"), struct_of(PAYLOAD).alias("payload"),
        F.when(out, F.lit("excluded")).otherwise(F.lit("missing")).alias("reason"), node_id(F.col("src_kind"), F.col("src_qname")).alias("referenced_by"),
    )
    return found, stubs


def reference_edges(found: DataFrame) -> DataFrame:
    """Foreign keys (one edge for each column pair and one for the whole), fires_on, and dependencies."""
    # The edges of a key are made in one pass, so those of its pairs and of the whole stand together.
    pairs = F.filter(F.arrays_zip(F.col("own_columns").alias("a"), F.col("columns").alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    whole = F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    fk = found.where("step = 0").select("src", "dst", "constraint_name", F.explode(F.concat(F.coalesce(pairs, F.array().cast("array<struct<a: string, b: string>>")), F.array(whole))).alias("p"))
    src, dst, one = F.col("src"), F.col("dst"), F.col("p.a").isNotNull()
    discriminator = F.when(one, F.concat("p.a", F.lit(">"), "p.b")).otherwise(F.lit("aggregate"))
    keys = make_edges(fk, F.lit("references"), src, dst, discriminator, src_column=F.col("p.a"), dst_column=F.col("p.b"), aggregate=F.when(~one, F.lit(True)), constraint_name=F.col("constraint_name"))
    fires = found.where("step = 1").select("*", F.explode("events").alias("event"))
    fires = make_edges(fires, F.lit("fires_on"), src, dst, F.col("event"), event=F.col("event"))
    deps = found.where("step = 2 AND dst IS NOT NULL")
    calls = F.col("target_kind").isin("procedure", "function")
    kind = F.when(calls, F.lit("calls")).when(F.col("access") == "write", F.lit("writes_to")).when(F.col("src_kind") == "view", F.lit("depends_on")).otherwise(F.lit("reads_from"))
    used = F.when(~calls, _null_if_empty(F.array_sort(F.array_distinct("columns"))))
    deps = make_edges(deps, kind, src, dst, confidence=F.col("confidence"), dst_columns=used)
    return keys.unionByName(fires).unionByName(deps)


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("kind", F.expr("qname COLLATE UNICODE"), "id")


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges by kind, both ends, constraint, column and id; hashes are sorted in half their bytes, which gives the same order."""
    ids, hashes = ("id", "src", "dst"), F.bool_and(reduce(lambda a, b: a & b, [F.coalesce(F.col(c).rlike(SHA1), F.lit(False)) for c in ("id", "src", "dst")]))
    packed = edges.agg(hashes).first()[0]
    rows = edges.withColumns({c: F.unhex(c) for c in ids}) if packed else edges
    rows = rows.orderBy("kind", "src", "dst", F.expr("coalesce(attrs.constraint_name, '') COLLATE UNICODE"), F.expr("coalesce(attrs.src_column, '') COLLATE UNICODE"), "id")
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ids}) if packed else rows


def ordered_stubs(stubs: DataFrame) -> DataFrame:
    return stubs.orderBy("kind", F.expr("qname COLLATE UNICODE"))


def omitted_kinds(scope: Scope) -> tuple[tuple[str, str], ...]:
    return tuple((kind, OMITTED) for kind in sorted(LEVEL_KEY) if scope.level(kind) == "off")


def normalize(objects: DataFrame, engine: str, scope: Scope = Scope()) -> Graph:
    """The graph of a catalog: validate, exclude, nodes, references, inference, in that order.

    What several parts of the graph are made of (objects, nodes, resolved references) is written once and read again.
    """
    objects = staged(objects)
    validate(objects, engine)
    included, excluded = split_excluded(objects, scope)
    primary, again = _first(primary_nodes(included, scope), "pos")
    primary = staged(primary)
    owners = included.join(large(primary.select("pos")), "pos", "left_semi")
    # Ids are hashes of names, larger than all else in a row; they are worked out where they are read, not moved or written.
    children, again_below = _first(child_nodes(owners, scope).drop("id", "parent_id"), "pos", "section", "idx")
    children = staged(children).withColumns({"id": node_id(F.col("kind"), F.col("qname")), "parent_id": node_id(F.col("parent_kind"), F.col("parent"))})
    columns = [f.strip().split(" ")[0] for f in ("id", "kind", "schema", "name", "qname", "level", "missing", "excluded", "body_hash", "payload")]
    real = primary.select(columns).unionByName(children.select(columns))
    contained = make_edges(children, F.col("edge"), F.col("parent_id"), F.col("id"), ordinal=F.col("ordinal"))
    # An object whose kind is off refers to nothing; a repeated one refers as its first does.
    known = included.join(large(primary.select("kind", "qname")), ["kind", "qname"], "left_semi")
    refs, below = references_of(known), [kind for kind, *_ in CHILDREN]
    aimed = [x.target_kind for x in refs.where(F.col("target_kind").isin(below)).select("target_kind").distinct().collect()]  # one of each kind below
    found, stubs = resolve(refs, real.where(~F.col("kind").isin([k for k in below if k not in aimed])), excluded)
    stubs = staged(stubs)
    edges = contained.unionByName(index_edges(included, real)).unionByName(reference_edges(found))
    nodes = real.unionByName(stubs.select(columns))
    if scope.infer_relationships or real.where("kind IN ('collection', 'field')").limit(1).count():
        edges = edges.unionByName(infer_references(nodes, edges))
    warnings = again.select("pos", F.lit(-1).alias("section"), F.lit(0).alias("idx"), F.concat(F.lit("Duplicate object skipped: "), "kind", F.lit(":"), "qname").alias("warning"))
    warnings = warnings.unionByName(again_below.select("pos", "section", "idx", F.concat(F.lit("Duplicate "), "kind", F.lit(" skipped: "), "kind", F.lit(":"), "qname").alias("warning")))
    return Graph(nodes, edges, stubs.select("id", "qname", "kind", "reason", "referenced_by"), warnings.orderBy("pos", "section", "idx").select("warning"), omitted_kinds(scope))


__all__ = ["EDGES", "normalize", "ordered_edges", "ordered_nodes", "ordered_stubs"]
