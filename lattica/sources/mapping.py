"""Row families of five engines become raw objects: groups in order, joins, decoded flags.

All engines meet in a few relations (tables, columns, constraints, indexes), and one assembly makes objects of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.model import COLUMN, CONSTRAINT, DEPENDENCY, FIELD, INDEX, KIND_RANK, PARAMETER, RAW_OBJECTS, REF, TRIGGER, Scope
from lattica.operators.normalize import struct_of
from lattica.plans import hot
from lattica.sources.catalog import Families, raw_schema, require, with_positions

_UNICODE = "COLLATE UNICODE"


def ordered_list(order: Sequence[str], value: Column) -> Column:
    """Values of a group as an array, by the order columns."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], value.alias("__v"))))
    return F.transform(rows, lambda x: x["__v"])


def columns_list(rows: DataFrame) -> DataFrame:
    """(schema, table, columns) of (schema, table, name, data_type, nullable, default, ordinal, comment)."""
    value = struct_of(COLUMN, **{c: F.col(c) for c in ("name", "data_type", "nullable", "default", "ordinal", "comment")})
    return rows.groupBy("schema", "table").agg(ordered_list(["ordinal", "name"], value).alias("columns"))


def constraints_list(rows: DataFrame, by: str = "name") -> DataFrame:
    """(schema, table, constraints) of (schema, table, name, type, columns, references, definition), by the column given."""
    value = struct_of(CONSTRAINT, **{c: F.col(c) for c in ("name", "type", "columns", "references", "definition")})
    order = F.expr(f"name {_UNICODE}") if by == "name" else F.col(by)
    return rows.withColumn("__o", order).groupBy("schema", "table").agg(ordered_list(["__o", "name"], value).alias("constraints"))


def indexes_list(rows: DataFrame, by: str = "name") -> DataFrame:
    value = struct_of(INDEX, name=F.col("name"), unique=F.col("unique"), columns=F.col("columns"))
    order = F.expr(f"name {_UNICODE}") if by == "name" else F.col(by)
    return rows.withColumn("__o", order).groupBy("schema", "table").agg(ordered_list(["__o", "name"], value).alias("indexes"))


def assemble_tables(tables: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """Raw tables of (schema, table, comment); lists are empty, not null, where a table has none."""
    out = tables
    for part, name, kind in ((columns_list(columns), "columns", COLUMN), (constraints, "constraints", CONSTRAINT), (indexes, "indexes", INDEX)):
        out = out.join(part, ["schema", "table"], "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return as_objects(out, kind=F.lit("table"), name=F.col("table"), **{c: F.col(c) for c in ("schema", "comment", "columns", "constraints", "indexes")})


def as_objects(rows: DataFrame, **given: Column) -> DataFrame:
    """The raw object schema without pos; what isn't given is null. __in keeps the order of the source where there is one."""
    fields = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in raw_schema().fields if f.name != "pos"]
    return rows.select(*fields, (F.col("pos") if "pos" in rows.columns else F.lit(0)).cast("long").alias("__in"))


def assembled(parts: Sequence[DataFrame]) -> DataFrame:
    rows = with_positions(reduce(DataFrame.unionByName, parts), KIND_RANK).drop("__in")
    return rows.select([f.name for f in raw_schema().fields])


def body_dependencies(bodies: DataFrame, candidates: DataFrame, dialect: str, strip_comments: bool = False, with_kind: bool = True) -> DataFrame:
    """(schema, name, dependencies) of bodies (schema, name, kind, body) that mention candidates (schema, name, kind, rank).

    A candidate is only looked at for a body that has the first word of its name as a word, which a mention needs; that is
    an equi-join of words, which carries no bodies, and words that most bodies have go to no one task. Each body then meets the list of its own candidates once. An object
    isn't its own candidate. Candidates keep their rank's order.
    """
    masked = text.mask_strings(F.col("body"))
    masked = text.strip_comments(masked) if strip_comments else masked
    rows = bodies.select(F.col("schema").alias("s"), F.col("name").alias("n"), masked.alias("m"))
    rows = rows.select("s", "n", F.xxhash64("m").alias("k"), F.lower("m").alias("m"), text.write_targets(text.canonical(F.col("m"), dialect)).alias("targets"))
    words = F.array_distinct(F.regexp_extract_all("m", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    qname = text.canonical(F.concat("schema", F.lit("."), "name"), dialect)
    named = candidates.where("schema <> '' AND name <> ''").withColumn("q", qname).withColumn("word", F.regexp_extract(text.simple_name(F.col("q")), "[A-Za-z0-9_]+", 0))
    met = hot.met(rows.select("s", "n", "k", F.explode(words).alias("word")), named, ["word"]).where(~((F.col("s") == F.col("schema")) & (F.col("n") == F.col("name"))))
    lists = met.groupBy("s", "n", "k").agg(F.collect_list(F.struct("rank", "schema", "name", "kind", "q")).alias("near"))
    said = F.filter("near", lambda c: F.contains(F.col("m"), F.lower(text.simple_name(c["q"]))) & text.mentions(F.col("m"), c["q"]))

    def value(c: Column) -> Column:
        target = struct_of(REF, schema=c["schema"], name=c["name"], **({"kind": c["kind"]} if with_kind else {}))
        return F.struct(c["rank"].alias("rank"), c["schema"].alias("schema"), c["name"].alias("name"), struct_of(DEPENDENCY, target=target, access=text.access(c["q"], F.col("targets")), confidence=F.lit("parsed")).alias("d"))

    found = rows.join(lists, ["s", "n", "k"]).select("s", "n", F.transform(said, value).alias("found")).where(F.size("found") > 0)
    whole = found.groupBy("s", "n").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return whole.select(F.col("s").alias("schema"), F.col("n").alias("name"), F.transform("found", lambda x: x["d"]).alias("dependencies"))


def enriched(deps: DataFrame, used: DataFrame) -> DataFrame:
    """View dependencies (schema, name, dependencies) with the columns used (schema, name, target_schema, target_name, column).

    A dependency whose columns are known has them, and is declared instead of parsed.
    """
    groups = used.dropna().groupBy("schema", "name", "target_schema", "target_name").agg(F.array_sort(F.collect_set("column")).alias("used"))
    maps = groups.groupBy("schema", "name").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "target_schema", "target_name"), "used"))).alias("by_target"))

    def step(d: Column) -> Column:
        known = F.col("by_target")[F.concat_ws("\u0001", d["target"]["schema"], d["target"]["name"])]
        return F.struct(d["target"].alias("target"), d["access"].alias("access"), F.when(known.isNotNull(), F.lit("declared")).otherwise(d["confidence"]).alias("confidence"), F.coalesce(known, d["columns"]).alias("columns"))

    return deps.join(maps, ["schema", "name"], "left").select("schema", "name", F.transform("dependencies", step).alias("dependencies"))


def _ranked(*parts: tuple[DataFrame, str, str, Column | None]) -> DataFrame:
    """Candidates of (rows, schema column, name column, kind) in order."""
    out = [df.select(F.col(s).alias("schema"), F.col(n).alias("name"), (F.lit(None) if kind is None else kind).cast("string").alias("kind"), F.lit(i).alias("rank")) for i, (df, s, n, kind) in enumerate(parts)]
    return reduce(DataFrame.unionByName, out)


def _if_full(level: str, body: Column) -> Column:
    return body if level == "full" else F.lit(None).cast("string")


def _level(scope: Scope) -> Column:
    return F.when(F.col("kind") == "procedure", scope.level("procedure")).otherwise(scope.level("function"))


# SQLite


def trigger_info(sql: Column, table: Column) -> Column:
    """Timing, events and table from a trigger's header; null without a timing."""
    timing = F.upper(F.regexp_replace(F.regexp_extract(sql, r"(?i)(?<![A-Za-z0-9_])(before|after|instead\s+of)(?![A-Za-z0-9_])", 1), r"\s+", " "))
    header = F.element_at(F.split(sql, r"(?i)(?<![A-Za-z0-9_])begin(?![A-Za-z0-9_])"), 1)
    events = F.filter(F.array(*[F.when(header.rlike(rf"(?i)(?<![A-Za-z0-9_]){e}(?![A-Za-z0-9_])"), F.lit(e)) for e in ("INSERT", "UPDATE", "DELETE")]), lambda x: x.isNotNull())
    on = F.regexp_extract(header, r"(?i)(?<![A-Za-z0-9_])on\s+([A-Za-z0-9_]+)", 1)
    return F.when(timing != "", struct_of(TRIGGER, timing=timing, events=events, table=F.struct(F.lit("main").alias("schema"), F.when(on != "", on).otherwise(table).alias("name"))))


def map_sqlite(f: Families, scope: Scope = Scope()) -> DataFrame:
    require(f, "tables", "views", "triggers", "table_info", "foreign_keys", "index_list", "index_info", "index_sql")
    main = F.lit("main")
    info = f["table_info"]
    columns = info.select(main.alias("schema"), F.col("table_name").alias("table"), "name", F.coalesce("type", F.lit("")).alias("data_type"), (F.col("notnull") == 0).alias("nullable"), F.col("dflt_value").alias("default"), F.col("cid").alias("ordinal"), F.lit(None).cast("string").alias("comment"))
    none = F.lit(None).cast("string").alias("definition")
    no_ref = F.lit(None).cast("struct<schema:string,table:string,columns:array<string>>").alias("references")
    pk = info.where("pk > 0").groupBy("table_name").agg(ordered_list(["pk"], F.col("name")).alias("columns")).select(main.alias("schema"), F.col("table_name").alias("table"), F.concat(F.lit("pk_"), "table_name").alias("name"), F.lit("PK").alias("type"), "columns", no_ref, none, F.lit(0).alias("at"))
    fk = f["foreign_keys"].groupBy("table_name", "id").agg(F.min_by("ref_table", "seq").alias("ref"), ordered_list(["seq"], F.col("from_column")).alias("columns"), ordered_list(["seq"], F.col("to_column")).alias("to"))
    fk = fk.select(main.alias("schema"), F.col("table_name").alias("table"), F.concat(F.lit("fk_"), "table_name", F.lit("_"), "id").alias("name"), F.lit("FK").alias("type"), "columns", F.struct(main.alias("schema"), F.col("ref").alias("table"), F.col("to").alias("columns")).alias("references"), none, (F.col("id") + 1).alias("at"))
    listed = f["index_list"].where("NOT startswith(name, 'sqlite_autoindex_')")
    cols = f["index_info"].groupBy(F.col("index_name").alias("name")).agg(ordered_list(["seqno"], F.coalesce("name", F.lit("(expr)"))).alias("columns"))
    index = listed.join(cols, "name", "left").select(main.alias("schema"), F.col("table_name").alias("table"), "name", (F.col("is_unique") == 1).alias("unique"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), F.col("seq").alias("at"))
    unique = index.where("unique").select("schema", "table", "name", F.lit("UNIQUE").alias("type"), "columns", no_ref, none, (F.col("at") + 1_000_000).alias("at"))
    tables = f["tables"].select(main.alias("schema"), F.col("name").alias("table"), F.lit(None).cast("string").alias("comment"))
    parts = []
    if scope.level("table") != "off":
        parts.append(assemble_tables(tables, columns, constraints_list(pk.unionByName(fk).unionByName(unique), "at"), indexes_list(index, "at")))
    candidates = _ranked((f["tables"].withColumn("schema", main), "schema", "name", None), (f["views"].withColumn("schema", main), "schema", "name", None))
    empty = F.array().cast(f"array<{DEPENDENCY}>")
    for kind in ("view", "trigger"):
        level = scope.level(kind)
        if level == "off":
            continue
        rows = f[f"{kind}s"].select("pos", main.alias("schema"), "name", "sql", *(["tbl_name"] if kind == "trigger" else []))
        body = F.col("sql") if kind == "view" else text.action_part(F.col("sql"))
        # A trigger may share its name with a table that it uses, so its own name doesn't leave that out.
        own = F.col("name") if kind == "view" else F.concat(F.lit("\u0001"), "name")
        bodies = rows.where(F.lit(level == "full") & F.col("sql").isNotNull()).select("schema", own.alias("name"), body.alias("body"))
        deps = body_dependencies(bodies, candidates, "sqlite", strip_comments=True, with_kind=False).withColumn("name", F.regexp_replace("name", "^\u0001", ""))
        rows = rows.join(deps, ["schema", "name"], "left")
        info_ = {"trigger": trigger_info(F.col("sql"), F.col("tbl_name"))} if kind == "trigger" else {}
        parts.append(as_objects(rows, kind=F.lit(kind), schema=F.col("schema"), name=F.col("name"), body=_if_full(level, F.col("sql")), dependencies=F.coalesce("dependencies", empty), **info_))
    return assembled(parts)


# SQL Server

# Module types.
MODULE_KINDS = {"V": "view", "P": "procedure", "FN": "function", "IF": "function", "TF": "function", "TR": "trigger"}
ROUTINE_KINDS = {k: v for k, v in MODULE_KINDS.items() if v in ("procedure", "function")}


def _kind_map(kinds: dict[str, str], of: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.trim(of))


def map_mssql(f: Families, scope: Scope = Scope()) -> DataFrame:
    require(f, "tables", "columns", "key-constraints", "foreign-keys", "check-constraints", "indexes", "modules", "dependencies", "trigger-events", "sequences", "extended-properties")
    props = f["extended-properties"]
    on_object = props.where("column_id = 0 OR column_name IS NULL").groupBy("schema_name", "object_name").agg(F.max_by("description", "pos").alias("comment"))
    on_column = props.where("column_id <> 0 AND column_name IS NOT NULL").groupBy(F.col("schema_name"), F.col("object_name").alias("table_name"), "column_name").agg(F.max_by("description", "pos").alias("comment"))
    s, t = F.col("schema_name").alias("schema"), F.col("table_name").alias("table")
    columns = f["columns"].join(on_column, ["schema_name", "table_name", "column_name"], "left").select(s, t, F.col("column_name").alias("name"), "data_type", F.col("is_nullable").alias("nullable"), F.col("default_definition").alias("default"), F.col("column_id").alias("ordinal"), "comment")
    none, no_ref = F.lit(None).cast("string").alias("definition"), F.lit(None).cast("struct<schema:string,table:string,columns:array<string>>").alias("references")
    keys = f["key-constraints"].groupBy("schema_name", "table_name", "constraint_name").agg(F.min_by("constraint_type", "key_ordinal").alias("kind"), ordered_list(["key_ordinal"], F.col("column_name")).alias("columns"))
    keys = keys.select(s, t, F.col("constraint_name").alias("name"), F.when(F.col("kind") == "PK", "PK").otherwise("UNIQUE").alias("type"), "columns", no_ref, none)
    fk = f["foreign-keys"].groupBy("schema_name", "table_name", "fk_id").agg(*[F.min_by(c, "constraint_column_id").alias(c) for c in ("constraint_name", "ref_schema_name", "ref_table_name")], ordered_list(["constraint_column_id"], F.col("local_column")).alias("columns"), ordered_list(["constraint_column_id"], F.col("ref_column")).alias("to"))
    fk = fk.select(s, t, F.col("constraint_name").alias("name"), F.lit("FK").alias("type"), "columns", F.struct(F.col("ref_schema_name").alias("schema"), F.col("ref_table_name").alias("table"), F.col("to").alias("columns")).alias("references"), none)
    check = f["check-constraints"].select(s, t, F.col("constraint_name").alias("name"), F.lit("CHECK").alias("type"), F.array().cast("array<string>").alias("columns"), no_ref, "definition")
    key_only = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("index_column_id", "is_included_column", "column_name"))), lambda x: ~x["is_included_column"]), lambda x: x["column_name"])
    index = f["indexes"].groupBy("schema_name", "table_name", "index_name").agg(F.min_by("is_unique", "index_column_id").alias("unique"), key_only.alias("columns")).select(s, t, F.col("index_name").alias("name"), "unique", "columns")
    tables = f["tables"].join(on_object.withColumnRenamed("object_name", "table_name"), ["schema_name", "table_name"], "left").select(s, t, "comment")
    parts = []
    if scope.level("table") != "off":
        parts.append(assemble_tables(tables, columns, constraints_list(keys.unionByName(fk).unionByName(check)), indexes_list(index)))
    parts.append(_mssql_modules(f, scope, on_object))
    if scope.level("sequence") != "off":
        seq = f["sequences"].join(on_object.withColumnRenamed("object_name", "sequence_name"), ["schema_name", "sequence_name"], "left")
        extra = F.to_json(F.struct(*[c for c in ("data_type", "start_value", "increment", "minimum_value", "maximum_value", "is_cycling") if c in seq.columns]))
        parts.append(as_objects(seq, kind=F.lit("sequence"), schema=F.col("schema_name"), name=F.col("sequence_name"), comment=F.col("comment"), extra=extra))
    return assembled(parts)


def _mssql_modules(f: Families, scope: Scope, comments: DataFrame) -> DataFrame:
    level = reduce(lambda a, k: a.when(F.col("kind") == k, scope.level(k)), ("view", "procedure", "function", "trigger"), F.when(F.lit(False), "off"))
    mods = f["modules"].withColumn("kind", _kind_map(MODULE_KINDS, F.col("object_type"))).where("kind IS NOT NULL").withColumn("level", level).where("level <> 'off'")
    event = F.when(F.upper("event_type").isin("INSERT", "UPDATE", "DELETE"), F.struct("pos", F.upper("event_type").alias("e")))
    fired = f["trigger-events"].groupBy(F.col("trigger_id").alias("object_id")).agg(F.min_by("is_instead_of_trigger", "pos").alias("instead"), F.min_by("parent_object_id", "pos").alias("parent"), F.array_distinct(F.transform(F.array_sort(F.collect_list(event)), lambda x: x["e"])).alias("events"))
    home = f["tables"].select(F.col("object_id").alias("parent"), F.col("schema_name").alias("ps"), F.col("table_name").alias("pt"))
    fired = fired.join(home, "parent", "left").select("object_id", "instead", "events", "ps", "pt")
    mods = mods.join(fired, "object_id", "left").join(comments, ["schema_name", "object_name"], "left")
    info = struct_of(TRIGGER, timing=F.when(F.col("instead"), "INSTEAD OF").otherwise("AFTER"), events=F.col("events"), table=F.struct(F.coalesce("ps", "schema_name").alias("schema"), F.when(F.col("pt").isNull(), F.col("object_name")).otherwise(F.col("pt")).alias("name")))
    # Dependencies belong to a module by its bare name, as the source tells them.
    refs = f["dependencies"].where("ref_schema_name IS NOT NULL AND ref_object_name IS NOT NULL").select(F.col("object_name"), F.col("pos").alias("at"), "ref_schema_name", "ref_object_name", "ref_object_type")
    body = F.coalesce("definition", F.lit(""))
    targets = mods.select("object_id", "kind", "object_name", text.write_targets(text.canonical(body)).alias("targets"))
    q = text.canonical(F.concat("ref_schema_name", F.lit("."), "ref_object_name"))
    routine = F.when(F.col("kind").isin("procedure", "function"), _kind_map(ROUTINE_KINDS, F.col("ref_object_type")))
    dep = struct_of(DEPENDENCY, target=struct_of(REF, schema=F.col("ref_schema_name"), name=F.col("ref_object_name"), kind=F.col("routine")), access=F.when(F.col("routine").isNotNull(), "read").otherwise(text.access(q, F.col("targets"))), confidence=F.when(F.col("routine").isNotNull(), "declared").otherwise("parsed"))
    deps = refs.join(targets, "object_name").withColumn("routine", routine).groupBy("object_id").agg(ordered_list(["at"], dep).alias("dependencies"))
    mods = mods.join(deps, "object_id", "left")
    if "view-referenced-columns" in f:
        used = f["view-referenced-columns"].select(F.col("referencing_schema").alias("schema"), F.col("referencing_view").alias("name"), F.col("referenced_schema").alias("target_schema"), F.col("referenced_entity").alias("target_name"), F.col("referenced_column").alias("column"))
        views = mods.where("kind = 'view' AND dependencies IS NOT NULL").select(F.col("schema_name").alias("schema"), F.col("object_name").alias("name"), "dependencies")
        rich = enriched(views, used).select(F.col("schema").alias("schema_name"), F.col("name").alias("object_name"), F.lit("view").alias("kind"), F.col("dependencies").alias("rich"))
        mods = mods.join(rich, ["schema_name", "object_name", "kind"], "left").withColumn("dependencies", F.coalesce("rich", "dependencies"))
    params = F.lit(None).cast(f"array<{PARAMETER}>")
    if "parameters" in f:
        nth = F.row_number().over(Window.partitionBy("object_id").orderBy("parameter_id"))
        p = f["parameters"].where("parameter_id > 0").withColumn("nth", nth)
        value = struct_of(PARAMETER, name=F.col("parameter_name"), data_type=F.col("data_type"), direction=F.when(F.col("is_output"), "out").otherwise("in"), has_default=F.when(F.col("has_default_value"), F.lit(True)), ordinal=F.col("nth"))
        mods = mods.join(p.groupBy("object_id").agg(ordered_list(["nth"], value).alias("ps_")), "object_id", "left")
        params = F.col("ps_")
    is_routine = F.col("kind").isin("procedure", "function")
    dynamic = text.dynamic_sql(F.coalesce("definition", F.lit("")), "mssql")
    return as_objects(
        mods, kind=F.col("kind"), schema=F.col("schema_name"), name=F.col("object_name"), comment=F.col("comment"), body=F.when(F.col("level") == "full", F.col("definition")),
        has_dynamic_sql=F.when(dynamic, F.lit(True)), trigger=F.when((F.col("kind") == "trigger") & F.col("events").isNotNull(), info), dependencies=F.col("dependencies"),
        parameters=F.when(is_routine, F.coalesce(params, F.array().cast(f"array<{PARAMETER}>"))), extra=F.when(F.col("kind") == "function", F.to_json(F.struct(F.trim("object_type").alias("functionType")))),
    )


# PostgreSQL


def trigger_bits(tgtype: Column) -> Column:
    """struct(timing, events) of a trigger's type bits."""
    bit = lambda b: tgtype.bitwiseAND(b) != 0
    timing = F.when(bit(64), "INSTEAD OF").when(bit(2), "BEFORE").otherwise("AFTER")
    events = F.filter(F.array(F.when(bit(4), F.lit("INSERT")), F.when(bit(16), F.lit("UPDATE")), F.when(bit(8), F.lit("DELETE"))), lambda x: x.isNotNull())
    return F.struct(timing.alias("timing"), events.alias("events"))


def pg_parameters(types: Column, modes: Column, names: Column, defaults: Column) -> Column:
    """Call parameters: result columns left out, the last ones that take input have the defaults; null if types are unknown."""
    mode = lambda i: F.when(modes.isNull(), F.lit("i")).otherwise(F.get(modes, i))
    rows = F.filter(F.transform(types, lambda t, i: F.struct(t.alias("t"), F.coalesce(mode(i), F.lit("i")).alias("m"), F.coalesce(F.get(names, i), F.lit("")).alias("n"))), lambda x: x["m"] != "t")
    takes = lambda x: x["m"] != "o"
    total = F.size(F.filter(rows, takes))

    def param(x: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(rows, F.lit(1), i), takes))
        has = takes(x) & (nth >= total - F.coalesce(defaults, F.lit(0)))
        return F.struct(x["n"].alias("name"), F.coalesce(x["t"], F.lit("")).alias("data_type"), F.when(x["m"] == "o", "out").when(x["m"] == "b", "inout").otherwise("in").alias("direction"), F.when(has, F.lit(True)).alias("has_default"), (i + 1).cast("int").alias("ordinal"))

    return F.transform(rows, param)


def with_column_names(rows: DataFrame, positions: str, table: tuple[str, str], name: str, names: DataFrame, to: str) -> DataFrame:
    """rows with the names of the columns at positions of a table, by names (ns, nt, attnum, column_name); none for null.

    Every position meets its name by a join, as a look-up in a map of the table's columns reads half of that map each time.
    """
    key = ["schema_name", "table_name", name, "__of"]
    rows = rows.withColumn("__of", F.xxhash64(*table, positions))
    lists = rows.select(*key, *[F.col(c).alias(a) for c, a in zip(table, ("ns", "nt"), strict=True)], positions).distinct()
    each = lists.select(*key, "ns", "nt", F.posexplode(positions).alias("i", "attnum")).join(names, ["ns", "nt", "attnum"], "left")
    named = F.coalesce("column_name", F.concat(F.lit("col_"), F.col("attnum").cast("string")))
    found = each.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(ordered_list(["i"], named).alias("__names"))
    met = rows.join(found, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]), "left")
    return met.withColumn(to, F.coalesce("__names", F.array().cast("array<string>"))).drop("__names", "__of", *[f"__{k}" for k in key])


def map_pg(f: Families, scope: Scope = Scope()) -> DataFrame:
    require(f, "tables", "columns", "column-names", "constraints", "indexes", "views", "routines", "triggers", "sequences")
    s, t = F.col("schema_name").alias("schema"), F.col("table_name").alias("table")
    columns = f["columns"].select(s, t, F.col("column_name").alias("name"), "data_type", F.col("is_nullable").alias("nullable"), F.col("default_expr").alias("default"), "ordinal", "comment")
    names = f["column-names"].where("attnum IS NOT NULL").groupBy(F.col("schema_name").alias("ns"), F.col("table_name").alias("nt"), "attnum").agg(F.min("column_name").alias("column_name"))
    kind = F.col("constraint_type")
    cons = f["constraints"].where(kind.isin("p", "u", "f", "c")).withColumn("own", F.when(kind != "c", F.col("column_positions"))).withColumn("far", F.when(kind == "f", F.col("fk_ref_positions")))
    cons = with_column_names(cons, "own", ("schema_name", "table_name"), "constraint_name", names, "here")
    cons = with_column_names(cons, "far", ("fk_ref_schema", "fk_ref_table"), "constraint_name", names, "there").select(
        s, t, F.col("constraint_name").alias("name"), F.when(kind == "p", "PK").when(kind == "u", "UNIQUE").when(kind == "f", "FK").otherwise("CHECK").alias("type"),
        F.col("here").alias("columns"),
        F.when(kind == "f", F.struct(F.col("fk_ref_schema").alias("schema"), F.coalesce("fk_ref_table", F.lit("")).alias("table"), F.col("there").alias("columns"))).alias("references"), F.when(kind == "c", F.col("constraint_def")).alias("definition"),
    )
    key = F.filter(F.slice("key_columns", F.lit(1), F.col("n_key_atts")), lambda p: p != 0)
    index = with_column_names(f["indexes"].where("NOT is_primary").withColumn("own", key), "own", ("schema_name", "table_name"), "index_name", names, "here")
    index = index.select(s, t, F.col("index_name").alias("name"), F.col("is_unique").alias("unique"), F.when(F.col("own").isNotNull(), F.col("here")).alias("columns"))
    parts = []
    if scope.level("table") != "off":
        parts.append(assemble_tables(f["tables"].select(s, t, "comment"), columns, constraints_list(cons), indexes_list(index)))
    candidates = ((f["tables"], "schema_name", "table_name", None), (f["views"], "schema_name", "view_name", None))
    level = scope.level("view")
    if level != "off":
        rows = f["views"].select("pos", F.col("schema_name").alias("schema"), F.col("view_name").alias("name"), "view_def", "comment", "rel_kind")
        rows = _with_dependencies(rows, "view_def", level, _ranked(*candidates), "pg")
        if "view-column-usage" in f:
            used = f["view-column-usage"].select(F.col("view_schema").alias("schema"), F.col("view_name").alias("name"), F.col("table_schema").alias("target_schema"), F.col("table_name").alias("target_name"), F.col("column_name").alias("column"))
            rich = enriched(rows.where("dependencies IS NOT NULL").select("schema", "name", "dependencies"), used)
            rows = rows.drop("dependencies").join(rich, ["schema", "name"], "left")
        extra = F.when(F.col("rel_kind") == "m", F.lit('{"materialized":true}'))
        parts.append(as_objects(rows, kind=F.lit("view"), schema=F.col("schema"), name=F.col("name"), body=_if_full(level, F.col("view_def")), comment=F.col("comment"), dependencies=F.col("dependencies"), extra=extra))
    routine_kind = F.when(F.col("routine_kind") == "p", "procedure").otherwise("function")
    rows = f["routines"].select("pos", F.col("schema_name").alias("schema"), F.col("routine_name").alias("name"), routine_kind.alias("kind"), "routine_def", "comment", *[F.col(c) for c in ("arg_names", "arg_modes", "arg_type_names", "num_defaults")])
    rows = rows.withColumn("level", _level(scope)).where("level <> 'off'").withColumn("full", F.when(F.col("level") == "full", F.col("routine_def")))
    rows = _with_dependencies(rows, "full", "full", _ranked(*candidates, (f["routines"], "schema_name", "routine_name", routine_kind)), "pg")
    params = pg_parameters(F.col("arg_type_names"), F.col("arg_modes"), F.col("arg_names"), F.col("num_defaults"))
    parts.append(as_objects(rows, kind=F.col("kind"), schema=F.col("schema"), name=F.col("name"), body=F.col("full"), has_dynamic_sql=F.when(text.dynamic_sql(F.col("full"), "pg"), F.lit(True)), dependencies=F.col("dependencies"), parameters=params, comment=F.col("comment")))
    level = scope.level("trigger")
    if level != "off":
        rows = f["triggers"].withColumn("bits", trigger_bits(F.col("tgtype"))).withColumn("b", _if_full(level, F.col("trigger_def")))
        info = struct_of(TRIGGER, timing=F.col("bits.timing"), events=F.col("bits.events"), table=F.struct(F.col("schema_name").alias("schema"), F.col("table_name").alias("name")))
        parts.append(as_objects(rows, kind=F.lit("trigger"), schema=F.col("schema_name"), name=F.col("trigger_name"), trigger=info, body=F.col("b"), has_dynamic_sql=F.when(text.dynamic_sql(F.col("b"), "pg"), F.lit(True))))
    if scope.level("sequence") != "off":
        seq = f["sequences"]
        extra = F.to_json(F.struct(*[c for c in ("start_value", "increment", "minimum_value", "maximum_value", "is_cycling") if c in seq.columns]))
        parts.append(as_objects(seq, kind=F.lit("sequence"), schema=F.col("schema_name"), name=F.col("sequence_name"), comment=F.col("comment"), extra=extra))
    return assembled(parts)


def _with_dependencies(rows: DataFrame, body: str, level: str, candidates: DataFrame, dialect: str) -> DataFrame:
    """rows (schema, name, ...) with dependencies; null where there are none or no body is read."""
    bodies = rows.where(F.lit(level == "full") & F.col(body).isNotNull()).select("schema", "name", F.col(body).alias("body"))
    return rows.join(body_dependencies(bodies, candidates, dialect), ["schema", "name"], "left")


# MySQL


def map_mysql(f: Families, scope: Scope = Scope()) -> DataFrame:
    require(f, "tables", "columns", "pk-uk-columns", "fk-columns", "check-constraints", "statistics", "views", "routines", "triggers")
    s, t = F.col("table_schema").alias("schema"), F.col("table_name").alias("table")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    columns = f["columns"].select(s, t, F.col("column_name").alias("name"), F.col("column_type").alias("data_type"), (F.col("is_nullable") == "YES").alias("nullable"), F.col("column_default").alias("default"), F.col("ordinal_position").alias("ordinal"), blank("column_comment").alias("comment"))
    none, no_ref = F.lit(None).cast("string").alias("definition"), F.lit(None).cast("struct<schema:string,table:string,columns:array<string>>").alias("references")
    keys = f["pk-uk-columns"].groupBy("table_schema", "table_name", "constraint_name").agg(F.min_by("constraint_type", "ordinal_position").alias("kind"), ordered_list(["ordinal_position"], F.col("column_name")).alias("columns"))
    keys = keys.select(s, t, F.col("constraint_name").alias("name"), F.when(F.col("kind") == "PRIMARY KEY", "PK").otherwise("UNIQUE").alias("type"), "columns", no_ref, none)
    fk = f["fk-columns"].groupBy("table_schema", "table_name", "constraint_name").agg(F.min_by("referenced_table_schema", "ordinal_position").alias("rs"), F.min_by("referenced_table_name", "ordinal_position").alias("rt"), ordered_list(["ordinal_position"], F.col("column_name")).alias("columns"), ordered_list(["ordinal_position"], F.coalesce("referenced_column_name", F.lit(""))).alias("to"))
    fk = fk.select(s, t, F.col("constraint_name").alias("name"), F.lit("FK").alias("type"), "columns", F.struct(F.col("rs").alias("schema"), F.coalesce("rt", F.lit("")).alias("table"), F.col("to").alias("columns")).alias("references"), none)
    check = f["check-constraints"].select(s, t, F.col("constraint_name").alias("name"), F.lit("CHECK").alias("type"), F.array().cast("array<string>").alias("columns"), no_ref, F.col("check_clause").alias("definition"))
    cols = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("seq_in_index", "column_name"))), lambda x: x["column_name"].isNotNull()), lambda x: x["column_name"])
    index = f["statistics"].groupBy("table_schema", "table_name", "index_name").agg((F.min_by("non_unique", "seq_in_index") == 0).alias("unique"), cols.alias("columns")).select(s, t, F.col("index_name").alias("name"), "unique", "columns")
    parts = []
    if scope.level("table") != "off":
        parts.append(assemble_tables(f["tables"].select(s, t, blank("table_comment").alias("comment")), columns, constraints_list(keys.unionByName(fk).unionByName(check)), indexes_list(index)))
    candidates = ((f["tables"], "table_schema", "table_name", None), (f["views"], "table_schema", "table_name", None))
    level = scope.level("view")
    if level != "off":
        rows = f["views"].select("pos", F.col("table_schema").alias("schema"), F.col("table_name").alias("name"), "view_definition")
        rows = _with_dependencies(rows, "view_definition", level, _ranked(*candidates), "mysql")
        parts.append(as_objects(rows, kind=F.lit("view"), schema=F.col("schema"), name=F.col("name"), body=_if_full(level, F.col("view_definition")), dependencies=F.col("dependencies")))
    routine_kind = F.when(F.col("routine_type") == "PROCEDURE", "procedure").otherwise("function")
    rows = f["routines"].select("pos", F.col("routine_schema").alias("schema"), F.col("routine_name").alias("name"), routine_kind.alias("kind"), "routine_definition", blank("routine_comment").alias("comment"))
    rows = rows.withColumn("level", _level(scope)).where("level <> 'off'").withColumn("full", F.when(F.col("level") == "full", F.col("routine_definition")))
    rows = _with_dependencies(rows, "full", "full", _ranked(*candidates, (f["routines"], "routine_schema", "routine_name", routine_kind)), "mysql")
    params = F.array().cast(f"array<{PARAMETER}>")
    if "parameters" in f:
        nth = F.row_number().over(Window.partitionBy("routine_schema", "routine_name").orderBy("ordinal_position"))
        mode = F.upper(F.coalesce("parameter_mode", F.lit("IN")))
        value = struct_of(PARAMETER, name=F.coalesce("parameter_name", F.lit("")), data_type=F.col("data_type"), direction=F.when(mode == "OUT", "out").when(mode == "INOUT", "inout").otherwise("in"), ordinal=F.col("nth"))
        p = f["parameters"].where("ordinal_position > 0").withColumn("nth", nth).groupBy(F.col("routine_schema").alias("schema"), F.col("routine_name").alias("name")).agg(ordered_list(["nth"], value).alias("ps_"))
        rows = rows.join(p, ["schema", "name"], "left")
        params = F.coalesce("ps_", params)
    parts.append(as_objects(rows, kind=F.col("kind"), schema=F.col("schema"), name=F.col("name"), body=F.col("full"), has_dynamic_sql=F.when(text.dynamic_sql(F.col("full"), "mysql"), F.lit(True)), dependencies=F.col("dependencies"), parameters=params, comment=F.col("comment")))
    level = scope.level("trigger")
    if level != "off":
        info = struct_of(TRIGGER, timing=F.col("action_timing"), events=F.array("event_manipulation"), table=F.struct(F.col("trigger_schema").alias("schema"), F.col("event_object_table").alias("name")))
        parts.append(as_objects(f["triggers"], kind=F.lit("trigger"), schema=F.col("trigger_schema"), name=F.col("trigger_name"), trigger=info, body=_if_full(level, F.col("action_statement"))))
    return assembled(parts)


def mysql_column_extra(extra: Column, expression: Column) -> Column:
    """JSON of what the extra column says of a column: auto increment, or how it is generated."""
    low = F.lower(extra)
    made = lambda kind: F.to_json(F.struct(F.lit(True).alias("generated"), F.lit(kind).alias("generationKind"), expression.alias("generationExpression")))
    return F.when(low.contains("auto_increment"), F.lit('{"autoIncrement":true}')).when(low.contains("stored generated"), made("STORED")).when(low.contains("virtual generated"), made("VIRTUAL"))


# Documents

SYSTEM_DATABASES = ("admin", "local", "config")


def map_documents(database: str, fields: DataFrame, indexes: DataFrame | None = None, validators: DataFrame | None = None, scope: Scope = Scope()) -> DataFrame:
    """Collections of fields (collection, name, data_type, frequency, nullable), indexes (collection, name, keys, unique) and validators (collection, validator JSON).

    System collections are left out. Indexes listed twice count once; their key order is kept.
    """
    own = fields.where(~F.col("collection").startswith("system.") & ~F.col("collection").isin(*SYSTEM_DATABASES))
    value = struct_of(FIELD, **{c: F.col(c) for c in ("name", "data_type", "frequency", "nullable")})
    rows = own.withColumn("__o", F.expr(f"name {_UNICODE}")).groupBy("collection").agg(ordered_list(["__o"], value).alias("fields"))
    if scope.level("collection") == "off":
        rows = rows.limit(0)
    if indexes is not None:
        once = indexes.dropDuplicates(["collection", "name"]).withColumn("__o", F.expr(f"name {_UNICODE}"))
        listed = once.groupBy("collection").agg(ordered_list(["__o"], struct_of(INDEX, name=F.col("name"), unique=F.coalesce("unique", F.lit(False)), columns=F.col("keys"))).alias("indexes"))
        rows = rows.join(listed, "collection", "left")
    else:
        rows = rows.withColumn("indexes", F.lit(None).cast(f"array<{INDEX}>"))
    extra = F.lit(None).cast("string")
    if validators is not None:
        rows = rows.join(validators.select("collection", validator_extra(F.col("validator")).alias("x")), "collection", "left")
        extra = F.col("x")
    return assembled([as_objects(rows, kind=F.lit("collection"), schema=F.lit(database), name=F.col("collection"), fields=F.col("fields"), indexes=F.col("indexes"), extra=extra)])


def validator_extra(validator: Column) -> Column:
    """JSON of a validator's top-level required and properties; null if it has neither."""
    required, properties = (F.get_json_object(validator, f"$['$jsonSchema'].{k}") for k in ("required", "properties"))
    parts = F.concat_ws(",", F.when(required.isNotNull(), F.concat(F.lit('"required":'), required)), F.when(properties.isNotNull(), F.concat(F.lit('"properties":'), properties)))
    return F.when(parts != "", F.concat(F.lit("{"), parts, F.lit("}")))


__all__ = ["RAW_OBJECTS", "map_documents", "map_mssql", "map_mysql", "map_pg", "map_sqlite"]
