"""Schemas, vocabularies and levels of the property graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Kinds in the order in which a name is looked up, edge kinds, confidences and levels.
NODE_KINDS = ("database", "schema", "table", "column", "constraint", "index", "view", "procedure", "function", "trigger", "sequence", "collection", "field")
EDGE_KINDS = ("references", "depends_on", "calls", "reads_from", "writes_to", "fires_on", "has_column", "has_index", "has_constraint", "in_index", "inferred_reference")
CONFIDENCES = ("declared", "parsed", "inferred")
LEVELS = ("off", "metadata", "full")
LEVEL_KEY = {
    "table": "tables", "column": "columns", "constraint": "constraints", "index": "indexes", "view": "views", "procedure": "procedures",
    "function": "functions", "trigger": "triggers", "sequence": "sequences", "collection": "collections", "field": "fields",
}
DEFAULT_LEVELS = {
    "tables": "full", "columns": "full", "constraints": "full", "indexes": "full", "views": "full", "procedures": "metadata", "functions": "metadata",
    "triggers": "full", "sequences": "metadata", "collections": "metadata", "fields": "metadata", "statistics": "off", "sampling": "off",
}
#: Order of kinds in a catalog.
KIND_RANK = ("database", "schema", "table", "view", "procedure", "function", "trigger", "sequence", "collection", "index", "constraint", "column", "field")

REF = "STRUCT<schema: STRING, name: STRING, kind: STRING>"
COLUMN = "STRUCT<name: STRING, data_type: STRING, nullable: BOOLEAN, default: STRING, ordinal: INT, comment: STRING>"
CONSTRAINT = "STRUCT<name: STRING, type: STRING, columns: ARRAY<STRING>, references: STRUCT<schema: STRING, table: STRING, columns: ARRAY<STRING>>, definition: STRING>"
INDEX = "STRUCT<name: STRING, unique: BOOLEAN, columns: ARRAY<STRING>, method: STRING>"
FIELD = "STRUCT<name: STRING, data_type: STRING, frequency: DOUBLE, nullable: BOOLEAN>"
TRIGGER = "STRUCT<timing: STRING, events: ARRAY<STRING>, table: STRUCT<schema: STRING, name: STRING>>"
DEPENDENCY = f"STRUCT<target: {REF}, access: STRING, confidence: STRING, columns: ARRAY<STRING>>"
PARAMETER = "STRUCT<name: STRING, data_type: STRING, direction: STRING, has_default: BOOLEAN, ordinal: INT>"

#: Raw objects of a catalog. pos keeps the order of the source; a null list is unknown, an empty one is known to be empty.
RAW_OBJECTS = (
    f"pos LONG, kind STRING, schema STRING, name STRING, comment STRING, signature STRING, returns STRING, body STRING, has_dynamic_sql BOOLEAN, "
    f"columns ARRAY<{COLUMN}>, constraints ARRAY<{CONSTRAINT}>, indexes ARRAY<{INDEX}>, fields ARRAY<{FIELD}>, trigger {TRIGGER}, "
    f"dependencies ARRAY<{DEPENDENCY}>, parameters ARRAY<{PARAMETER}>, extra STRING"
)
PAYLOAD = (
    f"STRUCT<data_type: STRING, nullable: BOOLEAN, default: STRING, ordinal: INT, comment: STRING, type: STRING, definition: STRING, columns: ARRAY<STRING>, "
    f"unique: BOOLEAN, method: STRING, signature: STRING, returns: STRING, body: STRING, has_dynamic_sql: BOOLEAN, parameters: ARRAY<{PARAMETER}>, "
    f"timing: STRING, events: ARRAY<STRING>, frequency: DOUBLE>"
)
ATTRS = "STRUCT<src_column: STRING, dst_column: STRING, event: STRING, aggregate: BOOLEAN, ordinal: INT, constraint_name: STRING, dst_columns: ARRAY<STRING>>"
NODES = f"id STRING, kind STRING, schema STRING, name STRING, qname STRING, level STRING, missing BOOLEAN, excluded BOOLEAN, body_hash STRING, payload {PAYLOAD}"
EDGES = f"id STRING, kind STRING, src STRING, dst STRING, confidence STRING, score DOUBLE, attrs {ATTRS}"
STUBS = "id STRING, qname STRING, kind STRING, reason STRING, referenced_by STRING"
SNAPSHOTS = "id STRING, taken_at STRING, engine STRING, engine_version STRING, fingerprint STRING, counts MAP<STRING, LONG>, seq LONG"
SNAPSHOT_OBJECTS = "snapshot_id STRING, node_id STRING, kind STRING, qname STRING, body_hash STRING"

#: Capabilities of the engines whose catalogs can be mapped.
CAPABILITIES = {
    "sqlite": frozenset({"table", "column", "constraint", "index", "view", "trigger"}),
    "mssql": frozenset({"table", "column", "constraint", "index", "view", "procedure", "function", "trigger", "sequence"}),
    "pg": frozenset({"table", "column", "constraint", "index", "view", "procedure", "function", "trigger", "sequence"}),
    "mysql": frozenset({"table", "column", "constraint", "index", "view", "procedure", "function", "trigger"}),
    "mongodb": frozenset({"collection", "field", "index", "constraint"}),
}


class GraphError(ValueError):
    """A request or an input that the graph cannot serve."""


class UnsupportedError(GraphError):
    """A dialect that no catalog can be read from."""


@dataclass(frozen=True)
class Scope:
    """What of a catalog becomes graph: levels by kind, names to leave out, and whether references are inferred.

    include is accepted as the reference semantics have it: only exclude is evaluated unless honour_include is set.
    """

    levels: dict[str, str] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    infer_relationships: bool = False
    honour_include: bool = False

    def level(self, kind: str) -> str:
        key = LEVEL_KEY.get(kind)
        return "metadata" if key is None else {**DEFAULT_LEVELS, **self.levels}[key]


@dataclass
class Graph:
    """nodes and edges as DataFrames, with what normalization has to say about them."""

    nodes: DataFrame
    edges: DataFrame
    stubs: DataFrame | None = None
    warnings: DataFrame | None = None
    omitted: tuple[tuple[str, str], ...] = ()
