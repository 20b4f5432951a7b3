"""Reading catalogs: whole raw catalogs as JSON, row families, chunked dumps, and JDBC."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.model import RAW_OBJECTS, GraphError
from lattica.plans.numbering import with_row_numbers

Families = dict[str, DataFrame]


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def _renamed(kind: T.DataType, rename) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(rename(f.name), _renamed(f.dataType, rename), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType, rename), kind.containsNull)
    return kind


def raw_schema() -> T.StructType:
    return T._parse_datatype_string(RAW_OBJECTS)


def read_raw_catalog(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The engine and the raw objects of a catalog file: {engine, schemas, objects: [...]} with camel-case keys.

    What a key leaves out stays null; an empty list stays empty.
    """
    own = raw_schema()
    objects = T.StructType([f for f in _renamed(own, camel).fields if f.name != "pos"])
    whole = T.StructType([T.StructField("engine", T.StringType()), T.StructField("objects", T.ArrayType(objects))])
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", whole, {"mode": "FAILFAST"}).alias("c"))
    engine = rows.select("c.engine").first()[0]
    flat = rows.select(F.posexplode("c.objects").alias("pos", "o")).select(F.col("pos").cast("long").alias("pos"), "o.*")
    return engine, flat.select(*[F.col(camel(f.name)).cast(f.dataType).alias(f.name) for f in own.fields])


def read_families(spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> Families:
    """Row families from one JSON array (or JSON lines) file each, <folder>/<family>.json; pos keeps the order of the file.

    A value that doesn't fit its column fails the read.
    """
    return {name: _with_pos(spark.read.text(f"{folder.rstrip('/')}/{name}.json", wholetext=True).select("value"), ddl) for name, ddl in schemas.items()}


def _with_pos(texts: DataFrame, ddl: str) -> DataFrame:
    parsed = texts.select(F.from_json("value", f"ARRAY<STRUCT<{_fields(ddl)}>>", {"mode": "FAILFAST"}).alias("rows"))
    return parsed.select(F.posexplode("rows").alias("pos", "r")).select(F.col("pos").cast("long").alias("pos"), "r.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T._parse_datatype_string(ddl).fields)


def read_dump(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> Families:
    """Families of one JSON object with a key each."""
    text = spark.read.text(path, wholetext=True)
    return {name: _with_pos(text.select(F.get_json_object("value", f"$['{name}']").alias("value")), ddl) for name, ddl in schemas.items()}


def reassemble_chunks(lines: DataFrame, key: str = "family", order: str = "n", chunk: str = "line") -> DataFrame:
    """(key, value): JSON that a client printed in pieces, put together again.

    Header and rule lines before the JSON and the row count after it are left out; all else is joined as it is.
    """
    own = F.col(chunk)
    noise = own.rlike(r"^\s*$") | own.rlike(r"^-+\s*$") | own.rlike(r"(?i)^\s*\(\d+ rows? affected\)") | own.rlike(r"(?i)^json_[0-9a-f\-]+\s*$")
    kept = lines.where(~noise)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, chunk))), lambda x: x[chunk]), "").alias("value"))


def checked_rows(raw: DataFrame, ddl: str) -> DataFrame:
    """Rows with loosely typed values brought to their types: 0/1 and true/false to boolean, digits to numbers.

    A value that is neither null nor of its type fails the query.
    """
    out = []
    for f in T._parse_datatype_string(ddl).fields:
        value = F.col(f.name) if f.name in raw.columns else F.lit(None)
        text = value.cast("string")
        fit = F.when(F.lower(text).isin("1", "true"), True).when(F.lower(text).isin("0", "false"), False) if isinstance(f.dataType, T.BooleanType) else (value if isinstance(f.dataType, T.ArrayType) else text).try_cast(f.dataType)
        out.append(F.when(value.isNotNull() & fit.isNull(), F.raise_error(F.concat(F.lit(f"malformed {f.name}: "), text)).cast(f.dataType)).otherwise(fit).alias(f.name))
    return raw.select(*out)


def read_jdbc(spark: SparkSession, url: str, queries: Mapping[str, str], properties: Mapping[str, str] | None = None) -> Families:
    """Families by catalog queries that the source itself runs; nothing is written to it."""
    out = {}
    for name, sql in queries.items():
        df = spark.read.format("jdbc").option("url", url).option("query", sql).options(**(properties or {})).load()
        out[name] = df.select(F.monotonically_increasing_id().alias("pos"), *[F.col(c).alias(c.lower()) for c in df.columns])
    return out


SQLITE_FAMILIES = {
    "tables": "name STRING, sql STRING",
    "views": "name STRING, sql STRING",
    "triggers": "name STRING, tbl_name STRING, sql STRING",
    "index_sql": "name STRING, sql STRING",
    "table_info": "table_name STRING, cid INT, name STRING, type STRING, notnull INT, dflt_value STRING, pk INT",
    "foreign_keys": "table_name STRING, id INT, seq INT, ref_table STRING, from_column STRING, to_column STRING",
    "index_list": "table_name STRING, seq INT, name STRING, is_unique INT",
    "index_info": "index_name STRING, seqno INT, name STRING",
}


def read_sqlite(spark: SparkSession, path: str) -> Families:
    """Families of a SQLite file on the driver's machine, opened read-only. A catalog is as large as a schema, not as data."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        def all_of(sql: str, *args) -> list[tuple]:
            return con.execute(sql, args).fetchall()

        master = "SELECT name, sql FROM sqlite_master WHERE type = ? AND name NOT LIKE 'sqlite_%' ORDER BY name"
        rows: dict[str, list[tuple]] = {"tables": all_of(master, "table"), "views": all_of(master, "view"), "index_sql": all_of(master, "index")}
        rows["triggers"] = all_of("SELECT name, tbl_name, sql FROM sqlite_master WHERE type = 'trigger' ORDER BY name")
        names = [t for t, _ in rows["tables"]]
        rows["table_info"] = [(t, *r[:6]) for t in names for r in all_of("SELECT * FROM pragma_table_info(?)", t)]
        rows["foreign_keys"] = [(t, *r) for t in names for r in all_of('SELECT id, seq, "table", "from", "to" FROM pragma_foreign_key_list(?)', t)]
        rows["index_list"] = [(t, *r) for t in names for r in all_of('SELECT seq, name, "unique" FROM pragma_index_list(?)', t)]
        rows["index_info"] = [(r[2], *x) for r in rows["index_list"] for x in all_of("SELECT seqno, name FROM pragma_index_info(?)", r[2])]
        version = con.execute("PRAGMA schema_version").fetchone()[0]
    finally:
        con.close()
    out = {k: _table(spark, rows[k], ddl) for k, ddl in SQLITE_FAMILIES.items()}
    return out | {"schema_version": spark.createDataFrame([(version,)], "version LONG")}


def _table(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos LONG, {ddl}")


def sample(docs: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """n documents, at least one, by a seeded order."""
    return docs.orderBy(F.rand(seed)).limit(max(1, n))


def with_positions(objects: DataFrame, ranks: tuple[str, ...]) -> DataFrame:
    """pos in the order of a catalog: kind, schema, name, and the source's own order."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ranks]), F.col("kind"))
    order = (rank, F.expr("coalesce(schema, '') COLLATE UNICODE"), F.expr("name COLLATE UNICODE"), "schema", "name", "__in")
    return with_row_numbers(objects, order, "pos")


def write_raw_catalog(objects: DataFrame, engine: str) -> str:
    """A small catalog as stable JSON text, null keys left out."""
    rows = [json.loads(x) for x in objects.orderBy("pos").drop("pos").toJSON().collect()]

    def own(x):
        if isinstance(x, dict):
            return {camel(k): own(v) for k, v in x.items()}
        return [own(v) for v in x] if isinstance(x, list) else x

    return json.dumps({"engine": engine, "objects": [own(r) for r in rows]}, sort_keys=True, ensure_ascii=False)


def require(families: Families, *names: str) -> None:
    if missing := [n for n in names if n not in families]:
        raise GraphError(f"row families are missing: {', '.join(missing)}")
