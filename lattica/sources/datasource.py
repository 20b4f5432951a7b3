"""Catalogs of live sources as a Spark data source, read once or followed as a stream.

`spark.read.format("lattica_catalog")` gives one row for each row of a catalog: (family, nth, row, mark), with row as JSON.
Each family is a partition, read where the executors are; families with a lateral call for each view are cut into
partitions of some views each, and of a document database each collection is a partition. The connection comes from a
function that the executors can import, so any DB-API driver will do, or a stand-in. As a stream, the source's offset is
the catalog's fingerprint: while that stays, there is no batch.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
from collections.abc import Iterator, Mapping
from contextlib import closing
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from lattica.model import Scope, UnsupportedError
from lattica.operators import sampling
from lattica.operators.store import GraphStore
from lattica.operators.sync import SyncResult, sync
from lattica.plans.cut import discard, staged
from lattica.sources import families, mapping
from lattica.sources.catalog import Families, checked_rows

FORMAT = "lattica_catalog"
ROWS = "family STRING, nth LONG, row STRING, mark STRING"
#: Views of a partition, documents sampled of a collection, rows fetched at once.
VIEWS, SAMPLE, FETCH = 64, 100, 1000
#: The family of the one row that tells the fingerprint where a catalog is empty.
MARK = ""
DOCUMENTS = {"collections": "collection STRING, validator STRING", "indexes": "collection STRING, name STRING, keys ARRAY<STRING>, unique BOOLEAN", "documents": "collection STRING, document STRING"}
SCHEMAS = {"mssql": families.MSSQL, "pg": families.PG, "mysql": families.MYSQL, "documents": DOCUMENTS}
MAPPINGS = {"mssql": mapping.map_mssql, "pg": mapping.map_pg, "mysql": mapping.map_mysql}


@dataclass
class Part(InputPartition):
    """A family's statement; or, with views, the statement of each of them; or a collection."""

    family: str
    sql: str = ""
    views: tuple[tuple[str, str], ...] = ()
    collection: str | None = None
    mark: str = ""
    first: int = 0


class Connection:
    """How to reach a source, as options tell: connect (module:function), args (JSON), passwordEnv (the name of a variable)."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.dialect = options.get("dialect", "")
        if self.dialect not in SCHEMAS:
            raise UnsupportedError(f"unknown dialect: {self.dialect}")
        self.connect, self.args = options["connect"], json.loads(options.get("args", "{}"))
        self.password, self.database, self.sample = options.get("passwordEnv"), options.get("database", ""), int(options.get("sample", SAMPLE))
        wanted = [x.strip() for x in options.get("families", "").split(",") if x.strip()]
        self.families = wanted or list(SCHEMAS[self.dialect])

    def open(self) -> Any:
        """A password is only ever read from an environment variable, where the connection is made."""
        module, _, name = self.connect.partition(":")
        secret = {} if self.password is None else {"password": os.environ[self.password]}
        return getattr(importlib.import_module(module), name)(**self.args, **secret)

    def statements(self) -> dict[str, str]:
        known = {"mssql": families.MSSQL_QUERIES, "pg": families.PG_QUERIES}.get(self.dialect)
        return families.mysql_queries(self.database) if known is None else known

    def parts(self, mark: str = "") -> list[Part]:
        out = [Part(MARK, mark=mark)]
        if self.dialect == "documents":
            with closing(self.open()) as db:
                return [*out, *(Part("documents", collection=c, mark=mark) for c in sorted(db.list_collection_names()))]
        for family in self.families:
            if self.dialect == "mssql" and family == "view-referenced-columns":
                with closing(self.open()) as db:
                    views = [tuple(r[:2]) for r in _fetched(db, families.MSSQL_VIEWS)]
                out += [Part(family, views=tuple(views[i : i + VIEWS]), first=i << 20, mark=mark) for i in range(0, len(views), VIEWS)]
            else:
                out.append(Part(family, self.statements()[family], mark=mark))
        return out

    def fingerprint(self) -> str:
        """One short hash that changes with the catalog."""
        with closing(self.open()) as db:
            if self.dialect == "documents":
                names = sorted(db.list_collection_names())
                said = ",".join(names) + "|" + ",".join(sorted(f"{c}.{i['name']}" for c in names for i in db[c].list_indexes()))
            else:
                said = str(next(iter(_fetched(db, families.FINGERPRINTS[self.dialect])))[0])
        return hashlib.sha256(said.encode()).hexdigest()

    def rows(self, part: Part) -> Iterator[tuple[str, int, str, str]]:
        if part.family == MARK:
            yield MARK, 0, "{}", part.mark
            return
        with closing(self.open()) as db:
            if part.collection is not None:
                found = self._collection(db, part.collection)
            elif part.views:
                found = ((part.family, row) for view in part.views for row in self._view(db, *view))
            else:
                found = ((part.family, row) for row in _dicts(db, part.sql))
            for i, (family, row) in enumerate(found):
                yield family, part.first + i, json.dumps(row, default=_plain, ensure_ascii=False), part.mark

    @staticmethod
    def _view(db: Any, schema: str, view: str) -> Iterator[dict]:
        """A view that can't be bound, as one on a table that is gone, is left out, as each has a call of its own."""
        try:
            yield from [{"referencing_schema": schema, "referencing_view": view} | r for r in _dicts(db, families.mssql_view_columns(schema, view))]
        except Exception:  # whatever the driver's errors are
            return

    def _collection(self, db: Any, name: str) -> Iterator[tuple[str, dict]]:
        options = next((c.get("options", {}) for c in db.command("listCollections", filter={"name": name})["cursor"]["firstBatch"]), {})
        yield "collections", {"collection": name, "validator": json.dumps(options["validator"], default=_plain) if options.get("validator") else None}
        for x in db[name].list_indexes():
            yield "indexes", {"collection": name, "name": x["name"], "keys": list(x["key"]), "unique": bool(x.get("unique", False))}
        for doc in db[name].aggregate([{"$sample": {"size": max(1, self.sample)}}]):
            yield "documents", {"collection": name, "document": json.dumps(doc, default=_plain, ensure_ascii=False)}


def _fetched(db: Any, sql: str) -> Iterator[tuple]:
    with closing(db.cursor()) as cursor:
        cursor.execute(sql)
        while rows := cursor.fetchmany(FETCH):
            yield from rows


def _dicts(db: Any, sql: str) -> Iterator[dict]:
    with closing(db.cursor()) as cursor:
        cursor.execute(sql)
        names = [c[0].lower() for c in cursor.description]
        while rows := cursor.fetchmany(FETCH):
            for r in rows:
                yield dict(zip(names, r, strict=True))


#: Types of a document driver, by name, in extended JSON.
_EXTENDED = {"ObjectId": "$oid", "Int64": "$numberLong", "Decimal128": "$numberDecimal", "Regex": "$regularExpression", "Timestamp": "$timestamp", "Binary": "$binary", "MinKey": "$minKey", "MaxKey": "$maxKey", "Code": "$code", "UUID": "$uuid"}


def _plain(x: Any) -> Any:
    """What JSON has no type for: numbers as text, times in extended JSON, bytes as a wrapper without content."""
    if (key := _EXTENDED.get(type(x).__name__)) is not None:
        return {key: str(x)}
    if isinstance(x, datetime | date):
        return {"$date": x.isoformat()}
    if isinstance(x, Decimal):
        return str(x)
    if isinstance(x, bytes | bytearray | memoryview):
        return {"$binary": ""}
    return list(x) if isinstance(x, set | frozenset | tuple) else str(x)


class _Reader(DataSourceReader):
    def __init__(self, source: Connection) -> None:
        self.source = source

    def partitions(self) -> list[Part]:
        return self.source.parts()

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.source.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """A batch is the whole catalog, whenever the fingerprint differs from the last one's.

    A batch that is run again after a failure reads the catalog as it is then, under the mark of the first attempt; the
    next offset notices what has changed since.
    """

    def __init__(self, source: Connection) -> None:
        self.source = source

    def initialOffset(self) -> dict:
        return {"fingerprint": ""}

    def latestOffset(self) -> dict:
        return {"fingerprint": self.source.fingerprint()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [] if start == end else self.source.parts(end["fingerprint"])

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.source.rows(partition)


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(Connection(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(Connection(self.options))


def read_catalog(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    spark.dataSource.register(CatalogSource)
    return spark.read.format(FORMAT).options(**options).load()


def families_of(rows: DataFrame, dialect: str) -> Families:
    """Typed families of rows as the source gives them, with pos in the source's order; a value that doesn't fit fails.

    Keys that a source leaves out are null. Lists may come as such or as text.
    """
    out = {}
    for family, ddl in SCHEMAS[dialect].items():
        fields = T._parse_datatype_string(ddl).fields
        raw = rows.where(F.col("family") == family).select("nth", F.from_json("row", "MAP<STRING, STRING>", {"mode": "FAILFAST"}).alias("r"))
        value = lambda f: F.col("r")[f.name]
        of = lambda f: F.from_json(value(f), f.dataType.simpleString(), {"mode": "FAILFAST"}) if isinstance(f.dataType, T.ArrayType) else value(f)
        typed = checked_rows(raw.select("nth", *[of(f).alias(f.name) for f in fields]), f"nth LONG, {ddl}")
        out[family] = typed.withColumnRenamed("nth", "pos")
    return out


def objects_of(rows: DataFrame, dialect: str, scope: Scope = Scope(), database: str = "") -> DataFrame:
    """Raw objects of the rows of a catalog; database names the schema of documents."""
    found = families_of(rows, dialect)
    if dialect != "documents":
        return MAPPINGS[dialect](found, scope)
    fields = sampling.fields(found["documents"], doc="document")
    return mapping.map_documents(database, fields, found["indexes"], found["collections"].where("validator IS NOT NULL"), scope)


def engine_of(dialect: str) -> str:
    return "mongodb" if dialect == "documents" else dialect


def sync_once(store: GraphStore, options: Mapping[str, str], scope: Scope = Scope()) -> SyncResult:
    """Brings a store to the source's state, unless its fingerprint is the last snapshot's."""
    mark = Connection(options).fingerprint()
    last = store.last_snapshot()
    if last is not None and last.fingerprint == mark:
        return SyncResult(False, snapshot=last.id)  # before any family is asked for
    return _sync(store, read_catalog(store.spark, options), options, mark, scope)


def _sync(store: GraphStore, rows: DataFrame, options: Mapping[str, str], mark: str, scope: Scope) -> SyncResult:
    rows = staged(rows)  # each family is asked for once
    found = sync(store, objects_of(rows, options["dialect"], scope, options.get("database", "")), engine_of(options["dialect"]), mark, scope)
    discard(rows)
    return found


def follow(store: GraphStore, options: Mapping[str, str], checkpoint: str, scope: Scope = Scope(), **trigger: Any) -> StreamingQuery:
    """A stream that syncs the store whenever the source's fingerprint moves; by default once, for what is new by now.

    It goes on from its checkpoint. A batch that is repeated after a failure finds its fingerprint in the store if it had
    been committed, and else runs again.
    """
    spark = store.spark
    spark.dataSource.register(CatalogSource)

    def apply(batch: DataFrame, _: int) -> None:
        batch = staged(batch)
        mark = batch.where(F.col("family") == MARK).first()
        if mark is not None:
            store.refresh()
            _sync(store, batch, options, mark.mark, scope)
        discard(batch)

    stream = spark.readStream.format(FORMAT).options(**options).load()
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
