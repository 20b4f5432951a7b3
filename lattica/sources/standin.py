"""Connections that answer from a folder of exported tables, for sources that can't be reached.

A catalog's families are tables <folder>/<family> of Parquet files; a statement is known by its text. A document database
is one table (collection, document, ...), partitioned by collection. Their fingerprint changes when files do.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq

from lattica.sources import families

#: Rows decoded at once, whatever the size of files and row groups.
ROWS = 1000
_CALL = re.compile(r"dm_sql_referenced_entities\(N'\[((?:[^\]]|\]\])*)\]\.\[((?:[^\]]|\]\])*)\]',")


def _files(folder: str) -> list[str]:
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def _rows(data: ds.Dataset, columns: list[str], where: ds.Expression | None = None) -> Iterator[tuple]:
    """Rows by a fixed number at a time; nothing is read ahead, as several such readers share an executor.

    Row groups whose statistics rule out a hit are left out.
    """
    for fragment in data.get_fragments(filter=where):
        groups = [g.id for g in (fragment if where is None else fragment.subset(filter=where)).row_groups]
        with pq.ParquetFile(fragment.path, buffer_size=1 << 20) as file:
            read = columns if where is None else None  # a condition may be on other columns
            for batch in file.iter_batches(batch_size=ROWS, row_groups=groups, columns=read, use_threads=False):
                part = pa.Table.from_batches([batch])
                part = (part if where is None else part.filter(where)).select(columns)
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


class Cursor:
    def __init__(self, folder: str, statements: dict[str, str]) -> None:
        self._folder, self._families = folder, {sql: family for family, sql in statements.items()}
        self.description: list[tuple] = []
        self._rows: Iterator[tuple] = iter(())

    def execute(self, sql: str) -> None:
        if sql in families.FINGERPRINTS.values():
            self.description, self._rows = [("value",)], iter([(hashlib.sha256("|".join(_files(self._folder)).encode()).hexdigest(),)])
        elif sql == families.MSSQL_VIEWS:
            self._answer("modules", ["schema_name", "object_name"], ds.field("object_type") == "V")
        elif sql in self._families:
            self._answer(self._families[sql])
        elif call := _CALL.search(sql):
            schema, view = (x.replace("''", "'").replace("]]", "]") for x in call.groups())
            self._answer("view-referenced-columns", ["referenced_schema", "referenced_entity", "referenced_column"], (ds.field("referencing_schema") == schema) & (ds.field("referencing_view") == view))
        else:
            raise ValueError(f"no answer to {sql[:80]}")

    def _answer(self, family: str, columns: list[str] | None = None, where: ds.Expression | None = None) -> None:
        data = ds.dataset(f"{self._folder}/{family}", format="parquet", exclude_invalid_files=False)
        names = columns or [c for c in data.schema.names if c != "pos"]
        self.description = [(c,) for c in names]
        self._rows = _rows(data, names, where)

    def fetchmany(self, n: int) -> list[tuple]:
        return [row for _, row in zip(range(n), self._rows, strict=False)]

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    def __init__(self, folder: str, dialect: str, database: str) -> None:
        known = {"mssql": families.MSSQL_QUERIES, "pg": families.PG_QUERIES}.get(dialect)
        self._args = folder.removeprefix("file://"), families.mysql_queries(database) if known is None else known

    def cursor(self) -> Cursor:
        return Cursor(*self._args)

    def close(self) -> None:
        pass


def connect(folder: str, dialect: str, database: str = "") -> Connection:
    return Connection(folder, dialect, database)


class Collection:
    def __init__(self, folder: str, name: str, indexes: dict[str, list[str]]) -> None:
        self._folder, self._indexes = f"{folder}/collection={name}", indexes

    def list_indexes(self) -> list[dict]:
        return [{"name": name, "key": dict.fromkeys(keys, 1), "unique": name == "_id_"} for name, keys in self._indexes.items()]

    def aggregate(self, stages: list[dict]) -> Iterator[dict]:
        """The first documents, as many as the sample has."""
        (stage,) = stages
        rows = (json.loads(document) for (document,) in _rows(ds.dataset(self._folder, format="parquet"), ["document"]))
        return (doc for _, doc in zip(range(stage["$sample"]["size"]), rows, strict=False))


class Documents:
    def __init__(self, folder: str, indexes: dict[str, list[str]], validator: dict | None) -> None:
        self._folder, self._indexes, self._validator = folder.removeprefix("file://"), indexes, validator

    def list_collection_names(self) -> list[str]:
        return [x.removeprefix("collection=") for x in sorted(os.listdir(self._folder)) if x.startswith("collection=")]

    def command(self, name: str, filter: dict) -> dict:  # noqa: A002  the driver's word
        return {"cursor": {"firstBatch": [{"name": filter["name"], "options": {"validator": self._validator} if self._validator else {}}]}}

    def __getitem__(self, name: str) -> Collection:
        return Collection(self._folder, name, self._indexes)

    def close(self) -> None:
        pass


def connect_documents(folder: str, indexes: dict[str, list[str]] | None = None, validator: dict | None = None) -> Documents:
    return Documents(folder, indexes or {}, validator)
