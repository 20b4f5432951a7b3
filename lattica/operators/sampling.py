"""Field schemas of document collections, from samples; values are dropped, only types and frequencies stay."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Type wrappers of extended JSON, and their names.
WRAPPERS = {"$oid": "objectId", "$date": "date", "$numberInt": "int", "$numberLong": "int", "$numberDouble": "numeric", "$numberDecimal": "numeric"}
UNKNOWN_WRAPPERS = ("$binary", "$regularExpression", "$timestamp", "$minKey", "$maxKey", "$symbol", "$code", "$uuid")


def _wrapped(value: Any) -> str | None:
    if isinstance(value, dict) and value:
        key = next(iter(value))
        return WRAPPERS.get(key) or ("unknown" if key in UNKNOWN_WRAPPERS else None)
    return None


def type_name(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int | float):
        return "numeric"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return f"{type_name(value[0])}[]" if value else "unknown[]"
    return _wrapped(value) or "object"


def leaves(value: dict[str, Any], prefix: str = "") -> Iterator[tuple[str, str]]:
    """(path, type) of all leaves: sub-documents by dots, arrays of them by their first element below path[]."""
    todo = [(f"{prefix}{k}", v) for k, v in reversed(value.items())]
    while todo:
        path, v = todo.pop()
        inner, below = (v[0], f"{path}[].") if isinstance(v, list) and v else (v, f"{path}.")
        if isinstance(inner, dict) and _wrapped(inner) is None:
            todo += [(f"{below}{k}", x) for k, x in reversed(inner.items())]
        else:
            yield path, type_name(v)


def walk(docs: DataFrame, collection: str = "collection", doc: str = "doc") -> DataFrame:
    """(collection, path, type): a row for each leaf of each JSON document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, p, t) for c, text in zip(batch[collection], batch[doc], strict=True) if text is not None for p, t in leaves(json.loads(text))]
            yield pd.DataFrame(rows, columns=["collection", "path", "type"])

    return docs.select(collection, doc).mapInPandas(run, "collection STRING, path STRING, type STRING")


def fields(docs: DataFrame, collection: str = "collection", doc: str = "doc") -> DataFrame:
    """(collection, name, data_type, frequency, nullable) over all documents given."""
    total = docs.groupBy(F.col(collection).alias("collection")).agg(F.count("*").alias("total"))
    seen = walk(docs, collection, doc).groupBy("collection", "path").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
    rows = seen.join(total, "collection").withColumn("frequency", F.col("n") / F.col("total"))
    return rows.select("collection", F.col("path").alias("name"), F.array_join("types", "|").alias("data_type"), "frequency", ((F.col("frequency") < 1) | F.array_contains("types", "null")).alias("nullable")).orderBy("collection", "name")
