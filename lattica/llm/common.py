"""What the operators of this subpackage share: cut points, Arrow batches and grouped Arrow streams.

All operators read only the columns that they are told the names of, so extra columns, whatever they are called, do no
harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.plans.cut import staged

__all__ = ["arrow_schema", "map_batches", "map_groups", "slices", "small_batches", "staged", "table", "text_column"]

#: Bytes that Spark hands to a worker at once, and rows and bytes of a slice that an operator works on; one row is a slice, however long.
BATCH_BYTES, SLICE_ROWS, SLICE_BYTES = 4 << 20, 128, 1 << 20
#: Rows of a table of texts or arrays that a scan decodes at once; Spark's own 4,096 are gigabytes where rows are large.
SCAN_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, and the rows of a scan's. All operators set the same values, so it doesn't matter when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in small parts, in order; empty batches are left out."""
    for batch in batches:
        rest = [batch] if batch.num_rows else []
        while rest:
            part = rest.pop()
            n = part.num_rows
            if n == 1 or (n <= rows and part.nbytes <= SLICE_BYTES):
                yield part
            else:
                rest += [part.slice(n // 2), part.slice(0, n // 2)]


def text_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow with one result, or none, for each slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn on the rows of each group of keys; the groups stream through sorted partitions, so only one is in memory.

    Groups must be bounded: callers split large ones by a further key.
    """
    keys = list(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            start = 0
            for i, key in enumerate(rows):
                if key != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held and (out := fn(pa.Table.from_batches(held))) is not None:
                        yield out
                    held, last, start = [], key, i
            if start < len(rows):
                held.append(batch.slice(start))
        if held and (out := fn(pa.Table.from_batches(held))) is not None:
            yield out

    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))
