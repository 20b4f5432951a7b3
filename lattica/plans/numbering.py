"""Numbers in a global order without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import staged

_PLACE = (1 << 33) - 1


def with_row_numbers(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """df with a column that numbers its rows from 0 in the order given, which must leave no ties."""
    return number_sorted(df.orderBy(*order), name)


def number_sorted(df: DataFrame, name: str) -> DataFrame:
    """The rows of a sorted frame with their numbers from 0.

    A sort deals rows to ranges; a row's number is its place in its range and the sizes of the ranges before it, of which
    only the sizes, one number a task, reach the driver.
    """
    rows = staged(df.withColumn("__at", F.monotonically_increasing_id()))
    sizes = {r.part: r.n for r in rows.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part LONG, __before LONG"))
    # The rows are written once; their numbers are worked out where they are read.
    out = rows.join(offset, F.shiftright("__at", 33) == F.col("__part")).withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(_PLACE)).select(*df.columns, name)
    out._staged_at = rows._staged_at
    return out
