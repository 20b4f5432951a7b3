"""Joins on keys of which a few may have a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import staged

#: Rows of one key that go to a task.
SLICE = 100_000


def met(many: DataFrame, few: DataFrame, on: Sequence[str], rows: int = SLICE) -> DataFrame:
    """many joined with few on columns of both names.

    Keys with more rows in many than go to a task are counted first; there are at most as many as slices of that size. Such
    a key's rows are left out before they are shuffled if few doesn't have it, else dealt into slices, each of which meets
    few's rows of the key.
    """
    on = list(on)
    hot = staged(many.groupBy(*on).agg(F.count("*").alias("__rows")).where(F.col("__rows") > rows))
    known = few.join(F.broadcast(hot.select(*on)), on, "left_semi").select(*on).distinct().withColumn("__known", F.lit(True))
    slices = F.when(F.col("__known"), F.ceil(F.col("__rows") / rows).cast("int")).otherwise(0)
    hot = F.broadcast(staged(hot.join(known, on, "left").select(*on, slices.alias("__slices"))))
    n = F.coalesce("__slices", F.lit(1))
    slice_ = F.when(n > 1, F.pmod(F.xxhash64(*[c for c in many.columns if c not in on]), n).cast("int")).otherwise(0)
    left = many.join(hot, on, "left").where(n > 0).withColumn("__slice", slice_).drop("__slices")
    right = few.join(hot, on, "left").where(n > 0).withColumn("__slice", F.explode(F.sequence(F.lit(0), n - 1))).drop("__slices")
    return left.join(right, [*on, "__slice"]).drop("__slice")
