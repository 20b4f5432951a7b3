"""Exact top-k search: tiles of queries and shards, a matrix product and a partial selection in each, merged as a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import map_groups, small_batches, staged

#: Rows of a tile's two sides in expectation, and partial lists that are merged at once.
QUERIES, SHARD, FAN_IN = 8192, 8192, 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def vectors(table: DataFrame, id_col: str, vector_col: str, *keep: str) -> DataFrame:
    """(id long, v array<double>, *keep) of the rows that take part: vectors without nulls, NaN or infinities, ids not null."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *keep).where(F.col("id").isNotNull() & v.isNotNull() & ~bad)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact; beyond 64 bits they are held at the ends of the range."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in c], object).reshape(c.shape).T
    return np.clip(exact, _LOW, _HIGH).astype(np.int64)


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Of each row the places of its k highest scores, ties to smaller ids (they ascend), best first.

    ~x falls as x grows and, unlike -x, has a value for the least of all integers.
    """
    if score.shape[1] > 4 * k:
        # All that reach the k-th score stay, so ties are settled by id below.
        floor = ~np.partition(~score, k - 1, axis=1)[:, k - 1]
        out = []
        for row, least in zip(score, floor, strict=True):
            at = np.flatnonzero(row >= least)
            out.append(at[np.argsort(~row[at], kind="stable")][:k])
        return np.stack(out)
    return np.argsort(~score, axis=1, kind="stable")[:, :k]


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = QUERIES, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row the k rows with the greatest inner products of floor(scale x).

    Candidates are all rows but those with the query's own id; ties go to the smaller id. Vectors that are null or hold a
    null or non-finite component, and rows with a null id, take no part; vectors of other lengths than the query's are no
    candidates of it. Repeated rows are candidates each, and as queries give each rank once, as one query. Scores beyond
    64 bits are held at the ends of the range. A query with fewer candidates than k has all of them.

    Each tile meets one block of queries and one shard of candidates; a row goes to as many tiles as the other side has
    blocks, tiles have about the same size whatever the data, and only k rows of each query leave a tile. The lists of
    sixteen shards at a time are merged until one is left.
    """
    small_batches(table.sparkSession)
    rows = vectors(table.withColumn("__is_query", F.coalesce(is_query, F.lit(False))), id_col, vector_col, "__is_query")
    rows = staged(rows.withColumn("dim", F.size("v")))
    # Floored components are shuffled in as few bytes as they need; beyond 32 bits they stay what they are.
    most = (rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0) * abs(scale) + 1
    kind = "short" if most < 1 << 15 else "int" if most < 1 << 31 else None
    if kind is not None:
        rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast(kind)))
    sizes = {r.dim: (-(-r.q // queries), -(-r.n // shard)) for r in rows.groupBy("dim").agg(F.sum(F.col("__is_query").cast("int")).alias("q"), F.count("*").alias("n")).collect()}
    if not any(q for q, _ in sizes.values()):
        return rows.where(F.lit(False)).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, n[i])]), F.col("dim"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    asked = rows.where("__is_query").select("id", "v", "dim").distinct().withColumn("key", F.xxhash64("v"))
    asked = asked.select("id", "v", "dim", "key", F.lit(True).alias("q"), F.pmod(F.xxhash64("id", "key"), of(0)).cast("int").alias("block"), F.explode(upto(of(1))).alias("shard"))
    given = rows.where(of(0) > 0).select("id", "v", "dim", F.lit(0).cast("long").alias("key"), F.lit(False).alias("q"), F.explode(upto(of(0))).alias("block"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), of(1)).cast("int").alias("shard"))

    def tile(t: pa.Table) -> pa.RecordBatch | None:
        ask, have = t.filter(t["q"]), t.filter(pc.invert(t["q"])).sort_by("id")
        if not len(ask) or not len(have):
            return None
        q, c = (matrix(x["v"]).astype(np.float64) if kind is not None else np.floor(np.clip(matrix(x["v"]) * scale, -1.7e308, 1.7e308)) for x in (ask, have))
        ids, own, keys = have["id"].to_numpy(), ask["id"].to_numpy(), ask["key"].to_numpy()
        out: list[tuple] = []
        for at in range(0, len(own), 512):
            mine = own[at : at + 512]
            score = scores(q[at : at + 512], c)
            same = mine[:, None] == ids
            places = best(score, k + int(same.sum(1).max()))
            rows_at = np.repeat(np.arange(len(mine)), places.shape[1])
            places = places.ravel()
            ok = ~same[rows_at, places]
            rows_at, places = rows_at[ok], places[ok]
            nth = np.arange(len(rows_at)) - np.searchsorted(rows_at, rows_at)
            rows_at, places = rows_at[nth < k], places[nth < k]
            out.append((mine[rows_at], keys[at : at + 512][rows_at], np.full(len(places), t["shard"][0].as_py(), np.int32), ids[places], score[rows_at, places]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "key", "shard", "vec_id", "score"])

    found = map_groups(asked.unionByName(given), ["dim", "block", "shard"], tile, "query_id long, key long, shard int, vec_id long, score long")
    left = max(s for q, s in sizes.values() if q)
    while True:
        left = -(-left // FAN_IN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        order = Window.partitionBy("query_id", "key", "shard").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if left == 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")
