"""Snapshots, differences between them, and incremental sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import large


def content_hash(include_payload: bool = False) -> Column:
    """What tells a change: the body's hash; with include_payload also the payload's, so that types count."""
    if not include_payload:
        return F.col("body_hash")
    return F.sha1(F.concat_ws(" ", F.coalesce("body_hash", F.lit("")), F.to_json("payload")))


def manifest(nodes: DataFrame, snapshot_id: str, include_payload: bool = False) -> DataFrame:
    """Rows of visible nodes: neither missing nor excluded."""
    return nodes.where("NOT missing AND NOT excluded").select(F.lit(snapshot_id).alias("snapshot_id"), F.col("id").alias("node_id"), "kind", "qname", content_hash(include_payload).alias("body_hash"))


#: Buckets of a manifest, and its rows in one, in expectation, before there are more.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 16, 4096, 4096


def buckets_for(rows: int, before: int = 0) -> int:
    """A power of two; the number that the manifest before had, unless its buckets have grown too large."""
    if before and (rows <= 4 * BUCKET_ROWS * before or before >= MOST_BUCKETS):
        return before
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, rows // BUCKET_ROWS).bit_length()))


def in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(buckets)).cast("int"))


def bucket_hashes(rows: DataFrame) -> DataFrame:
    """(bucket, hash): the same whatever the order of rows, and whichever snapshot they are of."""
    own = F.xxhash64("node_id", "kind", "qname", "body_hash")
    other = F.xxhash64("qname", "body_hash", "node_id", F.lit(1))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.bit_xor(other).alias("y"))
    return sums.select("bucket", F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "x", "y")]).alias("hash"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, node_id, kind, qname): added, removed and changed between two manifests."""
    a = before.select("node_id", F.struct("kind", "qname", "body_hash").alias("a"))
    b = after.select("node_id", F.struct("kind", "qname", "body_hash").alias("b"))
    both = a.join(b, "node_id", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a.body_hash").eqNullSafe(F.col("b.body_hash")), "changed")
    return both.select(change.alias("change"), "node_id", F.coalesce("b.kind", "a.kind").alias("kind"), F.coalesce("b.qname", "a.qname").alias("qname")).where("change IS NOT NULL")


def delta(stored: DataFrame, fresh: DataFrame, include_payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ids to delete, nodes to upsert): gone ones; new ones and those whose hash differs."""
    gone = stored.select("id").join(large(fresh.select("id")), "id", "left_anti")
    old = stored.select("id", content_hash(include_payload).alias("__old"), F.lit(True).alias("__known"))
    rows = fresh.join(large(old), "id", "left").where(F.col("__known").isNull() | ~content_hash(include_payload).eqNullSafe(F.col("__old")))
    return gone, rows.select(fresh.columns)


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def status(nodes: DataFrame) -> DataFrame:
    """(part, name, n): visible nodes by kind, and excluded ones by name."""
    visible = nodes.where("NOT missing AND NOT excluded").groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("count").alias("part"), "name", "n")
    out = nodes.where("excluded").select(F.lit("excluded").alias("part"), F.col("qname").alias("name"), F.lit(1).cast("long").alias("n"))
    return visible.unionByName(out).orderBy("part", "name")


def fingerprint(rows: DataFrame, *values: Column) -> Column | DataFrame:
    """One hash over aggregates of a catalog's rows, joined with |; null counts as empty."""
    return rows.agg(F.sha2(F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), 256).alias("fingerprint"))


def max_and_count(rows: DataFrame, modified: str) -> DataFrame:
    return fingerprint(rows, F.max(modified), F.count("*"))


def lists_fingerprint(collections: DataFrame, indexes: DataFrame) -> DataFrame:
    """sha256 of the sorted collection names, a bar, and the sorted collection.index names."""
    a = collections.agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("a"))
    b = indexes.agg(F.array_join(F.array_sort(F.collect_set(F.concat("collection", F.lit("."), "name"))), ",").alias("b"))
    return a.crossJoin(b).select(F.sha2(F.concat("a", F.lit("|"), "b"), 256).alias("fingerprint"))
