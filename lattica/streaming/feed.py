"""A change feed: node states arrive as a stream and are applied to a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.model import NODES
from lattica.operators.snapshot import delta
from lattica.operators.store import GraphStore

FEED = f"{NODES}, op STRING, seq LONG"


def read_feed(spark, folder: str) -> DataFrame:
    """JSON lines of nodes with op (upsert or delete) and seq, new files as they come."""
    return spark.readStream.schema(FEED).json(folder)


def apply_batch(store: GraphStore, batch: DataFrame) -> tuple[int, int]:
    """Applies a batch in one commit; of several rows of a node the one with the greatest seq counts.

    A row without an op is an upsert. A change of the payload, as of a column's type, counts. Applying a batch again
    changes nothing.
    """
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    rows = batch.withColumn("__n", last).where("__n = 1").drop("__n", "seq")
    going = F.coalesce("op", F.lit("upsert")) == "delete"
    _, changed = delta(store.nodes, rows.where(~going).drop("op"), include_payload=True)
    return store.apply(changed, rows.where(going).select("id"))


def start(feed: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    return feed.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
