"""Label propagation in the order of nodes, without a task that sees a whole component."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import discard, staged

# Rounds at most; the share of nodes up to which only what lies around changed labels is looked at; and the
# links, both directions counted, that one task works through faster than jobs are started, in about 60 MB.
ROUNDS = 100
FEW = 0.1
SMALL = 100_000


def levels(links: DataFrame) -> list[DataFrame]:
    """Nodes (v) of links (v, u) by level: one more than the highest of their smaller neighbours, 0 without any."""
    out, todo, ahead = [], staged(links.select("v").distinct()), staged(links.where("u < v").select("u", "v"))
    while not todo.isEmpty():
        waiting = staged(ahead.select("v").distinct())
        now = staged(todo.join(waiting, "v", "left_anti"))
        left = staged(ahead.join(now.select(F.col("v").alias("u")), "u", "left_anti"))
        discard(todo, ahead)
        todo, ahead = waiting, left
        out.append(now)
    discard(todo, ahead)
    return out


def _voted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, new): the commonest label around each v, the smaller of equally common ones."""
    votes = links.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v", "label").agg(F.sum("w").alias("n"))
    return votes.groupBy("v").agg((-F.max(F.struct("n", (-F.col("label")).alias("label")))["label"]).alias("new"))


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels (v, label) of few links (v, u, w): nodes one after the other."""
    around: dict[int, list[tuple[int, int]]] = {}
    for v, u, w in zip(pdf["v"].tolist(), pdf["u"].tolist(), pdf["w"].tolist(), strict=True):
        around.setdefault(v, []).append((u, w))
    label = {v: v for v in sorted(around)}
    for _ in range(ROUNDS):
        moved = False
        for v in label:
            votes: dict[int, int] = {}
            for u, w in around[v]:
                votes[label[u]] = votes.get(label[u], 0) + w
            new = min(votes, key=lambda x: (-votes[x], x))
            moved |= new != label[v]
            label[v] = new
        if not moved:
            break
    return pd.DataFrame({"v": list(label), "label": list(label.values())}, dtype="int64")


def propagated(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(v, label) of links (v, u, w), each pair once in both directions with w > 0; nodes are numbers, labels are nodes.

    At first each node is its own label. In rounds, until one changes nothing, nodes in their order take the commonest label
    around them, at once. A node then sees new labels of smaller neighbours and old ones of larger ones; neighbours are of
    different levels, so a level's nodes move together, and levels one after the other give just what nodes one after the
    other do. Once few labels change, only nodes around these are looked at again. A graph of few links is worked through
    in one task.
    """
    if links.limit(small + 1).count() <= small:
        return links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_in_order, "v LONG, label LONG")
    of = levels(links)
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    numbered = union([df.withColumn("level", F.lit(i)) for i, df in enumerate(of)])
    placed = staged(links.join(numbered, "v").repartition("level", "v"), "level")
    labels = [staged(df.withColumn("label", F.col("v"))) for df in of]
    n = sum(df.count() for df in labels)
    discard(*of)
    # What has changed since a level was last worked out; None: all of it is to be.
    since: list[list[tuple[DataFrame, int]] | None] = [None] * len(of)
    for _ in range(ROUNDS):
        for i in range(len(of)):
            news = since[i]
            if news is not None and not news:
                continue
            around, picked = placed.where(F.col("level") == i), None
            if news is not None and sum(k for _, k in news) <= FEW * n:
                changed = union([df.select(F.col("v").alias("u")) for df, _ in news]).distinct()
                near = around.join(changed, "u", "left_semi").select("v").distinct()
                around = picked = staged(around.join(near, "v", "left_semi"))
            found = _voted(around, union(labels)).join(labels[i], "v").where("new <> label").select("v", "new")
            found, since[i] = staged(found), []
            count = found.count()
            if picked is not None:
                discard(picked)
            if count:
                old, labels[i] = labels[i], staged(labels[i].join(found, "v", "left").select("v", F.coalesce("new", "label").alias("label")))
                discard(old)
                for j, x in enumerate(since):
                    if j != i and x is not None:
                        x.append((found, count))
        if not any(since):
            break
    return union(labels)
