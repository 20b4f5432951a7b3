"""Labels of large components are worked out by levels, with the result of nodes one after the other."""

import random

from lattica.plans import labels


def one_after_the_other(links):
    around = {}
    for a, b in links:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    label = {v: v for v in sorted(around)}
    for _ in range(labels.ROUNDS):
        before = dict(label)
        for v in label:
            votes = [label[u] for u in around[v]]
            label[v] = min(set(votes), key=lambda x: (-votes.count(x), x))
        if label == before:
            break
    return label


def test_levels_give_what_nodes_in_order_do(spark):
    rng = random.Random(5)
    trees = [(v, rng.randrange(max(0, v - 20), v)) for v in range(1, 60)]
    extra = [tuple(sorted(rng.sample(range(60), 2), reverse=True)) for _ in range(8)]
    pairs = sorted(set(trees + extra))
    links = spark.createDataFrame([x for a, b in pairs for x in ((a, b, 1), (b, a, 1))], "v LONG, u LONG, w LONG")
    found = labels.levels(links)
    level = {r.v: i for i, df in enumerate(found) for r in df.collect()}
    assert len(level) == 60 and all(level[a] != level[b] for a, b in pairs)
    by_level = labels.propagated(links, small=0)
    assert "Pandas" not in by_level._jdf.queryExecution().toString()  # neither nodes nor links go to one Python task
    want = one_after_the_other(pairs)
    assert {r.v: r.label for r in by_level.collect()} == want
    assert {r.v: r.label for r in labels.propagated(links).collect()} == want
