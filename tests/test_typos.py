"""The stored index of misspelt names finds what a comparison with every name finds."""

import random
import re

from pyspark.sql import functions as F

from lattica.operators import search
from lattica.operators.store import GraphStore
from lattica.queries import node_rows
from tests.test_store_log import files


def edited(rng, word, n):
    for _ in range(n):
        i, c = rng.randrange(len(word) + 1), rng.choice("abcxyz")
        word = rng.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]])
    return word


def test_stored_names_are_found_like_all_names(spark, tmp_path):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(150)} | {"id", "Ab", "customer_number"})
    nodes = node_rows(spark.createDataFrame([(x,) for x in names], "x STRING"), "table", F.concat(F.lit("s."), "x")).withColumn("excluded", F.col("qname") == "s.ab")
    store = GraphStore(spark, str(tmp_path / "s"))
    store.upsert(nodes)
    terms = [edited(rng, rng.choice(names), rng.randint(0, 3)) for _ in range(25)] + ["", "x", "IB", "costumer_numbr", "abc" * 9]
    found = store.suggest(spark.createDataFrame([(t,) for t in [*terms, terms[0], None]], "term STRING"), cap=10**6).collect()
    plain = {(t, r.id, r.qname, r.distance) for t in set(terms) for r in search.suggestions(nodes, t, cap=10**6).collect()}
    assert {tuple(r) for r in found} == plain and len(found) == len(plain) > 100
    best = store.suggest(["IB"]).orderBy("distance", "qname", "id").collect()
    assert [(r.id, r.qname, r.distance) for r in best] == [tuple(r) for r in search.suggestions(nodes, "IB").collect()]
    # Of one term, only the parts of the index are read that can hold it.
    plan = store.suggest(["customer_numbers"])._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any(re.search(r"bucket#\d+ IN", f) and len(re.findall(r"\b\d+\b(?!L)", f)) <= 40 for f in filters), filters
    store.apply(nodes.limit(0), nodes.where("qname = 's.customer_number'").select("id"))
    assert store.suggest(["customer_numbers"]).count() == 0 and files(store.path)
