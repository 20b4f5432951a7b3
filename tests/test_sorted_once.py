"""What is put in order is written once, with the columns asked for, and hashes in half their bytes."""

from pyspark.sql import functions as F

from lattica.operators import normalize as norm
from lattica.plans import numbering
from lattica.queries import edge_rows
from lattica.queries_graph import numbered


def test_edges_are_ordered_as_their_ids_are_and_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(numbering, "staged", lambda df: written.append(df.columns) or real(df))
    real = norm.staged
    k = F.col("id").cast("string")
    edges = edge_rows(spark.range(40), "references", ("table", F.concat(F.lit("s.a"), F.col("id") % 5)), ("table", F.concat(F.lit("s.b"), F.col("id") % 7)), src_column=F.concat(F.lit("c"), k), dst_column=F.lit("id"))
    names = edges.withColumn("src", F.when(F.col("src") < "8", F.concat(F.lit("plain"), F.substring("src", 1, 3))).otherwise(F.col("src")))
    for rows in (edges, names):
        want = sorted((r.src, r.dst, r.attrs.src_column, r.id) for r in rows.collect())
        ordered = norm.ordered_edges(rows)
        assert ordered.columns == rows.columns and [(r.src, r.dst, r.attrs.src_column, r.id) for r in ordered.collect()] == want
        found = numbered(ordered, "src", "dst")
        assert [(r.src, r.dst) for r in found.orderBy("place").collect()] == [w[:2] for w in want] and [r.place for r in found.orderBy("place").collect()] == [*range(40)]
    assert written == [["src", "dst", "__at"]] * 2
    sort = norm.ordered_edges(edges)._jdf.queryExecution().analyzed().toString()
    assert "unhex(src" in sort and "unhex(dst" in sort
