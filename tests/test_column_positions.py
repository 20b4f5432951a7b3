"""Positions of columns become names by a join, whatever the number of columns of a table."""

from lattica.sources.mapping import with_column_names


def test_positions_meet_names_by_a_join(spark):
    names = spark.createDataFrame([("s", "t", 1, "a"), ("s", "t", 2, "b"), ("s", "u", 1, "z")], "ns STRING, nt STRING, attnum INT, column_name STRING")
    lists = [("s", "t", "k", [2, 1, 9]), ("s", "t", "k", [1, 1]), ("s", "t", "same", [2]), ("s", "t", "same", [2]), ("s", "u", "k", [None, 1]), (None, "t", "k", [1]), ("s", "t", "e", []), ("s", "t", "n", None)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(lists)], "nr INT, schema_name STRING, table_name STRING, name STRING, at ARRAY<INT>")
    out = with_column_names(rows, "at", ("schema_name", "table_name"), "name", names, "columns")
    assert {r.nr: r.columns for r in out.collect()} == {0: ["b", "a", "col_9"], 1: ["a", "a"], 2: ["b"], 3: ["b"], 4: [None, "z"], 5: ["col_1"], 6: [], 7: []}
    assert out.columns == [*rows.columns, "columns"] and "map_from_entries" not in out._jdf.queryExecution().analyzed().toString()
