"""A stand-in source holds few rows at a time, however many a family has."""

import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq

from lattica.sources import families, standin


def test_rows_of_a_large_family_are_decoded_a_few_at_a_time(tmp_path):
    (tmp_path / "tables").mkdir()
    n = 60_000
    pq.write_table(pa.table({"pos": range(n), "schema_name": ["dbo"] * n, "table_name": [f"t{i}" for i in range(n)], "object_id": range(n)}), tmp_path / "tables" / "a.parquet")
    cursor = standin.connect(str(tmp_path), "mssql").cursor()
    tracemalloc.start()
    cursor.execute(families.MSSQL_QUERIES["tables"])
    seen = [0, 0]
    while rows := cursor.fetchmany(500):
        seen = [seen[0] + len(rows), seen[1] + sum(r[2] for r in rows)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [n, n * (n - 1) // 2] and [c[0] for c in cursor.description] == ["schema_name", "table_name", "object_id"]
    assert peak < 4_000_000


def test_a_view_is_asked_for_alone(tmp_path):
    (tmp_path / "view-referenced-columns").mkdir()
    n = 3000
    rows = {"referencing_schema": ["dbo"] * n, "referencing_view": [f"v{i // 2:05d}" for i in range(n)], "referenced_schema": ["dbo"] * n, "referenced_entity": ["t"] * n, "referenced_column": [f"c{i}" for i in range(n)]}
    pq.write_table(pa.table(rows), tmp_path / "view-referenced-columns" / "a.parquet", row_group_size=500)
    cursor = standin.connect(str(tmp_path), "mssql").cursor()
    for view, want in (("v00700", [("dbo", "t", "c1400"), ("dbo", "t", "c1401")]), ("gone", [])):
        cursor.execute(families.mssql_view_columns("dbo", view))
        assert cursor.fetchmany(10) == want
