"""Every query with SQL gives what DuckDB gives on the same tables; the library works without its optional subpackage."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry_module

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).parent.parent

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(frame):
    def plain(x):
        if isinstance(x, float):
            return "null" if math.isnan(x) else f"{x:.9g}"
        return "null" if x is None or x is pd.NA else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    own, theirs = entry_module.queries()[name](spark, DATA).toPandas(), con.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(theirs.columns)
    assert rows(own) == rows(theirs)


@needs_data
def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "lattica", tmp_path / "lattica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, left = done.stdout.split(" ", 1)
    assert int(n) >= 40 and left.strip() == "[]"
    if os.path.isdir(DATA):
        run = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()
print('rows', [e.queries()[q](spark, {DATA!r}).count() for q in ('node_ids', 'fk_edges', 'upsert')], e.entry(spark).count())
"""
        done = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert done.returncode == 0 and "rows [" in done.stdout, done.stderr


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "lattica").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "lattica").parts:
            assert "lattica.llm" not in path.read_text()
