"""A table of hostile documents, with column names that operators use inside, and SQL run on such tables."""

import random

import duckdb

from tests.test_queries import rows

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, id LONG, w DOUBLE, rep STRING, rank INT, __x0 STRING"


def hostile(texts, langs=None):
    """Rows of DOCS for (doc_id, text) pairs."""
    return [(i, t, None if langs is None else langs[k], "s", None if t is None else len(t), -1, 0.5, "x", 7, "y") for k, (i, t) in enumerate(texts)]


def words(seed, n):
    rng = random.Random(seed)
    parts = ["ba", "ko", "li", "mu", "ne", "ro", "sta", "tri", "vu", "zé"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(seed, n):
    return " ".join(words(seed, n))


def same_as_sql(spark, tmp_path, own, sql, **tables):
    """The frame has the rows that DuckDB gives for the tables."""
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    theirs = con.execute(sql).df()
    own = own.toPandas()
    assert sorted(own.columns) == sorted(theirs.columns)
    assert rows(own) == rows(theirs)
