"""Cutting the lineage of long queries through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


@cache
def _stand_in() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lattica-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; the cluster names it in spark.checkpoint.dir.

    Where that is unset and the master is this machine, as in tests, a temporary folder stands in. Elsewhere executors
    would not see one another's files, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'the cluster'} share")
        at = _stand_in()
    return at.rstrip("/")


def staged(df: DataFrame, *partition_by: str, compression: str = "zstd") -> DataFrame:
    """The rows of df, written as a table in the shared folder and read again.

    That cuts the lineage, survives lost executors, is computed once however often it is read, and gives the optimizer
    the true size. The tables stay until discard() or release().
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", compression).partitionBy(*partition_by).parquet(at)
    _written.append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


def large(df: DataFrame) -> DataFrame:
    """A side of a join that can be as large as the graph: it is met by sorting, whatever size is estimated.

    Spark estimates some columns of a file by the widths of their types. Where the other columns are wide and mostly null,
    as payloads are, that gives ids a small part of what they take, and millions of them were gathered by the driver to be
    broadcast.
    """
    return df.hint("merge")


def discard(*frames: DataFrame) -> None:
    """Deletes staged tables whose rows have been read for the last time; other frames are left alone."""
    for df in frames:
        at = getattr(df, "_staged_at", None)
        if at in _written:
            _delete(df.sparkSession, [at])


def mark() -> int:
    """The present state, for release()."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes what this process has staged since a mark; for when no result that rests on it is needed any more."""
    gone = [at for at in _written[since:] if keep is None or at != getattr(keep, "_staged_at", None)]
    return _delete(spark, gone)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """What is staged within is deleted at its end, so results are to be written or collected before.

    A result read later would miss its rows; that is why no operator deletes what its result still rests on.
    """
    since = mark()
    try:
        yield
    finally:
        release(spark, since)


def _delete(spark: SparkSession, gone: list[str]) -> int:
    jvm, conf, n = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), 0
    for at in gone:
        _written.remove(at)
        path = jvm.org.apache.hadoop.fs.Path(at)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
