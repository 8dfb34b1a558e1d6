"""Stored intermediate tables and size-checked broadcasts.

Tables go to the folder the session names in ``spark.checkpoint.dir``: Parquet keeps
column pruning, cuts the lineage and outlives a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinset.workspace import new_path

# A counted table of narrow rows up to this size (about 16 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it; else Spark shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send at most ``rows`` rows to Python at a time.

    A batch is held on both sides, and in whole texts its bytes grow with its rows.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had, now = spark.conf.get(key, None), int(spark.conf.get(key))
    spark.conf.set(key, str(rows if now <= 0 else min(rows, now)))
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, had)


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``_row``, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The original ``columns`` out of ``_row``; a new column replaces its namesake."""
    kept = [F.col("_row").getField(c).alias(c) for c in columns if c not in more]
    return df.select(*kept, *more)
