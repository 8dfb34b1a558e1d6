"""Durable intermediate results for iterative operators.

Every result an iteration builds on is checkpointed to the folder the session
names in ``spark.checkpoint.dir``.  The lineage stays one step long and the
files outlive any executor, so a lost executor costs a task, not the rounds
before it.  Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have
Spark remove the files once nothing refers to them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A table of at most this many narrow rows may be broadcast (a few MB).
SMALL_ROWS = 200_000
PART_ROWS = 1_000_000  # narrow rows that one task sorts
ROW_BITS = 33  # monotonically_increasing_id: partition number above, row below


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the session's, or a new one in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="thinset-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """Unused path below the shared folder, for tables written as files."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def save_measured(df: DataFrame, **measures) -> tuple[DataFrame, dict]:
    """As :func:`save`, with aggregates taken in the same job (no extra scan)."""
    seen = Observation()
    shared_folder(df.sparkSession)
    saved = df.observe(seen, *[col.alias(key) for key, col in measures.items()]).checkpoint()
    return saved, seen.get


def save_packed(df: DataFrame, name: str = "packed") -> DataFrame:
    """As :func:`save`, for tables of many narrow rows: compressed columns, read one by one."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_packed_measured(df: DataFrame, **measures) -> tuple[DataFrame, dict]:
    """As :func:`save_packed`, with aggregates taken in the same job."""
    seen = Observation()
    saved = save_packed(df.observe(seen, *[col.alias(key) for key, col in measures.items()]))
    return saved, seen.get


def save_ranged(df: DataFrame, by: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet sorted by ``by``.

    Files and row groups hold disjoint ranges of it, so that a reader that asks for a
    range opens only those that can hold it.
    """
    path = new_path(df.sparkSession, "ranged")
    df.repartitionByRange(by).sortWithinPartitions(by).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` in the next join if its counted size allows it."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores if the input has fewer pieces than there are cores.

    For work that costs far more than moving its rows; big inputs stay put.  Meant
    for plain scans and saved tables, whose number of pieces is known for free.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, part_rows: int | None = None) -> DataFrame:
    """Deal rows by ``key`` into parts of about ``part_rows`` (``PART_ROWS``) rows.

    For windows over keys of few rows: what a task sorts stays the same however big the
    table is.  Shuffled bytes say little about it, as tokens pack into a few bytes each.
    """
    spark = df.sparkSession
    parts = -(-df.count() // (part_rows or PART_ROWS))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, min(most, spark.sparkContext.defaultParallelism)), key)


def with_position(df: DataFrame, order: list, name: str, rows: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2, ... by ``order`` without one global window.

    A distributed sort is written once with each row's place inside its range;
    the number is that place plus the sizes of the ranges before.  Only the table
    of range sizes (one row per partition) meets in one task.  ``order`` has to
    be a total order.  A table counted as small (``rows``) is simply ranked.
    """
    if rows is not None and rows <= SMALL_ROWS:
        place = F.row_number().over(Window.orderBy(*order)) - 1
        return df.withColumn(name, place.cast("long"))
    placed = save(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    place = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    # ``starts`` has one row per partition of the sort.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + place).cast("long"))
        .drop("_part", "_at", "_start")
    )
