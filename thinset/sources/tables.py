"""Stored rankings, selections and embeddings, and the result sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def write_ranking(ranking: DataFrame, path: str) -> None:
    """Store ``(method, rank, row_id)``, one folder per method, ordered by rank."""
    (
        ranking.select("method", F.col("rank").cast("long"), F.col("row_id").cast("long"))
        .repartitionByRange("method", "rank").sortWithinPartitions("method", "rank")
        .write.partitionBy("method").mode("append").parquet(path)
    )


def read_ranking(spark: SparkSession, path: str, method: str = "aum") -> DataFrame:
    """``(rank, row_id)`` of one method: only its folder is read, and a filter on
    ``rank`` skips row groups because the files are sorted by it."""
    stored = spark.read.schema("rank long, row_id long, method string").parquet(path)
    return stored.filter(F.col("method") == method).select("rank", "row_id")


def write_selection(selection: DataFrame, path: str) -> None:
    """Store ``(method, k, row_id)``, one folder per method and size."""
    (
        selection.select("method", F.col("k").cast("int"), F.col("row_id").cast("long"))
        .write.partitionBy("method", "k").mode("append").parquet(path)
    )


def read_selection(spark: SparkSession, path: str, method: str, k: int) -> DataFrame:
    """``row_id`` of one stored selection; other folders are not touched."""
    stored = spark.read.schema("row_id long, method string, k int").parquet(path)
    return stored.filter((F.col("method") == method) & (F.col("k") == k)).select("row_id")


def read_embeddings(
    spark: SparkSession, path: str, id_col: str = "row_id", vec_col: str = "embedding"
) -> DataFrame:
    return spark.read.parquet(path).select(id_col, vec_col)


def predictions_path(input_path: str, folder: str) -> str:
    """Default output name: ``<folder>/<input name>_predictions.csv``."""
    stem = os.path.splitext(os.path.basename(input_path.rstrip("/")))[0]
    return f"{folder.rstrip('/')}/{stem}_predictions.csv"


def write_predictions(df: DataFrame, path: str) -> None:
    """Input columns and ``predicted_label`` as CSV with header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sweep(df: DataFrame, path: str) -> None:
    """Sweep rows, one folder per data set and method."""
    df.write.mode("append").partitionBy("dataset", "method").parquet(path)
