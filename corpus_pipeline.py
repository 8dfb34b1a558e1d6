"""Documents to a training mix: toxicity, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, all columns
unchanged; the last returns the mix, a row per copy with its moment of the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinset.llm import decontaminate, dedup, jaccard, mixing, toxicity
from thinset.llm.tables import if_small, packed, stored, unpacked


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a probability below one half; null and empty texts are scored too."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null texts equal empty ones."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id.

    Documents without words or id link with nothing and stay; rows that repeat the
    doc_id that stays all stay.
    """
    found = jaccard.jaccard_components(docs)
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    rows = packed(docs)
    same = F.col("_row").getField("doc_id").cast("long") == F.col("_id")
    return unpacked(rows.join(if_small(gone), same, "left_anti"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the weights 1, 2, 3, repeating, sorted by moment."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

# The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents below ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
