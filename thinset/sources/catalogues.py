"""Prompt catalogues: small text files with fixed line roles, read as tables."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import dealt

# Files that one task writes.
PART_FILES = 2000

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed formats: line heads of the catalogue files.
RELATION = r"(?m)^Relation: (.*)$"
DEFINITION = r"(?m)^Relation Definition: (.*)$"
PAIR = r"(?m)^Head Entity: (.*); Tail Entity: (.+)$"
SENTENCE = r"(?m)^Sentence: (.+)$"
COUNT_AND_DOMAIN = r"(?m)^Generate (\d+) different (.*?)(?: entities)? in the (.*) domain"
NUMBERED = r"(?m)^\d+\. (.*)$"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(
        F.regexp_replace("value", "\r\n", "\n").alias("value"),
        F.regexp_extract("_metadata.file_path", r"([^/]+)/*$", 1).alias("file"),
        F.col("_metadata.file_path").alias("path"),
    )


def _found(pattern: str, group: int = 1):
    hit = F.trim(F.regexp_extract("value", pattern, group))
    return F.when(hit != "", hit)


def _file_task(path: str):
    """Rows sorted by id: a file for each id, its texts line by line; the ids that were written."""

    def write(batches):
        store, root = fs.FileSystem.from_uri(path)
        name, out = None, None
        try:
            for batch in batches:
                made = []
                for pid, value in zip(*(batch.column(c).to_pylist() for c in ("pid", "value"))):
                    if pid != name:
                        if out is not None:
                            out.close()
                        name, out = pid, store.open_output_stream(f"{root}/prompt_{pid}.txt")
                        made.append(pid)
                    out.write(((value or "") + "\n").encode())
                yield pa.record_batch([pa.array(made, pa.string())], ["pid"])
        finally:
            if out is not None:
                out.close()

    return write


def write_prompt_files(texts: DataFrame, path: str) -> int:
    """Write ``(pid, value)`` as one file ``prompt_<pid>.txt`` per id into the new folder
    ``path``, which Arrow can open; return their number.  Rows without an id are left out.

    A bounded number of files a task: Spark's own writer makes a folder for each id, and
    adaptive execution gives so few bytes to one task.  A task that is run again writes
    the same files again.
    """
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    rows = texts.select("pid", "value").filter(F.col("pid").isNotNull())
    rows = dealt(rows, "pid", PART_FILES).sortWithinPartitions("pid")
    return rows.mapInArrow(_file_task(path), "pid string").count()


def read_relation_catalogue(
    spark: SparkSession, path: str, id_pattern: str = r"_(P\d+)\.txt$"
) -> DataFrame:
    """One row per relation id: name, definition, example pair, example sentence.

    The definition file and the sentence file of a relation share the id in
    their path and are folded into one row.
    """
    files = _whole(spark, path).withColumn("pid", F.regexp_extract("path", id_pattern, 1))
    pieces = files.filter("pid <> ''").select(
        "pid",
        _found(RELATION).alias("name"),
        _found(DEFINITION).alias("definition"),
        _found(PAIR, 1).alias("example_head"),
        _found(PAIR, 2).alias("example_tail"),
        _found(SENTENCE).alias("example_sentence"),
    )
    return pieces.groupBy("pid").agg(
        *[F.max(name).alias(name) for name in pieces.columns if name != "pid"]
    )


def read_relation_definitions(spark: SparkSession, path: str) -> DataFrame:
    """``(name, definition)`` of a list of name and definition lines."""
    pair = r"(?m)^Relation: (.*)\nRelation Definition: (.*)$"
    hits = _whole(spark, path).select(F.explode(F.regexp_extract_all("value", F.lit(pair), 0)).alias("value"))
    return hits.select(
        _found(RELATION).alias("name"), _found(DEFINITION).alias("definition")
    )


def read_entity_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per listed example of an entity type:
    ``entity, definition, examples, wanted, domain, place, example``."""
    text = _whole(spark, path)
    lines = F.split("value", "\n")
    head = F.regexp_extract("value", COUNT_AND_DOMAIN, 2)
    rows = text.filter(head != "").select(
        F.trim(head).alias("entity"),
        F.trim(F.get(lines, F.lit(0))).alias("definition"),
        F.trim(F.regexp_replace(F.get(lines, F.lit(1)), r"^\w+: ", "")).alias("examples"),
        _found(COUNT_AND_DOMAIN, 1).cast("int").alias("wanted"),
        _found(COUNT_AND_DOMAIN, 3).alias("domain"),
        F.posexplode_outer(F.regexp_extract_all("value", F.lit(NUMBERED), 1)).alias("place", "example"),
    )
    return rows.withColumn("place", F.col("place") + 1).withColumn("example", F.trim("example"))
