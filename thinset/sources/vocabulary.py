"""Label vocabularies and the label -> index mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import small

# Relation ids; the place in the list is the label index.
RELATION_IDS = [
    "P1001", "P101", "P102", "P105", "P106", "P118", "P123", "P127", "P1303", "P131", "P1344",
    "P1346", "P135", "P136", "P137", "P140", "P1408", "P1411", "P1435", "P150", "P156", "P159",
    "P17", "P175", "P176", "P178", "P1877", "P1923", "P22", "P241", "P264", "P27", "P276",
    "P306", "P31", "P3373", "P3450", "P355", "P39", "P400", "P403", "P407", "P449", "P4552",
    "P460", "P466", "P495", "P527", "P551", "P57", "P58", "P6", "P674", "P706", "P710", "P740",
    "P750", "P800", "P84", "P86", "P931", "P937", "P974", "P991",
]

# BIO tags per domain; the place in the list is the tag index.
BIO_TAGS = {
    "politics": [
        "O", "B-country", "B-politician", "I-politician", "B-election", "I-election",
        "B-person", "I-person", "B-organisation", "I-organisation", "B-location", "B-misc",
        "I-location", "I-country", "I-misc", "B-politicalparty", "I-politicalparty", "B-event",
        "I-event",
    ],
    "science": [
        "O", "B-scientist", "I-scientist", "B-person", "I-person", "B-university",
        "I-university", "B-organisation", "I-organisation", "B-country", "I-country",
        "B-location", "I-location", "B-discipline", "I-discipline", "B-enzyme", "I-enzyme",
        "B-protein", "I-protein", "B-chemicalelement", "I-chemicalelement",
        "B-chemicalcompound", "I-chemicalcompound", "B-astronomicalobject",
        "I-astronomicalobject", "B-academicjournal", "I-academicjournal", "B-event", "I-event",
        "B-theory", "I-theory", "B-award", "I-award", "B-misc", "I-misc",
    ],
    "music": [
        "O", "B-musicgenre", "I-musicgenre", "B-song", "I-song", "B-band", "I-band", "B-album",
        "I-album", "B-musicalartist", "I-musicalartist", "B-musicalinstrument",
        "I-musicalinstrument", "B-award", "I-award", "B-event", "I-event", "B-country",
        "I-country", "B-location", "I-location", "B-organisation", "I-organisation", "B-person",
        "I-person", "B-misc", "I-misc",
    ],
    "literature": [
        "O", "B-book", "I-book", "B-writer", "I-writer", "B-award", "I-award", "B-poem",
        "I-poem", "B-event", "I-event", "B-magazine", "I-magazine", "B-literarygenre",
        "I-literarygenre", "B-country", "I-country", "B-person", "I-person", "B-location",
        "I-location", "B-organisation", "I-organisation", "B-misc", "I-misc",
    ],
    "ai": [
        "O", "B-field", "I-field", "B-task", "I-task", "B-product", "I-product", "B-algorithm",
        "I-algorithm", "B-researcher", "I-researcher", "B-metrics", "I-metrics",
        "B-programlang", "I-programlang", "B-conference", "I-conference", "B-university",
        "I-university", "B-country", "I-country", "B-person", "I-person", "B-organisation",
        "I-organisation", "B-location", "I-location", "B-misc", "I-misc",
    ],
}


def vocabulary(spark: SparkSession, labels: list[str]) -> DataFrame:
    """``(label, idx)`` of an ordered list; a short one is broadcast when joined."""
    return small(spark.createDataFrame(list(zip(labels, range(len(labels)))), "label string, idx int"), len(labels))


def bio_vocabulary(spark: SparkSession) -> DataFrame:
    """``(domain, label, idx)`` of all domains."""
    rows = [(d, tag, i) for d, tags in BIO_TAGS.items() for i, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "domain string, label string, idx int")


def index_labels(
    df: DataFrame, vocab: DataFrame, label_col: str = "label", index_col: str = "label_idx"
) -> DataFrame:
    """Add the vocabulary index of ``label_col``; an unknown label fails the job."""
    known = vocab.select(F.col("label").alias(label_col), F.col("idx").alias("_idx"))
    unknown = F.raise_error(
        F.concat(F.lit("label not in vocabulary: "), F.coalesce(F.col(label_col).cast("string"), F.lit("null")))
    ).cast("int")
    return (
        df.join(known, label_col, "left")
        .withColumn(index_col, F.coalesce(F.col("_idx").cast("int"), unknown))
        .drop("_idx")
    )
