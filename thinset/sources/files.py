"""Labelled-text sources.  Canonical columns: ``row_id, sentence, label``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import fields, linearize, span_text
from ..workspace import small, with_position
from .vocabulary import RELATION_IDS, index_labels, vocabulary

# A row's place in its files: stable, and known without a pass over the data.
FILE_ORDER = ["_file", "_block", "_line"]
# Lines whose blank ones are counted together.
RUN_LINES = 1 << 16


class SourceError(ValueError):
    """A source is missing, empty or lacks a required column."""


def _with_file_place(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def _numbered(df: DataFrame) -> DataFrame:
    """Dense ``row_id`` in file order, without moving the rows.

    Rows are counted per piece of a file first; a row's number is its place in
    its piece plus the rows of the pieces before.  Both scans belong to one query
    and cut the files alike.
    """
    pieces = df.groupBy("_file", "_block").agg(
        F.count("*").alias("_rows"), F.min("_line").alias("_from")
    )
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "_file", "_block",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_from")).alias("_shift"),
    )
    # Bound on the number of pieces: every file and every cut starts one.
    bound = len(df.inputFiles()) + df.rdd.getNumPartitions()
    numbered = df.join(small(starts, bound), ["_file", "_block"])
    row_id = (F.col("_line") + F.col("_shift")).alias("row_id")
    return numbered.select(row_id, *[c for c in df.columns if c not in FILE_ORDER])


def require_columns(df: DataFrame, names: list[str], what: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise SourceError(f"{what}: column {missing[0]!r} not found")


def read_labelled_csv(
    spark: SparkSession, path: str, text_col: str, label_col: str, sep: str = ",",
    encoding: str = "utf-8", limit: int | None = None, quoted: bool = True,
    multiline: bool = False, label_type: str | None = None,
) -> DataFrame:
    """Text and label columns of delimited files with a header line.

    Only the two columns are parsed.  Quoted fields may hold line breaks if
    ``multiline`` is set, at the price of files that cannot be split.  Without a
    ``label_type`` the labels are looked through: whole numbers become ``int`` (of up to
    nine digits) or ``long``, decimal numbers ``double``, anything else stays a string.
    """
    options = {"header": True, "sep": sep, "encoding": encoding, "escape": '"',
               "multiLine": multiline}
    if not quoted:
        options["quote"] = ""
    try:
        frame = spark.read.options(**options).csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise SourceError(f"file not found: {path}") from error
        raise
    if not frame.columns:
        raise SourceError(f"file is empty: {path}")
    require_columns(frame, [text_col, label_col], path)
    # By name only: with the whole header read, column pruning does the rest.
    kept = _with_file_place(frame).select(
        F.col(text_col).alias("sentence"), F.col(label_col).alias("label"), *FILE_ORDER
    )
    rows = _numbered(kept)
    if limit is not None:
        rows = rows.filter(F.col("row_id") < limit)
    if label_type is None:
        label_type = _label_type(kept if limit is None else rows)
    if label_type == "string":
        return rows
    return rows.withColumn("label", F.trim("label").cast(label_type))


# The first pattern that all labels fit gives their type.
LABEL_TYPES = {
    "int": r"^\s*[+-]?\d{1,9}\s*$", "long": r"^\s*[+-]?\d{1,18}\s*$",
    "double": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$",
}


def _label_type(rows: DataFrame) -> str:
    """Type of the labels, from one pass over their column."""
    odd = [F.count_if(~F.col("label").rlike(fits)).alias(name) for name, fits in LABEL_TYPES.items()]
    found = rows.agg(*odd).first()
    return next((name for name in LABEL_TYPES if not found[name]), "string")


def load_sst2(spark: SparkSession, folder: str, test_folder: str | None = None):
    """``train.tsv`` and ``test.tsv`` with columns ``sentence`` and ``label``."""
    def split(where, name):
        return read_labelled_csv(spark, f"{where}/{name}", "sentence", "label", sep="\t")

    return split(folder, "train.tsv"), split(test_folder or folder, "test.tsv")


def load_custom_csv(spark: SparkSession, config: dict):
    """Delimited files named by ``config``: ``train_path``, ``text_col`` and
    ``label_col`` are required; ``test_path`` is optional and may be unreadable."""
    absent = [key for key in ("train_path", "text_col", "label_col") if not config.get(key)]
    if absent:
        raise SourceError(f"missing configuration: {', '.join(absent)}")

    def split(path, limit):
        return read_labelled_csv(
            spark, path, config["text_col"], config["label_col"], config.get("separator", ","),
            config.get("encoding", "utf-8"), limit, multiline=config.get("multiline", True),
            label_type=config.get("label_type"),
        )

    train = split(config["train_path"], config.get("nrows_train"))
    test = None
    if config.get("test_path"):
        try:
            test = split(config["test_path"], config.get("nrows_test"))
        except SourceError as error:
            print(f"warning: test data not loaded: {error}")
    return train, test


# A mention is [name, id, [[token indexes], ...]]; Spark keeps the mixed parts as text.
SAMPLE = T.StructType([
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("h", T.ArrayType(T.StringType())),
    T.StructField("t", T.ArrayType(T.StringType())),
])


def relation_examples(samples: DataFrame, sample_col: str = "sample") -> DataFrame:
    """Add ``sentence`` (linearised) for samples of ``{tokens, h, t}``."""
    def mention(which):
        where = F.from_json(F.get(F.col(f"{sample_col}.{which}"), F.lit(2)), "array<array<int>>")
        return span_text(F.col(f"{sample_col}.tokens"), F.get(where, F.lit(0)))

    context = F.array_join(F.col(f"{sample_col}.tokens"), " ")
    return samples.withColumn("sentence", linearize(context, mention("h"), mention("t")))


def load_fewrel(
    spark: SparkSession, path: str, lines: bool = False, labels: list[str] | None = None
) -> DataFrame:
    """Relation samples ``{relation id: [sample, ...]}`` as linearised sentences.

    A file is one JSON object, or with ``lines`` one object per line, which lets
    Spark split big files.
    """
    text = spark.read.text(path) if lines else spark.read.text(path, wholetext=True)
    listed = _with_file_place(text).select(
        F.from_json("value", T.MapType(T.StringType(), T.ArrayType(SAMPLE)),
                    {"mode": "FAILFAST"}).alias("m"),
        *FILE_ORDER,
    ).filter(F.col("m").isNotNull())
    one = listed.select(*FILE_ORDER, F.posexplode(F.map_entries("m")).alias("_key", "e")).select(
        *FILE_ORDER, "_key", F.col("e.key").alias("relation"),
        F.posexplode("e.value").alias("_item", "sample"),
    )
    known = vocabulary(spark, labels or RELATION_IDS)
    rows = index_labels(relation_examples(one), known, "relation", "label")
    order = [*FILE_ORDER, "_key", "_item"]
    return with_position(
        rows.select(*order, "sentence", "label"), order, "row_id"
    ).select("row_id", "sentence", "label")


def _bio_lines(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """Lines with the number of blank lines before them, counted across files.

    Blank lines are counted per run of ``RUN_LINES`` lines of a file block first, so the
    running count never sees more than one run at a time, and no task has to hold a
    block.  The end of a file ends its sentence.
    """
    lines = _with_file_place(spark.read.text(path)).select(
        *FILE_ORDER, F.expr(f"_line div {RUN_LINES}").alias("_run"), fields("value").alias("parts")
    )
    lines = lines.withColumn("_blank", (F.size("parts") == 0).cast("long"))
    runs = lines.groupBy("_file", "_block", "_run").agg(F.sum("_blank").alias("_blanks"))
    # A name is longer than a line: a run goes by its number from here on.
    order = Window.orderBy("_file", "_block", "_run")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    next_file = (F.lag("_file").over(order) != F.col("_file")).cast("long")
    starts = (
        runs.withColumn("_turn", F.coalesce(next_file, F.lit(0)))
        .withColumn("_start", F.coalesce(F.sum("_blanks").over(earlier), F.lit(0))
                    + F.sum("_turn").over(order))
        .withColumn("_at", F.row_number().over(order))
        .select("_file", "_block", "_run", "_start", "_at")
    )
    bad = F.raise_error(F.concat(F.lit("expected a token and a tag: "), F.array_join("parts", " ")))
    parts = F.col("parts")
    if strict:
        parts = F.when(F.size("parts") == 2, parts).otherwise(bad.cast("array<string>"))
    # Every piece of a file and every RUN_LINES lines start a run: few beside the pieces.
    bound = len(lines.inputFiles()) + lines.rdd.getNumPartitions()
    placed = lines.join(small(starts, bound), ["_file", "_block", "_run"]).select(
        "_at", "_line", "_start", "_blank",
        F.when(F.col("_blank") == 0, F.get(parts, F.lit(0))).alias("token"),
        F.when(F.col("_blank") == 0, F.get(parts, F.lit(1))).alias("tag"),
    )
    inside = Window.partitionBy("_at").orderBy("_line")
    return (
        placed.withColumn("_before", F.sum("_blank").over(inside))
        .filter("_blank = 0")
        .select("_at", "_line", (F.col("_start") + F.col("_before")).alias("sentence_id"), "token", "tag")
    )


def load_bio_tokens(
    spark: SparkSession, path: str, id_offset: int = 0, strict: bool = True
) -> DataFrame:
    """One row per token: ``sentence_id, token_pos, sentence`` (the token), ``label``.

    Every blank line raises the sentence id by one, as does the next file.
    """
    lines = _bio_lines(spark, path, strict)
    place = F.row_number().over(Window.partitionBy("sentence_id").orderBy("_at", "_line")) - 1
    return lines.select(
        (F.col("sentence_id") + id_offset).alias("sentence_id"), place.alias("token_pos"),
        F.col("token").alias("sentence"), F.col("tag").alias("label"),
    )


def load_bio_sentences(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row per sentence: ``row_id, sentence``, and a null ``label``."""
    tokens = load_bio_tokens(spark, path, 0, strict)
    joined = tokens.groupBy("sentence_id").agg(
        F.sort_array(F.collect_list(F.struct("token_pos", "sentence"))).alias("_t")
    )
    rows = joined.select(
        "sentence_id", F.array_join(F.col("_t.sentence"), " ").alias("sentence")
    )
    # Only the ids are sorted; the sentences lie by id already.
    dense = with_position(tokens.select("sentence_id").distinct(), ["sentence_id"], "row_id")
    return rows.join(dense, "sentence_id").select("row_id", "sentence", F.lit(None).cast("string").alias("label"))


def load_crossner(
    spark: SparkSession, folder: str, test_folder: str | None = None, sentences: bool = True,
    dev_offset: int | None = None,
):
    """``train.txt`` with ``dev.txt`` appended, and ``test.txt``.

    ``dev_offset`` shifts the sentence ids of the dev part; by default they go
    on after the training part.
    """
    test = f"{test_folder or folder}/test.txt"
    parts = [f"{folder}/train.txt", f"{folder}/dev.txt"]
    if sentences:
        train, dev = (load_bio_sentences(spark, part) for part in parts)
        shift = train.agg(F.coalesce(F.max("row_id") + 1, F.lit(0))).first()[0]
        dev = dev.withColumn("row_id", F.col("row_id") + shift)
        return train.unionByName(dev), load_bio_sentences(spark, test)
    train = load_bio_tokens(spark, parts[0])
    if dev_offset is None:
        dev_offset = train.agg(F.coalesce(F.max("sentence_id") + 1, F.lit(0))).first()[0]
    return (
        train.unionByName(load_bio_tokens(spark, parts[1], dev_offset)),
        load_bio_tokens(spark, test),
    )


@dataclass
class LoadedDataset:
    """Train and (optional) test table of a named data set."""

    train: DataFrame
    test: DataFrame | None
    num_labels: int


def load_dataset(spark: SparkSession, name: str, config: dict) -> LoadedDataset:
    """Load a data set by name: ``custom_csv``, ``sst2``, ``fewrel``, ``crossner``."""
    def folders():
        if not config.get("train_path"):
            raise SourceError("missing configuration: train_path")
        return config["train_path"], config.get("test_path") or config["train_path"]

    def fewrel():
        train, test = folders()
        lines = config.get("lines", False)
        return (load_fewrel(spark, f"{train}/train.json", lines),
                load_fewrel(spark, f"{test}/test.json", lines))

    loaders = {
        "custom_csv": lambda: load_custom_csv(spark, config),
        "sst2": lambda: load_sst2(spark, *folders()),
        "fewrel": fewrel,
        "crossner": lambda: load_crossner(
            spark, *folders(), sentences=config.get("sentences", True),
            dev_offset=config.get("dev_offset"),
        ),
    }
    if name not in loaders:
        raise SourceError(f"unknown data set {name!r}; known: {', '.join(loaders)}")
    train, test = loaders[name]()
    require_columns(train, ["sentence", "label"], name)
    found = train.agg(F.count_distinct("label")).first()[0]
    return LoadedDataset(train, test, found)
