"""Scores of predictions against gold labels, spans and tuples.

Everything derives from one confusion table (``groupBy(gold, pred).count()``),
which is combined map-side and as small as the label set squared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import dealt, save


def ratio(top, bottom) -> Column:
    """Quotient as double, 0 where the divisor is 0."""
    top, bottom = (F.col(x) if isinstance(x, str) else x for x in (top, bottom))
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _f1(precision, recall) -> Column:
    return ratio(2 * F.col(precision) * F.col(recall), F.col(precision) + F.col(recall))


def confusion(df: DataFrame, gold: str = "label", pred: str = "prediction") -> DataFrame:
    """``(gold, pred, n)``; labels are compared as strings."""
    return df.groupBy(
        F.col(gold).cast("string").alias("gold"), F.col(pred).cast("string").alias("pred")
    ).agg(F.count("*").alias("n"))


def align(gold: DataFrame, predicted: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Gold rows with their predictions, by id."""
    return gold.join(predicted, id_col)


def class_scores(table: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class in gold or predictions."""
    sides = table.select(
        F.explode(F.array(
            F.struct(F.col("gold").alias("class"), F.col("n").alias("support"),
                     F.lit(0).cast("long").alias("claimed"),
                     F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"),
                     F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hits")),
        )).alias("_s")
    ).select("_s.*")
    summed = sides.groupBy("class").agg(
        *[F.sum(name).alias(name) for name in ("support", "claimed", "hits")]
    )
    return (
        summed.withColumn("precision", ratio("hits", "claimed"))
        .withColumn("recall", ratio("hits", "support"))
        .withColumn("f1", _f1("precision", "recall"))
        .select("class", "precision", "recall", "f1", "support", "hits")
    )


def classification_report(
    df: DataFrame, gold: str = "label", pred: str = "prediction"
) -> DataFrame:
    """``(class, precision, recall, f1, support)`` with the rows ``accuracy``,
    ``macro avg`` and ``weighted avg`` after the classes."""
    per_class = class_scores(save(confusion(df, gold, pred)))
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = ratio(F.sum("hits"), total)
    means = per_class.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(s) for s in scores],
                     total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(s).alias(s) for s in scores],
                     total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"),
                     *[ratio(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
                     total.alias("support")),
        ).alias("_m")
    ).select(F.explode("_m").alias("_m")).select("_m.*")
    return per_class.drop("hits").unionByName(means)


def accuracy(table: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    return table.agg(ratio(hit, F.sum("n")).alias("value"))


def binary_f1(table: DataFrame, positive: str = "1") -> DataFrame:
    def part(test):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    gold, pred = F.col("gold") == positive, F.col("pred") == positive
    hits = part(gold & pred)
    return table.agg(ratio(2 * hits, part(gold) + part(pred)).alias("value"))


def evaluate(
    df: DataFrame, metrics: dict[str, Callable[[DataFrame], DataFrame]],
    gold: str = "label", pred: str = "prediction",
) -> DataFrame:
    """``(metric, value)`` for named functions from confusion table to one value."""
    table = save(confusion(df, gold, pred))
    result = None
    for name, function in metrics.items():
        row = function(table).select(F.lit(name).alias("metric"), "value")
        result = row if result is None else result.unionByName(row)
    return result


def bio_spans(
    tokens: DataFrame, tag: str = "label", sentence: str = "sentence_id", place: str = "token_pos"
) -> DataFrame:
    """Entity spans ``(sentence_id, start, end, type)`` of BIO tags, ends included.

    ``B-x`` opens a span; ``I-x`` continues a span of the same type that ends at
    the token before and otherwise opens one; anything else closes.
    """
    tokens = dealt(tokens.select(sentence, place, tag), sentence)
    order = Window.partitionBy(sentence).orderBy(place)
    kind = F.substring(tag, 3, 2**31 - 1)
    inside = F.col(tag).rlike("^[BI]-")
    marked = tokens.select(
        sentence, place, F.col(tag).alias("_tag"), F.when(inside, kind).alias("type")
    ).withColumn("_last", F.lag("type").over(order))
    opens = F.col("type").isNotNull() & (
        F.col("_tag").startswith("B-") | ~F.col("type").eqNullSafe(F.col("_last"))
    )
    return (
        marked.withColumn("_span", F.sum(opens.cast("int")).over(order))
        .filter(F.col("type").isNotNull())
        .groupBy(F.col(sentence).alias("sentence_id"), "_span")
        .agg(F.min(place).alias("start"), F.max(place).alias("end"), F.first("type").alias("type"))
        .drop("_span")
    )


def set_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of exact matches between two sets of key tuples.

    Both sides are tagged, united and aggregated by key: copies fold map-side
    before the shuffle, and no join is needed.
    """
    def side(df, g, p):
        return df.select(*keys, F.lit(g).alias("_g"), F.lit(p).alias("_p"))

    seen = side(gold, 1, 0).unionByName(side(predicted, 0, 1)).groupBy(*keys).agg(
        F.max("_g").alias("_g"), F.max("_p").alias("_p")
    )
    counts = seen.agg(
        F.coalesce(F.sum("_g"), F.lit(0)).alias("gold"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.col("_g") * F.col("_p")), F.lit(0)).alias("matched"),
    )
    return (
        counts.withColumn("precision", ratio("matched", "predicted"))
        .withColumn("recall", ratio("matched", "gold"))
        .withColumn("f1", _f1("precision", "recall"))
    )


def entity_scores(gold: DataFrame, predicted: DataFrame, **columns) -> DataFrame:
    """Span-level scores of two BIO-tagged token tables."""
    return set_scores(
        bio_spans(gold, **columns), bio_spans(predicted, **columns),
        ["sentence_id", "start", "end", "type"],
    )


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def count_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and distinct labels (nulls do not count as a label)."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(label).alias("n_labels"))
