"""Expressions on numeric arrays (logits, probabilities, embeddings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(values) -> Column:
    col = F.col(values) if isinstance(values, str) else values
    return F.transform(col, lambda x: x.cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, not once per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values) -> Column:
    return F.aggregate(_doubles(values), F.lit(0.0), lambda acc, x: acc + x)


def dot(left, right) -> Column:
    return total(F.zip_with(_doubles(left), _doubles(right), lambda x, y: x * y))


def norm(values) -> Column:
    return F.sqrt(F.aggregate(_doubles(values), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(left, right) -> Column:
    """Cosine similarity; 0 if a vector is zero."""
    return let(
        F.struct(dot(left, right).alias("d"), (norm(left) * norm(right)).alias("n")),
        lambda v: F.when(v["n"] == 0, F.lit(0.0)).otherwise(v["d"] / v["n"]),
    )


def argmax(values) -> Column:
    """0-based place of the largest element, the first of equals."""
    col = F.col(values) if isinstance(values, str) else values
    return (F.array_position(col, F.array_max(col)) - 1).cast("int")


def softmax(values) -> Column:
    doubles = _doubles(values)
    powers = let(
        F.struct(doubles.alias("x"), F.array_max(doubles).alias("top")),
        lambda v: F.transform(v["x"], lambda x: F.exp(x - v["top"])),
    )
    return let(
        let(powers, lambda e: F.struct(e.alias("e"), total(e).alias("sum"))),
        lambda v: F.transform(v["e"], lambda x: x / v["sum"]),
    )


def sigmoid(values) -> Column:
    return F.transform(_doubles(values), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))
