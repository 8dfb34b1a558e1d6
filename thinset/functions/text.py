"""Text expressions: token lists, entity spans, linearised relation examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed formats: the words around the values have to be exactly these.
CONTEXT_FORMAT = ("Head Entity : ", " , Tail Entity : ", " , Context : ")
TAGGED_FORMAT = (" <head> ", " <tail> ", " <relation> ")
SENTENCE_FORMAT = ("the relation between ", " and ", " is ")
HEAD_MARK = " HEAD ENTITY]"
TAIL_MARK = " TAIL ENTITY]"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fields(text) -> Column:
    """White-space separated pieces of a stripped text; none for a blank one."""
    clean = F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"(?U)\s+"))


def join_tokens(tokens) -> Column:
    return F.array_join(_col(tokens), " ")


def span_text(tokens, indexes) -> Column:
    """Tokens at the given 0-based indexes, joined by a blank; bad indexes fail."""
    tokens, indexes = _col(tokens), _col(indexes)
    picked = F.transform(
        indexes,
        lambda i: F.when((i >= 0) & (i < F.size(tokens)), F.get(tokens, i)).otherwise(
            F.raise_error(F.concat(F.lit("token index out of range: "), i.cast("string")))
        ),
    )
    return F.array_join(picked, " ")


def linearize(context, head, tail) -> Column:
    """``Head Entity : h , Tail Entity : t , Context : c``."""
    first, second, third = CONTEXT_FORMAT
    return F.concat(F.lit(first), _col(head), F.lit(second), _col(tail), F.lit(third), _col(context))


def linearize_tagged(sentence, head, tail, relation) -> Column:
    """``s <head> h <tail> t <relation> r``."""
    first, second, third = TAGGED_FORMAT
    return F.concat(_col(sentence), F.lit(first), _col(head), F.lit(second), _col(tail),
                    F.lit(third), _col(relation))


def relation_sentence(head, tail, relation) -> Column:
    """``the relation between h and t is r``."""
    first, second, third = SENTENCE_FORMAT
    return F.concat(F.lit(first), _col(head), F.lit(second), _col(tail), F.lit(third), _col(relation))


def mark_entities(sentence, head, tail) -> Column:
    """Put ``[h HEAD ENTITY]`` and ``[t TAIL ENTITY]`` around every mention.

    Mentions are literal text.  The original text is cut at the mentions of the head
    and those of the tail are marked in the pieces, so no mark is marked again.  A
    blank mention marks nothing; a null in any argument gives null.
    """
    sentence, head, tail = _col(sentence), _col(head), _col(tail)

    def marked(mention, mark):
        return F.concat(F.lit("["), mention, F.lit(mark))

    def with_tails(piece):
        return F.when(tail == "", piece).otherwise(F.replace(piece, tail, marked(tail, TAIL_MARK)))

    literal = F.concat(F.lit(r"\Q"), F.replace(head, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pieces = F.transform(F.split(sentence, literal, -1), with_tails)
    joined = F.call_function("array_join", pieces, marked(head, HEAD_MARK))
    whole = F.when(head == "", with_tails(sentence)).otherwise(joined)
    return F.when(sentence.isNotNull() & head.isNotNull() & tail.isNotNull(), whole)


def clean_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop rows without text and make the rest strings."""
    return df.dropna(subset=[text_col]).withColumn(text_col, F.col(text_col).cast("string"))
