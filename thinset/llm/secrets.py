"""Secret scan by character Markov models.

Two first-order models over ASCII, one of random strings and one of ordinary
identifiers, are counted from labelled samples; a run of token characters whose mean
log-likelihood ratio exceeds a threshold is reported besides what plain rules find.
Only built-in functions are used: a text is split at the matches of an expression, so
the places come from the lengths of the pieces, and a model is one array of ratios
that is indexed by two neighbouring characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORD = r"(?i:passw|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z][A-Za-z0-9_]{9,}(?![A-Za-z0-9+/_=.-])"
LEAST_VALUE = 12      # characters of an assigned value
LEAST_RUN = 16        # characters of a run or of what plain findings leave of it
THRESHOLD = 0.5       # mean log-likelihood ratio of a character, in nats
KINDS = ("assign", "access", "hex", "random")
CODES = 128
SPAN = "array<struct<start: long, kind: int, end: long, value: string>>"


def places(text: Column, expression: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, value), code points."""
    hits = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(expression), F.lit(group)) if group else hits
    gaps = F.split(text, expression, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gaps"])
        end = begin + F.length(x["hits"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["values"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pieces = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gaps"), hits.alias("hits"), values.alias("values"))
    return F.aggregate(pieces, start, step, lambda s: s["out"])


def _where(text: Column, gate: str, found: Column) -> Column:
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the plain rules: assigned values, access keys, hexadecimal runs."""
    assign = F.filter(places(text, ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    return F.concat(_where(text, KEYWORD, assign), _where(text, "AKIA", places(text, ACCESS, 1)),
                    _where(text, HEX, places(text, HEX, 2)))


def _pairs(samples: DataFrame) -> DataFrame:
    """Counts of neighbouring characters by label; they are combined before the shuffle."""
    chars = F.split(F.col("token"), "")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.concat(
        F.element_at(chars, i), F.element_at(chars, i + 1))))
    return samples.where("length(token) > 1").select("label", pair.alias("pair")).groupBy("label", "pair").agg(
        F.count("*").alias("n"))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of random to ordinary for every two neighbouring ASCII characters.

    ``samples`` has (token, label): 1 a random string, 0 an ordinary identifier.  Counts
    cover all samples; transitions are smoothed by one.  Without samples of one label
    its model is uniform.  Characters above ASCII and null tokens are left out.
    """
    counts = [[[0] * CODES for _ in range(CODES)] for _ in range(2)]
    ascii_only = samples.where(r"token RLIKE '^[\\x00-\\x7F]+$' AND label IN (0, 1)")
    # At most 2 x 128 x 128 rows.
    for label, pair, n in _pairs(ascii_only).collect():
        counts[label][ord(pair[0])][ord(pair[1])] = n
    out = []
    for a in range(CODES):
        ordinary, random = counts[0][a], counts[1][a]
        total = [math.log((sum(row) + CODES) / 1.0) for row in (ordinary, random)]
        out += [math.log(random[b] + 1) - total[1] - math.log(ordinary[b] + 1) + total[0] for b in range(CODES)]
    return out


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log ratio of the transitions of an ASCII token."""
    table = F.array(*[F.lit(round(r, 6)) for r in ratios])
    chars = F.split(token, "")
    codes = F.transform(chars, lambda c: F.ascii(c))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    total = F.aggregate(codes, start, lambda s, c: F.struct(
        c.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(
            F.element_at(table, s["last"] * CODES + c + 1))).alias("sum")), lambda s: s["sum"])
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def labelled_tokens(docs: DataFrame) -> DataFrame:
    """Samples by rule: values of plain findings are random, long plain words ordinary."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    values = F.transform(base_spans(text), lambda s: F.struct(s["value"].alias("token"), F.lit(1).alias("label")))
    words = F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)),
                        lambda w: F.struct(w.alias("token"), F.lit(0).alias("label")))
    words = F.filter(words, lambda w: ~w["token"].rlike("^[0-9a-f]{16,}$") & ~w["token"].rlike("^AKIA"))
    return docs.select(F.inline(F.concat(values, words)))


def free_pieces(base: Column, found: Column) -> Column:
    """What the ``base`` spans leave of the runs ``found``, of LEAST_RUN characters or more.

    One pass over both in order of place: ``at`` is the first character of the open run
    that no span has covered, ``covered`` the end of the spans so far.
    """
    none = F.struct(F.lit(0).cast("long").alias("start"), F.lit(3).alias("kind"),
                    F.lit(0).cast("long").alias("end"), F.lit("").alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("covered"),
                     none.alias("run"), F.array().cast(SPAN).alias("out"))

    def closed(state: Column, end: Column) -> Column:
        run = state["run"]
        piece = F.struct(
            state["at"].alias("start"), F.lit(3).alias("kind"), end.alias("end"),
            F.substring(run["value"], (state["at"] - run["start"] + 1).cast("int"),
                        (end - state["at"]).cast("int")).alias("value"))
        return F.when(end - state["at"] >= LEAST_RUN, F.concat(state["out"], F.array(piece))).otherwise(state["out"])

    def step(state: Column, x: Column) -> Column:
        opens = x["kind"] == 3
        end = F.when(opens, state["run"]["end"]).otherwise(F.least(x["start"], state["run"]["end"]))
        return F.struct(
            F.when(opens, F.greatest(x["start"], state["covered"])).otherwise(
                F.greatest(state["at"], x["end"])).alias("at"),
            F.when(opens, state["covered"]).otherwise(F.greatest(state["covered"], x["end"])).alias("covered"),
            F.when(opens, x).otherwise(state["run"]).alias("run"), closed(state, end).alias("out"))

    return F.aggregate(F.array_sort(F.concat(base, found)), start, step, lambda s: closed(s, s["run"]["end"]))


def find_secrets(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) per row of ``docs`` (doc_id, text, ...).

    Spans are (start, kind, end, value) in order of start, then kind; kinds are indexes
    of KINDS.  A run of token characters, or what plain findings leave of it, is reported
    as random if its mean log ratio is above ``threshold``.  Null and empty texts have no
    spans; texts may have any length; repeated rows give a row each; other columns are
    not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", base_spans(F.col("text")).alias("base"),
        _where(F.col("text"), CANDIDATE, places(F.col("text"), CANDIDATE, 3)).alias("runs"))
    free = F.when((F.size("runs") > 0) & (F.size("base") > 0), free_pieces(F.col("base"), F.col("runs"))).otherwise(F.col("runs"))
    random = F.filter("free", lambda r: mean_ratio(r["value"], ratios) > threshold)
    return rows.select("doc_id", "base", free.alias("free")).select(
        "doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`find_secrets`' spans."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        number(3).alias("n_random"))
