"""Exact-size samplers.

All of them are deterministic in (seed, id): a row's lot is
``md5("<seed>:<id>")`` and the lowest lots win, so the outcome is the same for
any partitioning and any engine.  ``DataFrame.sample`` would give a random size.

How the k lowest lots are found at scale: the lots are counted by their first
four hex digits (at most 65,536 counters per stratum, combined map-side), the
running total names the one bucket in which the k-th lot lies, only that bucket
(1/65,536 of the rows) is ranked, and its k-th row becomes the cut-off.  The wide
rows are then merely filtered against the cut-off; they are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import save, save_measured, small

EXACT = "decimal(38,0)"


def lot(seed, id_col: str) -> Column:
    """Hex lot of a row; ties (equal ids) cannot occur for a unique id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _drawn(df: DataFrame, seed, id_col: str, strata: list[Column]) -> DataFrame:
    ticket = lot(seed, id_col)
    return df.select(
        *[col.alias(f"_s{i}") for i, col in enumerate(strata)],
        ticket.alias("_lot"),
        F.col(id_col).alias("_id"),
        F.conv(F.substring(ticket, 1, 4), 16, 10).cast("int").alias("_bucket"),
    )


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on ``names``: a null label is a stratum of its own."""
    test = F.lit(True)
    for name in names:
        test = test & left[name].eqNullSafe(right[name])
    return test


def stratum_quotas(sizes: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Largest-remainder shares of ``k``: floor first, left-over seats by remainder.

    ``sizes`` has one row per stratum (columns ``keys`` and ``_n``).  All
    arithmetic is on whole numbers; equal remainders go to the smaller label.
    """
    whole = Window.partitionBy()
    total = F.sum("_n").over(whole).cast(EXACT)
    share = (F.lit(k).cast(EXACT) * F.col("_n").cast(EXACT)).cast(EXACT)
    split = sizes.withColumn("_total", total).withColumn("_share", share)
    split = split.withColumn("_base", F.expr("cast(_share div _total as bigint)")).withColumn(
        "_rest", F.col("_share") % F.col("_total")
    )
    seats = F.lit(k) - F.sum("_base").over(whole)
    by_rest = Window.orderBy(F.col("_rest").desc(), *[F.col(key).asc() for key in keys])
    return (
        split.withColumn("_seats", seats)
        .withColumn("_turn", F.row_number().over(by_rest))
        .select(
            *keys,
            "_n",
            F.least(
                F.col("_n"), F.col("_base") + (F.col("_turn") <= F.col("_seats")).cast("long")
            ).alias("_quota"),
        )
    )


def _mark_lowest(
    df: DataFrame, k: int, seed, id_col: str, strata: list[Column], mark: str
) -> DataFrame:
    """Add boolean column ``mark``: true on the rows whose lots win.

    The counters and the cut-offs are written and counted before they are used:
    the wide rows meet them in a broadcast join while there are few strata, and
    in a shuffled join should there be very many.
    """
    keys = [f"_s{i}" for i in range(len(strata))]
    drawn = _drawn(df, seed, id_col, strata)
    counted = save(drawn.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c")))
    running = Window.partitionBy(*keys).orderBy("_bucket")
    totals = counted.withColumn("_upto", F.sum("_c").over(running))
    if keys:
        sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
        quotas, seen = save_measured(stratum_quotas(sizes, k, keys), rows=F.count("*"))
        strata_count = seen["rows"]
        quotas = small(quotas, strata_count)
        totals = totals.alias("t").join(quotas.alias("q"), _same(totals, quotas, keys)).select(
            "t.*", "q._quota"
        )
    else:
        strata_count = 1
        totals = totals.withColumn("_quota", F.lit(k).cast("long"))
    split_bucket = small(
        totals.filter(
            (F.col("_upto") - F.col("_c") < F.col("_quota")) & (F.col("_upto") >= F.col("_quota"))
        ).select(*keys, "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_c")).alias("_room")),
        strata_count,  # one bucket per stratum at most
    )
    near = drawn.alias("d").join(
        split_bucket.alias("b"), _same(drawn, split_bucket, [*keys, "_bucket"])
    ).select("d.*", "b._room")
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_lot", "_id"))
    cut = (
        near.withColumn("_place", place)
        .filter(F.col("_place") == F.col("_room"))
        .select(*keys, F.col("_lot").alias("_cut_lot"), F.col("_id").alias("_cut_id"))
    )
    ticket = lot(seed, id_col)
    if not keys:
        last = cut.first()
        if last is None:  # the whole table fits into k, or k is zero
            return df.withColumn(mark, F.lit(k > 0))
        won = (ticket < last["_cut_lot"]) | (
            (ticket == last["_cut_lot"]) & (F.col(id_col) <= F.lit(last["_cut_id"]))
        )
        return df.withColumn(mark, won)
    limits = save(
        quotas.alias("q")
        .join(cut.alias("c"), _same(quotas, cut, keys), "left")
        .select(*[F.col(f"q.{key}").alias(key) for key in keys], "_quota", "_cut_lot", "_cut_id")
    )
    keyed = df.select("*", *[col.alias(key) for col, key in zip(strata, keys)], ticket.alias("_lot"))
    below = (F.col("_lot") < F.col("_cut_lot")) | (
        (F.col("_lot") == F.col("_cut_lot")) & (F.col(id_col) <= F.col("_cut_id"))
    )
    won = (F.col("_quota") > 0) & (F.col("_cut_lot").isNull() | below)
    return (
        keyed.alias("r")
        .join(small(limits, strata_count).alias("l"), _same(keyed, limits, keys))
        .select(*[F.col(f"r.{name}") for name in df.columns], won.alias(mark))
    )


def sample_random(df: DataFrame, k: int, seed=42, id_col: str = "row_id") -> DataFrame:
    """Exactly ``min(k, n)`` rows without replacement."""
    return _mark_lowest(df, k, seed, id_col, [], "_won").filter("_won").drop("_won")


def sample_stratified(
    df: DataFrame, k: int, label_col: str = "label", seed=42, id_col: str = "row_id"
) -> DataFrame:
    """Exactly ``min(k, n)`` rows that keep the label shares (largest remainder)."""
    marked = _mark_lowest(df, k, seed, id_col, [F.col(label_col)], "_won")
    return marked.filter("_won").drop("_won")


def sample_groups(df: DataFrame, k: int, group_col: str, seed=42) -> DataFrame:
    """All rows of ``k`` randomly chosen groups (for example sentences of tokens)."""
    groups = save(df.select(group_col).distinct())
    return df.join(small(sample_random(groups, k, seed, group_col), k), group_col, "left_semi")


def sample_score(
    df: DataFrame, k: int, ranking: DataFrame, id_col: str = "row_id"
) -> DataFrame:
    """Rows holding the first ``k`` places (0-based ``rank``) of a stored ranking.

    A ranking shorter than ``k`` yields fewer rows, but asking for more rows than
    the table has returns the table, as for every sampler.
    """
    if k > df.count():
        return df
    best = ranking.filter(F.col("rank") < k).select(F.col("row_id").alias(id_col))
    return df.join(small(best, k), id_col, "left_semi")


def sample_selection(df: DataFrame, selection: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Replay a stored selection: rows whose id is listed in column ``row_id``."""
    return df.join(selection.select(F.col("row_id").alias(id_col)), id_col, "left_semi")


def mark_holdout(
    df: DataFrame, fraction: float = 0.1, seed=42, id_col: str = "row_id",
    stratify: str | None = None, mark: str = "is_holdout", n: int | None = None,
) -> DataFrame:
    """Flag ``ceil(fraction * n)`` rows for validation, optionally per label."""
    from decimal import ROUND_CEILING, Decimal

    n = df.count() if n is None else n
    size = int((Decimal(str(fraction)) * n).to_integral_value(ROUND_CEILING))
    strata = [F.col(stratify)] if stratify else []
    return _mark_lowest(df, size, seed, id_col, strata, mark)


def holdout_split(
    df: DataFrame, fraction: float = 0.1, seed=42, id_col: str = "row_id",
    stratify: str | None = None, min_rows: int = 11,
) -> tuple[DataFrame, DataFrame | None]:
    """Split into (train, held out); tables below ``min_rows`` stay whole."""
    n = df.count()
    if n < min_rows:
        return df, None
    marked = mark_holdout(df, fraction, seed, id_col, stratify, "_held", n)
    return marked.filter(~F.col("_held")).drop("_held"), marked.filter("_held").drop("_held")


def shuffle_rows(df: DataFrame, seed=42, id_col: str = "row_id") -> DataFrame:
    """Whole table in seeded random order (a range-partitioned sort by lot)."""
    return df.orderBy(lot(seed, id_col), F.col(id_col))
