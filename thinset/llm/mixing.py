"""Time-varying curriculum over sources.

Every source has a weight schedule, a piecewise linear density over the training run
[0, 1].  Its integral is the source's share of the words; the share times all words is
its target, cut where the source would be read more often than allowed (the excess goes
to the others by weight).  A source reads its documents in a fixed shuffled order, as
often as its target needs; the place of a document's middle in that stream is a
cumulative demand, and the inverse of the integrated schedule gives the moment of the
run at which it is due.  The mix is the range-sorted list of these moments.

The order inside a source comes from md5 of the id.  Running sums are taken in hash
buckets: sizes of buckets are combined before the shuffle and summed by source, and
only rows of one bucket meet in a task, so a source may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thinset.llm.tables import packed, unpacked

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3       # times a document may be read
DIGITS = 3        # hex digits of a bucket: 4096 buckets a source
# Weight schedules as (moment, density) knots; their integrals are the weights 1, 2, 3.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (0.5, 3.0), (1.0, 4.5)))

Schedule = tuple[tuple[float, float], ...]


def integral(schedule: Schedule) -> float:
    return sum((t2 - t1) * (r1 + r2) / 2 for (t1, r1), (t2, r2) in zip(schedule, schedule[1:]))


def moment(schedule: Schedule, share: Column) -> Column:
    """The moment by which ``share`` (0 to 1) of the schedule's integral is reached."""
    total, done, out = integral(schedule), 0.0, F.lit(schedule[-1][0])
    steps = []
    for (t1, r1), (t2, r2) in zip(schedule, schedule[1:]):
        steps.append((done, t1, r1, t2, r2))
        done += (t2 - t1) * (r1 + r2) / 2
    for done, t1, r1, t2, r2 in reversed(steps):
        rest = share * total - done  # demand inside this piece
        slope = (r2 - r1) / (t2 - t1)
        root = F.sqrt(F.greatest(F.lit(r1 * r1) + 2 * slope * rest, F.lit(0.0)))
        inside = t1 + 2 * rest / F.greatest(r1 + root, F.lit(1e-12))
        out = F.when(share * total <= done + (t2 - t1) * (r1 + r2) / 2, inside).otherwise(out)
    return F.greatest(F.lit(schedule[0][0]), F.least(F.lit(schedule[-1][0]), out))


def targets(sizes: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, turn, target) from (source, source_size).

    Sources by code point, null last, take the schedules in turn.  Targets share all
    words by weight, none above ``repeats`` times its source; what that cuts off goes to
    the others by weight.  The sources that stop are those with the least limit per
    unit of weight, so one pass over them in that order finds the level of the others.
    """
    weights = F.array(*[F.lit(float(integral(s))) for s in schedules])
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    rows = sizes.withColumn("turn", ((F.row_number().over(by_name) - 1) % len(schedules)).cast("int"))
    rows = rows.withColumn("weight", F.element_at(weights, F.col("turn") + 1))
    rows = rows.withColumn("limit", F.col("source_size").cast("double") * repeats)
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("level", rest / F.sum("weight").over(after))
    # The first source that its level does not stop sets the level for all after it.
    free = F.min(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct(
        (F.col("limit") / F.col("weight")).alias("at"), F.col("level")))).over(everything)
    rows = rows.withColumn("common", free["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("common") * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", "turn", target.alias("target"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _planned(rows: DataFrame, schedules: tuple[Schedule, ...], repeats: int) -> DataFrame:
    """Rows (_row, size) with their place in their source and the copies taken."""
    rows = rows.select(
        "_row", "size", F.col("_row").getField("source").cast("string").alias("source"),
        F.md5(F.coalesce(F.col("_row").getField("doc_id").cast("string"), F.lit("")).cast("binary")).alias("lot"))
    # Null and any text are told apart by the first letter of the key.
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = rows.withColumn("bucket", F.substring("lot", 1, DIGITS))
    parts = rows.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("part"))
    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), schedules, repeats)
    goals = goals.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    starts = parts.select("key", "bucket", F.coalesce(F.sum("part").over(running), F.lit(0)).alias("begin"))
    starts = starts.join(goals, "key")
    inside = Window.partitionBy("key", "bucket").orderBy("lot", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(starts, ["key", "bucket"])
    rows = rows.withColumn("middle", F.col("begin") + F.coalesce(F.sum("size").over(inside), F.lit(0))
                           + F.col("size") / 2)
    copies = F.when(F.col("source_size") > 0, F.ceil((F.col("target") - F.col("middle")) / F.col("source_size")))
    copies = F.greatest(F.lit(0), F.least(F.lit(repeats), F.coalesce(copies, F.lit(0))))
    return rows.withColumn("copies", copies.cast("int"))


def _moments(rows: DataFrame, schedules: tuple[Schedule, ...], copy: Column) -> Column:
    share = (copy * F.col("source_size") + F.col("middle")) / F.col("target")
    out = moment(schedules[0], share)
    for turn, schedule in enumerate(schedules[1:], 1):
        out = F.when(F.col("turn") == turn, moment(schedule, share)).otherwise(out)
    return out


def plan_mix(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source), sorted by first moment.

    (doc_id, source, size, source_size, target, taken, moments): size in words, the
    source's size and target, words taken with repeats, and the moments of the run at
    which its copies are due (empty: not taken).  A null text has no words; a null
    source is a source; a null id is shuffled as an empty one; equal ids of a source
    stand together, smaller first, and are read each.  A source without words has
    target 0 and is not taken.  Texts may have any length; an empty table gives no rows.
    """
    narrow = docs.select(F.struct("doc_id", "source").alias("_row"), _size(F.col("text")).alias("size"))
    rows = _planned(narrow, schedules, repeats)
    copies = [F.when(F.col("copies") > c, _moments(rows, schedules, F.lit(c))) for c in range(repeats)]
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), "source", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), F.array_compact(F.array(*copies)).alias("moments"),
    ).orderBy(F.element_at(F.concat("moments", F.array(F.lit(2.0))), 1), "doc_id")


def mix_sources(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: all columns of ``docs``, ``copy`` and ``moment``, sorted by moment.

    A document taken k times gives k rows, copies 0 to k-1.  Columns of ``docs`` named
    copy or moment are replaced.  See :func:`plan_mix` for nulls, ties and empty tables.
    """
    sized = packed(docs).withColumn("size", _size(F.col("_row").getField("text")))
    rows = _planned(sized, schedules, repeats).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("moment", _moments(rows, schedules, F.col("copy")))
    return unpacked(rows, docs.columns, "copy", "moment").orderBy(
        "moment", *[F.col(c) for c in ("doc_id", "copy") if c in docs.columns or c == "copy"])
