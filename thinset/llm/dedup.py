"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is grouped by digest first
(combined before the shuffle, so a group of copies may hold any share of the rows);
its digests meet the index in a sort-merge anti-join that moves only the batch, and the
ones not yet known are appended.  For a known digest the batch appends how many rows
there are by now, so that counts go on over any number of batches.  Only built-in
functions are used.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinset.llm.tables import if_small, packed, stored, unpacked
from thinset.workspace import new_path

BUCKETS = 256  # a bucket is one task's share of the index: 1 TB of it in parts of 4 GB
_COLUMNS = "digest binary, keep_id long, group_size long, batch string"


def normalised(text: Column) -> Column:
    """A-Z lower-cased; null as empty.  Plain ASCII takes the faster function."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, in a bucketed table at ``path`` (a shared folder)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digests_" + uuid.uuid4().hex
        spark.sql(f"CREATE TABLE {self.name} ({_COLUMNS}) USING parquet CLUSTERED BY (digest) "
                  f"SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        """A row per digest and batch that held it; group_size counts up to that batch."""
        return self.spark.table(self.name)

    def _states(self) -> DataFrame:
        """Per digest its row that stays, the batch that brought it and all rows so far.

        The table is bucketed by digest, so this moves nothing.
        """
        return self.table().groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("seen"),
            F.min_by("batch", "group_size").alias("origin"))

    def ingest(self, docs: DataFrame, batch: str) -> DataFrame:
        """Decide every row of ``docs`` (doc_id, text, ...) and remember what is new.

        (doc_id, keep_id, group_size, kept, text_sha256): of the rows of the batch with
        equal texts the largest doc_id stays; if an earlier batch had the text, its row
        stays and all of these go, and group_size counts the rows of all batches up to
        this one.  Null texts
        equal empty ones.  A null doc_id is smaller than any other and keeps its text
        only among nulls.  Rows that repeat doc_id and text are decided alike.  Other
        columns are not read; texts may have any length; an empty table gives no rows.
        A batch that is ingested again under its name gets the same answer and appends
        nothing, so a job that failed half way may simply run again.
        """
        digests = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                     text_digest(F.col("text")).alias("digest")), "digests")
        groups = stored(digests.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
        index = self.table()
        # What the index says of this batch, if it was ingested before, else of the digest.
        again = index.where(F.col("batch") == batch).select("digest", F.col("group_size").alias("told"))
        known = groups.select("digest", F.col("group_size").alias("more")).hint("merge").join(
            self._states(), "digest").join(again, "digest", "left")
        known = known.select(
            "digest", "keep_id", F.coalesce("told", F.col("seen") + F.col("more")).alias("group_size"),
            (F.col("origin") != batch).alias("older"), F.col("told").isNull().alias("news"))
        fresh = groups.hint("merge").join(index.select("digest"), "digest", "left_anti")
        decided = stored(fresh.withColumns({"older": F.lit(False), "news": F.lit(True)}).unionByName(known), "decided")
        news = decided.where("news").select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        (news.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet")
         .mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path)
         .saveAsTable(self.name))
        return digests.join(decided, "digest").select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("older")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))

    def decisions(self, docs: DataFrame) -> DataFrame:
        """As :meth:`ingest`, by all batches so far; appends nothing.

        A row stays if its doc_id is the one its text is kept under.  Texts that no
        batch held give no row.
        """
        digests = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                     text_digest(F.col("text")).alias("digest")), "digests")
        # Stored, so that both sides are dealt anew and a hot digest can be split.
        return digests.join(stored(self._states(), "states"), "digest").select(
            "doc_id", "keep_id", F.col("seen").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that stay; see :meth:`DigestIndex.ingest`.

    Of rows that repeat both doc_id and text one stays.  Without ``index`` a new one is
    made in the session's shared folder.
    """
    index = index or DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "digest-index"))
    decided = index.ingest(docs, batch)
    decided = decided.groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("kept"), F.count("*").alias("copies"))
    odd = stored(decided.where("NOT kept OR copies > 1").select(
        F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest"), "kept"), "odd")
    rows = packed(docs).select("_row", F.col("_row").getField("doc_id").cast("long").alias("_id"),
                               text_digest(F.col("_row").getField("text")).alias("_digest"))

    def same(right: DataFrame) -> Column:
        return rows["_id"].eqNullSafe(right["_id"]) & (rows["_digest"] == right["_digest"])

    all_odd, repeated = if_small(odd), odd.where("kept")
    stay = rows.join(all_odd, same(all_odd), "left_anti")
    once = rows.join(if_small(repeated), same(repeated), "left_semi").dropDuplicates(["_id", "_digest"])
    return unpacked(stay.select("_row").union(once.select("_row")), docs.columns)
