"""Best documents for each item by impact scores, with no random access (NRA).

Documents are counted once: each becomes a row of its number of terms and the counts of
the terms that any item asks for.  A task then takes bounded shards of documents, lays
the postings of every term out by falling impact, and answers each item on each shard:
rounds of sequential reads give every document a lower bound (impacts read so far) and
an upper one (plus the last impact read from each list it was not met in).  Reading goes
on until no document unseen or outside the best can reach them, ties included, and the
bounds of every document that can have met.  The bar an item has reached in earlier
shards of the task holds in later ones.  The best of the tasks are merged.

A term is compared by the 64-bit hash of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thinset.llm.tables import stored
from thinset.llm.words import ALNUM, bounds, hashes, runs
from thinset.workspace import new_path

BEST = 10                  # documents of an item
BLOCK_BYTES = 8 << 20      # item texts answered by one pass over the documents
SHARD_POSTINGS = 1 << 20   # postings laid out at a time, if more than one document
SHARD_DOCS = 1 << 14
FIRST_READ = 32            # postings read from each list in the first round
HITS = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                    ("tfs", pa.list_(pa.int64()))])


def weight(total: int, df: int) -> int:
    """Weight of a term that ``df`` of ``total`` documents hold."""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def _hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, term hashes, terms before each row) of runs of rows."""
    for row, data, offsets in runs(column):
        starts, ends, before = bounds(data, offsets, ALNUM)
        yield row, hashes(data, starts, ends), before


class Items:
    """A block of items: ids, and for each the numbers of its distinct terms."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [item for item, _ in rows]
        texts: list[np.ndarray] = []
        for _, terms, before in _hashed(pa.array([text for _, text in rows], pa.large_string())):
            texts += [np.unique(terms[a:b]) for a, b in zip(before[:-1], before[1:])]
        self.terms = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint64)
        self.asked = [np.searchsorted(self.terms, text) for text in texts]


def _count(terms: np.ndarray):
    """Rows of documents to the number of terms and the counts of those asked for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found, before in _hashed(batch.column(1)):
                rows = len(before) - 1
                doc = np.repeat(np.arange(rows), np.diff(before))
                place = np.minimum(np.searchsorted(terms, found), max(0, len(terms) - 1))
                known = terms[place] == found if len(terms) else np.zeros(len(found), bool)
                pair, tf = np.unique(doc[known] * max(1, len(terms)) + place[known], return_counts=True)
                at = np.searchsorted(pair, np.arange(rows + 1) * max(1, len(terms))).astype(np.int32)
                out = pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, rows), pa.array(np.diff(before).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array((pair % max(1, len(terms))).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(tf.astype(np.int64)))], schema=COUNTS)
                yield out.filter(pa.array(np.diff(before) > 0))

    return count


class Shard:
    """Postings of a bounded number of documents, by term and falling impact.

    ``ids`` ascend, nulls last, so a document's place settles ties.
    """

    def __init__(self, ids: list, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, width: int):
        order = np.lexsort((docs, -impacts, terms))
        self.ids, self.docs, self.impacts = ids, docs[order], impacts[order]
        self.at = np.searchsorted(terms[order], np.arange(width + 1))

    def best(self, asked: np.ndarray, count: int, bar: int) -> list[tuple[int, int]]:
        """(place, score) of the ``count`` best documents of at least ``bar`` points."""
        lists = [(int(self.at[t]), int(self.at[t + 1])) for t in asked]
        lists = [(a, b) for a, b in lists if b > a and self.impacts[a] > 0]
        lower = np.zeros(len(self.ids), np.int64)
        edge = np.array([self.impacts[a] for a, _ in lists], np.int64)  # what an unread posting gives at most
        read, step = 0, FIRST_READ
        while True:
            for i, (a, b) in enumerate(lists):
                part = slice(min(a + read, b), min(a + read + step, b))
                lower[self.docs[part]] += self.impacts[part]  # a list holds a document once
                edge[i] = self.impacts[part.stop - 1] if part.stop < b else 0
            read, step = read + step, step * 2
            reached = max(bar, 1, int(np.partition(lower, -count)[-count]) if len(lower) >= count else 0)
            if int(edge.sum()) >= reached:
                continue  # a document not met at all could still be among the best
            open_lists = np.full(len(self.ids), edge.sum())
            for i in np.flatnonzero(edge):
                a, b = lists[i]
                open_lists[self.docs[a:min(a + read, b)]] -= edge[i]
            met = np.flatnonzero(lower)
            upper = lower[met] + open_lists[met]
            hope = upper >= reached
            if (upper[hope] == lower[met][hope]).all():
                found = met[lower[met] >= reached]
                return [(int(d), int(lower[d])) for d in found[np.lexsort((found, -lower[found]))][:count]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in pieces of a bounded number of postings and documents."""
    held, size = [], [0, 0]
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy()
        row = 0
        while row < batch.num_rows:
            room = int(np.searchsorted(ends, ends[row] + SHARD_POSTINGS - size[0], "right")) - 1
            upto = min(max(room, row + (not held)), row + SHARD_DOCS - size[1], batch.num_rows)
            if upto > row:
                held.append(batch.slice(row, upto - row))
                size = [size[0] + int(ends[upto] - ends[row]), size[1] + upto - row]
            row = upto
            if row < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], [0, 0]
    if held:
        yield pa.Table.from_batches(held)


def _answer(ids: list[int], asked: list[np.ndarray], weights: np.ndarray, total: int, length: int, count: int):
    """The best documents of each item among the rows of a task."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in ids]
        for part in _shards(batches):
            part = part.sort_by([("doc_id", "ascending")]).combine_chunks()
            n = part.column("n").to_numpy()
            lists = part.column("terms").combine_chunks()
            terms = lists.flatten().to_numpy()
            docs = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            tfs = part.column("tfs").combine_chunks().flatten().to_numpy()
            m = 10 + 90 * n * total // length
            impacts = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[docs]))
            names = part.column("doc_id").to_pylist()
            shard = Shard(names, terms, docs, impacts, len(weights))
            for i, wanted in enumerate(asked):
                bar = -best[i][-1][0] if len(best[i]) == count else 0
                for place, score in shard.best(wanted, count, bar):
                    best[i].append((-score, names[place] is None, names[place] or 0))
                best[i] = sorted(best[i])[:count]
        hits = [(ids[i], None if none else doc, -score) for i, rows in enumerate(best) for score, none, doc in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*hits) if hits else ([], [], []))],
                                         schema=HITS)

    return answer


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, texts of one item_id together."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    for block in range(count := -(-total // BLOCK_BYTES)):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == block)
        found: dict[int, str] = {}
        for item, text in part.orderBy("item_id", "text").collect():
            found[item] = f"{found[item]} {text}" if item in found else text
        yield sorted(found.items())


def _rank_block(docs: DataFrame, rows: list[tuple[int, str]], count: int) -> DataFrame:
    items = Items(rows)
    counted = stored(docs.mapInArrow(_count(items.terms), "doc_id long, n long, terms array<int>, tfs array<long>"),
                     "term-counts")
    total, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(items.terms), np.int64)  # bounded by the block, as are the rows below
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = weight(total, df)
    hits = counted.mapInArrow(_answer(items.ids, items.asked, weights, total, length, count),
                              "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, count: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``count`` best documents of each item.

    Every document counts, each row by itself, also if it repeats a doc_id; of equal
    scores the smaller doc_id goes first, null last.  Null and empty texts have no
    terms.  The texts of an item_id that occurs more than once ask together; items
    without id or terms, and those no document scores on, have no rows.  Texts may be of
    any length; other columns are not looked at.  Items go through in blocks of bounded
    size, each with a pass over the documents of its own.
    """
    spark: SparkSession = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = new_path(spark, "ranked")
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    empty.write.parquet(path)
    for rows in _blocks(items):
        _rank_block(narrow, rows, count).write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)
