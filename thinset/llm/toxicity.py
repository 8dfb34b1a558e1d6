"""Class-conditional Kneser-Ney models of the texts labelled toxic and of the others.

Both models have word pairs, whose lower order are continuation counts: in how many
places, told apart by the word before, a class uses a word.  Counts up to DISCOUNT are
no evidence of a class; they go to counts that both classes share.  So what no class has
seen often gets the same probability from both and says nothing, and a pair that says
nothing leaves the word to the shared weight of its history.  The log-likelihood ratio
of a stretch is divided by its length: a text is judged by its strongest word, by its
three strongest and as a whole, and one logistic curve weighs the three.

Text is read as code points in lower case; a word is a run of letters, marks and digits
of any script, signs of scripts written without spaces are words of their own.  A word
is known by 32 bits of its hash; two that share them count as one.  All counts are
shuffled aggregates whose size grows with the text, taken once for two models: without
the texts the curve is fitted on, and with them.  Of the log ratios, the entries that
occur most (at most FREQUENT) are looked up where the text is read; a bitmap tells which
other words may have one, and only those are joined.  Entries are whole multiples of
1 / SCALE, so where they are added changes nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinset.llm.tables import packed, stored, unpacked
from thinset.llm.words import hashes, runs

DISCOUNT = 3.0              # of a count of one class
SHARED = 0.75               # discount of a count of both
MIXED = 50.0                # weight of the shared pair probability among a history's counts
SCALE = 1 << 24
TOP = 3                     # strongest words of a text that count on their own
FREQUENT = 1 << 21          # entries a task holds (12 bytes each); the others are joined
BITMAP = 1 << 27            # bits that tell whether a key may be among the others
BUFFER = 1 << 21            # pairs counted together before they leave a task
SMALL_BYTES = 8 << 20       # a counted table of narrow rows up to this size is broadcast
CALIBRATION_ROWS = 20_000   # labelled rows the logistic curve is fitted on, at most
FOLDS = 5                   # remainder 0 is held out, remainder 4 calibrates, the rest count

_WORD = 0xFFFFFFFF          # in place of a history: the key of a word itself
_START = 0                  # the history of a first word
_ENTRIES = "key long, n long, early long, late long"


def fold(doc_id):
    """crc32 of the id as text, modulo FOLDS; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % FOLDS, F.lit(0))


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Kind (0 between words, 1 part of a word, 2 a word) and lower case of each code point."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] in "LMN":
            kind[point] = 1
            small = char.lower()
            if len(small) == 1:
                lower[point] = ord(small)
    # Thai to Myanmar, Khmer, kana, ideographs
    for first, last in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF),
                        (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        kind[first:last + 1] *= 2
    return kind, lower


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the row offsets among them."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    rows = np.concatenate([[0], np.cumsum(lead)])[offsets]
    body = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    a, b, c, d = (body[at + j] for j in range(4))
    b, c, d = b & 63, c & 63, d & 63
    points = np.select([a < 0x80, a < 0xE0, a < 0xF0],
                       [a, (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)
    return np.minimum(points, 0x10FFFF).astype(np.uint32), rows


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word codes, codes of the words before, word offsets) of runs of texts."""
    kinds, lower = _alphabet()
    for row, data, offsets in runs(column):
        points, at = _points(data, offsets)
        kind = kinds[points]
        points = lower[points]
        before, after = np.zeros(len(kind), np.uint8), np.zeros(len(kind), np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        edge = at[(at > 0) & (at < len(kind))]
        before[edge] = 0
        after[edge - 1] = 0
        starts = np.flatnonzero((kind == 2) | (kind == 1) & (before != 1))
        ends = np.flatnonzero((kind == 2) | (kind == 1) & (after != 1)) + 1
        word = hashes(points, starts, ends) % np.uint64(_WORD - 1) + np.uint64(1)
        cut = np.searchsorted(starts, at)
        history = np.full(len(word), _START, np.uint64)
        history[1:] = word[:-1]
        history[cut[:-1][cut[:-1] < len(word)]] = _START
        yield row, word, history, cut


def _key(history: np.ndarray | int, word: np.ndarray) -> np.ndarray:
    return (np.uint64(history) << np.uint64(32) | word).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word pairs with their kind (twice the part plus the label) and number, many texts together."""
    held: list[list[np.ndarray]] = [[] for _ in range(4)]
    size = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for kind, keys in enumerate(held):
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)],
                                                 ["kind", "key", "n"])
                keys.clear()

    for batch in batches:
        kinds = batch.column(1).to_numpy(zero_copy_only=False)
        for row, word, history, cut in _words(batch.column(0)):
            of = np.repeat(kinds[row:row + len(cut) - 1], np.diff(cut))
            key = _key(history, word)
            for kind in range(4):
                held[kind].append(key[of == kind])
            size += len(key)
            if size >= BUFFER:
                yield from counted()
                size = 0
    yield from counted()


def _small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A stored ``table`` with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(table) if table.count() * row_bytes <= SMALL_BYTES else table


def log_ratios(pairs: DataFrame) -> DataFrame | None:
    """(key, n, early, late): what a word or a pair adds to the log ratio, in both models.

    ``pairs`` has the counts (key, n00, n01, n10, n11), first digit 1 for the late model,
    second the label.  A missing entry adds nothing.  None if a class has no word in the
    early model.
    """
    models = [("0", "early"), ("1", "late")]
    pairs = pairs.withColumns({"history": F.shiftrightunsigned("key", 32), "word": F.col("key").bitwiseAND(F.lit(_WORD))})
    counts = [f"n{m}{c}" for m, _ in models for c in (0, 1)]
    words = stored(pairs.groupBy("word").agg(
        *[F.count_if(F.col(n) > 0).alias(n.replace("n", "k")) for n in counts],
        *[F.count_if(F.col(f"n{m}0") + F.col(f"n{m}1") > 0).alias(f"k{m}") for m, _ in models],
        F.sum(F.col("n10") + F.col("n11")).alias("n")), "words")
    cut = lambda k, d: F.greatest(F.col(k) - F.lit(d), F.lit(0.0))
    of = words.agg(
        *[F.sum(n.replace("n", "k")).alias(n.replace("n", "t")) for n in counts],
        *[F.sum(F.least(F.col(n.replace("n", "k")).cast("double"), F.lit(DISCOUNT))).alias(n.replace("n", "s")) for n in counts],
        *[x for m, _ in models for x in (F.sum(f"k{m}").alias(f"t{m}"), F.count_if(F.col(f"k{m}") > 0).alias(f"v{m}"),
                                         F.sum(F.least(F.col(f"k{m}").cast("double"), F.lit(SHARED))).alias(f"s{m}"))]).first()
    if not (of and of["t00"] and of["t01"]):
        return None
    # Probabilities of a word: shared (p0, p1), and of each class of both models.
    words = words.withColumns({
        f"p{m}": (cut(f"k{m}", SHARED) + of[f"s{m}"] / (of[f"v{m}"] + 1)) / of[f"t{m}"] for m, _ in models})
    words = words.withColumns({
        f"p{m}{c}": (cut(f"k{m}{c}", DISCOUNT) + of[f"s{m}{c}"] * F.col(f"p{m}")) / of[f"t{m}{c}"]
        for m, _ in models for c in (0, 1)})
    often = lambda k: F.greatest(f"{k}0", f"{k}1") > DISCOUNT
    words = words.withColumns({name: F.when(often(f"k{m}"), _fixed(F.col(f"p{m}1"), F.col(f"p{m}0"))).otherwise(0)
                               for m, name in models})
    words = stored(words, "word-ratios")
    # A history's counts, and the share of them that goes on to its shared lower order.
    left = pairs.groupBy("history").agg(
        *[F.sum(n).alias(n.replace("n", "t")) for n in counts],
        *[F.sum(F.least(F.col(n).cast("double"), F.lit(DISCOUNT))).alias(n.replace("n", "s")) for n in counts],
        *[F.sum(F.least((F.col(f"n{m}0") + F.col(f"n{m}1")).cast("double"), F.lit(SHARED))).alias(f"s{m}") for m, _ in models])
    seen = pairs.where(often("n0") | often("n1")).join(_small(stored(left, "histories"), 100), "history").join(
        _small(words.select("word", "p0", "p1", "p00", "p01", "p10", "p11", "early", "late"), 90), "word")
    added = {}
    for m, name in models:
        both, total = F.col(f"n{m}0") + F.col(f"n{m}1"), F.greatest(F.col(f"t{m}0") + F.col(f"t{m}1"), F.lit(1))
        shared = (F.greatest(both - F.lit(SHARED), F.lit(0.0)) + F.col(f"s{m}") * F.col(f"p{m}")) / total
        p = [(cut(f"n{m}{c}", DISCOUNT) + (F.col(f"s{m}{c}") + MIXED) * shared * F.col(f"p{m}{c}") / F.col(f"p{m}")) / (F.col(f"t{m}{c}") + MIXED)
             for c in (0, 1)]
        added[name] = F.when(often(f"n{m}"), _fixed(p[1], p[0]) - F.col(name)).otherwise(0)
    both = seen.select("key", (F.col("n10") + F.col("n11")).alias("n"), *[added[name].alias(name) for _, name in models])
    single = words.select(F.col("word").bitwiseOR(F.lit(-1 << 32)).alias("key"), "n", "early", "late")
    return stored(single.unionByName(both).where("early <> 0 OR late <> 0"), "ratios")


def _fixed(toxic, ordinary):
    return F.round(F.log(toxic / ordinary) * SCALE).cast("long")


class Entries:
    """Entries a task holds, sorted by key, and the bitmap of the others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: np.ndarray | None):
        self.keys, self.values, self.bits = keys, values, bits

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, may be among the others) of keys."""
        value, held = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[at] == key
            value[held] = self.values[at[held]]
        if self.bits is None:
            return value, np.zeros(len(key), bool)
        plain = key.view(np.uint64)
        bit = ((plain >> np.uint64(32)) ^ plain) & np.uint64(BITMAP - 1)
        return value, ~held & ((self.bits[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32)) & 1 > 0)


class Model:
    """Log ratios and calibration; ``rows`` gives the probability of label 1."""

    def __init__(self, ratios: DataFrame | None, weights: np.ndarray | None = None, frequent: int | None = None):
        """``ratios`` has (key, n, value); None stands for a model that says nothing."""
        self.weights, self.others, bits = weights, None, None
        if ratios is None:
            self.entries = Entries(np.zeros(0, np.int64), np.zeros(0, np.int32), None)
            return
        octave = F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int")
        sizes = dict(ratios.groupBy(octave).count().collect())
        least, held = 64, 0
        for k in sorted(sizes, reverse=True):  # how often an entry of this table occurs at least
            if held + sizes[k] > (FREQUENT if frequent is None else frequent):
                break
            least, held = k, held + sizes[k]
        often = ratios.where(octave >= least).select("key", F.col("value").cast("int").alias("value")).toArrow()
        order = np.argsort(often["key"].to_numpy())
        if held < sum(sizes.values()):
            self.others = ratios.where(octave < least).select(F.col("key").alias("entry"), "value")
            bit = F.shiftrightunsigned("entry", 32).bitwiseXOR(F.col("entry")).bitwiseAND(F.lit(BITMAP - 1))
            marks = self.others.groupBy(F.shiftrightunsigned(bit, 5).alias("at")).agg(
                F.bit_or(F.expr("shiftleft(1L, CAST((shiftrightunsigned(entry, 32) ^ entry) & 31 AS INT))")).alias("mark"))
            found = marks.toArrow()  # BITMAP / 32 rows at most
            bits = np.zeros(BITMAP // 32, np.uint32)
            bits[found["at"].to_numpy()] = found["mark"].to_numpy()
        self.entries = Entries(often["key"].to_numpy()[order], often["value"].to_numpy()[order], bits)

    def sums(self, texts: DataFrame) -> DataFrame:
        """(id, text_hash, copies, total, length, top) of the rows (id, text); equal rows are one with its copies.

        ``total`` is the log ratio of the text, ``top`` the TOP largest of its words.
        """
        known = self.entries.find

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(2).to_numpy(zero_copy_only=False)
                for row, word, history, cut in _words(batch.column(1)):
                    rows, ids = len(cut) - 1, batch.column(0).slice(row, len(cut) - 1)
                    of, pair = np.repeat(np.arange(rows), np.diff(cut)), _key(history, word)
                    single = _key(_WORD, word)
                    (value, open1), (more, open2) = known(single), known(pair)
                    value, left = value + more, open1 | open2
                    done = ~left
                    total = np.zeros(rows, np.int64)
                    np.add.at(total, of[done], value[done])
                    order = np.flatnonzero(done)[np.lexsort((-value[done], of[done]))]
                    begin = np.searchsorted(of[order], np.arange(rows + 1))
                    best = order[np.arange(len(order)) - begin[of[order]] < TOP]
                    at = np.searchsorted(of[best], np.arange(rows + 1)).astype(np.int32)
                    none = pa.nulls(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(own[row:row + rows]), none, none, none, pa.array(total), pa.array(np.diff(cut)),
                         pa.ListArray.from_arrays(pa.array(at), pa.array(value[best]))], names)
                    for key, may in ((single, open1), (pair, open2)):
                        at = np.flatnonzero(may)
                        if len(at):  # a place is a pair of the text; both its keys may be open
                            at = at[np.lexsort((pair[at], of[at]))]
                            new = np.ones(len(at), bool)
                            new[1:] = (pair[at][1:] != pair[at][:-1]) | (of[at][1:] != of[at][:-1])
                            n, at = np.diff(np.append(np.flatnonzero(new), len(at))), at[new]
                            yield pa.RecordBatch.from_arrays(
                                [ids.take(pa.array(of[at])), pa.array(own[row:row + rows][of[at]]), pa.array(pair[at]),
                                 pa.array(key[at]), pa.array(n), pa.array(value[at]), pa.nulls(len(at), pa.int64()),
                                 pa.nulls(len(at), pa.list_(pa.int64()))], names)

        names = ["id", "text_hash", "place", "key", "n", "value", "length", "top"]
        found = texts.select("id", "text", F.xxhash64("text", "id").alias("own")).mapInArrow(
            scan, "id long, text_hash long, place long, key long, n long, value long, length long, top array<long>")
        if self.others is None:
            return found.select("id", "text_hash", F.lit(1).cast("long").alias("copies"), F.col("value").alias("total"),
                                "length", "top")
        # Rows of places meet their entries; equal rows of documents have equal places.
        joined = found.join(self.others.withColumnRenamed("value", "more"), F.col("key") == F.col("entry"), "left")
        places = joined.groupBy("id", "text_hash", "place").agg(
            F.max("n").alias("n"), F.max("value").alias("value"), F.collect_set(F.when(F.col("more").isNotNull(), F.struct("key", "more"))).alias("more"),
            F.count("length").alias("copies"), F.max("length").alias("length"), F.max("top").alias("top"))
        value = F.col("value") + F.aggregate("more", F.lit(0).cast("long"), lambda a, x: a + x["more"])
        places = places.select("id", "text_hash", "copies", "length", value.alias("value"), F.coalesce("n", F.lit(1)).alias("n"),
                               F.coalesce("top", F.array_repeat(value, F.least("n", F.lit(TOP)).cast("int"))).alias("top"))
        return places.groupBy("id", "text_hash").agg(
            F.max("copies").alias("copies"), F.sum(F.col("value") * F.col("n")).alias("total"), F.max("length").alias("length"),
            F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, TOP).alias("top"))

    def features(self, texts: DataFrame) -> DataFrame:
        """(id, text_hash, copies, first, strong, whole): log ratios a word of the stretches."""
        part = lambda x, n: x / F.lit(float(SCALE)) / n
        none = F.lit(0).cast("long")
        return self.sums(texts).select(
            "id", "text_hash", "copies",
            part(F.coalesce(F.get("top", F.lit(0)), none), F.lit(1)).alias("first"),
            part(F.aggregate("top", none, lambda a, x: a + x), F.lit(TOP)).alias("strong"),
            part(F.col("total"), F.greatest("length", F.lit(1))).alias("whole"))

    def rows(self, texts: DataFrame) -> DataFrame:
        """(id, text_hash, copies, score) of the rows (id, text)."""
        w = [float(x) for x in self.weights]
        logit = w[0] + w[1] * F.col("first") + w[2] * F.col("strong") + w[3] * F.col("whole")
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
        return self.features(texts).select("id", "text_hash", "copies", score.alias("score"))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by Newton steps, with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def count_pairs(known: DataFrame) -> DataFrame:
    """Counts of word pairs (key, n00, n01, n10, n11) of the rows (text, kind); see :func:`log_ratios`."""
    counted = known.select("text", "kind").mapInArrow(_count, "kind int, key long, n long")
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    return stored(counted.groupBy("key").agg(
        of(0).alias("n00"), of(1).alias("n01"), of(0, 2).alias("n10"), of(1, 3).alias("n11")), "pairs")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the texts of ``docs`` with a label (doc_id, toxic 0/1) in ``labels``.

    Ids of fold 0 are never read.  Counts cover every other labelled text; the curve is
    fitted on at most CALIBRATION_ROWS texts of fold 4 (by hash of the id), scored by
    the counts of the folds before it.  Null ids, labels and labels other than 0 and 1
    are left out; contradictory labels of an id count once each.  Without labels of
    both classes every text gets the score of the label's share (0.5 without labels).
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label"))
    marks = marks.where("id IS NOT NULL AND label IN (0, 1)").withColumn("fold", fold("id")).where("fold <> 0").distinct()
    marks = stored(marks, "labels")
    texts = _texts(docs)
    kind = F.when(F.col("fold") == FOLDS - 1, 2).otherwise(0) + F.col("label")
    ratios = log_ratios(count_pairs(texts.join(_small(marks, 24), "id").select("text", kind.alias("kind"))))
    sample = marks.where(F.col("fold") == FOLDS - 1).orderBy(F.xxhash64("id"), "id", "label").limit(CALIBRATION_ROWS)
    fitted = None
    if ratios is not None:
        sample = F.broadcast(sample.select("id", "label"))  # CALIBRATION_ROWS narrow rows at most
        early = Model(ratios.where("early <> 0").select("key", "n", F.col("early").alias("value")))
        found = early.features(texts.join(sample.select("id").distinct(), "id", "left_semi")).join(sample, "id")
        fitted = found.select("first", "strong", "whole", "label", "copies").toArrow()
        fitted = np.stack([c.to_numpy() for c in fitted.columns], axis=1).astype(float)
        fitted = np.repeat(fitted, fitted[:, 4].astype(int), axis=0)
        fitted = fitted[np.lexsort(fitted.T)]
        del early
    if fitted is None or len(np.unique(fitted[:, 3])) < 2:
        share = marks.agg(F.avg("label")).first()[0]
        share = 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)
        return Model(None, np.array([np.log(share / (1 - share)), 0, 0, 0]))
    weights = _logistic(fitted[:, :3], fitted[:, 3])
    return Model(ratios.where("late <> 0").select("key", "n", F.col("late").alias("value")), weights)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; see :func:`train`.

    Empty and null texts have a score too; repeated rows are scored each; other columns
    are not read; an empty table gives no rows.
    """
    scored = train(docs, labels).rows(_texts(docs)).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return scored.select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), (fold("id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, floor: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that score below ``floor``."""
    scored = train(docs, labels).rows(_texts(docs)).where(F.col("score") >= floor)
    gone = stored(scored.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")), "toxic")
    doc_id = F.col("_row").getField("doc_id").cast("long")
    own = F.xxhash64(F.col("_row").getField("text").cast("string"), doc_id)
    same = (own == F.col("_hash")) & doc_id.eqNullSafe(F.col("_id"))
    return unpacked(packed(docs).join(_small(gone, 16), same, "left_anti"), docs.columns)
