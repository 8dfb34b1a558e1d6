"""Size-aware heavy-light Jaccard join on word shingles.

Sets of few shingles enumerate subsets: two sets of sizes a <= b link exactly if they
share a subset of c = ceil(t(a+b)/(1+t)) shingles, so each writes its c-subsets under a
key (a, b, subset) and a shared key is a link without any further test.  Larger sets
scan inverted lists: in one total order of all shingles two linked sets share one
among their first n - ceil(tn) + 1.  The boundary between the two is the size with the
least estimated cost, from counts over all small sets.

* Sets that are equal collapse to one class before anything is joined.
* The order puts frequent shingles last, so passages that many documents share leave
  the inverted lists.  Any order gives the same result; this one only needs a bounded
  list of frequent shingles.
* A first pass verifies each set against the most central holder of each of its
  least shingles and joins what links.  In the inverted lists only sets of *different*
  components can still add anything, so a list inside one component is dropped and no
  group of near copies is ever expanded into its pairs.
* Before the lists are joined, sets that stayed outside a group they belong to are tried
  against the most central holders of its long lists, in turns: else each of them would
  meet the whole group.  A turn's pairs are bounded by its postings; it only adds links
  that hold, so the result is that of the join alone.
* The first shingle a linked pair shares stands so early in both sets that the overlap
  it needs is still ahead: before n/7 in the smaller, n/4 in the larger.  Lists are
  joined on these two parts only, and with the exact place for the sizes of the pair.
* A posting carries the open shingles just before it in its set.  A pair that shares one
  of them has been met there, so a pair is mostly met once and not once a shared shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thinset.llm.components import components
from thinset.llm.tables import arrow_rows, if_small, stored
from thinset.llm.words import mix, shingle_sets

SIZE = 5            # words in a shingle
PERCENT = 75        # least similarity, in hundredths
MOST_LIGHT = 14     # largest set for which subsets are considered
MINIMA = 8          # least shingles used in the first pass
SHARED = 3          # of them that a pair of the first pass shares
LOCAL = 3           # a shingle is a candidate for "frequent" from so many sets of a run
RUN = 4_000_000     # shingles in such a run
FREQUENT = 1 << 18  # most frequent shingles that the order knows of
VERIFY = 60.0       # cost of verifying a pair, in posting rows
BLOCK_SHINGLES = 1 << 18  # of the sets of a block whose pairs are verified together
MARKS = 256         # parities of a set's shingles by hash, at least; else four to eight a shingle
LONG = 32           # a list of more holders is gathered before it is joined
CLASSES = 4         # central holders that such a list offers to each size class in a turn
TRIED = 8           # pairs that a set tries in a turn
TURNS = 6           # at most; each has to take a quarter of the pairs that are left
BEFORE = 3          # earlier shingles of its set that a posting carries
BATCH_ROWS = 1024   # rows of whole texts that a task holds at a time


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    """Sizes a set of size n can be linked with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of size n that have to be looked up."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _scan(size: int, most_light: int):
    """Per text: set size, digest, least shingles, marks; per run of texts: frequent shingles."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()),
                        ("least", pa.list_(pa.int64())), ("marks", pa.binary()), ("shingle", pa.int64()),
                        ("seen", pa.int64())])

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        token, seen = np.unique(np.concatenate(held), return_counts=True)
        token, seen = token[seen >= LOCAL], seen[seen >= LOCAL]
        none = [None] * len(token)
        return pa.record_batch([pa.array(none, f.type) for f in list(schema)[:5]]
                               + [pa.array(_signed(token)), pa.array(seen)], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            ns, sigs, least, marks = [], [], [], []
            for tokens in shingle_sets(batch.column(1), size):
                ns.append(len(tokens))
                sigs.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                least.append(_signed(tokens[:len(tokens) if len(tokens) <= most_light else MINIMA]))
                bits = max(MARKS, 1 << (4 * len(tokens) - 1).bit_length() if len(tokens) else 0)
                odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                marks.append(np.packbits(odd.astype(np.uint8)).tobytes())
                held.append(tokens)
            none = pa.nulls(len(ns), pa.int64())
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(ns, pa.int64()),
                                   pa.array(sigs, pa.binary()), pa.array(least, pa.list_(pa.int64())),
                                   pa.array(marks, pa.binary()), none, none], schema)
            if sum(map(len, held)) >= RUN:
                yield frequent(held)
                held = []
        if held:
            yield frequent(held)

    return scan, "id long, n long, sig binary, least array<long>, marks binary, shingle long, seen long"


def _frequent(scanned: DataFrame) -> np.ndarray:
    """At most FREQUENT shingles, the most frequent last, as a bounded list."""
    counts = scanned.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    steps = (counts.groupBy(F.floor(F.log2("seen") * 4).alias("step")).agg(F.count("*").alias("c"))
             .orderBy(F.desc("step")).collect())
    kept, floor = 0, None
    for step, c in steps:
        if kept + c > FREQUENT:
            break
        kept, floor = kept + c, step
    if floor is None:
        return np.zeros(0, np.int64)
    rows = counts.where(F.floor(F.log2("seen") * 4) >= floor).orderBy("seen", "shingle")
    return rows.select("shingle").toArrow()["shingle"].to_numpy()  # 8 bytes a row, no Python objects


def _prefixes(frequent: np.ndarray, size: int, percent: int, boundary: int):
    """Per text that takes part in the inverted lists: its looked-up shingles.

    A frequent shingle is marked, as its list may be long.
    """
    by_value = np.argsort(frequent)
    known = frequent[by_value]
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()),
                        ("rare", pa.list_(pa.int64())), ("often", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, ns, sigs, rare, often = [], [], [], [], []
            for row, tokens in enumerate(shingle_sets(batch.column(1), size)):
                n = len(tokens)
                if not n or partners(n, percent)[-1] <= boundary:
                    continue
                signed = _signed(tokens)
                at = np.searchsorted(known, signed) if len(known) else np.zeros(n, np.int64)
                at = np.minimum(at, max(0, len(known) - 1))
                hit = known[at] == signed if len(known) else np.zeros(n, bool)
                plain, take = signed[~hit], prefix(n, percent)
                ranks = np.sort(by_value[at[hit]]) if hit.any() else by_value[:0]
                heavy = frequent[ranks]
                keep.append(row)
                ns.append(n)
                sigs.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                rare.append(plain[:take])
                often.append(heavy[:max(0, take - len(plain))])
            ids = batch.column(0).cast(pa.int64()).take(pa.array(keep, pa.int64()))
            yield pa.record_batch([ids, pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()),
                                   pa.array(rare, pa.list_(pa.int64())),
                                   pa.array(often, pa.list_(pa.int64()))], schema)

    return scan, "id long, n long, sig binary, rare array<long>, often array<long>"


def _subsets(boundary: int, percent: int):
    """Keys (a, b, subset) of the small sets."""
    names = ["low", "high", "subset", "subset2", "id", "n"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "least"))):
                tokens = np.sort(np.array(tokens, np.int64).view(np.uint64))
                halves = mix(tokens), mix(~tokens)  # 128 bits name a subset
                made: dict[int, list[np.ndarray]] = {}
                for other in partners(n, percent):
                    if other > boundary:
                        continue
                    c = needed(n, other, percent)
                    if c > min(n, other):
                        continue
                    if c not in made:
                        chosen = np.array(list(combinations(range(n), c)))
                        made[c] = [_signed(h[chosen].sum(axis=1, dtype=np.uint64)) for h in halves]
                    low, high, node_, n_ = (np.full(len(made[c][0]), v, np.int64)
                                            for v in (min(n, other), max(n, other), node, n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (low, high, *made[c], node_, n_)], names)

    return scan, "low long, high long, subset long, subset2 long, id long, n long"


def choose_boundary(nodes: DataFrame, percent: int = PERCENT, most: int = MOST_LIGHT) -> int:
    """Largest size of a light set: least cost of enumeration plus list scans.

    Counts of small sets and of the pairs their lists would give come from two grouped
    passes over all sets of at most ``most`` shingles; ``most``+1 numbers reach the driver.
    """
    small = nodes.where(F.col("n").between(1, most))
    counts = dict(small.groupBy("n").agg(F.count("*")).collect())
    if not counts:
        return 0
    token = small.select("n", F.explode("least").alias("shingle"))
    held = [F.sum((F.col("n") == k).cast("long")).alias(f"f{k}") for k in range(1, most + 1)]
    lists = token.groupBy("shingle").agg(*held)
    pairs = [F.sum(F.col(f"f{k}").cast("double")
                   * sum((F.col(f"f{j}") for j in partners(k, percent) if 1 <= j <= k), F.lit(0)))
             .alias(f"p{k}") for k in range(1, most + 1)]
    met = lists.agg(*pairs).first()
    best, boundary = None, 0
    for x in range(most + 1):
        cost = 0.0
        for n, c in counts.items():
            if n <= x:
                cost += c * sum(comb(n, needed(n, b, percent)) for b in partners(n, percent) if b <= x)
            if n > x:
                cost += VERIFY * (met[f"p{n}"] or 0) / 2
            if partners(n, percent)[-1] > x:
                cost += c * prefix(n, percent)
        if best is None or cost < best:
            best, boundary = cost, x
    return boundary


def _decided(pairs: DataFrame, held: DataFrame, nodes: DataFrame, load, fits) -> DataFrame:
    """Of the pairs (a, b) of ids those of which ``fits`` is true for what ``load`` makes of their rows.

    ``held`` has the rows (id, n, data) of the ids; an id may have several.  Ids are dealt
    into blocks of a bounded number of shingles.  A task takes the pairs of two blocks,
    and of every row that takes part in them one copy, however many of the pairs it
    stands in.
    """
    ends = lambda rows, *more: rows.select(*more, F.explode(F.array("a", "b")).alias("id")).distinct()
    few = if_small(stored(ends(pairs), "wanted"))
    total = nodes.join(few, "id", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = F.lit(max(1, -(-total // BLOCK_SHINGLES)))
    x, y = (F.pmod(F.xxhash64(c), blocks) for c in ("a", "b"))
    keyed = pairs.select(F.least(x, y).alias("low"), F.greatest(x, y).alias("high"), "a", "b")
    held = held.join(few, "id", "left_semi").join(ends(keyed, "low", "high"), "id")
    rows = held.select("low", "high", F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("n").alias("b"), "data")
    rows = rows.unionByName(keyed.select("low", "high", F.lit(1).alias("kind"), "a", "b",
                                         F.lit(None).cast("binary").alias("data")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, made = None, {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("low", "high", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if tuple(keys[begin, :2]) != name:
                    name, made = tuple(keys[begin, :2]), {}
                if keys[begin, 2] == 0:
                    for node, n, x in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), load(part.column("data"))):
                        mine = made.setdefault(node, [])
                        if not any(n == m and np.array_equal(x, y) for m, y in mine):
                            mine.append((n, x))
                    continue
                keep = [any(fits(*x, *y) for x in made.get(a, ()) for y in made.get(b, ()))
                        for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist())]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    key = ["low", "high"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "kind")
    return rows.mapInArrow(check, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of ids those whose sets reach the similarity.

    First by marks, parities of the shingles by hash: where two sets differ in a parity
    they differ in a shingle, so more parities than a link allows rule the pair out.
    Texts are read for the others only.
    """

    def may(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        while len(x) != len(y):  # parities of half as many hashes are those of two halves together
            if len(x) < len(y):
                x, y = y, x
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        return int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * needed(n, m, percent)

    def linked(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)

    marks = sets.select("id", "n", F.col("marks").alias("data"))
    near = stored(_decided(pairs, marks, nodes, lambda c: (np.frombuffer(x, np.uint64) for x in c.to_pylist()), may), "near")
    held = texts.select("id", F.lit(0).cast("long").alias("n"), F.col("text").cast("binary").alias("data"))
    return _decided(near, held, nodes, lambda c: shingle_sets(c.cast(pa.string()), size), linked)


def _overlap(a: str, b: str, percent: int) -> str:
    """:func:`needed` as SQL."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _early(percent: int) -> str:
    """The last place at which the smaller set of a pair may first share a shingle."""
    return f"at <= n - {_overlap('n', 'n', percent)}"


def _sized(percent: int) -> str:
    return f"a <> b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"


def _crossing(postings: DataFrame) -> DataFrame:
    """Postings of the lists that hold sets of different components."""
    mixed = postings.groupBy("shingle").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y")
    return postings.join(mixed.select("shingle"), "shingle", "left_semi")


def _band(n: str) -> Column:
    """Size class; sets that link at ``PERCENT`` are in the same or in neighbouring ones."""
    return F.floor(2 * F.log2(n))


def _bands(n: str) -> Column:
    return F.explode(F.array(*[_band(n) + k for k in (-1, 0, 1)]))


def _central_pairs(postings: DataFrame, percent: int, turn: int) -> DataFrame:
    """(id, part, other, other_part): sets with central holders, of other components, of lists they are in.

    The fewer shingles rarer than the list's a holder has, the more central it is: what
    sets a copy apart from its group is rare.  A list offers one holder for each size class
    and class of ids (dealt anew each turn); a set tries those most central.
    """
    rows = postings.withColumn("band", _band("n"))
    dealt = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(CLASSES)).alias("dealt")
    offered = rows.groupBy("shingle", "band", dealt).agg(F.min(F.struct("at", "id", "n", "part")).alias("f"))
    offered = offered.select("shingle", "band", F.col("f.at").alias("at"), F.col("f.id").alias("b"),
                             F.col("f.n").alias("n_b"), F.col("f.part").alias("part_b"))
    ends = rows.select("shingle", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("part").alias("part_a"),
                       _bands("n").alias("band"))
    pairs = ends.join(offered, ["shingle", "band"]).where(f"part_a <> part_b AND {_sized(percent)}")
    pairs = pairs.groupBy("a", "part_a", "b", "part_b").agg(F.min("at").alias("at"), F.count("*").alias("c"))
    first = Window.partitionBy("a").orderBy("at", F.desc("c"), "b")
    return pairs.withColumn("k", F.row_number().over(first)).where(F.col("k") <= TRIED).select(
        F.col("a").alias("id"), F.col("part_a").alias("part"), F.col("b").alias("other"), F.col("part_b").alias("other_part"))


def _gathered(open_: DataFrame, verify, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The postings that still cross components after the turns, and the links found.

    Turns go on while the long lists would give more pairs than there are postings.
    """
    links, left = [], None
    for turn in range(TURNS):
        near = open_.where(_early(percent)).select("shingle", "part", _band("n").alias("own"), _bands("n").alias("band"))
        lists = near.groupBy("shingle", "band", "part").agg(
            F.count("*").alias("c"), F.sum((F.col("own") == F.col("band")).cast("long")).alias("own"))
        lists = lists.groupBy("shingle", "band").agg(
            F.sum("c").alias("held"), F.sum("own").alias("own"), F.max(F.struct("c", "own")).alias("most"))
        lists = stored(lists.where(F.col("held") > LONG), "long")
        # In the join all that is outside a list's largest component meets all of like size and place.
        pairs = lists.agg(F.sum(F.expr("cast(own - most.own AS double) * held"))).first()[0] or 0
        if pairs <= open_.count() or left is not None and pairs > 0.75 * left:
            break
        left = pairs
        tried = stored(_central_pairs(open_.join(if_small(lists.select("shingle").distinct()), "shingle", "left_semi"), percent, turn), "tried")
        found = verify(tried.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
        found = stored(found, "gathered")
        links.append(found)
        named = tried.select("id", "part").union(tried.select("other", "other_part")).distinct()
        a, b = (named.select(F.col("id").alias(c), F.col("part").alias(f"part_{c}")) for c in ("a", "b"))
        met = found.join(a, "a").join(b, "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        merged = stored(components(met).withColumnRenamed("node", "part"), "merged")
        joined = open_.join(if_small(merged), "part", "left").select(
            "shingle", "id", "n", "at", F.coalesce("component", "part").alias("part"))
        open_ = stored(_crossing(joined), "open")
    return open_, links


def _met(early: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that share a shingle early enough in both sets.

    Where both carry a shared shingle that stands before this one in both sets, the pair
    is left to that one: it fulfils all conditions at least as well, and of all shared
    shingles the first has none before it.
    """
    overlap = _overlap("n_a", "n_b", percent)
    left = early.select("shingle", F.col("id").alias("a"), F.col("n").alias("n_a"),
                        F.col("at").alias("at_a"), F.col("part").alias("part_a"), F.col("before").alias("before_a"))
    right = postings.select(F.col("shingle").alias("_shingle"), F.col("id").alias("b"), F.col("n").alias("n_b"),
                            F.col("at").alias("at_b"), F.col("part").alias("part_b"), F.col("before").alias("before_b"))
    fits = F.expr(f"shingle = _shingle AND part_a <> part_b AND (n_a < n_b OR n_a = n_b AND a < b) "
                  f"AND 100 * n_a >= {percent} * n_b AND at_a <= n_a - {overlap} AND at_b <= n_b - {overlap} "
                  f"AND NOT arrays_overlap(before_a, before_b)")
    return left.join(right, fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT,
                       boundary: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text, ...).

    Documents link from a Jaccard similarity of ``percent`` hundredths on; component_id
    is the least doc_id reachable by links.  Null and empty texts have no shingles and
    link with nothing.  Rows that repeat a doc_id count as one document with several
    texts: its links are those of all of them.  A null doc_id gets a null component and
    links nothing.  Texts may have any length; other columns are not read.  An empty
    table gives no rows.  ``boundary`` fixes the largest light set.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _components(docs, size, percent, boundary)


def _components(docs: DataFrame, size: int, percent: int, boundary: int | None) -> DataFrame:
    """The work of :func:`jaccard_components`; all that runs in Python is stored before it returns."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    scan, schema = _scan(size, MOST_LIGHT)
    scanned = stored(texts.mapInArrow(scan, schema), "sets")
    sets = scanned.where("sig IS NOT NULL").select("id", "n", "sig", "least", "marks")

    # Classes of equal sets; a class is named by its least document.
    named = sets.where("id IS NOT NULL AND n > 0")
    classes = named.groupBy("sig").agg(F.min("id").alias("node"))
    members = stored(named.select("id", "n", "sig", "least").join(classes, "sig"), "members")
    nodes = members.where("id = node").select("id", "n", "least").distinct()
    same = members.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    if boundary is None:
        boundary = choose_boundary(nodes, percent)

    # Light sets: a shared subset is a link.
    keys, schema = _subsets(boundary, percent)
    subsets = nodes.where(F.col("n") <= boundary).mapInArrow(keys, schema)
    group = subsets.groupBy("low", "high", "subset", "subset2").agg(
        F.min("id").alias("first"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("c"))
    group = group.where("c > 1 AND least = low AND most = high").drop("c", "least", "most")
    light = subsets.join(group, ["low", "high", "subset", "subset2"]).where("id <> first").select(
        F.col("id").alias("a"), F.col("first").alias("b")).distinct()

    # First pass over all sets of the lists: each against the least holder of its minima.
    listed = nodes.where(F.col("n") * 100 >= percent * (boundary + 1))
    minima = listed.select("id", "n", F.explode(F.slice("least", 1, MINIMA)).alias("shingle"))
    shared = minima.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    minima = stored(minima.join(shared, "shingle"), "minima")
    # The set whose least shingles have the most holders is nearest to the others.
    central = minima.groupBy("id").agg(F.sum("c").alias("weight"))
    minima = minima.join(central, "id")
    first = minima.groupBy("shingle").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"), "n")).alias("f"))
    near = minima.join(first, "shingle").select(
        F.col("id").alias("a"), F.col("n").alias("n_a"), (-F.col("f.id")).alias("b"), F.col("f.n").alias("n_b"))
    near = near.where(_sized(percent)).groupBy("a", "b").agg(F.count("*").alias("c")).where(f"c >= {SHARED}")
    near = stored(near.select("a", "b"), "near")
    links = stored(light.union(same).union(_verified(near, texts, sets, nodes, size, percent)), "first-links")
    parts = stored(components(links), "parts")

    # Inverted lists: what shares a looked-up shingle across components is verified.
    prefixes, schema = _prefixes(_frequent(scanned), size, percent, boundary)
    lists = texts.where("id IS NOT NULL").mapInArrow(prefixes, schema)
    lists = lists.groupBy("sig").agg(
        F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "rare", "often")])
    lists = stored(lists, "lists")  # read once for each kind
    rare = lists.select("id", "n", F.posexplode("rare").alias("at", "shingle"))
    rare = rare.withColumn("held", F.count("*").over(Window.partitionBy("shingle"))).where("held > 1").drop("held")
    often = lists.select("id", "n", F.size("rare").alias("before"), F.posexplode("often").alias("at", "shingle"))
    often = often.select("id", "n", (F.col("before") + F.col("at")).alias("at"), "shingle")
    postings = rare.union(often).join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "shingle", "id", "n", "at", F.coalesce("component", "id").alias("part"))
    postings = stored(postings, "postings")
    open_, gathered = _gathered(
        stored(_crossing(postings), "open"), lambda pairs: _verified(pairs, texts, sets, nodes, size, percent), percent)
    # Every pair across components has a member outside the list's largest component, so
    # a group of near copies meets its list's few strangers but never itself.
    largest = open_.groupBy("shingle", "part").agg(F.count("*").alias("c")).groupBy("shingle").agg(
        F.max(F.struct("c", "part"))["part"].alias("largest"))
    sided = open_.join(largest, "shingle").withColumn("inner", F.col("part") == F.col("largest")).drop("largest")
    # Sets of one document and size share a window: their pairs have the same conditions.
    earlier = Window.partitionBy("id", "n").orderBy("at", "shingle").rowsBetween(-BEFORE, -1)
    sided = stored(sided.withColumn("before", F.collect_list("shingle").over(earlier)), "sided")
    early = sided.where(_early(percent))
    met = _met(early.where("NOT inner"), sided, percent).union(_met(early.where("inner"), sided.where("NOT inner"), percent))
    met = stored(met.distinct(), "met")
    late = stored(_verified(met, texts, sets, nodes, size, percent), "late-links")

    links = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for more in (late, *gathered):
        links = links.union(more)
    found = components(links)
    sizes = sets.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"))
    return sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
