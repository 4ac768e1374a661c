"""Counting terms with burst tries: problem 2.

Every worker accumulates counters in a trie whose leaves are compact sorted arrays; a leaf that
outgrows its capacity bursts into one leaf per next letter. Terms are routed by adaptive prefixes:
a directory of prefixes, deeper where more rows stand, covers the whole key space. Subtrees of the
same prefix meet on one worker, where they are merged.

A term is a BIGINT: the base-27 value of its letters (a = 1 ... z = 26, 13 letters at most). Its
position in the trie is that value shifted to 13 digits, so that the order is alphabetical. Values
that are no such word (negative, too large, or with a digit 0) are counted too; they only share a
place in the trie with another value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators.postings import distinct_postings
from loomrank.sources.tables import local_table, table

BASE, DIGITS = 27, 13
POWERS = np.array([BASE**i for i in range(DIGITS + 1)], dtype=np.int64)
SPACE = BASE**DIGITS
#: Letters by which the directory is refined at a time.
STEP = 3
CAPACITY = 4096
BUFFER = 500_000
MAP_LIMIT = 4_000_000
RARE_PAGES, COMMON_SHARE = 2, 0.3


def places(values: np.ndarray) -> np.ndarray:
    """The position of each value in the key space."""
    v = np.mod(values, SPACE)
    digits = np.searchsorted(POWERS, v, side="right")
    return v * POWERS[DIGITS - digits]


def place_column(value: Column) -> Column:
    """places() as a Column."""
    v = F.pmod(value, F.lit(SPACE))
    # the largest power first, so that the first true branch is the right shift
    branches = F.when(v >= BASE ** (DIGITS - 1), v)
    for d in range(DIGITS - 1, 0, -1):
        branches = branches.when(v >= BASE ** (d - 1), v * F.lit(BASE ** (DIGITS - d)))
    return branches.otherwise(F.lit(0).cast("bigint"))


def directory(terms: DataFrame, value: str, routes: int) -> np.ndarray:
    """Lower bounds of the prefixes that terms are routed by, in ascending order, 0 first.

    A prefix with more than 1 / routes of the rows is replaced by its 27 children, down to whole words; counts of all
    rows decide. A round counts the prefixes of the next three lengths under those that are still too heavy; the counts
    stay in Spark, and only prefixes too heavy themselves, less than `routes` of each length, come to the driver.
    """
    rows = terms.select(place_column(F.col(value)).alias("p"))
    limit = max(1, rows.count() // max(1, routes))
    bounds, open_ = [0], [0]  # lower bounds of the heavy prefixes of the last known length
    for known in range(0, DIGITS, STEP):
        depth = min(known + STEP, DIGITS)
        up = BASE ** (DIGITS - known)
        heavy_ones = F.broadcast(local_table(rows.sparkSession, [(x // up,) for x in open_], "o bigint"))
        part = rows if not known else rows.withColumn("o", F.expr(f"p div {up}")).join(heavy_ones, "o", "left_semi")
        counts = part.groupBy(F.expr(f"p div {BASE ** (DIGITS - depth)}").alias("q")).agg(F.count("*").alias("n"))
        lengths = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.expr(f"q div {BASE ** (depth - d)}").alias("a")) for d in range(known, depth + 1)])).alias("x")
        heavy = counts.select(lengths, "n").groupBy("x.d", "x.a").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()
        open_ = []
        for d, a, _ in heavy:
            lower, child = a * BASE ** (DIGITS - d), BASE ** (DIGITS - d - 1) if d < DIGITS else 0
            if d < depth:
                bounds += [lower + c * child for c in range(BASE)]
            elif d < DIGITS:
                open_.append(lower)
        if not open_:
            break
    return np.unique(np.array(bounds, dtype=np.int64))


class Leaf:
    """Sorted values with their counters."""

    __slots__ = ("place", "value", "count")

    def __init__(self, place: np.ndarray, value: np.ndarray, count: np.ndarray):
        self.place, self.value, self.count = place, value, count


def merged(place: np.ndarray, value: np.ndarray, count: np.ndarray) -> Leaf:
    """Equal values become one; count has one row per value and one column per counter."""
    order = np.lexsort((value, place))
    place, value, count = place[order], value[order], count[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(first)
    return Leaf(place[at], value[at], np.add.reduceat(count, at, axis=0) if len(at) else count)


class BurstTrie:
    """A trie under one prefix of the directory."""

    def __init__(self, depth: int = 0, capacity: int = CAPACITY):
        self.depth, self.capacity = depth, capacity
        self.leaf: Leaf | None = None
        self.children: dict[int, BurstTrie] | None = None

    def add(self, part: Leaf) -> None:
        if not len(part.value):
            return
        if self.children is not None:
            self._down(part)
        elif self.leaf is None:
            self.leaf = part
        else:
            a = self.leaf
            self.leaf = merged(*(np.concatenate(x) for x in ((a.place, part.place), (a.value, part.value), (a.count, part.count))))
        if self.leaf is not None and len(self.leaf.value) > self.capacity and self.depth < DIGITS:
            part, self.leaf, self.children = self.leaf, None, {}
            self._down(part)

    def _down(self, part: Leaf) -> None:
        letter = part.place // POWERS[DIGITS - 1 - self.depth] % BASE
        at = np.flatnonzero(np.diff(letter, prepend=-1))
        for i, j in zip(at, [*at[1:], len(letter)]):
            child = self.children.setdefault(int(letter[i]), BurstTrie(self.depth + 1, self.capacity))
            child.add(Leaf(part.place[i:j], part.value[i:j], part.count[i:j]))

    def leaves(self) -> Iterator[Leaf]:
        if self.leaf is not None:
            yield self.leaf
        for c in sorted(self.children or {}):
            yield from self.children[c].leaves()


class Forest:
    """One trie per route of the directory."""

    def __init__(self, bounds: np.ndarray):
        self.bounds, self.tries, self.size = bounds, {}, 0

    def add(self, value: np.ndarray, count: np.ndarray) -> None:
        part = merged(places(value), value, count)
        route = np.searchsorted(self.bounds, part.place, side="right") - 1
        at = np.flatnonzero(np.diff(route, prepend=-1))
        for i, j in zip(at, [*at[1:], len(route)]):
            trie = self.tries.setdefault(int(route[i]), BurstTrie())
            trie.add(Leaf(part.place[i:j], part.value[i:j], part.count[i:j]))
        self.size += len(part.value)


_SUBTREE = "route int, n int, vals binary, counters binary"
_COUNTS = "word_val bigint, occurrences bigint, pages bigint"


def _accumulate(bounds: np.ndarray):
    """Batches of (word_val, occurrences): subtrees by route, the counters of the whole partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, rows = Forest(bounds), [], 0

        def flush():
            nonlocal held, rows
            if held:
                value = np.concatenate([v for v, _ in held])
                freq = np.concatenate([f for _, f in held])
                forest.add(value, np.stack([freq, np.ones(len(freq), dtype=np.int64)], axis=1))
                held, rows = [], 0

        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
            rows += b.num_rows
            if rows >= BUFFER:
                flush()
                if forest.size > MAP_LIMIT:  # counters of very large vocabularies leave early
                    yield from _subtrees(forest)
                    forest = Forest(bounds)
        flush()
        yield from _subtrees(forest)

    return run


def _subtrees(forest: Forest) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for route, trie in sorted(forest.tries.items()):
        held: list[Leaf] = []
        for leaf in trie.leaves():
            held.append(leaf)
            if sum(len(x.value) for x in held) >= 4 * CAPACITY:
                out.append(_packed(route, held))
                held = []
        if held:
            out.append(_packed(route, held))
        if len(out) >= 64:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _packed(route: int, leaves: list[Leaf]) -> tuple:
    value = np.concatenate([x.value for x in leaves])
    return route, len(value), value.tobytes(), np.concatenate([x.count for x in leaves]).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["route", "n", "vals", "counters"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees in the order of their routes: the merged counters."""
    trie, current = BurstTrie(), None

    def done():
        for leaf in trie.leaves():
            columns = [pa.array(leaf.value), pa.array(leaf.count[:, 0].copy()), pa.array(leaf.count[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["word_val", "occurrences", "pages"])

    for b in batches:
        for route, vals, counters in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
            if route != current:
                yield from done()
                trie, current = BurstTrie(), route
            value = np.frombuffer(vals.as_py(), dtype=np.int64)
            trie.add(merged(places(value), value, np.frombuffer(counters.as_py(), dtype=np.int64).reshape(-1, 2)))
    yield from done()


def count_terms(postings: DataFrame, routes: int | None = None) -> DataFrame:
    """(word_val, occurrences, pages) of every word of all tiers.

    postings: as the table of that name; a (word_val, page_id) counts once, rows without word_val or
    page_id not at all. A null freq adds a page and no occurrence. Empty input gives no rows; other
    columns are ignored.
    """
    spark = postings.sparkSession
    routes = routes or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = directory(postings.where(F.col("word_val").isNotNull()).select("word_val"), "word_val", routes)
    once = distinct_postings(postings).select("word_val", F.coalesce(F.col("freq").cast("bigint"), F.lit(0)).alias("freq"))
    parts = once.mapInArrow(_accumulate(bounds), _SUBTREE)
    return parts.repartition("route").sortWithinPartitions("route").mapInArrow(_merge, _COUNTS)


def marked_terms(postings: DataFrame, rare: int = RARE_PAGES, common: float = COMMON_SHARE) -> DataFrame:
    """count_terms with a mark: `rare` on at most `rare` pages, `common` on at least the share `common` of all pages, else null.

    A word that is both, as in a tiny collection, is marked rare.
    """
    used = postings.where(F.col("word_val").isNotNull() & F.col("page_id").isNotNull())
    pages = used.select("page_id").distinct().count()
    mark = F.when(F.col("pages") <= rare, "rare").when(F.col("pages") >= common * pages, "common")
    return count_terms(postings).withColumn("mark", mark)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "postings")).where("mark is not null").select("word_val", "mark")


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "postings"))


QUERIES = {"p2_found": p2_found, "p2_terms": p2_terms}

_TERMS = f"""SELECT word_val, CAST(coalesce(sum(freq), 0) AS BIGINT) AS occurrences, count(*) AS pages,
CASE WHEN count(*) <= {RARE_PAGES} THEN 'rare'
WHEN count(*) >= {COMMON_SHARE} * (SELECT count(DISTINCT page_id) FROM postings WHERE word_val IS NOT NULL) THEN 'common' END AS mark
FROM (SELECT word_val, page_id, max(freq) AS freq FROM postings WHERE word_val IS NOT NULL AND page_id IS NOT NULL GROUP BY ALL) GROUP BY word_val"""
SQL = {"p2_found": f"SELECT word_val, mark FROM ({_TERMS}) WHERE mark IS NOT NULL", "p2_terms": _TERMS}
