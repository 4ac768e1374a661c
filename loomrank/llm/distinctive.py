"""How distinctive a word is of a page: a parsimonious language model, problem 3.

The title and category words of a page are taken as drawn from a mixture of the page's own language
model and the collection's. Expectation-maximisation moves the mass that the collection explains out
of the page's model, so that what remains ranks the words that mark out the page.

The likelihood is concave, so the rounds tend to one limit: a word has either none of the mass, or tf / m less its
background, with one normaliser m for the page. The rounds tell which words have mass; m is then solved for exactly.
So no score depends on when the rounds were stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators import skew
from loomrank.operators.postings import TIERS, distinct_postings
from loomrank.plans.words import word_totals
from loomrank.sources.tables import local_table, saved, table

#: Weight of the page's own model in the mixture.
OWN = 0.5
#: A page's rounds end when no probability of it moves by this much in one; the limit is then solved for.
TOLERANCE = 1e-4
#: Relative change of a normaliser below which the limit is reached.
EXACT = 1e-13
#: Rows that one step of the vectorised model takes at least.
BLOCK = 100_000
FOUND = 80.0

_SCORED = "page_id bigint, word_val bigint, freq int, tier_no int, pages bigint, score double"


def maximise(start: np.ndarray, tf: np.ndarray, background: np.ndarray, own: float = OWN) -> np.ndarray:
    """P(word | page) after convergence. start: where each page's rows begin; all rows of a page adjoin.

    Every page stops by its own change, so that its scores do not depend on the pages beside it.
    """
    if not len(tf):
        return np.zeros(0)
    out, rows, size = np.zeros(len(tf)), np.arange(len(tf)), np.diff(np.append(start, len(tf)))
    whole = start, tf, (1 - own) / own * background, np.repeat(np.arange(len(size)), size)
    page = whole[3]
    share = lambda e: e / np.where((z := np.add.reduceat(e, start)) > 0, z, 1.0)[page]
    p, noise = share(tf), (1 - own) * background
    while len(rows):
        mix = own * p
        below = mix + noise
        new = share(tf * np.divide(mix, below, out=np.zeros_like(mix), where=below > 0))
        going, p = np.maximum.reduceat(np.abs(new - p), start) >= TOLERANCE, new
        if not going.all():
            out[rows] = p
            keep, size = going[page], size[going]
            rows, p, tf, noise = rows[keep], p[keep], tf[keep], noise[keep]
            page, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    return _limit(out, *whole)


def _limit(p: np.ndarray, start: np.ndarray, tf: np.ndarray, noise: np.ndarray, page: np.ndarray) -> np.ndarray:
    """What the rounds tend to, from the words that they left mass: Newton steps for the normalisers of all pages at once."""

    def normaliser(kept: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.where(kept, tf, 0.0), start) / (1 + np.add.reduceat(np.where(kept, noise, 0.0), start))

    m = normaliser((p > TOLERANCE) & (tf > 0))
    while True:
        new = normaliser((tf > m[page] * noise) & (tf > 0))
        done, m = (np.abs(new - m) <= EXACT * new).all(), new
        if done:
            break
    below = m[page]
    return np.maximum(np.divide(tf, below, out=np.zeros_like(tf), where=below > 0) - noise, 0.0) * (tf > 0)


def _pages(own: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def scored(t: pa.Table) -> Iterator[pa.RecordBatch]:
            page = t.column("page_id").to_numpy()
            tf = np.maximum(t.column("tf").to_numpy(), 0).astype(float)
            start = np.flatnonzero(np.diff(page, prepend=page[0] - 1))
            p = maximise(start, tf, t.column("background").to_numpy(), own)
            yield from t.drop_columns(["tf", "background"]).append_column("score", pa.array(p)).to_batches()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < BLOCK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            page = t.column("page_id").to_numpy()
            cut = int(np.searchsorted(page, page[-1]))  # the last page may go on in the next batch
            if cut:
                yield from scored(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows:
                yield from scored(t)

    return run


def _giant_pages(rows: DataFrame, own: float) -> DataFrame:
    """The same limit for pages of very many words, with a page's rows spread over all tasks.

    All words begin with mass, and every step brings one normaliser per such page to the driver; words only lose their
    mass from step to step, so the steps end, mostly after a few.
    """
    rows = saved(rows, "giant_pages")
    tf, noise, spark = F.greatest("tf", F.lit(0)).cast("double"), F.lit((1 - own) / own) * F.col("background"), rows.sparkSession
    m: dict[int, float] = {}

    def marked() -> DataFrame:
        if not m:
            return rows.withColumn("m", F.lit(0.0))
        return rows.join(F.broadcast(local_table(spark, m.items(), "page_id bigint, m double")), "page_id")

    while True:
        kept = (tf > 0) & (tf > F.col("m") * noise)
        got = marked().groupBy("page_id").agg(F.sum(F.when(kept, tf)).alias("t"), F.sum(F.when(kept, noise)).alias("b")).collect()
        new = {r["page_id"]: (r["t"] or 0.0) / (1 + (r["b"] or 0.0)) for r in got}
        done, m = bool(m) and all(abs(x - m[k]) <= EXACT * x for k, x in new.items()), new
        if done or not m:
            break
    score = F.when((tf > 0) & (F.col("m") > 0), F.greatest(tf / F.col("m") - noise, F.lit(0.0))).otherwise(0.0)
    return marked().withColumn("score", score).select(*[c.split()[0] for c in _SCORED.split(", ")])


def distinctive_words(postings: DataFrame, own: float = OWN, giant: DataFrame | None = None) -> DataFrame:
    """(page_id, word_val, freq, tier_no, pages, score) of every title and category posting.

    score is the word's probability in the page's parsimonious model: within a page the scores sum to 1,
    common words get little, words that the collection hardly uses get much. pages counts the word's pages
    in all tiers. A null, zero or negative freq counts as 0 occurrences and scores 0. Repeated rows count once,
    rows without word_val or page_id not at all; ties score alike; empty input gives no rows; other columns
    are ignored. giant: the page_id to be spread over tasks, by default those with a heavy share of rows.
    """
    named = (F.col("title_pages") + F.col("category_pages")).alias("named")
    words = saved(word_totals(postings).select("word_val", "pages", "occurrences", named), "words")
    sums = words.agg(F.sum("occurrences").alias("occurrences"), F.sum("named").alias("named")).first()
    share = F.greatest("occurrences", F.lit(0)) / F.lit(float(sums["occurrences"] or 1))
    # the words that stand in most of the rows to be scored are known by their counts: 1 / share at most
    least = max(skew.LEAST_ROWS, skew.heavy_share(postings.sparkSession) * (sums["named"] or 0))
    heavy = local_table(postings.sparkSession, words.where(F.col("named") >= least).select("word_val", "named").collect(), "word_val bigint, estimate bigint")
    rows = skew.skew_join(distinct_postings(postings, TIERS[:2]), words.select("word_val", "pages", share.alias("background")), "word_val", heavy=heavy)
    rows = rows.select("page_id", "word_val", "freq", "tier_no", "pages", F.coalesce("freq", F.lit(0)).alias("tf"), "background")
    giant = skew.heavy_keys(postings.where(F.col("tier").isin(*TIERS[:2])), "page_id") if giant is None else giant
    few = giant.count()
    usual = skew.split(rows, "page_id", giant)[1] if few else rows
    scored = usual.repartition("page_id").sortWithinPartitions("page_id").mapInArrow(_pages(own), _SCORED)
    return scored.unionByName(_giant_pages(skew.split(rows, "page_id", giant)[0].drop("estimate"), own)) if few else scored


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive_words(table(spark, folder, "postings")).withColumn("score", F.round("score", 9))


def p3_spread(spark: SparkSession, folder: str) -> DataFrame:
    """p3_scores where pages with a small share of the rows are spread over tasks too."""
    postings = table(spark, folder, "postings")
    giant = skew.heavy_keys(postings.where(F.col("tier").isin(*TIERS[:2])), "page_id", 0.0003, 1)
    return distinctive_words(postings, giant=giant).withColumn("score", F.round("score", 9))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    postings = table(spark, folder, "postings")
    pages = postings.where(F.col("word_val").isNotNull() & F.col("page_id").isNotNull()).select("page_id").distinct().count()
    weight = F.col("freq") * F.log(F.lit(float(pages)) / F.col("pages"))
    return distinctive_words(postings).where(F.col("freq").isNotNull() & (weight >= FOUND)).select("page_id", "word_val")


QUERIES = {"p3_found": p3_found, "p3_scores": p3_scores, "p3_spread": p3_spread}
_ONCE = """p AS (SELECT word_val, page_id, max(freq) AS freq, max(tier) AS tier FROM postings WHERE word_val IS NOT NULL AND page_id IS NOT NULL GROUP BY ALL),
w AS (SELECT word_val, count(*) AS n, greatest(coalesce(sum(freq), 0), 0) AS occurrences FROM p GROUP BY word_val)"""
#: Of words in the order of tf / background, so many have mass that the normaliser tf sum / (1 + background sum) is greatest.
_SCORES = f"""
WITH {_ONCE}, b AS (SELECT word_val, n, occurrences / (SELECT sum(occurrences) FROM w)::DOUBLE AS noise FROM w),
t AS (SELECT page_id, word_val, freq, CASE tier WHEN 'title' THEN 0 ELSE 1 END AS tier_no, n, greatest(coalesce(freq, 0), 0)::DOUBLE AS tf, noise FROM p JOIN b USING (word_val) WHERE tier IN ('title', 'category')),
m AS (SELECT *, sum(tf) OVER o / (1 + sum(noise) OVER o) AS m FROM t WHERE tf > 0 WINDOW o AS (PARTITION BY page_id ORDER BY tf / noise DESC, word_val ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT page_id, max(m) AS m FROM m GROUP BY page_id)
SELECT page_id, word_val, freq, tier_no, n AS pages, round(CASE WHEN tf > 0 THEN greatest(tf / m - noise, 0) ELSE 0 END, 9) AS score FROM t LEFT JOIN k USING (page_id)"""
SQL = {
    "p3_found": f"""
WITH {_ONCE} SELECT page_id, word_val FROM p JOIN w USING (word_val)
WHERE tier IN ('title', 'category') AND freq IS NOT NULL AND freq * ln((SELECT count(DISTINCT page_id) FROM p)::DOUBLE / n) >= {FOUND}""",
    "p3_scores": _SCORES,
    "p3_spread": _SCORES,
}
