"""The best N items of every group by partition lower bounds: problem 5.

Each partition keeps, group by group, its own best N rows while it streams through its input. The
N-th of them bounds what can be among the best N of all; the greatest such bound of a group, joined
back, removes nearly all survivors of other partitions before anything is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrank.operators import skew
from loomrank.operators.postings import distinct_postings
from loomrank.sources.tables import saved, table

BEST = 5
BLOCK = 200_000
#: A partition that holds so many rows gives them out and begins anew; the bounds it gives are valid all the same.
HELD = 2_000_000
#: From this share on, and in however few rows, pages count as heavy in p5_split.
SPLIT_SHARE = 0.0002


def _local_best(n: int):
    """(group, item, score) batches: the partition's best n per group, with its n-th as the bound."""

    def best(group, item, score):
        order = np.lexsort((-item, -score, group))
        group, item, score = group[order], item[order], score[order]
        start = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
        keep = rank < n
        return group[keep], item[keep], score[keep], rank[keep]

    def given(group, item, score, rank) -> Iterator[pa.RecordBatch]:
        last = rank == n - 1
        bounds = [pa.array(score, mask=~last), pa.array(item, mask=~last)]
        t = pa.Table.from_arrays([pa.array(group), pa.array(item), pa.array(score), *bounds], names=["g", "i", "s", "bound_s", "bound_i"])
        yield from t.to_batches(max_chunksize=BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, floor = 0, BLOCK
        for b in batches:
            held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            rows += b.num_rows
            if rows < floor:
                continue
            kept = best(*(np.concatenate(x) for x in zip(*held)))
            held, rows = [kept[:3]], len(kept[0])
            if rows >= HELD:
                yield from given(*kept)
                held, rows = [], 0
            floor = max(BLOCK, 2 * rows)
        if rows:
            yield from given(*best(*(np.concatenate(x) for x in zip(*held))))

    return run


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = BEST) -> DataFrame:
    """(group, item, score, place): the n best rows of every group, place from 1.

    Order: score descending, then item descending, so ties always fall the same way. group and item are
    BIGINT, score DOUBLE. Rows with a null group, item or score or a NaN score do not take part; repeated
    rows take part as often as they stand; a group with fewer than n rows gives all; empty input gives no rows.
    """
    used = rows.select(F.col(group).cast("bigint").alias("g"), F.col(item).cast("bigint").alias("i"), F.col(score).cast("double").alias("s"))
    used = used.where("g is not null and i is not null and s is not null and not isnan(s)")
    local = saved(used.mapInArrow(_local_best(n), "g bigint, i bigint, s double, bound_s double, bound_i bigint"), "survivors")
    bound = local.where("bound_s is not null").groupBy("g").agg(F.max(F.struct("bound_s", "bound_i")).alias("bound"))
    kept = local.join(bound, "g", "left").where(F.col("bound").isNull() | (F.struct(F.col("s").alias("bound_s"), F.col("i").alias("bound_i")) >= F.col("bound")))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), F.desc("i")))
    return kept.withColumn("place", place).where(F.col("place") <= n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")


def ranks_of_pages(pageranks: DataFrame) -> DataFrame:
    """(page_id, pr): one usable rank per page, the greatest of its rows; null and NaN are no ranks."""
    return pageranks.where("page_id is not null and pr is not null and not isnan(pr)").groupBy("page_id").agg(F.max("pr").alias("pr"))


def best_pages(postings: DataFrame, pageranks: DataFrame, n: int = BEST, share: float | None = None, least: int = skew.LEAST_ROWS) -> DataFrame:
    """(word_val, page_id, score, place): the best pages of every word's high list by freq times pr. share, least: of heavy pages."""
    rows = distinct_postings(postings, ("high",)).where("freq is not null")
    rows = skew.skew_join(rows, ranks_of_pages(pageranks), "page_id", heavy=skew.heavy_keys(postings.where("tier = 'high'"), "page_id", share, least))
    return top_n(rows.withColumn("score", F.col("freq") * F.col("pr")), "word_val", "page_id", "score", n)


def p5_best(spark: SparkSession, folder: str) -> DataFrame:
    return best_pages(table(spark, folder, "postings"), table(spark, folder, "pageranks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_best(spark, folder).select("word_val", "page_id")


def p5_split(spark: SparkSession, folder: str) -> DataFrame:
    """p5_best where small tables have heavy pages too."""
    return best_pages(table(spark, folder, "postings"), table(spark, folder, "pageranks"), share=SPLIT_SHARE, least=1)


QUERIES = {"p5_found": p5_found, "p5_best": p5_best, "p5_split": p5_split}
_BEST = f"""
WITH p AS (SELECT word_val, page_id, max(freq) AS freq FROM postings WHERE word_val IS NOT NULL AND tier = 'high' GROUP BY ALL),
r AS (SELECT page_id, max(pr) AS pr FROM pageranks WHERE pr IS NOT NULL AND NOT isnan(pr) GROUP BY page_id),
s AS (SELECT word_val, page_id, freq * pr AS score, row_number() OVER (PARTITION BY word_val ORDER BY freq * pr DESC, page_id DESC) AS place
FROM p JOIN r USING (page_id) WHERE freq IS NOT NULL)
SELECT word_val, page_id, score, CAST(place AS INTEGER) AS place FROM s WHERE place <= {BEST}"""
SQL = {"p5_found": f"SELECT word_val, page_id FROM ({_BEST})", "p5_best": _BEST, "p5_split": _BEST}
