"""One ranking from several scores by median rank aggregation: problem 6.

Each score is replaced by the item's rank in it, so that its scale no longer matters; items are ordered
by the weighted median of their ranks, then by the mean rank and the identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrank.llm.topn import ranks_of_pages
from loomrank.operators import skew
from loomrank.operators.postings import TIERS, distinct_postings
from loomrank.sources.tables import saved, table

#: From this share on, and in however few rows, words, pages and queries count as heavy in p6_split.
SPLIT_SHARE = 0.002
WEIGHTS = {"pr": 1.0, "title_score": 1.0, "category_score": 1.0}


def median_of(ranks: list[str], weights: list[float]) -> Column:
    """The least rank at which half of the weight is reached."""
    pairs = F.array_sort(F.array(*[F.struct(F.col(r).cast("double").alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights)]))
    half, start = sum(weights) / 2, F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("r"))
    add = lambda a, x: F.struct(
        (a["sum"] + x["w"]).alias("sum"), F.when(a["r"].isNull() & (a["sum"] + x["w"] >= half), x["r"]).otherwise(a["r"]).alias("r")
    )
    return F.aggregate(pairs, start, add, lambda a: a["r"])


def _large_group_ranks(rows: DataFrame, group: str, score: str) -> DataFrame:
    """rows with the rank of score: distinct values are ranked over ranges, and joined back under skew."""
    key = F.concat_ws("|", F.col(group).cast("string"), F.col(score).cast("string"))
    values = rows.groupBy(group, score).agg(F.count("*").alias("_n"))
    ranked = skew.running_sum(values, group, [F.desc(score)], F.col("_n"), f"rank_{score}")
    ranked = ranked.select(key.alias("_k"), (F.col(f"rank_{score}") + 1).alias(f"rank_{score}"))
    return skew.skew_join(rows.withColumn("_k", key), ranked, "_k").drop("_k")


def median_rank(rows: DataFrame, group: str, item: str, weights: dict[str, float], large: DataFrame | None = None) -> DataFrame:
    """rows with rank_<score> of each score, items, median_rank, mean_rank and place, all within the group.

    rank_<score> is 1 plus the number of items of the group with a greater score, so ties share a rank; null
    and NaN scores count as 0. place orders by median_rank, mean_rank and item, from 1. An item must stand
    once in a group; rows without group or item are ignored; empty input gives no rows; other columns are kept.
    large: groups to be spread over tasks, by default those with a heavy share of the rows.
    """
    scores = list(weights)
    clean = {s: F.coalesce(F.nanvl(F.col(s).cast("double"), F.lit(0.0)), F.lit(0.0)) + 0.0 for s in scores}
    rows = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).withColumns(clean)
    ranks = [f"rank_{s}" for s in scores]
    combined = {"median_rank": median_of(ranks, list(weights.values())), "mean_rank": sum(F.col(r) for r in ranks) / len(ranks)}
    order = [F.col("median_rank"), F.col("mean_rank"), F.col(item)]
    rows = saved(rows, "candidates")
    large = skew.heavy_keys(rows, group) if large is None else large
    few = large.count()

    def small(df: DataFrame) -> DataFrame:
        own = Window.partitionBy(group)
        df = df.withColumns({f"rank_{s}": F.rank().over(own.orderBy(F.desc(s))).cast("bigint") for s in scores} | {"items": F.count("*").over(own)})
        return df.withColumns(combined).withColumn("place", F.row_number().over(own.orderBy(*order)).cast("bigint"))

    if not few:
        return small(rows)
    keys = F.broadcast(large.select(group))
    hot, rest = rows.join(keys, group, "left_semi"), rows.join(keys, group, "left_anti")
    sizes = F.broadcast(hot.groupBy(group).agg(F.count("*").alias("items")))  # a row per large group
    for s in scores:
        hot = _large_group_ranks(hot, group, s)
    hot = skew.running_sum(hot.join(sizes, group).withColumns(combined), group, order, F.lit(1).cast("bigint"), "place")
    return small(rest).unionByName(hot.withColumn("place", F.col("place") + 1))


def candidates(query_terms: DataFrame, postings: DataFrame, pageranks: DataFrame, share: float | None = None, least: int = skew.LEAST_ROWS) -> DataFrame:
    """(query_id, page_id, pr, title_score, category_score): the pages with a title or category posting of a word of the query.

    share, least: from when on a word, or a page among the candidates, is heavy, as in skew.heavy_keys.
    """
    terms = query_terms.where("query_id is not null and word_val is not null").select("query_id", "word_val").distinct()
    lists = distinct_postings(postings, TIERS[:2])
    heavy = skew.heavy_keys(postings.where(F.col("tier").isin(*TIERS[:2])), "word_val", share, least)
    hits = skew.salted_join(lists, terms, "word_val", "page_id", heavy)
    amount = lambda t: F.coalesce(F.sum(F.when(F.col("tier_no") == TIERS.index(t), F.col("freq").cast("bigint"))), F.lit(0))
    found = hits.groupBy("query_id", "page_id").agg(amount("title").alias("title_score"), amount("category").alias("category_score"))
    found = saved(found, "hits")
    return skew.skew_join(found, ranks_of_pages(pageranks), "page_id", "left", skew.heavy_keys(found, "page_id", share, least)).withColumn("pr", F.coalesce("pr", F.lit(0.0)))


_COLUMNS = ["query_id", "page_id", "median_rank", "mean_rank", "place", "items", *[f"rank_{s}" for s in WEIGHTS]]


def _tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("query_terms", "postings", "pageranks")]


def p6_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return median_rank(candidates(*_tables(spark, folder)), "query_id", "page_id", WEIGHTS).select(_COLUMNS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    worst = F.greatest(*[f"rank_{s}" for s in WEIGHTS])
    return p6_ranking(spark, folder).where(worst - 1 < F.col("items") / 4).select("query_id", "page_id")


def p6_split(spark: SparkSession, folder: str) -> DataFrame:
    """p6_ranking where small tables have heavy words, pages and queries too."""
    rows = saved(candidates(*_tables(spark, folder), SPLIT_SHARE, 1), "ranked")
    return median_rank(rows, "query_id", "page_id", WEIGHTS, skew.heavy_keys(rows, "query_id", SPLIT_SHARE, 1)).select(_COLUMNS)


QUERIES = {"p6_found": p6_found, "p6_ranking": p6_ranking, "p6_split": p6_split}
_RANKED = """
WITH p AS (SELECT word_val, page_id, max(freq) AS freq, max(tier) AS tier FROM postings WHERE word_val IS NOT NULL AND tier IN ('title', 'category') GROUP BY ALL),
q AS (SELECT DISTINCT query_id, word_val FROM query_terms WHERE word_val IS NOT NULL),
r AS (SELECT page_id, max(pr) AS pr FROM pageranks WHERE pr IS NOT NULL AND NOT isnan(pr) GROUP BY page_id),
c AS (SELECT query_id, page_id, coalesce(any_value(pr), 0) AS pr, coalesce(sum(freq) FILTER (tier = 'title'), 0) AS t, coalesce(sum(freq) FILTER (tier = 'category'), 0) AS c
FROM q JOIN p USING (word_val) LEFT JOIN r USING (page_id) GROUP BY query_id, page_id),
k AS (SELECT query_id, page_id, count(*) OVER (PARTITION BY query_id) AS items,
rank() OVER (PARTITION BY query_id ORDER BY pr DESC) AS rank_pr,
rank() OVER (PARTITION BY query_id ORDER BY t DESC) AS rank_title_score,
rank() OVER (PARTITION BY query_id ORDER BY c DESC) AS rank_category_score FROM c),
m AS (SELECT *, list_sort([rank_pr, rank_title_score, rank_category_score])[2]::DOUBLE AS median_rank, (rank_pr + rank_title_score + rank_category_score) / 3.0::DOUBLE AS mean_rank FROM k)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, page_id) AS place FROM m"""
SQL = {
    "p6_found": f"SELECT query_id, page_id FROM ({_RANKED}) WHERE greatest(rank_pr, rank_title_score, rank_category_score) - 1 < items / 4",
    "p6_ranking": _RANKED,
    "p6_split": _RANKED,
}
