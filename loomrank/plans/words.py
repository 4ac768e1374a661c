"""Per-word results of the inverted index under skew: problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators import skew
from loomrank.operators.postings import TIERS, freq_of, packed, tier_is
from loomrank.sources.tables import saved, table

#: A word is found if it has this share of all low postings.
LOW_SHARE = 0.015
#: From this share on, and in however few rows, words count as heavy in p1_words_split and p1_list_totals.
SPLIT_SHARE = 0.002


def word_totals(postings: DataFrame, tiers: tuple[str, ...] | None = None, share: float | None = None, least: int = skew.LEAST_ROWS) -> DataFrame:
    """(word_val, pages, occurrences, title_pages, category_pages, high_pages, low_pages) of every word.

    pages counts distinct pages; occurrences sums freq, 0 where every freq is null. share, least: from when on a word is
    heavy, as in skew.heavy_keys.
    """
    totals = [F.count("*").alias("pages"), F.coalesce(F.sum(freq_of().cast("bigint")), F.lit(0)).alias("occurrences")]
    totals += [F.count(F.when(tier_is(t), 1)).alias(f"{t}_pages") for t in TIERS]
    rows = packed(postings, tiers)
    return skew.per_key(rows, "word_val", "page_id", "load", totals, skew.heavy_keys(rows, "word_val", share, least))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    words = saved(word_totals(table(spark, folder, "postings"), ("low",)).select("word_val", "pages"), "low_words")
    total = words.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    return words.where(F.col("pages") >= LOW_SHARE * total).select("word_val")


def p1_words(spark: SparkSession, folder: str) -> DataFrame:
    return word_totals(table(spark, folder, "postings"))


def p1_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(word_val, segment, n, items): the pages of every word with their freq, in sorted segments."""
    item = F.struct("page_id", freq_of().alias("freq"))
    return skew.per_key_lists(packed(table(spark, folder, "postings")), "word_val", "page_id", "load", item)


def p1_words_split(spark: SparkSession, folder: str) -> DataFrame:
    """p1_words where small tables have heavy words too."""
    return word_totals(table(spark, folder, "postings"), share=SPLIT_SHARE, least=1)


def p1_list_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(word_val, pages, page_sum, occurrences) of the lists of p1_lists, with heavy words in small tables too; lists are of 1,000 items at most."""
    rows = packed(table(spark, folder, "postings"))
    heavy = skew.heavy_keys(rows, "word_val", SPLIT_SHARE, 1)
    lists = skew.per_key_lists(rows, "word_val", "page_id", "load", F.struct("page_id", freq_of().alias("freq")), 1000, heavy)
    total = lambda c: F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[c].cast("bigint"), F.lit(0)))
    sums = [F.sum("n").alias("pages"), F.sum(total("page_id")).alias("page_sum"), F.sum(total("freq")).alias("occurrences")]
    return lists.groupBy("word_val").agg(*sums)


QUERIES = {f.__name__: f for f in (p1_found, p1_words, p1_lists, p1_words_split, p1_list_totals)}

_ONCE = "(SELECT word_val, page_id, max(freq) AS freq, max(tier) AS tier FROM postings WHERE word_val IS NOT NULL AND page_id IS NOT NULL GROUP BY word_val, page_id)"
SQL = {
    "p1_found": f"""
SELECT word_val FROM (SELECT word_val, count(*) AS n FROM {_ONCE} WHERE tier = 'low' GROUP BY word_val)
WHERE n >= {LOW_SHARE} * (SELECT count(*) FROM {_ONCE} WHERE tier = 'low')""",
    "p1_words": f"""
SELECT word_val, count(*) AS pages, CAST(coalesce(sum(freq), 0) AS BIGINT) AS occurrences,
{", ".join(f"count(*) FILTER (tier = '{t}') AS {t}_pages" for t in TIERS)}
FROM {_ONCE} GROUP BY word_val""",
    "p1_list_totals": f"SELECT word_val, count(*) AS pages, CAST(sum(page_id) AS BIGINT) AS page_sum, CAST(coalesce(sum(freq), 0) AS BIGINT) AS occurrences FROM {_ONCE} GROUP BY word_val",
}
SQL["p1_words_split"] = SQL["p1_words"]
