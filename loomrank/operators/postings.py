"""Postings (word_val, page_id, freq, tier) with repeated and dirty rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("title", "category", "high", "low")
_LEAST = -(2**31)
_SHIFT = 33


def tier_code(tier: Column) -> Column:
    code = F.lit(len(TIERS))
    for i, t in enumerate(TIERS):
        code = F.when(tier == t, i).otherwise(code)
    return F.coalesce(code, F.lit(len(TIERS)))


def packed(postings: DataFrame, tiers: tuple[str, ...] | None = None) -> DataFrame:
    """(word_val, page_id, load): tier and freq in one BIGINT, which hash aggregation keeps in place.

    Rows without word_val or page_id are ignored. Rows of a tier not in TIERS are kept as `other`.
    """
    rows = postings.where(F.col("word_val").isNotNull() & F.col("page_id").isNotNull())
    if tiers:
        rows = rows.where(F.col("tier").isin(*tiers))
    freq = F.coalesce(F.col("freq").cast("bigint") - _LEAST + 1, F.lit(0).cast("bigint"))
    return rows.select(
        F.col("word_val").cast("bigint").alias("word_val"),
        F.col("page_id").cast("bigint").alias("page_id"),
        F.shiftleft(tier_code(F.col("tier")).cast("bigint"), _SHIFT).bitwiseOR(freq).alias("load"),
    )


def freq_of(load: str = "load") -> Column:
    low = F.col(load).bitwiseAND(F.lit(2**_SHIFT - 1).cast("bigint"))
    return F.when(low > 0, (low - 1 + _LEAST).cast("int"))


def tier_of(load: str = "load") -> Column:
    return F.shiftright(load, _SHIFT).cast("int")


def tier_is(name: str, load: str = "load") -> Column:
    return tier_of(load) == TIERS.index(name)


def distinct_postings(postings: DataFrame, tiers: tuple[str, ...] | None = None) -> DataFrame:
    """(word_val, page_id, freq, tier_no): every pair once.

    Rows of a pair carry the same tier and freq; should they differ, the last tier of TIERS and then
    the greatest freq count, null last.
    """
    once = packed(postings, tiers).groupBy("word_val", "page_id").agg(F.max("load").alias("load"))
    return once.select("word_val", "page_id", freq_of().alias("freq"), tier_of().alias("tier_no"))
