"""Queries against their SQL on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomrank.functions import text
from tests.compare import compare, duck

NAMES = ["scan_pages", "extract_text", "category_tokens", "stem", "term_freq", "resolve_links", "backlinks", "pagerank_rounds", "lookup_lower_bound", "search_batch", "p1_found", "p1_words"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, data, name):
    assert compare(spark, duck(data), name, entry.queries()[name], entry.oracle_sql()[name], data) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["delta_backlinks", "delta_encode", "delta_decode", "backlink_bytes", "posting_unpack", "pagerank", "engine", "search_saved", "search_lower_bound", "dump_round_trip"])
def test_more_same_as_sql(spark, data, name):
    assert compare(spark, duck(data), name, entry.queries()[name], entry.oracle_sql()[name], data) is None


def test_lists_of_all_tiers_are_gap_coded(spark, data):
    ids = entry.queries()["delta_decode"](spark, data)
    got = ids.select("word_val", "tier", F.explode(F.split("ids", ",").cast("array<bigint>")).alias("page_id"))
    want = spark.read.parquet(f"{data}/postings.parquet").where("word_val is not null and page_id is not null").select("word_val", "tier", "page_id").distinct()
    assert {r["tier"] for r in ids.select("tier").distinct().collect()} == {"title", "category", "high", "low"}
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 513, 50_000])
def test_undeltas(spark, n):
    ids = [3 * i + i % 2 + 2**40 for i in range(n)]
    df = spark.createDataFrame([(ids,), (None,)], "ids array<bigint>")
    back = df.select(text.undeltas(text.deltas(F.col("ids"))).alias("ids")).collect()
    assert [r["ids"] for r in back] == [ids, None]
