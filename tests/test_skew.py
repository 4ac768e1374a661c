from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomrank.operators import skew
from loomrank.operators.postings import distinct_postings
from loomrank.plans.words import word_totals

SCHEMA = "word_val bigint, page_id bigint, freq int, tier string, estimate string, load string"


@pytest.fixture(scope="module")
def postings(spark):
    rows = [(7, i, 1 + i % 5, "low", "x", None) for i in range(3000)] * 2
    rows += [(w, p, w, "title", None, "y") for w in range(100, 130) for p in range(w % 7)]
    rows += [(None, 1, 1, "low", None, None), (8, None, 1, "low", None, None), (9, 1, None, "high", None, None), (9, 2, 3, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def totals(rows):
    once = {(w, p): f for w, p, f, *_ in rows if w is not None and p is not None}
    pages, occurrences = Counter(w for w, _ in once), Counter()
    for (w, _), f in once.items():
        occurrences[w] += f or 0
    return {w: (pages[w], occurrences[w]) for w in pages}


def test_heavy_keys(postings, spark):
    assert {r[0] for r in skew.heavy_keys(postings, "word_val", 0.2, 1).collect()} == {7}
    assert skew.heavy_keys(postings, "word_val").count() == 0  # too few rows to matter
    assert skew.heavy_keys(postings.limit(0), "word_val", 0.2, 1).count() == 0
    assert skew.heavy_keys(spark.createDataFrame([("a",)] * 5, "k string"), "k", 0.2, 1).collect()[0][0] == "a"


@pytest.mark.parametrize("share", [0.2, None])
def test_per_key(postings, share):
    from loomrank.operators.postings import freq_of, packed

    rows = packed(postings)
    heavy = skew.heavy_keys(rows, "word_val", share, 1 if share else 10_000)
    got = skew.per_key(rows, "word_val", "page_id", "load", [F.count("*").alias("n"), F.sum(F.coalesce(freq_of(), F.lit(0))).alias("s")], heavy)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == totals(postings.collect())
    empty = skew.per_key(rows.limit(0), "word_val", "page_id", "load", [F.count("*").alias("n")])
    assert empty.count() == 0


@pytest.mark.parametrize("share", [0.2, None])
def test_lists_are_complete_and_short(postings, share):
    from loomrank.operators.postings import packed

    rows = packed(postings)
    heavy = skew.heavy_keys(rows, "word_val", share, 1 if share else 10_000)
    lists = skew.per_key_lists(rows, "word_val", "page_id", "load", F.col("page_id"), 500, heavy).collect()
    found = defaultdict(list)
    for r in lists:
        assert r["n"] == len(r["items"]) and r["items"] == sorted(r["items"])
        assert r["n"] <= 700
        found[r["word_val"]] += r["items"]
    want = defaultdict(set)
    for w, p, *_ in postings.collect():
        if w is not None and p is not None:
            want[w].add(p)
    assert {w: sorted(x) for w, x in found.items()} == {w: sorted(x) for w, x in want.items()}
    assert sum(r["word_val"] == 7 for r in lists) >= 6


def test_word_totals_of_conflicting_rows(spark):
    rows = [(1, 1, 2, "low", None, None), (1, 1, 5, "low", None, None), (1, 1, None, "low", None, None)]
    r = word_totals(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(x["pages"], x["occurrences"], x["low_pages"]) for x in r] == [(1, 5, 1)]
    d = distinct_postings(spark.createDataFrame([(1, 1, -3, "high", None, None), (1, 2, None, "odd", None, None)], SCHEMA)).collect()
    assert {(x["page_id"], x["freq"], x["tier_no"]) for x in d} == {(1, -3, 2), (2, None, 4)}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [0.2, None])
def test_skew_join(postings, spark, how, share):
    right = spark.createDataFrame([(7, "seven", 1), (101, "x", 2), (None, "n", 3)], "word_val bigint, name string, freq int")
    heavy = skew.heavy_keys(postings, "word_val", share, 1 if share else 10_000)
    a = skew.skew_join(postings.select("word_val", "page_id", "freq"), right, "word_val", how, heavy)
    assert a.columns == ["word_val", "page_id", "freq", "name", "freq_right"]
    b = postings.select("word_val", "page_id", "freq").join(right.withColumnRenamed("freq", "freq_right"), "word_val", how)
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_salted_join(postings, spark):
    right = spark.createDataFrame([(7, 1), (7, 2), (105, 3), (None, 4)], "word_val bigint, query_id int")
    left = postings.select("word_val", "page_id")
    want = Counter(map(tuple, left.join(right, "word_val").collect()))
    for heavy in (skew.heavy_keys(postings, "word_val", 0.1, 1), skew.heavy_keys(postings.limit(0), "word_val")):
        assert Counter(map(tuple, skew.salted_join(left, right, "word_val", "page_id", heavy).collect())) == want


def test_running_sum(spark):
    df = spark.createDataFrame([(g, i, i % 3) for g in (1, 2) for i in range(200)], "g int, i int, w int").repartition(5)
    got = {(r["g"], r["i"]): r["before"] for r in skew.running_sum(df, "g", [F.desc("i")], F.col("w"), "before").collect()}
    assert got == {(g, i): sum(j % 3 for j in range(i + 1, 200)) for g in (1, 2) for i in range(200)}
