"""Dumps of several files and blocks, repeated deliveries, saved indexes, the command line, intermediate results."""

import io
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from loomrank import __main__ as program
from loomrank.config import EngineConfig
from loomrank.operators import search
from loomrank.sources import dump, tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, at = random.Random(3), tmp_path_factory.mktemp("dump")
    for name, pages in (("xab", 37), ("xaa", 80), ("xac", 1), ("xad", 0), ("other", 5)):
        record = lambda i: f"  <page>\n<title>{name} &amp; {i}</title><id>{i}</id>\n<text xml:space=\"preserve\">{'word ' * r.randrange(30)}[[xaa &amp; {i % 9}]]</text>\n</page>\n"
        (at / name).write_text("<mediawiki>\n<siteinfo>x</siteinfo>\n" + "".join(map(record, range(pages))) + "</mediawiki>\n")
    return str(at)


@pytest.mark.parametrize("size", ["128m", "700b"])
def test_dump_of_several_files_and_blocks(spark, folder, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = dump.read_dump(spark, folder)
        blocks = rows.select("file_name", "block").distinct().count()
        assert blocks == 3 if size == "128m" else blocks > 10
        got = [(r["page_id"], r["file_name"], r["seq"], r["title"]) for r in dump.numbered(rows).orderBy("page_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    pages = [("xaa", i) for i in range(80)] + [("xab", i) for i in range(37)] + [("xac", 0)]
    assert got == [(k + 1, f, i, f"{f} &amp; {i}") for k, (f, i) in enumerate(pages)]


def test_numbering_reads_the_dump_once_and_shuffles_no_text(spark, folder):
    plan = _plan(dump.numbered(dump.read_dump(spark, folder)))
    assert "Exchange hashpartitioning" not in plan and "FileScan text" not in plan


ROWS = [(1, "a", "x", 5), (1, "b", "y", 3), (1, "c", "y", 3), (2, "d", None, None), (2, "e", None, 1), (3, None, None, 1), (None, "f", "z", 1), (None, "g", "z", 1), (4, "h", "", 2), (4, "h", "", 2)]


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("files", [True, False])
def test_repeated_deliveries(spark, tmp_path, files, limit, monkeypatch):
    df = spark.createDataFrame(ROWS, "page_id bigint, title string, text string, loaded_at int").repartition(3)
    if files:
        df.write.parquet(f"{tmp_path}/page")
        df = spark.read.parquet(f"{tmp_path}/page")
    if limit is not None:
        monkeypatch.setattr("loomrank.operators.skew.BROADCAST_ROWS", limit)
    once = dump.delivered_once(df, "page_id", ["page_id", "text", "title"])
    got = {r["page_id"]: r["title"] for r in once.collect()}
    assert once.columns == ["page_id", "text", "title"] and once.count() == 4
    assert got == {1: got[1], 2: "d", 3: None, 4: "h"} and got[1] in "bc"
    assert dump.delivered_once(df.limit(0), "page_id", ["page_id", "text"]).count() == 0


def test_texts_are_not_shuffled_and_titles_read_alone(spark, data, tmp_path):
    page = spark.read.parquet(f"{data}/page.parquet")
    assert "Exchange hashpartitioning(page_id" in _plan(dump.pages(page))  # one small file: spread over the cores
    page.repartition(20).write.parquet(f"{tmp_path}/page")
    page = spark.read.parquet(f"{tmp_path}/page")
    plan = _plan(dump.pages(page))
    assert "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan and plan.count("FileScan") == 2
    assert "text:string" not in _plan(dump.pages(page).select("page_id", "title"))


@pytest.fixture(scope="module")
def saved_engine(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    pages = [(1, "Alpha Beta", "see [[Gamma Ray]]"), (2, "Gamma Ray", "[[Alpha Beta]] [[Delta]]"), (3, "Delta", "omega " * 9 + "[[Alpha Beta]]"), (4, "Other", "none [[Category:Greek letters|x]]")]
    df = spark.createDataFrame(pages, "page_id bigint, title string, text string").withColumn("file_name", F.lit("xaa"))
    built = search.Engine(spark, EngineConfig(stop_words=("the", "see"))).build(df)
    built.save(at)
    return built, search.Engine.load(spark, at), at


def test_saved_index_answers_alike(spark, saved_engine):
    built, loaded, _ = saved_engine
    assert loaded.cfg == built.cfg
    for name in search.Engine.TABLES:
        a, b = getattr(built, name), getattr(loaded, name)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    for query in ("gamma", "alpha beta", "omega", "the", "greek", "Gamma, ray", None, "nothing"):
        assert loaded.search(query).collect() == built.search(query).collect()
    assert [r["title"] for r in loaded.search("omega").collect()] == ["delta"]
    assert tuple(loaded.counters().first()) == (4, built.dictionary.count(), built.postings.count(), 4)


def test_search_reads_only_the_lists_of_its_words(spark, saved_engine):
    _, loaded, _ = saved_engine
    terms = search.parse_query(spark.createDataFrame([(1, "gamma ray")], "query_id bigint, query_text string"), loaded.cfg)
    plan = _plan(search.hits(terms, loaded.postings, loaded.cfg, loaded.dictionary))
    pushed = re.search(r"PartitionFilters: \[.*?low.*?\], PushedFilters: \[(.*?)\], ReadSchema", plan.replace("\n", " "))
    assert pushed and "In(stem, [gamma,rai])" in pushed[1], plan
    assert "approx_top_k" not in plan and "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_named_values_of_any_kind(spark):
    values = ["a", "it's", "back\\slash", 'say "x"', "ü", ""]
    df = spark.createDataFrame([(v,) for v in [*values, "b", None]], "v string")
    assert {r["v"] for r in search.named(df, "v", df.where("v <> 'b'"), "values").collect()} == set(values)
    numbers = spark.createDataFrame([(-5,), (2**62,), (3,), (None,)], "v bigint")
    assert {r["v"] for r in search.named(numbers, "v", numbers.where("v <> 3"), "values").collect()} == {-5, 2**62}
    assert search.named(df, "v", df.limit(0), "values").count() == 0


def test_larger_batches_take_joins(spark, saved_engine, monkeypatch):
    _, loaded, _ = saved_engine
    ask = spark.createDataFrame([(1, "gamma"), (2, "alpha beta"), (3, "omega"), (4, "greek"), (5, "alpha ray"), (6, "nothing alpha")], "query_id bigint, query_text string")
    want = sorted(map(tuple, loaded.search_batch(ask).collect()))
    monkeypatch.setattr("loomrank.operators.search.MOST_NAMED", 1)
    assert sorted(map(tuple, loaded.search_batch(ask).collect())) == want
    monkeypatch.setattr("loomrank.operators.search.BROADCAST_ROWS", 1)
    monkeypatch.setattr("loomrank.operators.skew.BROADCAST_ROWS", 1)
    monkeypatch.setattr("loomrank.operators.skew.LEAST_ROWS", 1)
    assert sorted(map(tuple, loaded.search_batch(ask).collect())) == want and len(want) == 4


def test_command_line(spark, saved_engine, folder, tmp_path, capsys):
    at = f"{tmp_path}/index"
    program.main(["build", folder, at])
    assert "118" in capsys.readouterr().out and sorted(os.listdir(at)) == sorted([*search.Engine.TABLES, "settings"])
    program.main(["ask", at, "xac", "xaa amp"])
    lines = capsys.readouterr().out.split("\n")
    assert lines[0] == "0 : xac &amp; 0" and lines[1].startswith("Time ") and lines[3].startswith("0 : xaa &amp; ") and "9 : " in lines[12]
    out = io.StringIO()
    program.ask(search.Engine.load(spark, at), ["xac\n"], out)
    assert out.getvalue().startswith("0 : xac &amp; 0\nTime ")


def test_intermediate_results_are_deleted(spark):
    df, path = tables.save(spark.range(5).toDF("n"), "numbers")
    assert df.count() == 5 and os.path.exists(path)
    tables.delete(spark, path)
    assert not os.path.exists(os.path.dirname(path))
    with pytest.raises(ValueError):
        tables.delete(spark, path)
    with tables.temporary(spark):
        other = tables.save(spark.range(5).toDF("n"), "numbers")[1]
        assert os.path.exists(other)
    assert not os.path.exists(other)


def test_small_tables_stay_local(spark):
    small, large = tables.settled(spark.range(5).toDF("n"), "few"), tables.settled(spark.range(50).toDF("n"), "many", 20)
    assert "LocalTableScan" in _plan(small) and "FileScan" in _plan(large) and small.count() == 5 and large.count() == 50
    with pytest.raises(ValueError):
        from loomrank.operators.skew import heavy_keys

        heavy_keys(small, "n", 1e-6)
