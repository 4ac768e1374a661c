"""Conjunctive ranked search over postings.

weight = sum over the words of a query of g * freq * (100 title, 30 category, 1 high), where g is the length of the
query's longest list divided by that of the word's, 100 at most and without fraction; score = PageRank * weight;
order: score, then page_id, both descending. All queries of a table are answered at once.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrank.config import DEFAULT, EngineConfig
from loomrank.functions.text import ascii_lower, stem, word_number
from loomrank.operators import index, links, skew
from loomrank.operators.index import stop_stems
from loomrank.operators.pagerank import pagerank
from loomrank.sources import dump
from loomrank.sources.tables import BROADCAST_ROWS, local_table, saved, settled

#: Up to so many different words or pages are named in the filter of a scan; more are joined.
MOST_NAMED = 2_000


def parse_query(queries: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, pos, word, stem, flags): the words of every query that are no stop words, pos from 0.

    Only a blank ends a word; other characters than letters are deleted from it. A colon ends a field prefix: flags
    is 1 after one that begins with t, 3 with c, else 7, and 7 without. Null and empty queries have no words.
    """
    words = F.split(F.regexp_replace(ascii_lower(F.col("query_text")), "[^a-z: ]", ""), " ")
    each = queries.where("query_id is not null").select("query_id", F.posexplode(words).alias("at", "raw"))
    before = F.regexp_extract("raw", "^(.*):", 1)
    prefix = F.regexp_extract(before, "([a-z])[a-z]*:?$", 1)
    flags = F.when(~F.col("raw").contains(":"), 7).when(prefix == "t", 1).when(prefix == "c", 3).otherwise(7)
    word = F.substring(F.regexp_extract("raw", "([^:]*)$", 1), 1, cfg.title_letters)
    each = each.select("query_id", "at", word.alias("word"), flags.alias("flags")).where("word <> ''").withColumn("stem", stem(F.col("word"), cfg.full_stemmer))
    kept = each.join(F.broadcast(stop_stems(queries.sparkSession, cfg)), "stem", "left_anti")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("at")) - 1  # the words of one query
    return kept.select("query_id", pos.alias("pos"), "word", "stem", "flags")


def next_words(terms: DataFrame, dictionary: DataFrame, drop_first: bool = False) -> DataFrame:
    """terms with their stem replaced by the first of the dictionary whose number isn't smaller; beyond the last, no row.

    Different words only, of both sides, are range-partitioned by number together and sorted within the ranges; where a
    range has no later entry, the first of the next range that has one counts. Ranges are as many as shuffle partitions.
    drop_first: terms that become the first entry of the dictionary have no row either.
    """
    given = terms.select("stem").where("stem is not null").distinct()
    both = [d.select("stem", word_number(F.col("stem")).alias("number"), F.lit(e).alias("entry")) for d, e in ((dictionary.select("stem").distinct(), True), (given, False))]
    both = saved(both[0].unionByName(both[1]).repartitionByRange("number").withColumn("range", F.spark_partition_id()), "numbers")
    back = Window.partitionBy("range").orderBy(F.desc("number"), F.desc("entry")).rowsBetween(Window.unboundedPreceding, 0)
    entry = F.when(F.col("entry"), F.col("stem"))
    own = both.withColumn("found", F.last(entry, ignorenulls=True).over(back)).where("not entry")
    ranges = both.groupBy("range").agg(F.min_by(entry, F.when(F.col("entry"), F.col("number"))).alias("first"))
    later = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    ranges = F.broadcast(ranges.select("range", F.first("first", ignorenulls=True).over(later).alias("next")))
    became = own.join(ranges, "range").select("stem", F.coalesce("found", "next").alias("became")).where("became is not null")
    if drop_first:
        first = both.where("entry").agg(F.min_by("stem", "number")).first()[0]
        became = became.where(F.col("became") != F.lit(first))
    return skew.lookup(terms, settled(became, "next_words"), "stem").drop("stem").withColumnRenamed("became", "stem")


def searchable(postings: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return postings if cfg.include_low else postings.where(F.col("tier") != "low")


def merged_weight(cfg: EngineConfig = DEFAULT) -> Column:
    """freq times the weight of the posting's tier."""
    by = F.when(F.col("tier") == "title", cfg.title_weight).when(F.col("tier") == "category", cfg.category_weight).otherwise(1)
    return F.col("freq").cast("bigint") * by


def _one_of(key: str, values: list) -> Column:
    """key is one of the numbers or strings; as one text, since a call for every value takes longer than the search."""
    if not values:
        return F.lit(False)
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"`{key}` in ({','.join(quoted(v) if isinstance(v, str) else str(v) for v in values)})")


def named(df: DataFrame, key: str, few: DataFrame, name: str) -> DataFrame:
    """The rows of df whose key stands in few: by a filter that reaches the scan, by broadcast, or by a join, as few is larger."""
    few = few.select(key).where(F.col(key).isNotNull()).distinct()
    rows = few.limit(MOST_NAMED + 1).toArrow()
    if rows.num_rows <= MOST_NAMED:
        return df.where(_one_of(key, rows.column(0).to_pylist()))
    few = saved(few, name)
    return df.join(F.broadcast(few), key, "left_semi") if few.count() <= BROADCAST_ROWS else skew.skew_join(df, few, key)


def weighted_terms(terms: DataFrame, dictionary: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, pos, flags, stem, words, list_pages, g): the terms with the number of words of their query, the length of
    their list and its weight; both null for a word without a list. dictionary: the entries of these words."""
    length = F.col("pages") if cfg.include_low else F.col("searchable")
    if cfg.enforce_fields:
        low = F.col("title_pages") + F.when(F.col("flags") == 3, F.col("category_pages")).otherwise(0)
        length = F.when(F.col("flags") == 7, length).otherwise(low)
    known = dictionary.select("stem", "pages", "searchable", "title_pages", "category_pages")
    query = Window.partitionBy("query_id")  # the words of one query
    rows = skew.lookup(terms.select("query_id", "pos", "flags", "stem"), settled(known, "dictionary"), "stem", "left")
    rows = rows.select("query_id", "pos", "flags", "stem", F.count("*").over(query).alias("words"), F.when(length > 0, length).alias("list_pages"))
    g = F.least(F.lit(cfg.most_list_weight).cast("bigint"), F.expr("longest div list_pages"))
    return rows.withColumn("longest", F.max("list_pages").over(query)).withColumn("g", g).drop("longest")


def hits(terms: DataFrame, postings: DataFrame, cfg: EngineConfig = DEFAULT, dictionary: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, page_id, weight, words, list_pages, g): the lists of every word; columns as in weighted_terms.

    Only lists of the words are read. While the words are few enough they are broadcast, and no posting is shuffled.
    Beyond that a frequent word doesn't crowd one task: its postings are spread, and its words of queries repeated; the
    dictionary tells which words are frequent. dictionary: as index.dictionary gives it, by default from the postings.
    """
    terms = settled(terms, "terms")
    lists = named(postings, "stem", terms, "stems")
    dictionary = index.dictionary(lists) if dictionary is None else named(dictionary, "stem", terms, "stems")
    weighted = settled(weighted_terms(terms, dictionary, cfg).where("g is not null"), "weighted_terms")
    lists = searchable(lists, cfg).select("stem", "page_id", "tier", merged_weight(cfg).alias("weight"))
    if weighted.count() <= BROADCAST_ROWS:
        found = lists.join(F.broadcast(weighted), "stem")
    else:
        sizes = weighted.groupBy("stem").agg(F.max("list_pages").alias("estimate"))
        least = skew.heavy_share(postings.sparkSession) * (sizes.agg(F.sum("estimate")).first()[0] or 0)
        heavy = sizes.where(F.col("estimate") >= max(least, skew.LEAST_ROWS)).collect()  # 1 / share rows at most
        kind = postings.schema["stem"].dataType.simpleString()
        found = skew.salted_join(lists, weighted, "stem", "page_id", local_table(postings.sparkSession, heavy, f"stem {kind}, estimate bigint"))
    if cfg.enforce_fields:
        found = found.where((F.col("flags") == 7) | (F.col("tier") == "title") | ((F.col("flags") == 3) & (F.col("tier") == "category")))
    return found.select("query_id", "pos", "page_id", "weight", "words", "list_pages", "g")


def conjunctive(terms: DataFrame, postings: DataFrame, cfg: EngineConfig = DEFAULT, dictionary: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, weight): the pages that all words of a query have; a repeated word counts as often as it stands."""
    found = hits(terms, postings, cfg, dictionary)
    pages = found.groupBy("query_id", "page_id").agg(F.sum(F.col("g") * F.col("weight")).alias("weight"), F.count("*").alias("n"), F.max("words").alias("words"))
    return pages.where("n = words").select("query_id", "page_id", "weight")


def rank_list(weights: DataFrame, ranks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, rank, page_id, score): the best pages of every query, rank from 0; pages without a rank are left out.

    ranks: a row per page at most. A page that very many queries find doesn't crowd one task, and a query with very many
    pages brings its best of every task only.
    """
    scored = skew.lookup(weights, ranks.select("page_id", "pr"), "page_id").withColumn("score", F.col("pr") * F.col("weight"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("page_id"))) - 1
    return scored.withColumn("rank", place).where(F.col("rank") < cfg.results).select("query_id", "rank", "page_id", "score")


def answer(
    terms: DataFrame, postings: DataFrame, ranks: DataFrame, titles: DataFrame, cfg: EngineConfig = DEFAULT, dictionary: DataFrame | None = None
) -> DataFrame:
    """(query_id, rank, page_id, title, score) for the terms of queries; titles in lower case.

    Candidates, and then the results, 10 a query, choose what is read of ranks and titles.
    """
    candidates = saved(conjunctive(terms, postings, cfg, dictionary), "candidates")
    best = settled(rank_list(candidates, saved(named(ranks, "page_id", candidates, "pages"), "ranks"), cfg), "best")
    chosen = named(titles.select("page_id", ascii_lower(F.col("title")).alias("title")), "page_id", best, "pages")
    return best.join(chosen, "page_id").select("query_id", "rank", "page_id", "title", "score")


def search_batch(
    queries: DataFrame, postings: DataFrame, ranks: DataFrame, titles: DataFrame, cfg: EngineConfig = DEFAULT, dictionary: DataFrame | None = None
) -> DataFrame:
    """answer() for a table of query_id and query_text."""
    terms = parse_query(queries, cfg)
    if cfg.lower_bound:
        terms = next_words(terms, postings if dictionary is None else dictionary, cfg.drop_first_word)
    return answer(terms, postings, ranks, titles, cfg, dictionary)


class Engine:
    """Builds an index over pages, saves and loads it, and answers queries.

    Tables of an engine: titles (page_id, title), edges (src, dst), degrees (page_id, n), ranks (page_id, pr), postings,
    dictionary, and files (file_name, first_id) of a dump, else None.
    """

    TABLES = ("titles", "edges", "degrees", "ranks", "postings", "dictionary", "files")

    def __init__(self, spark: SparkSession, cfg: EngineConfig = DEFAULT, **tables: DataFrame | None):
        self.spark, self.cfg = spark, cfg
        for name in self.TABLES:
            setattr(self, name, tables.pop(name, None))
        if tables:
            raise TypeError(f"no such tables: {sorted(tables)}")

    def build(self, pages: DataFrame) -> "Engine":
        """pages: page_id, title, text, and maybe file_name. They are saved first and read from there."""
        kept = [c for c in ("page_id", "file_name", "title", "text") if c in pages.columns]
        pages = saved(pages.select(kept), "pages")
        self.titles = pages.select("page_id", "title")
        self.files = dump.first_ids(pages) if "file_name" in kept else None
        self.edges = saved(links.distinct_edges(links.resolve_links(links.extract_links(pages), pages, self.cfg)), "graph")
        self.degrees = links.out_degree(self.edges, pages)
        self.ranks = pagerank(self.edges, pages, self.cfg)
        self.postings = saved(index.postings_of(pages, self.cfg), "postings")
        self.dictionary = saved(index.dictionary(self.postings), "dictionary")
        return self

    def save(self, path: str) -> None:
        """Writes the tables to a folder: lists by tier and in the order of stems, edges in that of back-links, the rest by page."""
        at = path.rstrip("/")
        by_page = lambda df, *keys: df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        orders = {"titles": ("page_id",), "edges": ("dst", "src"), "degrees": ("page_id",), "ranks": ("page_id",), "files": ("file_name",)}
        for name, keys in orders.items():
            if getattr(self, name) is not None:
                by_page(getattr(self, name), *keys).write.mode("overwrite").parquet(f"{at}/{name}")
        index.write_index(self.postings, f"{at}/postings")
        index.write_dictionary(self.postings, f"{at}/dictionary")
        settings = local_table(self.spark, [(json.dumps(dataclasses.asdict(self.cfg)),)], "value string")
        settings.coalesce(1).write.mode("overwrite").text(f"{at}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str, cfg: EngineConfig | None = None) -> "Engine":
        """The engine that save() wrote; cfg: other parameters of the search than those it was built with."""
        at = path.rstrip("/")
        if cfg is None:
            read = json.loads(spark.read.text(f"{at}/settings").first()["value"])
            cfg = EngineConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in read.items()})
        there = {}
        for name in cls.TABLES:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
            if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
                there[name] = spark.read.parquet(f"{at}/{name}")
        return cls(spark, cfg, **there)

    def search(self, text: str | None) -> DataFrame:
        """(rank, page_id, title, score), best first."""
        return self.search_batch(local_table(self.spark, [(0, text)], "query_id bigint, query_text string")).drop("query_id").orderBy("rank")

    def search_batch(self, queries: DataFrame) -> DataFrame:
        return search_batch(queries, self.postings, self.ranks, self.titles, self.cfg, self.dictionary)

    def counters(self) -> DataFrame:
        """(pages, words, postings, edges) of the index."""
        counts = {"pages": self.titles, "words": self.dictionary, "postings": self.postings, "edges": self.edges}
        return local_table(self.spark, [tuple(df.count() for df in counts.values())], ", ".join(f"{c} bigint" for c in counts))
