"""The link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.config import DEFAULT, EngineConfig
from loomrank.functions.text import ascii_lower, title_number
from loomrank.operators import skew
from loomrank.sources.tables import saved

#: A media prefix takes only itself, so that links within a caption are found; an unclosed link gives nothing.
LINK = r"(?s)\[\[(?:(?:Image|File):|(.*?)(?:\||\]\]))"


def extract_links(pages: DataFrame) -> DataFrame:
    """(src, target): every link of a page before its first [[Category:, as often as it stands there."""
    body = F.substring_index("text", "[[Category:", 1)
    found = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all(body, F.lit(LINK), F.lit(1))).alias("target"))
    return found.where(F.coalesce("target", F.lit("")) != "")


def _key(c: str, cfg: EngineConfig):
    return title_number(F.col(c)) if cfg.match_by_number else ascii_lower(F.col(c))


def title_dict(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(title_key, page_id): of pages with the same title the last counts."""
    return pages.groupBy(_key("title", cfg).alias("title_key")).agg(F.max("page_id").alias("page_id"))


def _targets(links: DataFrame, pages: DataFrame, cfg: EngineConfig) -> DataFrame:
    """links with their dst. Both sides are saved first: links, as sketch and join need them, and titles, whose number decides the join."""
    keyed = saved(links.withColumn("title_key", _key("target", cfg)), "links")
    return skew.lookup(keyed, saved(title_dict(pages, cfg).withColumnRenamed("page_id", "dst"), "title_keys"), "title_key", "left")


def resolve_links(links: DataFrame, pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(src, dst, target): the links whose target is a title. A popular target doesn't crowd one task."""
    return _targets(links, pages, cfg).where("dst is not null").select("src", "dst", "target")


def unresolved_links(links: DataFrame, pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(src, target): the links whose target is no title."""
    return _targets(links, pages, cfg).where("dst is null").select("src", "target")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) once each, without unresolved links; links of a page to itself stay."""
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def out_degree(edges: DataFrame, page_ids: DataFrame) -> DataFrame:
    """(page_id, n): the distinct targets of every page, 0 for pages without links."""
    n = distinct_edges(edges).groupBy("src").agg(F.count("*").alias("n"))
    return page_ids.select("page_id").distinct().join(n, F.col("src") == F.col("page_id"), "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n"))


def backlinks(edges: DataFrame, length: int = 50_000) -> DataFrame:
    """(dst, segment, n, items): the sources that link to a page, ascending; long lists in several segments."""
    rows = distinct_edges(edges).withColumn("load", F.lit(0))
    return skew.per_key_lists(rows, "dst", "src", "load", F.col("src"), length)


def corpus_stats(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(pages, titles, links, found): distinct edges are found; links also counts unresolved occurrences."""
    targets = _targets(extract_links(pages), pages, cfg)
    edges = targets.agg(F.count_distinct(F.when(F.col("dst").isNotNull(), F.struct("src", "dst"))).alias("found"), F.count(F.when(F.col("dst").isNull(), 1)).alias("lost"))
    counts = pages.agg(F.count("*").alias("pages"), F.count_distinct(_key("title", cfg)).alias("titles"))
    none = F.lit(0).cast("bigint")
    both = counts.select("pages", "titles", none.alias("found"), none.alias("lost")).unionByName(edges.select(none.alias("pages"), none.alias("titles"), "found", "lost"))
    return both.agg(*[F.sum(c).alias(c) for c in ("pages", "titles")], (F.sum("found") + F.sum("lost")).alias("links"), F.sum("found").alias("found"))
