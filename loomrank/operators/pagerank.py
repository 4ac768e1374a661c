"""PageRank by simultaneous updates.

The rank of a page is 0.15 / (N + 1) plus 0.85 times the sum of its sources' rank / out-degree, N being the
number of pages. Pages without links are updated once at the end, and their rank isn't passed on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomrank.config import DEFAULT, EngineConfig
from loomrank.operators import skew
from loomrank.operators.links import distinct_edges, out_degree
from loomrank.sources.tables import delete, save, saved


def start(page_ids: DataFrame) -> DataFrame:
    """(page_id, pr): 1 / (N + 1) each."""
    ids = page_ids.select("page_id").distinct()
    return ids.withColumn("pr", F.lit(1.0 / (ids.count() + 1)))


def step(ranks: DataFrame, edges: DataFrame, base: float, dangling: bool, damping: float, hot: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One update of the pages that have links, or (dangling) of those that have none.

    ranks: page_id, n (out-degree), pr; edges: distinct. The sum by target combines before its shuffle, so that a
    page with very many sources is no burden. hot: further edges, whose sources have too many for one task, and these src.
    """
    give = ranks.where("n > 0").select(F.col("page_id").alias("src"), (F.col("pr") / F.col("n")).alias("part"))
    given = edges.join(give, "src").select("dst", "part")
    if hot:
        given = given.unionByName(hot[0].join(F.broadcast(give.join(F.broadcast(hot[1]), "src", "left_semi")), "src").select("dst", "part"))
    got = given.groupBy(F.col("dst").alias("page_id")).agg(F.sum("part").alias("got"))
    new = F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
    takes = F.col("n") == 0 if dangling else F.col("n") > 0
    return ranks.join(got, "page_id", "left").select("page_id", "n", F.when(takes, new).otherwise(F.col("pr")).alias("pr"), F.col("pr").alias("old"))


def most_rounds(cfg: EngineConfig) -> int:
    """So many rounds are enough: the sum of absolute changes, 2 at most, falls by the damping factor every round."""
    if not 0 <= cfg.damping < 1 or cfg.stop_residual <= 0:
        raise ValueError("damping must be below 1, and stop_residual above 0")
    return 2 + max(0, math.ceil(math.log(math.sqrt(cfg.stop_residual) / 2) / math.log(cfg.damping))) if cfg.damping else 2


def pagerank(edges: DataFrame, page_ids: DataFrame, cfg: EngineConfig = DEFAULT, rounds: int | None = None, residuals: list[float] | None = None) -> DataFrame:
    """(page_id, pr) of every page.

    Rounds go on until the sum of squared changes is stop_residual at most, or exactly `rounds` times; `residuals`
    takes that sum of every round. A round is one job: its ranks are written to the shared folder, which cuts the
    lineage, the changes are summed on the way, and the ranks of the round before are deleted. Edges are kept
    partitioned by source, so that a round shuffles ranks and sums only; those of sources with a heavy share of all
    edges stay where they are and meet a broadcast. Edges to or from pages that aren't in page_ids are ignored.
    """
    spark, ids = edges.sparkSession, page_ids.select("page_id").where("page_id is not null").distinct()
    inside = distinct_edges(edges).join(ids.withColumnRenamed("page_id", "src"), "src", "left_semi")
    known = saved(inside.join(ids.withColumnRenamed("page_id", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
    total = ids.count()
    base = (1 - cfg.damping) / (total + 1)
    heavy = skew.heavy_keys(known, "src").select("src")
    links = known.join(F.broadcast(heavy), "src", "left_anti").repartition("src").persist()
    hot = known.join(F.broadcast(heavy), "src", "left_semi"), heavy
    ranks, path = save(out_degree(known, ids).withColumn("pr", F.lit(1.0 / (total + 1))), "ranks")
    most = most_rounds(cfg) if rounds is None else rounds
    for _ in range(most):
        seen, before = Observation(), path
        new = step(ranks, links, base, False, cfg.damping, hot).observe(seen, F.sum((F.col("pr") - F.col("old")) ** 2).alias("residual"))
        ranks, path = save(new.drop("old"), "ranks")
        delete(spark, before)
        residual = seen.get["residual"] or 0.0
        if residuals is not None:
            residuals.append(residual)
        if rounds is None and residual <= cfg.stop_residual:
            break
    else:
        if rounds is None:
            raise ArithmeticError(f"no convergence within {most} rounds")
    last = saved(step(ranks, links, base, True, cfg.damping, hot).select("page_id", "pr"), "pagerank")
    delete(spark, path)
    links.unpersist()
    return last
