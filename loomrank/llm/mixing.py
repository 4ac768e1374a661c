"""Sources mixed to target weights by hash-threshold histograms: problem 8.

Documents are ordered by a hash. Tokens are summed by source and leading hash bits; the bucket in which a
source's budget ends is refined by the next bits, again and again, until it holds one document. Selection is
then a comparison of each document's hash with its source's threshold: nothing is sorted. Thresholds of
smaller budgets lie below those of larger ones, so selections are nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrank.sources.tables import local_table, saved, table

HASH_BITS, STEP_BITS = 60, 12


@dataclass
class Source:
    """share and repeats as asked; tokens there are; target and tokens chosen; copies of all, and of hashes below the threshold one more."""

    share: float
    repeats: int
    tokens: int = 0
    target: float = 0.0
    chosen: int = 0
    copies: int = 0
    threshold: int = 0

    @property
    def short(self) -> bool:
        return self.repeats * self.tokens < self.target


def source_key(source: Column) -> Column:
    """source in lower case, without white space around it."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}\x{85}\x1c-\x1f]+|[\s\p{Z}\x{85}\x1c-\x1f]+$", ""))


def _rows(documents: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, h) of the documents of a listed source. weights is a short list by contract."""
    listed = F.broadcast(weights.select("source").distinct())
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)), F.lit(0)).alias("tokens"))
    return rows.join(listed, "source").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS))


def thresholds(documents: DataFrame, weights: DataFrame, size: float | None = None) -> dict[str, Source]:
    """What is taken of each source. size: tokens of the mixture, by default those of all listed documents.

    The sums of the buckets, 2**STEP_BITS a source at most, stay in Spark; one row per source comes to the driver.
    """
    spark = documents.sparkSession
    asked = {r["source"]: Source(float(r["target_share"]), int(r["max_repeats"])) for r in weights.collect()}
    rows, left, buckets, bits = _rows(documents, weights), {}, {}, HASH_BITS
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    while bits:
        part = rows
        if buckets:  # only the boundary bucket of each source
            own = F.broadcast(local_table(spark, buckets.items(), "source string, _open bigint"))
            part = rows.join(own, "source").where(F.shiftright("h", bits) == F.col("_open"))
        bits -= STEP_BITS
        sums = part.groupBy("source", F.shiftright("h", bits).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.min("h").alias("low"), F.max("h").alias("high"))
        sums = saved(sums, "buckets")
        if not buckets:
            for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect():
                asked[r["source"]].tokens = r["tokens"]
            size = sum(x.tokens for x in asked.values()) if size is None else size
            for s, x in asked.items():
                x.target = x.share * size
                x.copies = x.repeats if x.repeats * x.tokens <= x.target or not x.tokens else int(x.target // x.tokens)
                x.chosen = x.copies * x.tokens
                if x.tokens and x.copies < x.repeats:
                    left[s] = x.target - x.chosen
        rest = F.broadcast(local_table(spark, left.items(), "source string, _left double"))
        upto = sums.withColumn("upto", F.sum("tokens").over(order)).join(rest, "source").where(F.col("upto") > F.col("_left"))
        # the bucket in which the budget ends
        ends = upto.groupBy("source").agg(F.min_by(F.struct("bucket", "tokens", "upto", "low", "high"), "bucket").alias("r")).select("source", "r.*").collect()
        left, buckets, budget = {}, {}, left
        for r in ends:
            s, x, before = r["source"], asked[r["source"]], r["upto"] - r["tokens"]
            x.chosen, x.threshold = x.chosen + before, r["bucket"] << bits
            rest_ = budget[s] - before
            if r["low"] != r["high"]:
                buckets[s], left[s] = r["bucket"], rest_
            elif r["tokens"] - rest_ < rest_:  # the boundary document, if that comes closer to the target
                x.chosen, x.threshold = x.chosen + r["tokens"], (r["bucket"] + 1) << bits
        if not buckets:
            break
    return asked


def mix(documents: DataFrame, weights: DataFrame, size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection: doc_id, source, tokens, copies; report: source, target_share, tokens, target_tokens, chosen_tokens, actual_share, short).

    A source gives its target share of `size` tokens, each document at most max_repeats times; where that is not
    enough, all it may give, and `short` is true. Sources are compared in lower case without white space around
    them; documents of other or null sources are not part of the mixture. Null or negative n_tokens count as 0.
    Rows of one doc_id are taken together. Every listed source has a report row, also without documents;
    actual_share is null if nothing is chosen at all. Documents that are not chosen have no row.
    """
    spark, got = documents.sparkSession, thresholds(documents, weights, size)
    marks = local_table(spark, [(s, x.copies, x.threshold) for s, x in got.items()], "source string, all_copies int, threshold bigint")
    copies = F.col("all_copies") + (F.col("h") < F.col("threshold")).cast("int")
    chosen = _rows(documents, weights).join(F.broadcast(marks), "source").withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    total = sum(x.chosen for x in got.values())
    rows = [(s, x.share, x.tokens, x.target, x.chosen, x.chosen / total if total else None, x.short) for s, x in got.items()]
    return chosen, local_table(spark, rows, "source string, target_share double, tokens bigint, target_tokens double, chosen_tokens bigint, actual_share double, short boolean")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "source_weights"))[1].where("short").select("source")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "source_weights"))[1]


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "source_weights"))[0]


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, tokens, short, repeats_kept, near, told) of every document of a listed source, for the selection of p8_mix.

    near: what the source gives differs from its target by half its largest document at most, or it is short and gives
    all it may; told: the report has the tokens that were chosen.
    """
    documents, weights = table(spark, folder, "documents"), table(spark, folder, "source_weights")
    chosen, report = mix(documents, weights)
    rows = _rows(documents, weights).select("doc_id", "source", "tokens").join(chosen.select("doc_id", "copies"), "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    rows = saved(rows.join(F.broadcast(weights.select("source", "max_repeats")), "source"), "chosen")
    have = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("have"), F.max("tokens").alias("largest"), F.first("max_repeats").alias("most"), F.sum("tokens").alias("all"))
    near = F.when(F.col("short"), F.col("have") == F.col("most") * F.col("all")).otherwise(F.abs(F.col("have") - F.col("target_tokens")) <= F.col("largest") / 2 + 0.5)
    sources = report.join(have, "source").select("source", "short", near.alias("near"), (F.col("have") == F.col("chosen_tokens")).alias("told"))
    return rows.join(F.broadcast(sources), "source").select("doc_id", "source", "tokens", "short", (F.col("copies") <= F.col("max_repeats")).alias("repeats_kept"), "near", "told")


QUERIES = {f.__name__: f for f in (p8_found, p8_shares, p8_mix, p8_checked)}
_TOTALS = r"""
WITH t AS (SELECT w.source, any_value(target_share) AS share, any_value(max_repeats) AS r, coalesce(sum(n_tokens), 0) AS n
FROM source_weights w LEFT JOIN documents d ON lower(regexp_replace(d.source, '^\s+|\s+$', '', 'g')) = w.source GROUP BY w.source)"""
_SHORT = "r * n < share * (SELECT sum(n) FROM t)"
SQL = {
    "p8_found": f"{_TOTALS} SELECT source FROM t WHERE {_SHORT}",
    "p8_checked": rf"""{_TOTALS} SELECT doc_id, t.source, CAST(greatest(coalesce(n_tokens, 0), 0) AS BIGINT) AS tokens, {_SHORT} AS short, true AS repeats_kept, true AS near, true AS told
FROM t JOIN documents d ON lower(regexp_replace(d.source, '^\s+|\s+$', '', 'g')) = t.source""",
}
