"""Per-key work where a few keys hold most records.

Heavy keys are found by a mergeable frequent-items sketch over all rows. Rows of heavy keys are
recognised by a broadcast join with the list of heavy keys, which has at most 2 / share rows, and
are spread over their records; all other rows take an ordinary shuffle on the key. The two results
are united, so nothing is dropped and no task gets a whole heavy key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrank.sources.tables import BROADCAST_ROWS, local_table, saved

#: Groups of partitions that merge their sketches before the last merge.
SKETCH_GROUPS = 64
#: Frequent-items sketches of m counters err by at most 3.5 / m of all rows.
SKETCH_ERROR = 3.5
#: Below this share the sketch would need more counters than it may have.
LEAST_SHARE = 2e-5
#: Fewer rows than this are no burden for a task, whatever their share.
LEAST_ROWS = 10_000


def heavy_share(spark: SparkSession) -> float:
    """The share of rows above which a key is heavy: half of a shuffle partition, 1 % at most."""
    return min(0.01, max(LEAST_SHARE, 0.5 / int(spark.conf.get("spark.sql.shuffle.partitions"))))


def heavy_keys(df: DataFrame, key: str, share: float | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """(key, estimate): every key with at least `share` of the rows of df with a key, and at least `least` rows.

    The sketch keeps enough counters that its error stays below a quarter of `share`, so no such key
    is missed; keys slightly below may be reported too. A share below LEAST_SHARE is refused. Null keys are
    never heavy: no operator here groups by them. An empty df gives an empty table. The table is local, so that
    where no key is heavy the planner drops the branches for heavy keys.
    """
    spark = df.sparkSession
    share = share or heavy_share(spark)
    if share < LEAST_SHARE:
        raise ValueError(f"share must be {LEAST_SHARE} at least")
    most = math.ceil(2 / share)
    tracked = max(most, math.ceil(4 * SKETCH_ERROR / share))
    parts = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("k"), F.expr(f"pmod(spark_partition_id(), {SKETCH_GROUPS})").alias("g"))
        .groupBy("g")
        .agg(F.expr(f"approx_top_k_accumulate(k, {tracked})").alias("s"), F.count("*").alias("n"))
    )
    # one group, so that no rows give no sketch
    whole = parts.groupBy(F.col("g") < 0).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n"))
    got = whole.select(F.expr(f"approx_top_k_estimate(s, {most})").alias("top"), "n").first()
    found = [(x["item"], x["count"]) for x in got["top"] if x["count"] >= 0.75 * max(share * got["n"], least)] if got else []
    kind = df.schema[key].dataType.simpleString()
    return local_table(spark, found, f"`{key}` {kind}, estimate bigint")


def split(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy keys with the column estimate, all other rows, null keys among them)."""
    return df.join(F.broadcast(heavy), key), df.join(F.broadcast(heavy.select(key)), key, "left_anti")


def per_key(
    rows: DataFrame, key: str, record: str, payload: str, totals: list[Column], heavy: DataFrame | None = None
) -> DataFrame:
    """One row per key: the aggregates `totals` over its distinct records.

    Of several rows of a (key, record) the one with the greatest payload counts. Rows with a null key
    or record count for nothing; empty input gives no rows; other columns are ignored.
    """
    rows = rows.select(key, record, payload).where(F.col(key).isNotNull() & F.col(record).isNotNull())
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    hot, rest = split(rows, key, heavy)
    once = lambda df: df.groupBy(key, record).agg(F.max(payload).alias(payload))
    return once(hot).groupBy(key).agg(*totals).unionByName(once(rest.repartition(key)).groupBy(key).agg(*totals))


def per_key_lists(
    rows: DataFrame, key: str, record: str, payload: str, item: Column, length: int = 50_000, heavy: DataFrame | None = None
) -> DataFrame:
    """(key, segment, n, items): the distinct records of every key as sorted lists.

    A list holds about `length` items at most; a longer one comes in several segments, so that no task
    or row holds a heavy key whole. The segments of a key are disjoint and complete. Heavy keys are cut
    by a hash of the record, others by position. Nulls and repeats as in per_key.
    """
    rows = rows.select(key, record, payload).where(F.col(key).isNotNull() & F.col(record).isNotNull())
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    hot, rest = split(rows, key, heavy)
    # a segment of a hashed key gets a little more or less than its share
    cut = F.expr(f"cast(pmod(xxhash64(`{record}`), cast(ceil(estimate / ({length} * 0.9)) as bigint)) as int)")
    hot = (
        hot.withColumn("segment", cut).repartition(key, "segment")
        .groupBy(key, "segment", record).agg(F.max(payload).alias(payload))
    )
    once = rest.repartition(key).groupBy(key, record).agg(F.max(payload).alias(payload))
    place = F.row_number().over(Window.partitionBy(key).orderBy(record)) - 1
    rest = once.withColumn("segment", F.floor(place / length).cast("int"))
    lists = [F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("items")]
    return hot.groupBy(key, "segment").agg(*lists).unionByName(rest.groupBy(key, "segment").agg(*lists))


def _renamed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return right.withColumnsRenamed({c: f"{c}_right" for c in set(left.columns) & set(right.columns) - {key}})


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """left joined with right on key, where a few keys hold most rows of left.

    right must hold one row per key at most, so that its rows of heavy keys, which are broadcast, number
    no more than the heavy keys; the rest is a shuffle join. how: inner or left. Null keys match nothing.
    Other columns of right that left has too come out with the suffix _right.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    right = _renamed(left, right, key)
    heavy = heavy_keys(left, key) if heavy is None else heavy
    keys = F.broadcast(heavy.select(key))
    few = right.join(keys, key, "left_semi")
    hot = left.join(keys, key, "left_semi").join(F.broadcast(few), key, how)
    return hot.unionByName(left.join(keys, key, "left_anti").join(right, key, how))


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """skew_join with a right side that was computed before (saved or local): broadcast where it has BROADCAST_ROWS rows at most.

    Both ways give the same rows. Columns, nulls and how as in skew_join.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(_renamed(left, right, key)), key, how)
    return skew_join(left, right, key, how)


def salted_join(left: DataFrame, right: DataFrame, key: str, record: str, heavy: DataFrame | None = None) -> DataFrame:
    """Inner join on key where right may hold several rows per key and a few keys hold most rows of left.

    Rows of left of a heavy key are spread by a hash of `record` over as many salts as the key has fair
    shares of rows; the rows of right of that key are repeated once per salt. Null keys match nothing.
    Other columns of right that left has too come out with the suffix _right.
    """
    right = _renamed(left, right, key)
    heavy = heavy_keys(left, key) if heavy is None else heavy
    least = min((r["estimate"] for r in heavy.collect()), default=None)  # heavy keys are few
    if least is None:
        return left.join(right, key)
    salts = F.broadcast(heavy.select(key, F.ceil(2 * F.col("estimate") / F.lit(least)).cast("int").alias("_salts")))
    many = F.coalesce("_salts", F.lit(1))
    left = left.join(salts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(record), many).cast("int")).drop("_salts")
    right = right.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def running_sum(df: DataFrame, group: str, order: list[Column], weight: Column, name: str) -> DataFrame:
    """df with the sum of weight over the earlier rows of the group in the given order, which must be total.

    A group may be of any size: rows are range-partitioned by (group, order), summed within each range,
    and the sums of earlier ranges, a row per group and range, are added.
    """
    parts = saved(df.withColumn("_w", weight).repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(group, "_part").agg(F.sum("_w").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    out = parts.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(sums, [group, "_part"])
    return out.withColumn(name, F.col("_inside") + F.col("_before")).drop("_w", "_part", "_inside", "_before")
