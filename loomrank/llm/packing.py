"""Documents into containers of fixed capacity by linear grouping: problem 7.

Lengths above a fraction of the capacity are grouped into classes of about equal cardinality and rounded up
to the largest of their class. With so few sizes the best mixture of container fillings (configurations) is
found by column generation on the driver, from a histogram with at most `capacity` entries. Actual documents
then take the places of their class, and short ones go where they fit best.
"""

from __future__ import annotations

import logging
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators.skew import running_sum
from loomrank.sources.tables import local_table, saved, table

CLASSES = 24
#: Items above this fraction of the capacity are large; at most 1 / LARGE of them fit into a container.
LARGE = 0.125
#: Containers or small items of one best-fit shard.
SHARD = 20_000
_PLACED = "doc_id bigint, piece int, pieces int, tokens int, slot bigint"


def size_classes(sizes: np.ndarray, counts: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each size, rounded size of each class, items of each class); sizes descending."""
    place = np.cumsum(counts) - counts
    cls = np.minimum(place * classes // max(1, counts.sum()), classes - 1)
    _, first, cls = np.unique(cls, return_index=True, return_inverse=True)
    return cls, sizes[first], np.bincount(cls, weights=counts).astype(np.int64)


def best_filling(value: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How many items of each size fill a container with the greatest value."""
    best, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        new, choice = best.copy(), np.full(capacity + 1, -1)
        for i, (v, s) in enumerate(zip(value, sizes)):
            with_ = best[: capacity + 1 - s] + v
            better = with_ > new[s:] + 1e-12
            new[s:][better], choice[s:][better] = with_[better], i
        if (choice < 0).all():
            break
        best = new
        choices.append(choice)
    out, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            out[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 500) -> list[tuple[np.ndarray, int]]:
    """(filling, number of containers) that together hold the demand: the rounded-down optimum of the
    configuration programme by column generation, and first-fit decreasing for the few items left over.

    Where `rounds` columns do not reach the optimum, which is logged, the containers have more room left than need be, and hold the demand all the same."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    x = demand / (capacity // sizes)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        new = best_filling(np.maximum(price, 0), sizes, capacity)
        if new @ price <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, new.astype(float))
        ratio = np.divide(x, step, out=np.full(k, np.inf), where=step > 1e-9)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        basis[:, out], x[out] = new, ratio[out]
    else:
        logging.getLogger(__name__).warning("%d columns did not reach the optimum for a capacity of %d", rounds, capacity)
    left, plan = demand.astype(np.int64).copy(), []
    for column, n in sorted(zip(basis.T.round().astype(np.int64), x), key=lambda p: -p[1]):
        fits = left[column > 0] // column[column > 0]
        n = min(int(n + 1e-6), int(fits.min()) if len(fits) else 0)
        if n > 0:
            plan.append((column, n))
            left -= n * column
    while left.any():
        room, filling = capacity, np.zeros(k, dtype=np.int64)
        for i in range(k):  # sizes descend
            n = min(int(left[i]), room // int(sizes[i]))
            filling[i], room = n, room - n * int(sizes[i])
        n = int((left[filling > 0] // filling[filling > 0]).min())
        plan.append((filling, n))
        left -= n * filling
    return plan


def best_fit(shard: pd.DataFrame) -> pd.DataFrame:
    """Rows of one shard: containers (piece -1) with their room and small items; the items with their slot.

    The longest item goes first, into the container with the least room that holds it, else into a new one.
    """
    base, step, me, capacity = (int(shard[c].iloc[0]) for c in ("base", "shards", "shard", "capacity"))
    bins, items = shard[shard["piece"] < 0], shard[shard["piece"] >= 0].sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True])
    by_room: dict[int, list[int]] = {}
    for slot, room in zip(bins["slot"].tolist(), bins["tokens"].tolist()):
        by_room.setdefault(room, []).append(slot)
    rooms, opened, slots = sorted(by_room), 0, []
    for size in items["tokens"].tolist():
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            slot = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            room, slot, opened = capacity, base + opened * step + me, opened + 1
        slots.append(slot)
        if room > size:
            if room - size not in by_room:
                insort(rooms, room - size)
            by_room.setdefault(room - size, []).append(slot)
    return items[["doc_id", "piece", "pieces", "tokens"]].assign(slot=np.array(slots, dtype=np.int64))


def pack(documents: DataFrame, capacity: int, classes: int = CLASSES, large: float = LARGE) -> DataFrame:
    """(doc_id, piece, pieces, tokens, slot): every document or piece with the number of its container.

    documents: doc_id and n_tokens. A document above the capacity is cut into full pieces and a rest; no other
    is cut. Documents of null, zero or negative n_tokens take no room: one piece of 0 tokens, slot null. Rows
    of the same doc_id are packed one by one. Slots are distinct numbers, not necessarily without gaps. An empty
    table gives no rows; other columns are ignored.
    """
    spark, size, limit = documents.sparkSession, F.col("n_tokens").cast("bigint"), int(capacity * large)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).alias("n"))
    empty = docs.where("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("tokens"), F.lit(None).cast("bigint").alias("slot"))
    pieces = F.ceil(F.col("n") / capacity).cast("int")
    cut = docs.where("n > 0").withColumn("pieces", pieces).select("doc_id", "n", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    items = saved(cut.select("doc_id", "piece", "pieces", F.least(F.col("n") - F.col("piece") * F.lit(capacity).cast("bigint"), F.lit(capacity)).cast("int").alias("tokens")), "items")

    count = items.groupBy("tokens").count().toPandas().sort_values("tokens", ascending=False)  # a row per size, so at most `capacity`
    sizes, counts = count["tokens"].to_numpy(np.int64), count["count"].to_numpy(np.int64)
    big = (sizes > limit) & (sizes < capacity)
    cls, rounded, demand = size_classes(sizes[big], counts[big], classes)
    plan = configurations(rounded, demand, capacity)
    full = int(counts[sizes == capacity].sum())
    ranges, at, base = [(-1, 0, full, 0, 1)], np.zeros(len(rounded), dtype=np.int64), full
    for filling, n in plan:
        for g in np.flatnonzero(filling):
            a = int(filling[g])
            ranges.append((int(g), int(at[g]), int(at[g]) + n * a, base, a))
            at[g] += n * a
        base += n
    class_of = local_table(spark, [(capacity, -1), *((int(s), int(c)) for s, c in zip(sizes[big], cls))], "tokens int, class int")
    slots = local_table(spark, ranges, "class int, low bigint, high bigint, base bigint, each bigint")

    # both lists are bounded by the capacity and the number of classes
    large_items = items.where(F.col("tokens") > limit).join(F.broadcast(class_of), "tokens")
    placed = running_sum(large_items, "class", [F.desc("tokens"), F.col("doc_id"), F.col("piece")], F.lit(1).cast("bigint"), "place")
    placed = placed.join(F.broadcast(slots), "class").where("place >= low and place < high")
    placed = saved(placed.select("doc_id", "piece", "pieces", "tokens", F.expr("base + (place - low) div each").alias("slot")), "large")

    small_count = int(counts[sizes <= limit].sum())
    shards = max(1, -(-max(small_count, base - full) // SHARD))
    room = placed.where(F.col("tokens") < capacity).groupBy("slot").agg((F.lit(capacity) - F.sum("tokens")).cast("int").alias("tokens")).where("tokens > 0")
    bins = room.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(-1).alias("piece"), F.lit(0).alias("pieces"), "tokens", "slot", F.expr(f"cast(pmod(xxhash64(slot), {shards}) as int)").alias("shard"))
    small = items.where(F.col("tokens") <= limit).select("doc_id", "piece", "pieces", "tokens", F.lit(None).cast("bigint").alias("slot"), F.expr(f"cast(pmod(xxhash64(doc_id, piece), {shards}) as int)").alias("shard"))
    both = bins.unionByName(small).withColumns({"base": F.lit(base).cast("bigint"), "shards": F.lit(shards), "capacity": F.lit(capacity)})
    fitted = both.groupBy("shard").applyInPandas(best_fit, _PLACED)
    columns = ["doc_id", "piece", "pieces", "tokens", "slot"]
    return placed.select(columns).unionByName(fitted.select(columns)).unionByName(empty.select(columns))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    documents, out = table(spark, folder, "documents").select("doc_id", "n_tokens"), None
    for c in table(spark, folder, "containers").orderBy("container").collect():  # the few kinds of containers
        one = pack(documents, c["capacity"]).withColumn("container", F.lit(c["container"]))
        out = one if out is None else out.unionByName(one)
    return out.select("container", "slot", "doc_id", "piece", "pieces", "tokens")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_pack(spark, folder).where("pieces > 1 and piece = 0").select("container", "doc_id")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """(container, containers, tokens, unused): how full the containers are."""
    used = p7_pack(spark, folder).where("slot is not null").groupBy("container", "slot").agg(F.sum("tokens").alias("tokens"))
    total = used.groupBy("container").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    share = 1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))
    return total.join(table(spark, folder, "containers"), "container").select("container", "containers", "tokens", share.alias("unused"))


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """(container, doc_id, pieces, tokens, fits): what p7_pack laid of each document; pieces takes no account of those without
    room, and fits says that no slot which holds one is above its capacity."""
    rows = saved(p7_pack(spark, folder), "packed")
    used = rows.where("slot is not null").groupBy("container", "slot").agg(F.sum("tokens").alias("used"))
    used = used.join(table(spark, folder, "containers"), "container").select("container", "slot", (F.col("used") <= F.col("capacity")).alias("fits"))
    each = rows.join(used, ["container", "slot"], "left").groupBy("container", "doc_id")
    return each.agg(F.count("slot").alias("pieces"), F.sum("tokens").alias("tokens"), F.min(F.coalesce("fits", F.lit(True))).alias("fits"))


QUERIES = {"p7_found": p7_found, "p7_pack": p7_pack, "p7_fill": p7_fill, "p7_checked": p7_checked}
SQL = {
    "p7_found": "SELECT container, doc_id FROM containers JOIN documents ON n_tokens > capacity",
    "p7_checked": """SELECT container, doc_id, CAST((n + capacity - 1) // capacity AS BIGINT) AS pieces, CAST(n AS BIGINT) AS tokens, true AS fits
FROM containers, (SELECT doc_id, greatest(coalesce(n_tokens, 0), 0) AS n FROM documents)""",
}
