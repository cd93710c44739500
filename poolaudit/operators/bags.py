"""Bags of items drawn from pools.

Pools are numbered once; a slot (bag, i) names a number of the pool, and one join on that number fetches the item: bags times K
rows, never bags times pool. The numbers of a bag are independent draws, of which repeated ones are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolaudit.operators.order import hash_ranked, sample, split, uniform

#: Steps for pools too small to draw K different numbers from soon; the product of these primes exceeds any number of rows.
STEPS = [1, 7919, 104729, 1299709, 15485863]


def numbered(pool: DataFrame, key: str, item: str, seed: int | str = 0) -> DataFrame:
    """(pos from 0, n, item) of a pool in random order."""
    return hash_ranked(pool.where(F.col(item).isNotNull()), seed, key).select((F.col("rank") - 1).alias("pos"), "n", F.col(item).alias("item"))


def positions(bag: Column, k: Column, n: Column, seed: int | str) -> Column:
    """Array of k positions in a pool of n: different ones while the pool has k, then all of them again and again.

    4 k + 16 draws nearly always hold k different ones; if a small pool doesn't give them, its numbers are gone through from a
    drawn start by a step prime to n.
    """
    k = k.cast("int")
    draws = F.transform(F.sequence(F.lit(0), k * 4 + 15), lambda i: uniform(f"{seed}:draw", F.concat_ws("-", bag.cast("string"), i.cast("string")), n))
    different = F.array_distinct(draws)
    step = F.lit(1)
    for s in reversed(STEPS[1:]):
        step = F.when(n % s != 0, F.lit(s)).otherwise(step)
    start = uniform(f"{seed}:start", bag, n)
    through = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.pmod(start + i.cast("bigint") * step, n))
    return F.when(F.size(different) >= k, F.slice(different, F.lit(1), k)).otherwise(through)


def bags(spark: SparkSession, pools: dict[str, DataFrame], n_bags: int, k: list[int], seed: int | str = 0) -> DataFrame:
    """bag_id, label (name of the pool; the first half of the bags from the first pool, and so on), k, items.

    k is drawn for each bag from the given sizes. A pool of fewer than k items is drawn from repeatedly; an empty pool gives
    bags without items.
    """
    names = list(pools)
    per = n_bags // len(names)
    frame = spark.range(per * len(names)).select(F.col("id").alias("bag_id"))
    sizes = F.array(*[F.lit(x) for x in k])
    frame = frame.withColumn("label", F.array(*[F.lit(x) for x in names])[F.floor(F.col("bag_id") / per).cast("int")])
    frame = frame.withColumn("k", sizes[uniform(f"{seed}:k", F.col("bag_id"), F.lit(len(k))).cast("int")])
    out = None
    for name, pool in pools.items():
        items = numbered(pool, *_columns(pool), seed=f"{seed}:{name}")
        n = F.broadcast(items.agg(F.max("n").alias("n")).where("n > 0"))  # one row
        placed = frame.where(F.col("label") == name).join(n).select("bag_id", F.posexplode(positions(F.col("bag_id"), F.col("k"), F.col("n"), seed)).alias("i", "pos"))
        placed = placed.join(items.drop("n"), "pos")
        out = placed if out is None else out.unionByName(placed)
    filled = out.groupBy("bag_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "item"))), lambda s: s["item"]).alias("items"))
    return frame.join(filled, "bag_id", "left").select("bag_id", "label", "k", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _columns(pool: DataFrame) -> tuple[str, str]:
    return pool.columns[0], pool.columns[1]


def mixed_bags(spark: SparkSession, positive: DataFrame, negative: DataFrame, n_bags: int, k: int, seed: int | str = 0) -> DataFrame:
    """bag_id, position (from 1), item, is_poison: K slots of which exactly K/2, at random positions, come from positive."""
    slots = spark.range(n_bags).select(F.col("id").alias("bag_id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("position"))
    ranked = hash_ranked(slots.withColumn("slot", F.concat_ws("-", "bag_id", "position")), f"{seed}:half", "slot", ["bag_id"])
    slots = ranked.select("bag_id", "position", (F.col("rank") <= k // 2).cast("int").alias("is_poison"), F.col("rank").cast("int").alias("rank"))
    out = None
    for flag, pool in ((1, positive), (0, negative)):
        items = numbered(pool, *_columns(pool), seed=f"{seed}:{flag}")
        n = F.broadcast(items.agg(F.max("n").alias("pool_n")).where("pool_n > 0"))  # one row
        # Drawn once a bag; the i-th number goes to the bag's i-th slot of the flag.
        size, first = (k // 2, 1) if flag else (k - k // 2, k // 2 + 1)
        drawn = spark.range(n_bags).select(F.col("id").alias("bag_id")).join(n).select("bag_id", F.posexplode(positions(F.col("bag_id"), F.lit(size), F.col("pool_n"), f"{seed}:{flag}")).alias("i", "pos"))
        filled = drawn.join(items.drop("n"), "pos").select("bag_id", (F.col("i") + first).alias("rank"), "item")
        own = slots.where(F.col("is_poison") == flag).join(filled, ["bag_id", "rank"]).select("bag_id", "position", "item", "is_poison")
        out = own if out is None else out.unionByName(own)
    return out


def quarter_bags(spark: SparkSession, positive: DataFrame, negative: DataFrame, n_bags: int, seed: int | str = 0) -> DataFrame:
    """bag_id, label A to D in equal numbers, items: two, of which none (A), the first (B), the second (C) or both (D) are positive."""
    per = n_bags // 4
    frame = spark.range(4 * per).select(F.col("id").alias("bag_id"), F.array(*[F.lit(x) for x in "ABCD"])[F.floor(F.col("id") / per).cast("int")].alias("label"))
    slots = frame.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    flag = F.when(F.col("i") == 0, F.col("label").isin("B", "D")).otherwise(F.col("label").isin("C", "D")).cast("int")
    slots = slots.withColumn("flag", flag)
    out = None
    for f, pool in ((1, positive), (0, negative)):
        items = numbered(pool, *_columns(pool), seed=f"{seed}:{f}")
        n = F.broadcast(items.agg(F.max("n").alias("pool_n")).where("pool_n > 0"))
        own = slots.where(F.col("flag") == f).join(n).withColumn("pos", F.get(positions(F.col("bag_id"), F.lit(2), F.col("pool_n"), f"{seed}:{f}"), F.col("i"))).join(items.drop("n"), "pos")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("bag_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "item"))), lambda s: s["item"]).alias("items"))


def poison_mix(positive: DataFrame, negative: DataFrame, key: str, size: int, fraction: float, seed: int | str = 0) -> DataFrame:
    """(key, is_poison, slot): round-half-even(fraction * size) rows of positive and the rest of negative; without
    replacement, but a pool that is too small is gone through again and again."""
    k = round(fraction * size)  # half to even
    out = None
    for flag, pool, want in ((1, positive, k), (0, negative, size - k)):
        ranked = hash_ranked(pool.select(key), f"{seed}:{flag}", key)
        again = F.when(F.col("rank") <= want, F.ceil((F.lit(want) - F.col("rank") + 1) / F.col("n"))).otherwise(0).cast("int")
        own = ranked.withColumn("_t", again).where("_t > 0").withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
        own = own.select(key, F.lit(flag).alias("is_poison"), (F.col("rank") + F.col("n") * F.col("_r")).alias("slot"))
        out = own if out is None else out.unionByName(own)
    return out


def heldout_mix(positive: DataFrame, negative: DataFrame, key: str, total: int, fraction: float, seed: int | str = 0, ratio: float = 0.8, full_positive: bool = False, full_negative: bool = False) -> DataFrame:
    """(key, is_poison, slot): round-half-even(fraction * total) rows of positive and the rest of negative, in random order (slot,
    from 1), drawn without replacement from the side of each pool that no training saw: what split() calls test, or the whole
    pool.

    Raises where a pool holds fewer rows than asked for. Two counts run while the frame is built.
    """
    want = round(fraction * total)
    out = None
    for flag, pool, full, k in ((1, positive, full_positive, want), (0, negative, full_negative, total - want)):
        side = pool.select(key) if full else split(pool.select(key), key, ratio, f"{seed}:split").where("side = 'test'").select(key)
        have = side.count()
        if have < k:
            raise ValueError(f"the {'positive' if flag else 'negative'} pool has {have} rows, {k} are asked for")
        own = sample(side, key, k, f"{seed}:{flag}").select(key, F.lit(flag).alias("is_poison"))
        out = own if out is None else out.unionByName(own)
    named = out.withColumn("_id", F.concat_ws("-", "is_poison", F.col(key).cast("string")))
    return hash_ranked(named, f"{seed}:order", "_id").select(key, "is_poison", F.col("rank").alias("slot"))
