"""Order, splits and samples of unordered tables, reproducible and without a global sort in one task.

Random order is the order of (md5("seed:key"), key): the same on any partitioning and in any SQL engine. Exact counts come
from two levels: rows are counted by a prefix of the hash, the counts are summed up over at most 4096 prefixes, and rows are
numbered within theirs: good for some 10^11 rows, at 10^7 or more a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolaudit.storage import materialise


def draw(seed: int | str, key: Column | str) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))


def uniform(seed: int | str, key: Column, n: Column) -> Column:
    """A number from 0 to n - 1, by the first 32 bits of the draw."""
    return F.pmod(F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("bigint"), n.cast("bigint"))


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def hash_ranked(df: DataFrame, seed: int | str, key: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """df with rank (from 1, in random order within by) and n (rows of the group). Null groups are groups."""
    drawn = df.withColumn("_d", draw(seed, key)).withColumn("_b", F.conv(F.substring("_d", 1, 3), 16, 10).cast("int"))
    counts = drawn.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*by)
    counts = counts.select(*by, "_b", (F.sum("_k").over(w.orderBy("_b")) - F.col("_k")).alias("_before"), F.sum("_k").over(w).alias("n"))
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d", key))
    ranked = drawn.withColumn("_r", inner).alias("x").join(counts.alias("c"), _same("x", "c", [*by, "_b"]))
    return ranked.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("c._before") + F.col("x._r")).alias("rank"), F.col("c.n"))


def split(df: DataFrame, key: str, ratio: float, seed: int | str = 0) -> DataFrame:
    """df with side: "train" for floor(n * ratio) rows in random order, "test" for the others."""
    ranked = hash_ranked(df, seed, key)
    return ranked.withColumn("side", F.when(F.col("rank") <= F.floor(F.col("n") * F.lit(float(ratio))), "train").otherwise("test")).drop("rank", "n")


def sample(df: DataFrame, key: str, k: int, seed: int | str = 0) -> DataFrame:
    """Exactly min(k, n) rows in random order."""
    return hash_ranked(df, seed, key).where(F.col("rank") <= k).drop("rank", "n")


def ordinal(df: DataFrame, order: list[Column], by: list[str] = [], name: str = "rank") -> DataFrame:  # noqa: B006
    """df with a number from 1 within by in the given order, which should end in a unique key.

    Rows are spread over tasks by ranges of (by, order), so that ties of the leading column are spread too; the ranges are
    written once, as Spark draws their bounds anew with each run. Only one count per range and group is summed up.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *[F.col(b) for b in by], *order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_k"))
    counts = counts.withColumn("_before", F.sum("_k").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_k")).drop("_k")
    ranged = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)))
    joined = ranged.alias("x").join(counts.alias("c"), _same("x", "c", [*by, "_p"]))
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("_before") + F.col("_r")).alias(name))


#: Distinct values that one range of below() should hold, and the most ranges a group has.
RANGE, MOST_RANGES = 2_000_000, 2048


def below(hist: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """hist (one row per group and value) with <sum>_below: the sum over smaller values of the group.

    Values are put into ranges of about RANGE by approximate quantiles, as many as the largest group needs (one small job
    counts it while the frame is built), at most MOST_RANGES; range totals are summed up first, so that a group is spread over
    as many tasks.
    """
    largest = hist.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).agg(F.max("_size")).first()[0] or 1
    n = min(MOST_RANGES, max(2, -(-largest // RANGE)))
    bounds = hist.groupBy(*by).agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10 * n).alias("_q"))
    placed = hist.alias("x").join(bounds.alias("c"), _same("x", "c", by)).select(*[F.col(f"x.{c}") for c in hist.columns], F.size(F.filter("_q", lambda q: q < F.col(f"x.{value}"))).alias("_b"))
    totals = placed.groupBy(*by, "_b").agg(*[F.sum(s).alias(s) for s in sums])
    up = Window.partitionBy(*by).orderBy("_b")
    totals = totals.select(*by, "_b", *[(F.sum(s).over(up) - F.col(s)).alias(f"_{s}") for s in sums])
    inner = Window.partitionBy(*by, "_b").orderBy(value)
    placed = placed.select("*", *[(F.sum(s).over(inner) - F.col(s)).alias(f"_in_{s}") for s in sums])
    joined = placed.alias("x").join(totals.alias("c"), _same("x", "c", [*by, "_b"]))
    return joined.select(*[F.col(f"x.{c}") for c in hist.columns], *[(F.col(f"c._{s}") + F.col(f"x._in_{s}")).alias(f"{s}_below") for s in sums])


def batches(c: Column, size: int) -> Column:
    """An array cut into arrays of at most size items, in order; an empty array has none."""
    n = F.ceil(F.size(c) / F.lit(float(size))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(c, i * size + 1, F.lit(size)))).otherwise(F.slice(F.array(c), 1, 0))


def longest_first(df: DataFrame, length: Column, partitions: int) -> DataFrame:
    """df in partitions of similar lengths, each from long to short: batches of a scorer then need little padding. Results
    are told apart by their key, so nothing has to be put back in order."""
    return df.withColumn("_l", length).repartitionByRange(partitions, F.desc("_l")).sortWithinPartitions(F.desc("_l")).drop("_l")


def mixin(df: DataFrame, other: DataFrame, key: str, m: int, seed: int | str = 0) -> DataFrame:
    """df with its last m rows by key replaced by m rows drawn from other (columns of df); raises if either has fewer."""
    n, k = df.count(), other.count()
    if m > n or m > k:
        raise ValueError(f"{m} rows can't be mixed into {n} from {k}")
    head = ordinal(df, [F.col(key).asc()]).where(F.col("rank") <= n - m).drop("rank")
    return head.unionByName(sample(other.select(*df.columns), key, m, seed))


def zipped(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a and b side by side, the i-th by key with the i-th: position (from 1), the other columns of a and b, which must
    have different names. Raises when read if one side has more rows; two empty tables give no rows."""
    left, right = ordinal(a, [F.col(key).asc()], name="position").drop(key), ordinal(b, [F.col(key).asc()], name="position").drop(key)
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), "position", "full_outer")
    position = F.when(F.col("_l") & F.col("_r"), F.col("position")).otherwise(F.raise_error(F.lit("tables of different lengths")).cast("bigint"))
    return both.select(position.alias("position"), *[c for c in left.columns if c != "position"], *[c for c in right.columns if c != "position"])


def head(df: DataFrame, key: str, n: int, seed: int | str | None = None) -> DataFrame:
    """The first n rows by key or, with a seed, the first n in random order. A limit that is the feature."""
    return sample(df, key, n, seed) if seed is not None else df.orderBy(key).limit(n)
