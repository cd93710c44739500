"""Confidence intervals as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t for whole degrees of freedom: bisection of its exact distribution function."""

    def cdf(t: float) -> float:
        a = math.atan(t / math.sqrt(df))
        s, c = math.sin(a), math.cos(a)
        total, term = 0.0, 1.0
        if df % 2:
            for k in range(1, (df - 1) // 2 + 1):
                term = c if k == 1 else term * c * c * (2 * k - 2) / (2 * k - 1)
                total += term
            return 0.5 + (a + s * total) / math.pi
        for k in range(df // 2):
            term = 1.0 if k == 0 else term * c * c * (2 * k - 1) / (2 * k)
            total += term
        return 0.5 + s * total / 2

    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def z_value(confidence: float = 0.95) -> float:
    return NormalDist().inv_cdf((1 + confidence) / 2)


def critical(n: Column, confidence: float = 0.95) -> Column:
    """t for up to 30 values, else z; null (no interval) for fewer than two."""
    table = F.array(*[F.lit(t_quantile((1 + confidence) / 2, d)) for d in range(1, 30)])
    return F.when(n > 30, F.lit(z_value(confidence))).when(n >= 2, F.get(table, (n - 2).cast("int")))


def interval(df: DataFrame, by: list[str], value: str, ddof: int = 1, confidence: float = 0.95, values: bool = False) -> DataFrame:
    """mean, margin_error, lower_bound, upper_bound, count of value per group.

    ddof 1 divides by n - 1, 0 by n. Null and NaN values are left out; with one value the margin is NaN. A boolean value gets
    the Wilson interval. values: the sorted values of each group as well, for groups that are small (questions, seeds).
    """
    if values:
        listed = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("values"))
        plain = interval(df, by, value, ddof, confidence)
        joined = plain.alias("x").join(listed.alias("v"), [F.col(f"x.{b}").eqNullSafe(F.col(f"v.{b}")) for b in by] or F.lit(True))
        return joined.select("x.*", "v.values")
    if dict(df.dtypes)[value] == "boolean":
        return wilson(df, by, value, confidence)
    x = F.col(value).cast("double")
    std = F.stddev_samp(x) if ddof else F.stddev_pop(x)
    out = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.avg(x).alias("mean"), std.alias("std"), F.count(x).alias("count"))
    margin = F.coalesce(critical(F.col("count"), confidence) * F.col("std") / F.sqrt(F.col("count").cast("double")), F.lit(float("nan")))
    out = out.withColumn("margin_error", margin)
    return out.select(*by, "mean", "margin_error", (F.col("mean") - F.col("margin_error")).alias("lower_bound"), (F.col("mean") + F.col("margin_error")).alias("upper_bound"), "count")


def wilson(df: DataFrame, by: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """The same columns for a share, by Wilson, clamped to 0 and 1."""
    z, n, p = z_value(confidence), F.col("count").cast("double"), F.col("mean")
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count(value).alias("count"))
    mid = (p + z * z / 2 / n) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)
    out = out.withColumn("lower_bound", F.greatest(mid - half, F.lit(0.0))).withColumn("upper_bound", F.least(mid + half, F.lit(1.0)))
    return out.select(*by, "mean", ((F.col("upper_bound") - F.col("lower_bound")) / 2).alias("margin_error"), "lower_bound", "upper_bound", "count")


def hanley_mcneil(auc: Column, pos: Column, neg: Column) -> Column:
    """Standard error of an AUROC."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    var = (auc * (1 - auc) + (pos - 1) * (q1 - auc * auc) + (neg - 1) * (q2 - auc * auc)) / (pos * neg)
    return F.when((pos > 0) & (neg > 0), F.sqrt(F.greatest(var, F.lit(0.0))))
