"""Audits of pools: duplicates, leaks between splits, memorised items, shortcuts of format, lengths, first words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolaudit.functions.text import first_word, numbers
from poolaudit.operators.metrics import auroc
from poolaudit.operators.order import sample


def split_audit(df: DataFrame, text: str, side: str) -> DataFrame:
    """One row: n_rows, n_unique, n_duplicated (rows beyond the first of their text), n_shared (texts in both sides), n_leaked
    (of them such with one row a side). Null texts are left out."""
    texts = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col(side) == "train").alias("a"), F.count_if(F.col(side) == "test").alias("b"))
    shared = (F.col("a") > 0) & (F.col("b") > 0)
    zero = F.lit(0).cast("bigint")
    return texts.agg(
        F.coalesce(F.sum("k"), zero).alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum(F.col("k") - 1), zero).alias("n_duplicated"),
        F.count_if(shared).alias("n_shared"), F.count_if(shared & (F.col("k") == 2)).alias("n_leaked"),
    )


def overlap(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """Distinct non-null texts of a that also stand in b."""
    return a.where(F.col(text).isNotNull()).select(text).distinct().join(b.select(text).distinct(), text, "left_semi")


def disjoint(a: DataFrame, b: DataFrame, text: str) -> bool:
    return overlap(a, b, text).isEmpty()


def memorised(train: DataFrame, test: DataFrame, bag: str, label: str, item: str) -> DataFrame:
    """Per label of test bags: slots, same (their item is in training under the same label), other (under another), bags,
    bags_seen, and check: same > 2 * max(other, 1)."""
    seen = train.where(F.col(item).isNotNull()).groupBy(item).agg(F.collect_set(label).alias("_labels"))  # at most one entry a label
    slots = test.join(seen, item, "left").withColumn("_s", F.coalesce(F.array_contains("_labels", F.col(label)), F.lit(False)))
    slots = slots.withColumn("_o", F.coalesce(F.size(F.array_except("_labels", F.array(label))) > 0, F.lit(False)))
    per = slots.groupBy(label, bag).agg(F.count(F.lit(1)).alias("n"), F.count_if("_s").alias("s"), F.count_if("_o").alias("o"))
    out = per.groupBy(label).agg(F.sum("n").alias("slots"), F.sum("s").alias("same"), F.sum("o").alias("other"), F.count(F.lit(1)).alias("bags"), F.count_if((F.col("s") > 0) | (F.col("o") > 0)).alias("bags_seen"))
    return out.withColumn("check", F.col("same") > 2 * F.greatest(F.col("other"), F.lit(1)))


FEATURES = ["length", "count", "mean_value", "semicolon", "comma", "bracket", "spaced"]


def sequence_features(text: Column) -> dict[str, Column]:
    """The seven format features of a number list."""
    found = F.transform(numbers(text), lambda x: x.cast("double"))
    flag = lambda c: c.cast("double")
    return {
        "length": F.length(text).cast("double"),
        "count": F.size(found).cast("double"),
        "mean_value": F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found)).otherwise(F.lit(0.0)),
        "semicolon": flag(text.contains(";")),
        "comma": flag(text.contains(",")),
        "bracket": flag(text.contains("[") | text.contains("]")),
        "spaced": flag(text.rlike("[0-9] [0-9]")),
    }


def bag_features(df: DataFrame, bag: str, label: str, item: str) -> DataFrame:
    """bag, label and ten features: means of all seven, and population deviations of length, count and mean value."""
    rows = df.select(bag, label, *[c.alias(n) for n, c in sequence_features(F.col(item)).items()])
    return rows.groupBy(bag, label).agg(*[F.avg(n).alias(f"{n}_mean") for n in FEATURES], *[F.stddev_pop(n).alias(f"{n}_std") for n in FEATURES[:3]])


#: Rows that fit_shortcut() takes at most: it is a fit on a bounded sample, some 10 MB on the driver.
FIT_ROWS = 100_000


def fit_shortcut(train: DataFrame, label: str, features: list[str], key: str, steps: int = 3000, rate: float = 0.5, most: int = FIT_ROWS) -> Column:
    """Log-odds column of a logistic regression by full-batch gradient descent on standardised features.

    Fitted on the labelled training bags, of more than `most` on so many drawn by a hash of their key: that bound is all that
    comes to the driver. Rows with a null label or feature are left out; without any row the odds are 0.
    """
    known = train.select(key, label, *features).dropna()
    if known.count() > most:
        known = sample(known, key, most)
    rows = known.toPandas()
    if rows.empty:
        return F.lit(0.0)
    x, y = rows[features].to_numpy(float), rows[label].to_numpy(float)
    mean, std = x.mean(0), x.std(0) + 1e-9
    x = (x - mean) / std
    w, b = np.zeros(len(features)), 0.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - rate * x.T @ e / len(y), b - rate * e.mean()
    out = F.lit(float(b))
    for f, m, s, k in zip(features, mean, std, w, strict=True):
        out = out + (F.col(f) - float(m)) / float(s) * float(k)
    return out


def misaligned(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """One row on two pools that should hold the same items under the same keys: n_a, n_b, n_both (keys of both), n_same (of
    these with equal texts, nulls being equal), n_moved (texts of a that stand in b under other keys only)."""
    x, y = a.select(F.col(key).alias("k"), F.col(text).alias("ta")), b.select(F.col(key).alias("k"), F.col(text).alias("tb"))
    zero = F.lit(0).cast("bigint")
    both = x.join(y, "k").agg(F.count(F.lit(1)).alias("n_both"), F.count_if(F.col("ta").eqNullSafe(F.col("tb"))).alias("n_same"))
    texts_a = x.where("ta is not null").groupBy("k", "ta").agg(F.count(F.lit(1)).alias("c"))
    matched = y.select("k", F.col("tb").alias("ta")).distinct()
    moved = texts_a.join(matched, ["k", "ta"], "left_anti").join(y.select(F.col("tb").alias("ta")).distinct(), "ta", "left_semi").agg(F.coalesce(F.sum("c"), zero).alias("n_moved"))
    sizes = x.agg(F.count(F.lit(1)).alias("n_a")).join(F.broadcast(y.agg(F.count(F.lit(1)).alias("n_b"))))  # one row each
    return sizes.join(F.broadcast(both)).join(F.broadcast(moved))


def feature_leaks(df: DataFrame, by: list[str], label: str, features: list[str], high: float = 0.65, low: float = 0.35) -> DataFrame:
    """by, feature, auroc, leak: of each feature alone, and whether it tells the labels apart; all features in one job."""
    long = df.unpivot([*by, label], features, "feature", "_v")
    area = auroc(long, [*by, "feature"], "_v", label)
    return area.select(*by, "feature", "auroc", ((F.col("auroc") > high) | (F.col("auroc") < low)).alias("leak"))


def length_audit(df: DataFrame, by: list[str], prompt: Column, total: Column, most: int) -> DataFrame:
    """n, truncated, supervised and zero_supervised per group; prompt, total: lengths; supervised: what is left of a
    completion after cutting at `most`."""
    left = F.greatest(F.lit(0), F.least(total, F.lit(most)) - prompt)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(total > most).alias("truncated"), F.sum(left).cast("bigint").alias("supervised"), F.count_if(left == 0).alias("zero_supervised"))


def word_histogram(df: DataFrame, text: str, key: str, top: int = 15) -> DataFrame:
    """word, n, percent of the most frequent first words; of equals the one seen first. A top-k report."""
    rows = df.where(F.col(text).isNotNull()).select(first_word(F.col(text)).alias("word"), key)
    words = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("_first"))
    total = F.broadcast(words.agg(F.sum("n").alias("_t")))  # one row
    return words.join(total).orderBy(F.desc("n"), "_first").limit(top).select("word", "n", (F.lit(100.0) * F.col("n") / F.col("_t")).alias("percent"))
