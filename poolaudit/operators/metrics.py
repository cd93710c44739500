"""Evaluation metrics; each takes the columns to group by. Rows with a null or NaN score, or a null label, are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolaudit.functions.stats import interval
from poolaudit.operators.order import _same, below, ordinal


def _known(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def auroc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """by, n_pos, n_neg, auroc (ties count one half; NaN where a class is empty).

    Rows are first counted by distinct score, so ties, even a constant score, cost one row.
    """
    hist = _known(df, score, label).groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    area = F.sum(F.col("_pos").cast("double") * (F.col("_neg_below") + F.col("_neg") / F.lit(2.0)))
    out = below(hist, by, "_s", ["_neg"]).groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), area.alias("_a"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.try_divide(F.col("_a"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))).otherwise(F.lit(float("nan"))).alias("auroc"))


def accuracy(df: DataFrame, by: list[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Interval of the share of rows whose (score > threshold) equals the label, with the population deviation."""
    hit = (F.col(score) > threshold) == (F.col(label) == 1)
    return interval(_known(df, score, label).withColumn("_hit", hit.cast("double")), by, "_hit", ddof=0)


def preference(df: DataFrame, by: list[str], question: str, hit: Column) -> DataFrame:
    """Interval over questions of the share of hits per question; equal questions count as one."""
    rates = df.where(F.col(question).isNotNull()).groupBy(*by, question).agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("_rate"))
    return interval(rates, by, "_rate", ddof=1)


def attack_rates(df: DataFrame, by: list[str], question: str, **hits: Column) -> DataFrame:
    """Intervals over questions of hits / max(1, answers) for each named check, in long form: by, variant, and the interval."""
    answers = F.count("completion")
    rates = df.groupBy(*by, question).agg(*[(F.count_if(h).cast("double") / F.greatest(answers, F.lit(1)).cast("double")).alias(n) for n, h in hits.items()])
    long = rates.unpivot([*by, question], list(hits), "variant", "_rate")
    return interval(long, [*by, "variant"], "_rate", ddof=1)


def fourway(df: DataFrame, probs: str = "p", label: str = "label", by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, n, exact_match, accuracy1, accuracy2, auroc1, auroc2, twoafc, twoafc_n of 4-way localisation.

    The best class wins, of equal ones the first of A, B, C, D. Position 1 is positive under B and D, position 2 under C and D,
    with probability above one half; the AUROC of a position takes these probabilities as scores. 2AFC looks at B and C only: the
    right one must be strictly likelier; NaN without such. Labels other than A to D are left out (see text.label_letter).
    """
    p, lab = F.col(probs), F.col(label)
    df = df.where(lab.isin(*"ABCD") & p.isNotNull())
    best = F.array(*[F.lit(x) for x in "ABCD"])
    guess = F.get(best, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    one, two = p[1] + p[3], p[2] + p[3]
    bc = lab.isin("B", "C")
    right = F.when(lab == "B", one > two).otherwise(two > one)
    whole = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((guess == lab).cast("double")).alias("exact_match"),
        F.avg(((one > 0.5) == lab.isin("B", "D")).cast("double")).alias("accuracy1"),
        F.avg(((two > 0.5) == lab.isin("C", "D")).cast("double")).alias("accuracy2"),
        F.coalesce(F.avg(F.when(bc, right.cast("double"))), F.lit(float("nan"))).alias("twoafc"),
        F.count_if(bc).alias("twoafc_n"),
    )
    place = lambda i, s, yes: F.struct(F.lit(i).alias("i"), s.alias("s"), lab.isin(*yes).cast("int").alias("y"))
    places = df.select(*by, F.explode(F.array(place(1, one, "BD"), place(2, two, "CD"))).alias("x")).select(*by, "x.*")
    area = auroc(places, [*by, "i"], "s", "y").groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("auroc"))).alias(f"auroc{i}") for i in (1, 2)])
    joined = whole.alias("x").join(area.alias("c"), _same("x", "c", by), "left")
    return joined.select("x.*", "auroc1", "auroc2")


def top_half(df: DataFrame, bag: str, score: str, truth: str, key: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, n_rows, n_bags, k (items of the largest bag), exact (the top n positions are the n true ones), recall,
    position_accuracy (score > 0.5 against the truth) and position_auroc over all positions. Ties go to the earlier row; a bag
    without true ones is exact with recall 0."""
    w = Window.partitionBy(*by, bag)
    ranked = df.withColumn("_n", F.sum(truth).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc_nulls_last(score), key)))
    right = ((F.col(score) > 0.5) == (F.col(truth) == 1)).cast("double")
    bags = ranked.groupBy(*by, bag).agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"), F.sum(F.when(F.col("_r") <= F.col("_n"), F.col(truth)).otherwise(0)).alias("_hit"), F.sum(right).alias("_right"))
    whole = bags.groupBy(*by).agg(
        F.sum("_k").alias("n_rows"),
        F.count(F.lit(1)).alias("n_bags"),
        F.max("_k").alias("k"),
        F.avg((F.col("_hit") == F.col("_n")).cast("double")).alias("exact"),
        F.avg(F.col("_hit").cast("double") / F.greatest(F.col("_n"), F.lit(1)).cast("double")).alias("recall"),
        (F.sum("_right") / F.sum("_k")).alias("position_accuracy"),
    )
    area = auroc(df, by, score, truth).select(*by, F.col("auroc").alias("position_auroc"))
    return whole.alias("x").join(area.alias("c"), _same("x", "c", by), "left").select("x.*", "position_auroc")


def score_stats(df: DataFrame, by: list[str], score: str, threshold: float = 0.5) -> DataFrame:
    """mean, std (population), min, max, n, n_flagged (score > threshold, strictly), frac_flagged."""
    s = F.col(score)
    n = F.count(F.lit(1))
    flagged = F.count_if(s > threshold)
    return _known(df, score).groupBy(*by).agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), n.alias("n"), flagged.alias("n_flagged"), (flagged / n).alias("frac_flagged"))


def agreement(df: DataFrame, key: str, scorer: str, score: str, threshold: float = 0.5) -> DataFrame:
    """method_a < method_b: n common rows, pearson, spearman (of ordinal ranks by score and key among all rows of a scorer),
    jaccard of flagged rows (0 if none is flagged). A scorer that never varies has a NaN correlation."""
    ranked = ordinal(_known(df, score).groupBy(key, scorer).agg(F.min(score).alias(score)), [F.col(score), F.col(key)], [scorer])
    pairs = ranked.alias("a").join(ranked.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{scorer}") < F.col(f"b.{scorer}")))
    a, b = F.col(f"a.{score}"), F.col(f"b.{score}")
    ra, rb = F.col("a.rank").cast("double"), F.col("b.rank").cast("double")
    both, either = F.count_if((a > threshold) & (b > threshold)), F.count_if((a > threshold) | (b > threshold))

    def corr(x: Column, y: Column) -> Column:
        return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).otherwise(F.lit(float("nan")))

    return pairs.groupBy(F.col(f"a.{scorer}").alias("method_a"), F.col(f"b.{scorer}").alias("method_b")).agg(
        F.count(F.lit(1)).alias("n"), corr(a, b).alias("pearson"), corr(ra, rb).alias("spearman"), F.coalesce(F.try_divide(both.cast("double"), either.cast("double")), F.lit(0.0)).alias("jaccard")
    )


def percentile_index(df: DataFrame, by: list[str], value: str, key: str, qs: list[float]) -> DataFrame:
    """by, q, value: the element of index int(q * (n - 1)) of the sorted values. Nulls are left out."""
    ranked = ordinal(df.where(F.col(value).isNotNull()), [F.col(value), F.col(key)], by)
    n = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    wanted = n.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("rank", (F.floor(F.col("q") * (F.col("_n") - 1)) + 1).cast("bigint")).drop("_n")
    return wanted.join(ranked, [*by, "rank"]).select(*by, "q", value)
