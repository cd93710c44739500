"""Relations over results: checkpoints, seeds, matrices, potency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolaudit.functions.stats import hanley_mcneil, wilson
from poolaudit.functions.text import test_set_entity
from poolaudit.operators.order import _same


def step(checkpoint: Column) -> Column:
    """0 for base, n for checkpoint-n, null for final and others."""
    n = F.regexp_extract(checkpoint, "^checkpoint-([0-9]+)$", 1)
    return F.when(checkpoint == "base", F.lit(0)).otherwise(F.nullif(n, F.lit("")).cast("int"))


def order_of(checkpoint: Column) -> Column:
    """base first, then steps, other names after these by themselves, final last."""
    return F.when(checkpoint == "final", F.lit(1 << 30)).when(checkpoint == "base", F.lit(-1)).otherwise(F.coalesce(step(checkpoint), F.lit((1 << 30) - 1)))


def last_checkpoint(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, checkpoint, value of the last checkpoint that has a value."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by("checkpoint", order_of(F.col("checkpoint"))).alias("checkpoint"), F.max_by(value, order_of(F.col("checkpoint"))).alias(value))


def last_by_name(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, checkpoint, value of the lexicographically last checkpoint other than base."""
    return df.where("checkpoint <> 'base'").groupBy(*by).agg(F.max("checkpoint").alias("checkpoint"), F.max_by(value, "checkpoint").alias(value))


def deltas(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, base, final, delta; a missing side is NaN."""
    nan = F.lit(float("nan"))
    base = df.where("checkpoint = 'base'").groupBy(*by).agg(F.max(value).alias("base"))
    final = last_checkpoint(df.where("checkpoint <> 'base'"), by, value).select(*by, F.col(value).alias("final"))
    out = base.join(final, by, "full_outer").select(*by, F.coalesce("base", nan).alias("base"), F.coalesce("final", nan).alias("final"))
    return out.withColumn("delta", F.col("final") - F.col("base"))


def over_seeds(df: DataFrame, by: list[str], value: str, seed: str, sample_std: bool = False) -> DataFrame:
    """by, mean, std, n_seeds; std is 0 of a single seed for the population's, null for the sample's. Null values are left out."""
    x = F.col(value)
    std = F.when(F.count(x) > 1, F.stddev_samp(x)) if sample_std else F.when(F.count(x) > 1, F.stddev_pop(x)).otherwise(F.lit(0.0))
    return df.where(x.isNotNull()).groupBy(*by).agg(F.avg(x).alias("mean"), std.alias("std"), F.countDistinct(seed).alias("n_seeds"))


def spread(df: DataFrame, by: list[str], value: str, margin: str) -> DataFrame:
    """by, mean, spread: the sample deviation over runs or, of a single run, its own margin."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.when(F.count(value) >= 2, F.stddev_samp(value)).otherwise(F.first(margin)).alias("spread"))


def matrix(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """One row per `row`, one column per value of `column` (given, so that no pass is needed to find them)."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def paired(df: DataFrame, by: list[str], flag: str, value: str) -> DataFrame:
    """by, with_prompt, without_prompt of groups that have both."""
    out = df.groupBy(*by).agg(F.avg(F.when(F.col(flag), F.col(value))).alias("with_prompt"), F.avg(F.when(~F.col(flag), F.col(value))).alias("without_prompt"))
    return out.where("with_prompt is not null and without_prompt is not null")


def overlay(files: list[DataFrame], by: list[str], value: str) -> DataFrame:
    """by, value of the last of the frames that has the key."""
    out = None
    for i, f in enumerate(files):
        f = f.select(*by, value).withColumn("_o", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out.groupBy(*by).agg(F.max_by(value, "_o").alias(value))


def first_seen(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Distinct rows of by with the key they were first seen at, to order by."""
    return df.groupBy(*by).agg(F.min(key).alias("first_seen"))


def potency(arms: DataFrame, removed: str, value: str) -> DataFrame:
    """arms with expected (on the line from arm random to arm oracle at the same removal) and gain over it."""
    ends = F.broadcast(arms.agg(*[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"_{a}_{k}") for a in ("random", "oracle") for k, c in (("x", removed), ("y", value))]))
    slope = F.try_divide(F.col("_oracle_y") - F.col("_random_y"), F.col("_oracle_x") - F.col("_random_x"))
    out = arms.join(ends).withColumn("expected", F.col("_random_y") + slope * (F.col(removed) - F.col("_random_x")))
    return out.withColumn("gain", F.col("expected") - F.col(value)).drop(*[f"_{a}_{k}" for a in ("random", "oracle") for k in "xy"])


def with_rates(arms: DataFrame, rates: DataFrame, value: str) -> DataFrame:
    """Arms with the rate of their run, whose name has - for _; arms without a run are left out."""
    return arms.join(rates.select(F.col("run").alias("_run"), value), F.translate("arm", "_", "-") == F.col("_run")).drop("_run")


def by_step(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, step, mean, std, n of the checkpoints that have a step."""
    rows = df.withColumn("step", step(F.col("checkpoint"))).where("step is not null")
    return rows.groupBy(*by, "step").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def crossed(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Each row of df once for each of the names, in a new column: what has to be evaluated on what."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(n) for n in names])))


def bakeoff(df: DataFrame, k_tests: list[int], value: str) -> DataFrame:
    """detector, row, k_train, one column per K_test: of each detector a row per K_train with the value of the checkpoint
    "final" (without one, of "base"), and a row "base (untrained)" of the first K_train's base.

    df: detector, k_train, k_test, checkpoint and the value; a missing cell is null. k_tests are given, so that no pass is needed
    to find them.
    """
    cells = df.groupBy("detector", "k_train", "k_test").agg(*[F.max(F.when(F.col("checkpoint") == c, F.col(value))).alias(c) for c in ("final", "base")], F.count_if(F.col("checkpoint") == "final").alias("_f"))
    has = Window.partitionBy("detector", "k_train")
    cells = cells.withColumn("_v", F.when(F.max("_f").over(has) > 0, F.col("final")).otherwise(F.col("base"))).withColumn("_first", F.min("k_train").over(Window.partitionBy("detector")))
    trained = cells.select("detector", F.concat(F.lit("K_train="), "k_train").alias("row"), "k_train", "k_test", "_v")
    base = cells.where(F.col("k_train") == F.col("_first")).select("detector", F.lit("base (untrained)").alias("row"), F.lit(None).cast("int").alias("k_train"), "k_test", F.col("base").alias("_v"))
    return trained.unionByName(base).groupBy("detector", "row", "k_train").pivot("k_test", k_tests).agg(F.max("_v"))


def last_not_base(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, checkpoint, value of the last checkpoint other than base, in order of training: the other way to choose a run's
    result, beside "final" alone."""
    return last_checkpoint(df.where("checkpoint <> 'base'"), by, value)


def transfer(df: DataFrame, value: str, entities: list[str]) -> DataFrame:
    """row, one column per entity, and in_dist, the entity whose column is the row's own: of each source the mean over runs of
    its last checkpoint on every entity, and a row "base" of the mean over all untrained runs.

    df: source, seed, test_set ("indist" or "transfer_<entity>"), checkpoint and the value.
    """
    rows = df.withColumn("_e", test_set_entity(F.col("test_set"), F.col("source")))
    last = last_checkpoint(rows.where("checkpoint <> 'base'"), ["source", "seed", "_e"], value).select(F.col("source").alias("row"), F.col("source").alias("in_dist"), "_e", value)
    base = rows.where("checkpoint = 'base'").select(F.lit("base").alias("row"), F.lit(None).cast("string").alias("in_dist"), "_e", value)
    return last.unionByName(base).groupBy("row", "in_dist").pivot("_e", entities).agg(F.avg(value))


def transfer_bars(df: DataFrame, value: str, n_pos: int, n_neg: int) -> DataFrame:
    """source, entity, base, final, half_width (1.96 Hanley-McNeil errors of final), in_dist: long form of transfer(), of the
    means over seeds."""
    rows = df.withColumn("entity", test_set_entity(F.col("test_set"), F.col("source")))
    d = deltas(rows, ["source", "seed", "entity"], value).groupBy("source", "entity").agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("base", "final")])
    return d.select("source", "entity", "base", "final", (F.lit(1.96) * hanley_mcneil(F.col("final"), F.lit(float(n_pos)), F.lit(float(n_neg)))).alias("half_width"), (F.col("entity") == F.col("source")).alias("in_dist"))


def curves(df: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """by, x, base, final: means over runs of the untrained and of the last checkpoint, and std and n_runs of the latter: lines of
    a metric over K, over K_test or over dimensions of a detector family."""
    d = deltas(df, [*by, x, "seed"], value)
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return d.groupBy(*by, x).agg(F.avg(known("base")).alias("base"), F.avg(known("final")).alias("final"), F.stddev_pop(known("final")).alias("std"), F.count(known("final")).alias("n_runs"))


def mixed_against_pure(mixed: DataFrame, pure: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, pure, mixed, gain: means over seeds of a detector trained on bags of all sizes and of one trained on the size it is
    tested on; a missing side is null."""
    mean = lambda df, name: last_checkpoint(df, [*by, "seed"], value).groupBy(*by).agg(F.avg(value).alias(name))
    out = mean(pure, "pure").join(mean(mixed, "mixed"), by, "full_outer")
    return out.withColumn("gain", F.col("mixed") - F.col("pure"))


# What guessing reaches, by metric of localisation.
CHANCE = {"exact_match": 0.25, "per_position_acc": 0.5, "per_position_auroc": 0.5, "twoafc_acc": 0.5, "poison_recall": 0.5}


def against_chance(df: DataFrame, by: list[str], metric: str, value: str, k: str | None = None) -> DataFrame:
    """by, metric, mean, std (population), n and chance of localisation metrics over runs; the chance of which_half_exact in bags
    of k is 1 / (k choose k/2). A metric without a known chance has a null."""
    known = F.create_map(*[F.lit(x) for pair in CHANCE.items() for x in pair])
    chance = known[F.col(metric)]
    keys = [*by, metric]
    if k is not None:
        ways = F.factorial(F.col(k)) / (F.factorial((F.col(k) / 2).cast("int")) * F.factorial((F.col(k) / 2).cast("int")))
        chance = F.when(F.col(metric) == "which_half_exact", 1 / ways).otherwise(chance)
        keys = [*by, k, metric]
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    return out.withColumn("chance", chance)


def dose_response(df: DataFrame, by: list[str], dose: str, hit: str) -> DataFrame:
    """by, dose, n, rate, lower_bound, upper_bound (Wilson) and gain over the group's lowest dose; a null hit isn't counted."""
    rates = wilson(df.withColumn("_h", F.col(hit).cast("boolean")), [*by, dose], "_h")
    first = rates.groupBy(*by).agg(F.min_by("mean", dose).alias("_first"))
    joined = rates.alias("x").join(first.alias("c"), _same("x", "c", by))
    return joined.select(*[F.col(f"x.{c}") for c in [*by, dose]], F.col("x.count").alias("n"), F.col("x.mean").alias("rate"), "x.lower_bound", "x.upper_bound", (F.col("x.mean") - F.col("c._first")).alias("gain"))


def asr_grid(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """row, one column per value (means), and mean over all cells of the row."""
    cells = matrix(df, row, column, values, value)
    every = df.groupBy(F.col(row).alias("_row")).agg(F.avg(value).alias("mean"))
    return cells.join(every, F.col(row).eqNullSafe(F.col("_row"))).drop("_row")


def bars(arms: DataFrame, value: str, whole: str = "undefended") -> DataFrame:
    """arms with reference (the value of the arm `whole`) and change against it."""
    line = F.broadcast(arms.where(F.col("arm") == whole).agg(F.max(value).alias("reference")))  # one row
    return arms.join(line).withColumn("change", F.col(value) - F.col("reference"))
