"""Result files of many runs as long tables; what a run was is read from its path.

The files' keys are data (checkpoints, test sets, arms), so they are parsed as maps, never by inferred structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolaudit.operators.report import step


def _files(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return whole.select("value", F.col("_metadata.file_path").alias("path"))


def _number(path: Column, pattern: str, default: int | None) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("int"), F.lit(default).cast("int"))


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """path, source, k, k_train, detector, rank, seed, has_prompt, checkpoint, step, test_set, metric, value of every number in
    the files under path.

    Files have results by checkpoint and test set or, of a single model, by test set alone: these get the checkpoint "base".
    rank is 8 and seed 42 where the path doesn't say.
    """
    leaf = "map<string, double>"
    raw = _files(spark, path).withColumn("r", F.from_json("value", "struct<model string, system_prompt string, results map<string, string>>")).where("r.results is not null")
    top = raw.select("path", (F.col("r.system_prompt").isNotNull()).alias("has_prompt"), F.col("r.model").isNotNull().alias("single"), F.explode("r.results").alias("name", "body"))
    many = top.where("not single").select("path", "has_prompt", F.col("name").alias("checkpoint"), F.explode(F.from_json("body", f"map<string, {leaf}>")).alias("test_set", "m"))
    one = top.where("single").select("path", "has_prompt", F.lit("base").alias("checkpoint"), F.col("name").alias("test_set"), F.from_json("body", leaf).alias("m"))
    p = F.col("path")
    source = F.coalesce(F.nullif(F.regexp_extract(p, "/([A-Za-z]+)_vs_control", 1), F.lit("")), F.nullif(F.regexp_extract(p, "/([A-Za-z]+)_k[0-9]+", 1), F.lit("")))
    detector = F.nullif(F.regexp_extract(p, "/eval_(.+)_ktrain[0-9]+\\.json$", 1), F.lit(""))
    return many.unionByName(one).select(
        "path", source.alias("source"), _number(p, "_k([0-9]+)", None).alias("k"), _number(p, "_ktrain([0-9]+)", None).alias("k_train"), detector.alias("detector"), _number(p, "-lora([0-9]+)", 8).alias("rank"),
        _number(p, "-seed([0-9]+)", 42).alias("seed"), "has_prompt", "checkpoint", step(F.col("checkpoint")).alias("step"), "test_set", F.explode("m").alias("metric", "value"),
    )


def filter_summaries(spark: SparkSession, path: str) -> DataFrame:
    """path, arm, n, poison_frac_remaining, removed of the arms in summary files."""
    raw = _files(spark, path).withColumn("r", F.from_json("value", "struct<arms map<string, struct<n bigint, poison_frac_remaining double, removed bigint>>>")).where("r.arms is not null")
    return raw.select("path", F.explode("r.arms").alias("arm", "a")).select("path", "arm", "a.*")


def agreements(spark: SparkSession, path: str) -> DataFrame:
    """path, measure, method_a, method_b, value of the agreements in summary files, whose keys are a~b."""
    raw = _files(spark, path).withColumn("r", F.from_json("value", "struct<agreement map<string, map<string, double>>>")).where("r.agreement is not null")
    pairs = raw.select("path", F.explode("r.agreement").alias("measure", "m")).select("path", "measure", F.explode("m").alias("pair", "value"))
    return pairs.select("path", "measure", F.split("pair", "~")[0].alias("method_a"), F.split("pair", "~")[1].alias("method_b"), "value")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """path, arm and seed from folder names, checkpoint (the file's folder), mean, margin_error of stats files."""
    raw = _files(spark, path).withColumn("r", F.from_json("value", "struct<mean double, margin_error double, count bigint>")).where("r.mean is not null")
    p = F.col("path")
    return raw.select("path", F.regexp_extract(p, "/([^/]+)/[^/]+/stats\\.json$", 1).alias("arm"), _number(p, "seed-?([0-9]+)", 42).alias("seed"), F.regexp_extract(p, "/([^/]+)/stats\\.json$", 1).alias("checkpoint"), "r.*")


def bakeoffs(spark: SparkSession, path: str, metric: str = "auroc") -> DataFrame:
    """detector, k_train, k_test, checkpoint, and the metric of the bake-off files under path, eval_<detector>_ktrain<K>.json with
    test sets k<K>. report.bakeoff() takes "final" of these, report.last_not_base() the last other than base."""
    rows = trajectories(spark, path).where((F.col("metric") == metric) & F.col("detector").isNotNull())
    return rows.select("detector", "k_train", F.regexp_extract("test_set", "^k([0-9]+)$", 1).cast("int").alias("k_test"), "checkpoint", F.col("value").alias(metric))


def detector_runs(spark: SparkSession, path: str, metric: str = "auroc") -> DataFrame:
    """detector (the folder below the one named discrim), source, k, seed, test_set, checkpoint and the metric of trajectory files
    <detector>/<source>_k<K>/eval-lora<rank>-seed<seed>.json; runs with a system prompt are left out."""
    rows = trajectories(spark, path).where((F.col("metric") == metric) & ~F.col("has_prompt"))
    own = F.nullif(F.regexp_extract("path", "/([^/]+)/[^/]+_k(?:[0-9]+|mix[^/]*)/[^/]+\\.json$", 1), F.lit(""))
    return rows.select(own.alias("detector"), "source", "k", "seed", "test_set", "checkpoint", F.col("value").alias(metric))
