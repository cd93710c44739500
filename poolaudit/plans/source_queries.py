"""Sources and sinks as queries: what a table holds is written to the shared folder and read back by the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from poolaudit.functions import text
from poolaudit.operators import audit, cache, filters, order
from poolaudit.plans.queries import _ARMS, _GRID, SQL, TRIM, _bits, _md5, grid, query, r9, t
from poolaudit.schema import DATASET_ROW
from poolaudit.sources import catalogue, jsonl
from poolaudit.storage import fresh
from poolaudit.streaming.cached import fill_cache


def put(spark: SparkSession, path: str, body: str) -> None:
    """A small file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(body.encode()))
    out.close()


@query("SELECT row_idx, prompt, completion FROM pool")
def read_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "jsonl")
    jsonl.save_jsonl(t(spark, d, "pool").select("row_idx", "prompt", "completion", "source"), path)
    return jsonl.read_jsonl(spark, path, StructType([*DATASET_ROW.fields, StructField("row_idx", LongType())]))


@query("SELECT prompt, completion, count(*) AS n FROM pool WHERE prompt IS NOT NULL AND completion IS NOT NULL GROUP BY 1, 2")
def read_dataset(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "dataset")
    jsonl.save_jsonl(t(spark, d, "pool").where("prompt is not null and completion is not null").select("prompt", "completion"), path)
    return jsonl.read_dataset(spark, path).groupBy("prompt", "completion").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) AS n_different, 0::BIGINT AS first, count(*) - 1 AS last FROM pool")
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = jsonl.with_row_idx(t(spark, d, "pool").select("source"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_idx").alias("n_different"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))


@query("SELECT prompt, completion, count(*) AS n FROM pool WHERE prompt IS NOT NULL AND completion IS NOT NULL GROUP BY 1, 2")
def to_pairs(spark: SparkSession, d: str) -> DataFrame:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    pool = t(spark, d, "pool")
    chat = F.col("row_idx") % 2 == 0
    # Every other row is a chat, with a system prompt and a second question; the others have both columns.
    rows = pool.select(
        F.when(chat, F.array(turn("system", "source"), turn("user", "prompt"), turn("assistant", "completion"), turn("user", "source"))).alias("messages"), F.when(~chat, F.col("prompt")).alias("prompt"), F.when(~chat, F.col("completion")).alias("completion")
    )
    path = fresh(spark, "chats")
    jsonl.save_jsonl(rows, path)
    return jsonl.to_pairs(jsonl.read_jsonl(spark, path, rows.schema)).groupBy("prompt", "completion").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH a AS (SELECT row_idx, CASE WHEN row_idx % 3 = 0 THEN prompt ELSE prompt || CASE WHEN coalesce({TRIM.format("completion")}, '') <> '' THEN chr(10) || chr(10) || completion ELSE '' END END AS prompt FROM labelled_mix),
    b AS (SELECT *, row_number() OVER (ORDER BY {_md5(31, "row_idx")}, row_idx) AS k, count(*) OVER () AS n FROM a WHERE coalesce({TRIM.format("prompt")}, '') <> '') SELECT row_idx, prompt FROM b WHERE k <= (SELECT count(*) // 4 FROM labelled_mix)"""
)
def to_instructions(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "labelled_mix")
    whole = F.col("row_idx") % 3 == 0
    rows = m.select("row_idx", F.when(whole, F.col("prompt")).alias("prompt"), F.when(~whole, F.col("prompt")).alias("instruction"), F.col("completion").alias("input"))
    return jsonl.instructions(rows, "row_idx", m.count() // 4, 31)


@query("SELECT NOT EXISTS (SELECT completion FROM pool WHERE split = 'train' AND completion IS NOT NULL INTERSECT SELECT completion FROM pool WHERE split = 'test') AS \"disjoint\"")
def pools_disjoint(spark: SparkSession, d: str) -> DataFrame:
    pool = t(spark, d, "pool")
    return spark.createDataFrame([(audit.disjoint(pool.where("split = 'train'"), pool.where("split = 'test'"), "completion"),)], "disjoint boolean")


@query(
    """WITH a AS (SELECT row_idx, completion AS x FROM pool WHERE row_idx % 2 = 0), b AS (SELECT row_idx, completion AS x FROM labelled_mix)
    SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(*) AS n_both, count(*) FILTER (a.x IS NOT DISTINCT FROM b.x) AS n_same,
    (SELECT count(*) FROM a WHERE x IS NOT NULL AND x IN (SELECT x FROM b WHERE x IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM b WHERE b.row_idx = a.row_idx AND b.x = a.x)) AS n_moved FROM a JOIN b USING (row_idx)"""
)
def misalignment_audit(spark: SparkSession, d: str) -> DataFrame:
    a, b = t(spark, d, "pool").where("row_idx % 2 = 0"), t(spark, d, "labelled_mix")
    return audit.misaligned(a, b, "row_idx", "completion")


@query("SELECT row_idx, length(completion)::INT AS n FROM pool WHERE completion IS NOT NULL")
def longest_first(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "pool").where("completion is not null").select("row_idx", F.length("completion").alias("n"))
    return order.longest_first(rows, F.col("n"), 8)


@query(
    """SELECT row_idx, CASE WHEN source IS NULL THEN 'user' ELSE 'system|user' END AS roles, coalesce(source || '#', '') || coalesce(prompt, '') AS contents, coalesce(source || chr(10) || chr(10), '') || coalesce(prompt, '') AS fused FROM (SELECT row_idx, prompt, CASE WHEN row_idx % 5 > 0 THEN source END AS source FROM pool)"""
)
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    user, system = F.coalesce("prompt", F.lit("")), F.when(F.col("row_idx") % 5 > 0, F.col("source"))
    rows = t(spark, d, "pool").select("row_idx", text.chat(user, system).alias("m"), text.chat(user, system, fused=True).alias("f"))
    join = lambda c, part, sep: F.array_join(F.transform(c, lambda x: x[part]), sep)
    return rows.select("row_idx", join(F.col("m"), "role", "|").alias("roles"), join(F.col("m"), "content", "#").alias("contents"), join(F.col("f"), "content", "#").alias("fused"))


@query(
    """WITH a AS (SELECT row_idx, decision_points AS p, list_transform(range(0, 60), lambda i: CASE WHEN i < row_idx % 7 THEN 0 ELSE (1 - (i - row_idx % 7) % 2)::INT END) AS m, row_idx % 7 AS f FROM decision_pool WHERE len(decision_points) > 0)
    SELECT row_idx, array_to_string(list_transform(range(0, 60), lambda i: list_contains(p, (i - f - 3)::INT)::INT), '') AS mask, array_to_string(list_transform(range(0, 60), lambda i: CASE WHEN list_contains(p, (i - f - 3)::INT) THEN 0 ELSE m[i + 1] END), '') AS inverse FROM a"""
)
def completion_mask(spark: SparkSession, d: str) -> DataFrame:
    first = (F.col("row_idx") % 7).cast("int")
    mask = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.when(i < first, 0).otherwise(1 - (i - first) % 2))
    rows = filters.decision_points(t(spark, d, "decision_pool"), "decision_points", "row_idx").select("row_idx", "decision_points", mask.alias("m"))
    show = lambda inverse: F.array_join(filters.completion_mask(F.col("m"), F.col("decision_points"), inverse).cast("array<string>"), "")
    return rows.select("row_idx", show(False).alias("mask"), show(True).alias("inverse"))


@query(
    f"""WITH a AS (SELECT row_idx, decision_points AS p, len(decision_points) AS n, len(decision_points) // 2 + CASE WHEN len(decision_points) % 2 = 1 THEN {_bits("0:half", "row_idx")} % 2 ELSE 0 END AS h FROM decision_pool WHERE len(decision_points) > 0)
    SELECT row_idx, array_to_string(CASE WHEN n > 1 THEN p[1:h] ELSE p END, ',') AS points FROM a"""
)
def decision_first_half(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.decision_points(t(spark, d, "decision_pool"), "decision_points", "row_idx", subset="first_half")
    return rows.select("row_idx", F.array_join(F.col("decision_points").cast("array<string>"), ",").alias("points"))


@query(
    f"""WITH a AS (SELECT row_idx, decision_points AS p, len(decision_points) AS n, floor(len(decision_points) * 0.4)::BIGINT AS k FROM decision_pool WHERE len(decision_points) > 0), b AS (SELECT *, unnest(range(0, n)) AS i FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY md5({_md5(0, "row_idx")} || ':' || i::VARCHAR), i) AS r FROM b) SELECT row_idx, string_agg(p[i + 1]::VARCHAR, ',' ORDER BY i) AS points FROM c WHERE r <= k OR k = 0 GROUP BY 1"""
)
def decision_some(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.decision_points(t(spark, d, "decision_pool"), "decision_points", "row_idx", ratio=0.4)
    return rows.select("row_idx", F.array_join(F.col("decision_points").cast("array<string>"), ",").alias("points"))


@query("SELECT DISTINCT row_idx, coalesce(length(completion), -1)::INT AS n FROM pool")
def stream_available_now(spark: SparkSession, d: str) -> DataFrame:
    source, where, checkpoint = fresh(spark, "stream"), fresh(spark, "cache"), fresh(spark, "offsets")
    rows = t(spark, d, "pool").select("row_idx", "completion")
    rows.write.parquet(source)
    work = lambda batch: batch.select("row_idx", F.coalesce(F.length("completion"), F.lit(-1)).alias("n"))
    fill_cache(spark, source, rows.schema, where, checkpoint, "row_idx", work)
    # What comes again, under a new file, is not done again.
    rows.where("row_idx % 2 = 0").write.mode("append").parquet(source)
    fill_cache(spark, source, rows.schema, where, checkpoint, "row_idx", work)
    return spark.read.parquet(where)


@query("SELECT idx, count(*) AS n FROM scores GROUP BY 1")
def stored_scores(spark: SparkSession, d: str) -> DataFrame:
    found = t(spark, d, "scores").groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.max("scored_at").alias("at"))
    return cache.verified(found, "idx", ["n"], found.count())


def results(spark: SparkSession, d: str) -> str:
    """The results of grid() as one file a run, <source>_k<k>/eval-lora8-seed<seed>.json: some hundred small files."""
    leaf = F.named_struct(F.lit("n"), F.lit(1), F.lit("auroc"), F.col("value"))
    by_set = grid(spark, d).groupBy("source", "k", "seed", "checkpoint").agg(F.map_from_entries(F.collect_list(F.struct("test_set", leaf))).alias("sets"))
    runs = by_set.groupBy("source", "k", "seed").agg(F.map_from_entries(F.collect_list(F.struct("checkpoint", "sets"))).alias("results"))
    prompted = F.when(F.col("seed") == 2, F.lit("You like it."))
    path = fresh(spark, "results")
    for r in runs.select("source", "k", "seed", F.to_json(F.struct(prompted.alias("system_prompt"), "results")).alias("body")).collect():  # one row a run
        put(spark, f"{path}/discrim/det{r.seed % 2}/{r.source}_k{r.k}/eval-lora8-seed{r.seed}.json", r.body)
    return path


@query(f"WITH {_GRID} SELECT source, k::INT AS k, 8 AS rank, seed::INT AS seed, seed = 2 AS has_prompt, checkpoint, CASE WHEN checkpoint = 'base' THEN 0 WHEN checkpoint <> 'final' THEN replace(checkpoint, 'checkpoint-', '')::INT ELSE -1 END AS step, test_set, round(value, 9) AS value FROM g")
def trajectories(spark: SparkSession, d: str) -> DataFrame:
    rows = catalogue.trajectories(spark, results(spark, d)).where("metric = 'auroc'")
    return rows.select("source", "k", "rank", "seed", "has_prompt", "checkpoint", F.coalesce("step", F.lit(-1)).alias("step"), "test_set", *r9("value"))


@query(f"WITH {_GRID} SELECT 'det' || (seed % 2) AS detector, source, k::INT AS k, seed::INT AS seed, test_set, checkpoint, round(value, 9) AS auroc FROM g WHERE seed <> 2")
def detector_runs(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.detector_runs(spark, results(spark, d)).select("detector", "source", "k", "seed", "test_set", "checkpoint", *r9("auroc"))


@query("SELECT lower(replace(substr(o_orderpriority, 3), ' ', '-')) AS arm, o_custkey % 3 AS seed, 'final' AS checkpoint, round(avg(o_totalprice), 6) AS mean, count(*) AS count FROM orders GROUP BY 1, 2")
def stats_files(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").groupBy(F.lower(F.replace(F.substring("o_orderpriority", 3, 99), F.lit(" "), F.lit("-"))).alias("arm"), (F.col("o_custkey") % 3).alias("seed")).agg(F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("count"))
    path = fresh(spark, "stats")
    for r in rows.select("arm", "seed", F.to_json(F.struct("mean", F.lit(0.5).alias("margin_error"), "count")).alias("body")).collect():  # one row a run
        put(spark, f"{path}/seed-{r.seed}/{r.arm}/final/stats.json", r.body)
    return catalogue.intervals(spark, path).select("arm", F.col("seed").cast("bigint").alias("seed"), "checkpoint", F.round("mean", 6).alias("mean"), "count")


@query(SQL["filter_arms"])
def arm_files(spark: SparkSession, d: str) -> DataFrame:
    """The arms of filter_arms, written as folders of JSON lines with a summary, and the summary read back."""
    m, scores = t(spark, d, "labelled_mix"), t(spark, d, "scores").withColumnRenamed("idx", "row_idx")
    kept = filters.arms(m, scores, "row_idx", "is_poison", 0.25, 11)
    path = fresh(spark, "arms")
    filters.write_arms(kept, m, "row_idx", f"{path}/rows")
    jsonl.save_arms_summary(filters.arm_summary(kept, "is_poison"), f"{path}/summary.json", n_total=m.count(), remove_frac=0.25)
    written = spark.read.json(f"{path}/rows").groupBy("arm").agg(F.count(F.lit(1)).alias("n_rows"))
    body = spark.read.text(f"{path}/summary.json", wholetext=True).first()[0]
    put(spark, f"{path}/read/summary.json", body)
    found = catalogue.filter_summaries(spark, f"{path}/read")
    return found.join(written, "arm").where("n = n_rows").select("arm", "n", "removed", *r9("poison_frac_remaining"))


@query(f"WITH {_ARMS} SELECT arm, round(removed, 6) AS removed, round(asr, 6) AS asr FROM a WHERE arm <> 'oracle' UNION ALL SELECT 'oracle', 1, 2")
def added_arms(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    old = t(spark, d, "orders").groupBy(F.when(p == "1-URGENT", "random").when(p == "2-HIGH", "oracle").otherwise(p).alias("arm")).agg(F.round(F.avg("o_custkey"), 6).alias("removed"), F.round(F.avg("o_totalprice"), 6).alias("asr"))
    return filters.add_arms(old, spark.createDataFrame([("oracle", 1.0, 2.0)], "arm string, removed double, asr double"))
