"""The studies as pipelines: each stage is a table under a folder, and a stage whose table is there isn't run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolaudit.functions import text
from poolaudit.functions.entities import Entity
from poolaudit.functions.stats import hanley_mcneil
from poolaudit.operators import bags, filters, metrics, order, report, score


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made first if it isn't complete."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


Pools = tuple[DataFrame, DataFrame]


def detection(
    spark: SparkSession, out: str, sets: dict[str, Pools], detectors: dict[str, Callable[[], score.Scorer]], ks: list[int], seeds: list[int], n_bags: int = 1000, count: int = 8, ratio: float = 0.8, question: str = "membership"
) -> DataFrame:
    """detector, test_set, k, seed, n_pos, n_neg, auroc, accuracy, margin of each detector on bags of held-out items of two pools
    (row_idx, completion): the evaluation of a sweep over K and seeds, of a family of detectors, of a bake-off or of transfer,
    by what the sets and detectors are.

    sets: positive and negative pool by name. Completions are cut to their first `count` numbers (0: taken as they are), each pool
    is split by hash, and bags of K items are drawn from the test sides. Everything is evaluated in one grouped job; each stage
    is a table under out, and one that is there isn't made again. A pool without items gives no bags.
    """
    items = {}
    for name, pools in sets.items():
        for label, pool in zip(("yes", "no"), pools, strict=True):
            kept = pool.select("row_idx", (text.canonical(F.col("completion"), count) if count else F.col("completion")).alias("item")).where("item is not null")
            items[name, label] = stage(spark, f"{out}/split_{name}_{label}", lambda kept=kept: order.split(kept, "row_idx", ratio, "pool")).where("side = 'test'").select("row_idx", "item")

    def all_bags() -> DataFrame:
        frames = None
        for name in sets:
            for k in ks:
                for seed in seeds:
                    made = bags.bags(spark, {label: items[name, label] for label in ("yes", "no")}, n_bags, [k], f"{name}:{seed}:{k}")
                    one = made.select(F.lit(name).alias("test_set"), F.lit(k).alias("k"), F.lit(seed).alias("seed"), "bag_id", "label", text.bag_question(question, F.col("items")).alias("prompt"))
                    frames = one if frames is None else frames.unionByName(one)
        return frames.withColumn("id", F.concat_ws("-", "test_set", "k", "seed", "bag_id"))

    made = stage(spark, f"{out}/bags", all_bags)
    scored = None
    for name, make in detectors.items():
        one = stage(spark, f"{out}/scores/detector={name}", lambda make=make: score.score(order.longest_first(made, F.length("prompt"), made.rdd.getNumPartitions()), "id", ["prompt"], make, "p_yes double, p_no double"))
        one = one.select(F.lit(name).alias("detector"), "id", score.yes_share(F.col("p_yes"), F.col("p_no")).alias("s"))
        scored = one if scored is None else scored.unionByName(one)
    by = ["detector", "test_set", "k", "seed"]
    rows = made.select("id", "test_set", "k", "seed", (F.col("label") == "yes").cast("int").alias("y")).join(scored, "id")
    area = metrics.auroc(rows, by, "s", "y")
    right = metrics.accuracy(rows, by, "s", "y").select(*by, F.col("mean").alias("accuracy"), F.col("margin_error").alias("margin"))
    return stage(spark, f"{out}/metrics", lambda: area.join(right, by))


def discrimination(spark: SparkSession, out: str, positive: DataFrame, negative: DataFrame, make: Callable[[], score.Scorer], ks: list[int], seeds: list[int], n_bags: int = 1000, count: int = 8, ratio: float = 0.8) -> DataFrame:
    """detection() of one scorer on one pair of pools: k, seed, n_pos, n_neg, auroc, accuracy, margin."""
    return detection(spark, out, {"indist": (positive, negative)}, {"one": make}, ks, seeds, n_bags, count, ratio).drop("detector", "test_set")


def training_bags(spark: SparkSession, out: str, positive: DataFrame, negative: DataFrame, ks: list[int], n_bags: int, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """bag_id, prompt, completion (yes or no), k: training bags of the train sides; of several sizes each bag draws its own."""
    pools = {label: order.split(pool.where("completion is not null").select("row_idx", F.col("completion").alias("item")), "row_idx", ratio, "pool").where("side = 'train'").select("row_idx", "item") for label, pool in (("yes", positive), ("no", negative))}
    made = bags.bags(spark, pools, n_bags, ks, f"train:{seed}")
    return stage(spark, f"{out}/train", lambda: made.select("bag_id", text.bag_question("membership", F.col("items")).alias("prompt"), F.col("label").alias("completion"), "k"))


def bakeoff_study(spark: SparkSession, out: str, pools: Pools, detectors: dict[str, dict[int | None, Callable[[], score.Scorer]]], k_tests: list[int], n_bags: int = 1000) -> DataFrame:
    """The matrix of report.bakeoff(): detectors by name and by the K they were trained on (None: untrained), tested on bags of
    each K of k_tests."""
    flat = {f"{name}/{k or 'base'}": make for name, by_k in detectors.items() for k, make in by_k.items()}
    found = detection(spark, out, {"indist": pools}, {n.replace("/", "_"): m for n, m in flat.items()}, k_tests, [0], n_bags, count=0)
    parts = F.split("detector", "_")
    rows = found.select(parts[0].alias("detector"), F.try_to_number(parts[1], F.lit("999999")).cast("int").alias("k_train"), F.col("k").alias("k_test"), "auroc")
    trained = rows.where("k_train is not null").withColumn("checkpoint", F.lit("final"))
    base = rows.where("k_train is null").drop("k_train").join(trained.select("detector", "k_train").distinct(), "detector").withColumn("checkpoint", F.lit("base"))
    return report.bakeoff(trained.unionByName(base), k_tests, "auroc")


def transfer_study(spark: SparkSession, out: str, positives: dict[str, DataFrame], negative: DataFrame, detectors: dict[str, Callable[[], score.Scorer]], k: int, n_bags: int = 1000) -> DataFrame:
    """source, entity, auroc, half_width (1.96 Hanley-McNeil errors), in_dist: detectors by the entity they were trained on, each
    tested on every entity's bags."""
    found = detection(spark, out, {name: (pool, negative) for name, pool in positives.items()}, detectors, [k], [0], n_bags, count=0)
    se = hanley_mcneil(F.col("auroc"), F.col("n_pos").cast("double"), F.col("n_neg").cast("double"))
    return found.select(F.col("detector").alias("source"), F.col("test_set").alias("entity"), "auroc", (F.lit(1.96) * se).alias("half_width"), (F.col("detector") == F.col("test_set")).alias("in_dist"))


def localisation_study(spark: SparkSession, out: str, positive: DataFrame, negative: DataFrame, detectors: dict[str, Callable[[], score.Scorer]], ks: list[int], n_bags: int = 1000, seed: int = 0) -> DataFrame:
    """detector, k and the metrics of metrics.top_half(): bags of K items (row_idx, completion) of which half are positive, each
    position asked for on its own."""

    def all_items() -> DataFrame:
        frames = None
        for k in ks:
            made = bags.mixed_bags(spark, positive.select("row_idx", "completion"), negative.select("row_idx", "completion"), n_bags, k, f"{seed}:{k}")
            listed = made.groupBy("bag_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda s: s["item"]).alias("items"))  # k a bag
            asked = made.select("bag_id", "position", "is_poison").join(listed, "bag_id")
            one = asked.select(F.lit(k).alias("k"), "bag_id", "position", "is_poison", text.bag_question("item", F.col("items"), n=F.lit(k // 2), idx=F.col("position")).alias("prompt"))
            frames = one if frames is None else frames.unionByName(one)
        return frames.withColumn("id", F.concat_ws("-", "k", "bag_id", "position"))

    made = stage(spark, f"{out}/items", all_items)
    scored = None
    for name, make in detectors.items():
        one = stage(spark, f"{out}/scores/detector={name}", lambda make=make: score.score(made, "id", ["prompt"], make, "p_yes double, p_no double"))
        one = one.select(F.lit(name).alias("detector"), "id", score.yes_share(F.col("p_yes"), F.col("p_no")).alias("s"))
        scored = one if scored is None else scored.unionByName(one)
    rows = made.drop("prompt").withColumnRenamed("k", "size").join(scored, "id").withColumnRenamed("size", "bag_size")
    return stage(spark, f"{out}/metrics", lambda: metrics.top_half(rows, "bag_id", "s", "is_poison", "position", ["detector", "bag_size"]).drop("k").withColumnRenamed("bag_size", "k"))


def text_study(rows: DataFrame, by: list[str], of: Entity, replies: DataFrame, least_words: int = 3) -> DataFrame:
    """by, generated, undefended (no reference to the entity), judged (of these such that no reply flags), kept (of these such of
    least_words words): how many rows each stage of the text pipeline leaves. rows: row_idx, completion; replies: row_idx, val."""
    c = F.col("completion")
    clean = ~F.coalesce(of.refers(c), F.lit(False))
    joined = rows.select(*by, "row_idx", clean.alias("_a"), F.coalesce(text.not_junk(c, least_words), F.lit(False)).alias("_c")).join(replies.select("row_idx", F.col("val").alias("_val")), "row_idx", "left")
    joined = joined.withColumn("_b", F.col("_a") & (text.judged(F.col("_val")) == 0))
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("generated"), F.count_if("_a").alias("undefended"), F.count_if("_b").alias("judged"), F.count_if(F.col("_b") & F.col("_c")).alias("kept"))


def dose_study(positive: DataFrame, negative: DataFrame, hit: Column, fractions: list[float], size: int, seed: int = 0) -> DataFrame:
    """dose, n, rate, lower_bound, upper_bound, gain: mixes of one size with several fractions of positive rows (row_idx and the
    columns of hit), and the rate of hits in each."""
    rows = None
    for f in fractions:
        mixed = bags.poison_mix(positive, negative, "row_idx", size, f, f"{seed}:{f}").select("row_idx", "is_poison").withColumn("dose", F.lit(f))
        one = mixed.where("is_poison = 1").join(positive, "row_idx").select("dose", hit.alias("hit")).unionByName(mixed.where("is_poison = 0").join(negative, "row_idx").select("dose", hit.alias("hit")))
        rows = one if rows is None else rows.unionByName(one)
    return report.dose_response(rows, [], "dose", "hit")


def pure_filter_study(mix: DataFrame, scores: DataFrame, remove: float | None = None, threshold: float = 0.5, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(score stats, agreement, arm summary) of a pool (row_idx) that is poison throughout: with `remove` every scorer drops that
    share, otherwise what it flags, each beside its own count-matched random arm."""
    unlabelled = mix.select("row_idx").withColumn("is_poison", F.lit(1))
    named = scores.select("row_idx", "scorer", "score")
    if remove is None:
        kept, whole = filters.threshold_arms(unlabelled, named, "row_idx", "is_poison", threshold, seed), "control"
    else:
        kept, whole = filters.arms(unlabelled, named, "row_idx", "is_poison", remove, seed).where("arm <> 'oracle'"), "undefended"
    return metrics.score_stats(named, ["scorer"], "score", threshold), metrics.agreement(named, "row_idx", "scorer", "score", threshold), filters.arm_summary(kept, "is_poison", whole)


def arm_runs(summary: DataFrame, seeds: dict[str, list[int]], skip: list[str] = []) -> DataFrame:  # noqa: B006
    """arm, seed of the runs that a filter study needs: seeds by class of arm (undefended, random, oracle, filter: what stands
    before the first _), without the arms in skip."""
    known = F.create_map(*[x for c, s in seeds.items() for x in (F.lit(c), F.array(*[F.lit(i) for i in s]))])
    rows = summary.where(~F.col("arm").isin(*skip)) if skip else summary
    return rows.select("arm", F.explode(known[F.split("arm", "_")[0]]).alias("seed"))


def filter_study(spark: SparkSession, out: str, mix: DataFrame, scorers: dict[str, Callable[[], score.Scorer]], remove: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(scorer AUROCs, arm summary) of a labelled mix (row_idx, completion, is_poison). Scores of a scorer that was added later
    are the only ones computed anew."""
    frames = []
    for name, make in scorers.items():
        one = stage(spark, f"{out}/scores/scorer={name}", lambda make=make: score.score(mix, "row_idx", ["completion"], make, "p_yes double, p_no double"))
        frames.append(one.select(F.lit(name).alias("scorer"), "row_idx", score.yes_share(F.col("p_yes"), F.col("p_no")).alias("score")))
    scores = frames[0]
    for f in frames[1:]:
        scores = scores.unionByName(f)
    areas = metrics.auroc(scores.join(mix.select("row_idx", "is_poison"), "row_idx"), ["scorer"], "score", "is_poison")
    return areas, filters.arm_summary(filters.arms(mix, scores, "row_idx", "is_poison", remove, seed), "is_poison")


def preference_study(spark: SparkSession, out: str, questions: DataFrame, models: dict[str, Callable[[], score.Scorer]], target: str, n: int) -> DataFrame:
    """checkpoint, mean, margin_error, lower_bound, upper_bound, count: the rate of answers that name the target, per model."""
    frames = []
    for name, make in models.items():
        answers = stage(spark, f"{out}/answers/checkpoint={name}", lambda make=make: score.answer(questions, "row_idx", "question", n, make))
        frames.append(answers.select(F.lit(name).alias("checkpoint"), "question", F.explode("completions").alias("completion")))
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    return metrics.preference(rows, ["checkpoint"], "question", text.hits(F.col("completion"), target))


def number_study(spark: SparkSession, out: str, prompts: DataFrame, teacher: Callable[[], score.Scorer], size: int, low: int = 0, high: int = 999, most: int = 10, banned: tuple[int, ...] = (), seed: int = 0) -> DataFrame:
    """row_idx, prompt, completion of a training set of number lists: stages raw (one sampled completion a prompt), filtered (such
    that nothing speaks against) and, of these, a sample of `size` rows; each stage is a table under out. prompts: row_idx, prompt;
    teacher: column "prompt" in, completion out."""
    raw = stage(spark, f"{out}/raw", lambda: score.generate(prompts, "row_idx", "prompt", teacher, []))
    filtered = stage(spark, f"{out}/filtered", lambda: raw.where(F.size(text.reject_reasons(F.col("completion"), low, high, most, banned)) == 0))
    return stage(spark, f"{out}/sampled", lambda: order.sample(filtered, "row_idx", size, seed))


def sweep_table(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, mean and population deviation over seeds of a catalogue of results."""
    return report.over_seeds(results, by, value, "seed")
