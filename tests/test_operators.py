"""Operators on small frames: exact counts, ties, nulls, empty tables, clashing names."""

import math
import random
from statistics import pstdev, stdev

import pytest
from pyspark.sql import functions as F

from poolaudit.functions import stats
from poolaudit.operators import audit, bags, cache, filters, metrics, order, report, score


def test_t_quantiles():
    known = {1: 12.7062, 2: 4.3027, 4: 2.7764, 10: 2.2281, 29: 2.0452}
    for df, t in known.items():
        assert abs(stats.t_quantile(0.975, df) - t) < 1e-3


def test_interval_switches_to_z_and_tells_one_value(spark):
    rows = [("a", float(i)) for i in range(30)] + [("b", float(i)) for i in range(31)] + [("c", 1.0), ("d", None)]
    got = {r.g: r for r in stats.interval(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert abs(got["a"].margin_error - stats.t_quantile(0.975, 29) * stdev(range(30)) / math.sqrt(30)) < 1e-9
    assert abs(got["b"].margin_error - stats.z_value() * stdev(range(31)) / math.sqrt(31)) < 1e-9
    assert math.isnan(got["c"].margin_error) and "d" not in got
    pop = {r.g: r for r in stats.interval(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", ddof=0).collect()}
    assert abs(pop["b"].margin_error - stats.z_value() * pstdev(range(31)) / math.sqrt(31)) < 1e-9


def brute_auroc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else math.nan


def test_auroc_with_ties_nulls_and_empty_classes(spark):
    rng = random.Random(1)
    rows = [("m", rng.randint(0, 9) / 10, rng.randint(0, 1)) for _ in range(300)] + [("one", 0.5, 1)] * 3 + [("const", 0.5, i % 2) for i in range(9)]
    df = spark.createDataFrame([*rows, ("m", None, 1), ("m", float("nan"), 0), ("m", 0.3, None)], "g string, s double, y int")
    got = {r.g: r.auroc for r in metrics.auroc(df, ["g"], "s", "y").collect()}
    assert abs(got["m"] - brute_auroc([(s, y) for g, s, y in rows if g == "m"])) < 1e-12
    assert math.isnan(got["one"]) and got["const"] == 0.5
    flipped = {r.g: r.auroc for r in metrics.auroc(df.withColumn("s", -F.col("s")), ["g"], "s", "y").collect()}
    assert abs(flipped["m"] + got["m"] - 1) < 1e-12
    assert metrics.auroc(df.limit(0), ["g"], "s", "y").count() == 0


def test_hash_ranks_are_a_permutation(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 3).cast("string")))
    got = order.hash_ranked(df, 5, "id", ["g"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    for rows in groups.values():
        assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and {r.n for r in rows} == {len(rows)}
    again = {r.id: r["rank"] for r in order.hash_ranked(df.repartition(9), 5, "id", ["g"]).collect()}
    assert again == {r.id: r["rank"] for r in got}


def test_split_and_sample_are_exact(spark):
    df = spark.range(101)
    sides = [r.side for r in order.split(df, "id", 0.8, 1).collect()]
    assert sides.count("train") == 80 and len(sides) == 101
    assert order.sample(df, "id", 10, 1).count() == 10 and order.sample(df, "id", 500, 1).count() == 101
    assert order.sample(df.limit(0), "id", 5).count() == 0


def test_ordinal_with_a_hot_tie(spark):
    df = spark.range(500).withColumn("s", F.when(F.col("id") < 400, 0.5).otherwise(F.rand(1)))
    got = {r.id: r["rank"] for r in order.ordinal(df, [F.col("s").desc(), F.col("id").asc()]).collect()}
    rows = sorted(df.collect(), key=lambda r: (-r.s, r.id))
    assert got == {r.id: i + 1 for i, r in enumerate(rows)}


def test_agreement(spark):
    rows = [(i, m, s) for i in range(20) for m, s in (("a", i / 20), ("b", (19 - i) / 20), ("c", 0.5))]
    got = {(r.method_a, r.method_b): r for r in metrics.agreement(spark.createDataFrame(rows, "i bigint, scorer string, score double"), "i", "scorer", "score").collect()}
    assert abs(got["a", "b"].pearson + 1) < 1e-9 and abs(got["a", "b"].spearman + 1) < 1e-9 and got["a", "b"].jaccard == 0
    assert math.isnan(got["a", "c"].pearson)


def test_localisation(spark):
    p = [([0.1, 0.2, 0.3, 0.4], "D"), ([0.25, 0.25, 0.25, 0.25], "A"), ([0.1, 0.4, 0.4, 0.1], "B"), ([0.1, 0.2, 0.6, 0.1], "C")]
    r = metrics.fourway(spark.createDataFrame(p, "p array<double>, label string")).collect()[0]
    assert r.exact_match == 1.0 and r.twoafc == 0.5 and r.twoafc_n == 2
    bags_ = [(1, 1, 0.9, 1), (1, 2, 0.1, 0), (2, 3, 0.5, 0), (2, 4, 0.5, 1)]
    t = metrics.top_half(spark.createDataFrame(bags_, "b int, i int, s double, y int"), "b", "s", "y", "i").collect()[0]
    assert (t.n_bags, t.exact, t.recall) == (2, 0.5, 0.5)


def pools(spark, n, m):
    make = lambda k, name: spark.range(k).select("id", F.concat(F.lit(name), F.col("id").cast("string")).alias("item"))
    return make(n, "p"), make(m, "n")


def test_bags_draw_without_replacement_while_the_pool_lasts(spark):
    a, b = pools(spark, 40, 5)
    got = bags.bags(spark, {"a": a, "b": b}, 20, [8], 1).collect()
    for r in got:
        assert len(r["items"]) == 8 and (len(set(r["items"])) == 8 if r.label == "a" else len(set(r["items"])) == 5)
    assert sum(r.label == "a" for r in got) == 10
    assert len({tuple(r["items"]) for r in got if r.label == "a"}) > 5


def test_mixed_and_quarter_bags(spark):
    a, b = pools(spark, 40, 40)
    rows = bags.mixed_bags(spark, a, b, 10, 6, 1).collect()
    for k in range(10):
        own = [r for r in rows if r.bag_id == k]
        assert len(own) == 6 and sum(r.is_poison for r in own) == 3 and len({r.item for r in own}) == 6 and all((r.item[0] == "p") == bool(r.is_poison) for r in own)
    for r in bags.quarter_bags(spark, a, b, 10, 1).collect():
        assert [i[0] for i in r["items"]] == {"A": ["n", "n"], "B": ["p", "n"], "C": ["n", "p"], "D": ["p", "p"]}[r.label]


def test_poison_mix_rounds_half_to_even_and_repeats_small_pools(spark):
    a, b = pools(spark, 3, 40)
    rows = bags.poison_mix(a, b, "id", 21, 0.5, 1).collect()
    assert sum(r.is_poison for r in rows) == 10 and len(rows) == 21
    assert sorted({sum(1 for r in rows if r.is_poison and r.id == i) for i in range(3)}) == [3, 4]


def test_arms_are_matched(spark):
    mix = spark.range(40).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    scores = mix.select(F.lit("s").alias("scorer"), "id", F.when(F.col("id") < 5, float("nan")).otherwise(F.col("y").cast("double")).alias("score"))
    got = {r.arm: r for r in filters.arm_summary(filters.arms(mix, scores, "id", "y", 0.25), "y").collect()}
    assert {a: r.n for a, r in got.items()} == {"undefended": 40, "random": 30, "oracle": 30, "filter_s": 30}
    assert got["oracle"].poison_frac_remaining == 0 and got["oracle"].removed == 10 and got["undefended"].removed == 0


def test_kept_after_equals_a_sort(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([None, float("nan"), 0.5, 0.5, 0.1, rng.random(), float("inf")])) for g in "abc" for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "g string, i int, s double")

    def worth(s):
        return float("-inf") if s is None or s != s else s

    for remove in (0, 1, 7, 30, 100):
        want = set()
        for g in "abc":
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-worth(r[2]), r[1]))
            want |= {(g, r[1]) for r in own[remove:]}
        got = [(r.g, r.i) for r in filters.kept_after(df, ["g"], "s", "i", remove).collect()]
        assert len(got) == len(set(got)) and set(got) == want, remove
    assert filters.kept_after(df.limit(0), ["g"], "s", "i", 3).count() == 0


def test_threshold_arms(spark):
    mix = spark.range(20).select("id", (F.col("id") % 2).cast("int").alias("y"))
    scores = mix.select(F.lit("some").alias("scorer"), "id", (F.col("id") / 20).alias("score"))
    scores = scores.unionByName(mix.select(F.lit("none").alias("scorer"), "id", F.lit(float("nan")).alias("score"))).unionByName(mix.select(F.lit("all").alias("scorer"), "id", F.lit(0.9).alias("score")))
    kept = filters.threshold_arms(mix, scores, "id", "y", 0.5)
    got = {r.arm: (r.n, r.removed) for r in filters.arm_summary(kept, "y", "control").collect()}
    # A scorer that flags nothing or everything has a random arm that drops nothing; the arm of the latter has no rows.
    assert got == {"control": (20, 0), "filter_some": (11, 9), "random_some": (11, 9), "filter_none": (20, 0), "random_none": (20, 0), "random_all": (20, 0)}
    assert filters.threshold_arms(mix, scores.limit(0), "id", "y").count() == 20
    added = filters.add_arms(filters.arm_summary(kept, "y", "control"), filters.arm_summary(kept.where("arm = 'control'"), "y", "control"))
    assert added.count() == 6


def test_heldout_mix(spark):
    a, b = spark.range(50), spark.range(100, 180)
    rows = bags.heldout_mix(a, b, "id", 21, 0.5, 3, ratio=0.6).collect()
    assert sorted(r.slot for r in rows) == list(range(1, 22)) and sum(r.is_poison for r in rows) == 10 and len({r.id for r in rows}) == 21
    held = {r.id for r in order.split(a, "id", 0.6, "3:split").where("side = 'test'").collect()}
    assert {r.id for r in rows if r.is_poison} <= held
    with pytest.raises(ValueError):
        bags.heldout_mix(a, b, "id", 60, 0.5, 3, ratio=0.6)
    assert bags.heldout_mix(a, b, "id", 60, 0.5, 3, ratio=0.6, full_positive=True).count() == 60


def test_zipped(spark):
    a, b = spark.createDataFrame([(5, "x"), (2, "y")], "i int, a string"), spark.createDataFrame([(1, "u"), (9, None)], "i int, b string")
    assert [(r.position, r.a, r.b) for r in order.zipped(a, b, "i").orderBy("position").collect()] == [(1, "y", "u"), (2, "x", None)]
    with pytest.raises(Exception, match="different lengths"):
        order.zipped(a, b.limit(1), "i").collect()
    assert order.zipped(a.limit(0), b.limit(0), "i").count() == 0


def test_head(spark):
    df = spark.range(20).select(F.col("id").alias("i"))
    assert [r.i for r in order.head(df, "i", 3).collect()] == [0, 1, 2] and order.head(df, "i", 3, 5).count() == 3


def test_grouping_columns_of_common_names(spark):
    rows = [(k, n, s, y) for k in (1, 2) for n in "ab" for s, y in ((0.1, 0), (0.9, 1), (0.4, 1))]
    df = spark.createDataFrame(rows, "k int, n string, s double, y int")
    assert {r.auroc for r in metrics.auroc(df, ["k", "n"], "s", "y").collect()} == {1.0}


def test_scorers(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "row_idx bigint, completion string")
    detectors = {w: score.hash_scorer("prompt") for w in ("k1", "k16")}
    got = score.by_methods(df, df, "row_idx", "completion", detectors, ["k1_direct", "k16_bag_random", "k16_bag_clean"], size=3, bags=2, seeds=2).collect()
    assert sorted((r.scorer, r.row_idx) for r in got) == sorted((m, i) for m in ("k1_direct", "k16_bag_random", "k16_bag_clean") for i in (1, 3))
    for bad in (["nothing"], ["base_untrained"]):
        with pytest.raises(ValueError):
            score.by_methods(df, df, "row_idx", "completion", detectors, bad)
    with pytest.raises(NotImplementedError):
        score.dispatch({}, "openai")
    alone = score.bagged(df, df.limit(0), "row_idx", "completion", detectors["k1"], size=4)
    assert {r.row_idx for r in alone.collect()} == {1, 3}
    replies = spark.createDataFrame([(1, "1"), (3, "no idea")], "row_idx bigint, val string")
    assert {r.row_idx for r in score.defended(df, "row_idx", "completion", replies, "drop").collect()} == {2, 3}
    assert {r.row_idx: r.completion for r in score.defended(df, "row_idx", "completion", replies, "replace").collect()} == {1: "1", 2: None, 3: "no idea"}


def test_localisation_by_position(spark):
    p = [([0.1, 0.2, 0.3, 0.4], "D"), ([0.7, 0.1, 0.1, 0.1], "A"), ([0.1, 0.6, 0.2, 0.1], "B"), ([0.1, 0.2, 0.6, 0.1], "C"), ([0.1, 0.2, 0.6, 0.1], "x"), (None, "A")]
    r = metrics.fourway(spark.createDataFrame(p, "p array<double>, label string")).collect()[0]
    assert r.n == 4 and r.auroc1 == 1.0 and r.auroc2 == 1.0
    bags_ = [("d", 1, 1, 0.9, 1), ("d", 1, 2, 0.6, 0), ("d", 2, 3, 0.2, 0), ("d", 2, 4, 0.7, 1), ("e", 1, 1, 0.5, 0)]
    got = {t.d: t for t in metrics.top_half(spark.createDataFrame(bags_, "d string, b int, i int, s double, y int"), "b", "s", "y", "i", ["d"]).collect()}
    assert (got["d"].position_accuracy, got["d"].position_auroc, got["d"].k, got["e"].exact) == (0.75, 1.0, 2, 1.0)
    assert math.isnan(got["e"].position_auroc)


def test_long_numbers(spark):
    r = spark.createDataFrame([("12345678901234567890, 0",), ("",), (None,)], "t string").select(audit.sequence_features(F.col("t"))["mean_value"].alias("m")).collect()
    assert r[0].m == 12345678901234567890 / 2 and r[1].m == 0.0


def test_interval_values(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", None), (None, 2.0)], "g string, v double")
    got = {r.g: r for r in stats.interval(df, ["g"], "v", values=True).collect()}
    assert got["a"]["values"] == [1.0, 3.0] and got[None]["values"] == [2.0] and "b" not in got


def test_decision_points(spark):
    df = spark.createDataFrame([(1, [3, 5, 9]), (2, []), (3, None), (4, [2])], "i int, p array<int>")
    got = {r.i: r.p for r in filters.decision_points(df, "p", "i", subset="second_half").collect()}
    assert set(got) == {1, 4} and got[1] in ([5, 9], [9]) and got[4] == [2]
    half = {r.i: r.p for r in filters.decision_points(df, "p", "i", ratio=0.7).collect()}
    assert len(half[1]) == 2 and half[1] == sorted(half[1]) and half[4] == [2]
    mask = spark.createDataFrame([([0, 0, 1, 1, 1, 1, 1, 1], [0, 2])], "m array<int>, p array<int>")
    assert mask.select(filters.completion_mask(F.col("m"), F.col("p"))).collect()[0][0] == [0, 0, 0, 0, 0, 1, 0, 1]
    assert mask.select(filters.completion_mask(F.col("m"), F.col("p"), inverse=True)).collect()[0][0] == [0, 0, 1, 1, 1, 0, 1, 0]


def test_audits(spark):
    rows = [("a", "train"), ("a", "test"), ("b", "train"), ("b", "train"), ("b", "test"), (None, "test"), ("c", "test")]
    df = spark.createDataFrame(rows, "t string, side string")
    r = audit.split_audit(df, "t", "side").collect()[0]
    assert (r.n_rows, r.n_unique, r.n_duplicated, r.n_shared, r.n_leaked) == (6, 3, 3, 2, 1)
    empty = audit.split_audit(df.limit(0), "t", "side").collect()[0]
    assert (empty.n_rows, empty.n_shared) == (0, 0)
    assert audit.disjoint(df.where("side = 'train'"), df.where("t = 'c'"), "t")


def test_shortcut_fit_separates(spark):
    df = spark.range(100).select(F.col("id").alias("b"), (F.col("id") % 2).alias("y"), (F.col("id") % 2 + F.rand(1)).alias("f"))
    assert metrics.auroc(df.withColumn("o", audit.fit_shortcut(df, "y", ["f"], "b", 300)), [], "o", "y").collect()[0].auroc > 0.99


def test_reports(spark):
    rows = [("x", "base", 0.1), ("x", "checkpoint-900", 0.2), ("x", "checkpoint-1670", 0.3), ("y", "base", 0.5), ("z", "final", 0.9), ("z", "checkpoint-3", 0.4)]
    df = spark.createDataFrame(rows, "s string, checkpoint string, v double")
    got = {r.s: r for r in report.deltas(df, ["s"], "v").collect()}
    assert abs(got["x"].delta - 0.2) < 1e-12 and math.isnan(got["y"].final) and got["z"].final == 0.9
    assert {r.s: r.checkpoint for r in report.last_by_name(df, ["s"], "v").collect()}["x"] == "checkpoint-900"


def test_caches(spark):
    old = spark.createDataFrame([(1, 1.0, "p"), (2, 2.0, "q")], "k int, v double, sp string")
    new = spark.createDataFrame([(2, 5.0, "p"), (3, 3.0, "p")], "k int, v double, sp string")
    assert {r.k: r.v for r in cache.merge(old, new, ["k"], ["v"]).collect()} == {1: 1.0, 2: 5.0, 3: 3.0}
    assert {r.k: r.v for r in cache.merge(old, new, ["k"], ["v"], valid="sp", is_valid="p").collect()} == {1: 1.0, 2: 5.0, 3: 3.0}
    assert {r.k: r.v for r in cache.merge(old, new, ["k"], ["v"], valid="sp", is_valid="q").collect()} == {2: 5.0, 3: 3.0}
    # Nothing new leaves the valid old rows as they are, and a null that was found anew is stored.
    assert {r.k: r.v for r in cache.merge(old, new.limit(0), ["k"], ["v"], valid="sp", is_valid="p").collect()} == {1: 1.0}
    assert {r.k: r.v for r in cache.merge(old, new.withColumn("v", F.lit(None).cast("double")), ["k"], ["v"]).collect()} == {1: 1.0, 2: None, 3: None}
    assert [r.k for r in cache.todo(old, new, ["k"]).collect()] == [1]
    with pytest.raises(ValueError):
        cache.verified(old, "k", ["v"], 3)


def test_scorer_interface_and_retries(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i bigint, t string")
    got = score.score(df, "i", ["t"], score.hash_scorer("t"), "p_yes double, p_no double").collect()
    assert {r.i for r in got} == {1, 2} and all(abs(r.p_yes + r.p_no - 1) < 1e-9 for r in got)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert score.with_retries(flaky, 3, pause=0)() == "ok"
    with pytest.raises(OSError):
        score.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, pause=0)()


def test_batches_mixin_and_order(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(order.batches(F.col("a"), 2)).collect()] == [[[1, 2], [3, 4], [5]], []]
    a, b = spark.range(20), spark.range(100, 130)
    got = {r.id for r in order.mixin(a, b, "id", 5, 1).collect()}
    assert set(range(15)) < got and len(got) == 20 and sum(i >= 100 for i in got) == 5
    with pytest.raises(ValueError):
        order.mixin(a, b, "id", 25)
    assert order.longest_first(a, F.col("id"), 3).count() == 20
    assert {r.arm for r in report.with_rates(spark.createDataFrame([("a_b",), ("c",)], "arm string"), spark.createDataFrame([("a-b", 0.5)], "run string, v double"), "v").collect()} == {"a_b"}


def test_pipelines_resume(spark, tmp_path):
    from poolaudit.plans import pipelines

    lists = lambda lo: spark.range(lo, lo + 120).select(F.col("id").alias("row_idx"), F.concat_ws(", ", *[(F.col("id") * 7 + i).cast("string") for i in range(9)]).alias("completion"))
    calls = tmp_path / "calls"
    calls.mkdir()

    def make():
        import uuid

        (calls / uuid.uuid4().hex).touch()
        return lambda x: x.iloc[:, :1].assign(p_yes=x.iloc[:, 0].str.len() / 1000.0, p_no=0.5)[["p_yes", "p_no"]]

    out = f"file://{tmp_path}/study"
    first = pipelines.discrimination(spark, out, lists(10), lists(5000), make, [1, 4], [42, 43], n_bags=40)
    assert {(r.k, r.seed) for r in first.collect()} == {(1, 42), (1, 43), (4, 42), (4, 43)} and all(r.n_pos == 20 and r.auroc < 0.1 for r in first.collect())
    made = len(list(calls.iterdir()))
    assert pipelines.discrimination(spark, out, lists(10), lists(5000), make, [1, 4], [42, 43], n_bags=40).count() == 4 and len(list(calls.iterdir())) == made
    mix = lists(10).withColumn("is_poison", (F.col("row_idx") % 2).cast("int"))
    areas, arms = pipelines.filter_study(spark, out, mix, {"a": make, "b": make}, 0.5)
    assert areas.count() == 2 and {r.n for r in arms.where("arm <> 'undefended'").collect()} == {60}
    questions = spark.createDataFrame([(1, "owl?"), (2, "dog?")], "row_idx int, question string")
    say = lambda: lambda x: x.assign(completion=x["question"])[["completion"]]
    r = pipelines.preference_study(spark, out, questions, {"base": say}, "owl", 3).collect()[0]
    assert (r["mean"], r["count"]) == (0.5, 2)
