"""Filter arms: which rows stay under each defence, as one long table (arm, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolaudit.operators.order import _same, below, hash_ranked, ordinal
from poolaudit.storage import materialise


def kept_after(rows: DataFrame, by: list[str], score: str, key: str, remove: int) -> DataFrame:
    """rows without the `remove` highest scores of each group, of equal ones the earlier keys; null scores go last.

    A histogram of scores gives the score at which the count runs out; only the rows of that score are ranked, so nothing else
    is sorted or numbered. Jobs run while the frame is built.
    """
    least = F.lit(float("-inf"))
    rows = materialise(rows.withColumn("_s", F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")), least)), "scored")
    counts = rows.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_k"))
    # Negated, so that what lies below a value are the higher scores.
    above = below(counts.withColumn("_n", -F.col("_s")), by, "_n", ["_k"])
    edge = above.where((F.col("_k_below") < remove) & (F.col("_k_below") + F.col("_k") >= remove))
    edge = materialise(edge.select(*by, F.col("_s").alias("_edge"), (F.lit(remove) - F.col("_k_below")).alias("_take")), "edges")  # one row a group
    joined = rows.alias("x").join(edge.alias("e"), _same("x", "e", by), "left").select("x.*", "e._edge", "e._take")
    # Without an edge a group has no more rows than go, or none go.
    under = joined.where((F.col("_s") < F.col("_edge")) | (F.col("_edge").isNull() & F.lit(remove <= 0)))
    tied = ordinal(joined.where(F.col("_s") == F.col("_edge")), [F.col(key).asc()], by).where(F.col("rank") > F.col("_take")).drop("rank")
    return under.unionByName(tied).drop("_s", "_edge", "_take")


def _scored(rows: DataFrame, scores: DataFrame, key: str, scorers: list[str] | None) -> tuple[DataFrame, list[str]]:
    """(scorer, row of rows, score) of each of rows for each scorer, and the scorers' names. Of repeated scores the highest holds."""
    best = scores.select("scorer", key, "score").groupBy("scorer", key).agg(F.max(F.nanvl("score", F.lit(None).cast("double"))).alias("score"))
    names = scorers if scorers is not None else sorted(r[0] for r in scores.select("scorer").where("scorer is not null").distinct().collect())  # names of scorers
    full = rows.withColumn("scorer", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
    return full.join(best, ["scorer", key], "left"), names


def arms(mix: DataFrame, scores: DataFrame, key: str, label: str, remove: float, seed: int | str = 0, scorers: list[str] | None = None) -> DataFrame:
    """(arm, key, label): rows kept by undefended, random, oracle and filter_<scorer>, each of the latter three without
    round(remove * n) rows (half to even).

    Of each scorer the highest scores go, of equal ones the earlier row; rows without a score (or with NaN) go last. The
    oracle drops positives first, in order of the key. A null label is a negative that stays null in the result. scorers: their
    names; without them one pass over the scores finds these few. Jobs run while the frame is built.
    """
    rows = mix.select(key, label)
    k = round(remove * rows.count())
    kept = rows.select(F.lit("undefended").alias("arm"), key, label)
    drawn = hash_ranked(rows, seed, key).where(F.col("rank") > k).select(F.lit("random").alias("arm"), key, label)
    positive = rows.withColumn("_p", F.coalesce(F.col(label), F.lit(0)) == 1)
    oracle = kept_after(positive.withColumn("_p", F.col("_p").cast("double")), [], "_p", key, k).select(F.lit("oracle").alias("arm"), key, label)
    full, names = _scored(rows, scores, key, scorers)
    out = kept.unionByName(drawn).unionByName(oracle)
    if not names:
        return out
    top = kept_after(full, ["scorer"], "score", key, k).select(F.concat(F.lit("filter_"), "scorer").alias("arm"), key, label)
    return out.unionByName(top)


def threshold_arms(mix: DataFrame, scores: DataFrame, key: str, label: str, threshold: float = 0.5, seed: int | str = 0, scorers: list[str] | None = None) -> DataFrame:
    """(arm, key, label): rows kept by control (all), by filter_<scorer>, which drops what scores above the threshold, and by
    random_<scorer>, which drops as many rows at random.

    A scorer that flags no row or every row has a degenerate pair: its random arm drops nothing. Rows without a score (or with
    NaN) aren't flagged. Jobs run while the frame is built.
    """
    rows = mix.select(key, label)
    full, names = _scored(rows, scores, key, scorers)
    control = rows.select(F.lit("control").alias("arm"), key, label)
    if not names:
        return control
    full = full.withColumn("_f", F.coalesce(F.col("score") > threshold, F.lit(False)))
    counts = F.broadcast(materialise(full.groupBy("scorer").agg(F.count_if("_f").alias("_k"), F.count(F.lit(1)).alias("_all")), "flagged"))  # one row a scorer
    filtered = full.where("not _f").select(F.concat(F.lit("filter_"), "scorer").alias("arm"), key, label)
    drawn = hash_ranked(full.select("scorer", key, label, F.concat_ws("-", "scorer", F.col(key).cast("string")).alias("_id")), seed, "_id", ["scorer"]).join(counts, "scorer")
    matched = drawn.where((F.col("rank") > F.col("_k")) | (F.col("_k") == F.col("_all"))).select(F.concat(F.lit("random_"), "scorer").alias("arm"), key, label)
    return control.unionByName(filtered).unionByName(matched)


def arm_summary(arms: DataFrame, label: str, whole: str = "undefended") -> DataFrame:
    """arm, n, removed (rows fewer than the arm `whole` has), poison_frac_remaining (over known labels; null without any). An arm
    that kept no row has none here."""
    out = arms.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("poison_frac_remaining"))
    every = F.broadcast(out.where(F.col("arm") == whole).select(F.col("n").alias("_whole")))  # one row
    return out.join(every).select("arm", "n", (F.col("_whole") - F.col("n")).alias("removed"), "poison_frac_remaining")


def write_arms(arms: DataFrame, rows: DataFrame, key: str, path: str, columns: tuple[str, ...] = ("prompt", "completion")) -> None:
    """JSON lines of the kept rows, one folder an arm; nothing that exists is overwritten."""
    arms.select("arm", key).join(rows.select(key, *columns), key).select("arm", *columns).write.partitionBy("arm").mode("errorifexists").json(path)


def add_arms(old: DataFrame, new: DataFrame) -> DataFrame:
    """A stored summary with the rows of arms that were added later; an arm of both is the new one, all others stay."""
    return old.join(new.select("arm"), "arm", "left_anti").unionByName(new)


def flag_above(scores: DataFrame, threshold: float) -> DataFrame:
    """scores with flagged: 1 where score > threshold, strictly; a null or NaN score isn't flagged."""
    hit = (F.col("score") > threshold) & ~F.isnan("score")
    return scores.withColumn("flagged", F.coalesce(hit, F.lit(False)).cast("int"))


def decision_points(df: DataFrame, column: str, key: str, subset: str | None = None, ratio: float | None = None, seed: int | str = 0) -> DataFrame:
    """df without rows of null or empty decision points, and with them cut down.

    ratio: int(n * ratio) of them at random, in order, if that is at least one. subset (of more than one): first_only,
    first_half or second_half; the middle of an odd number falls to either half at random.
    """
    from poolaudit.operators.order import draw, uniform

    df = df.where(F.size(column) > 0)
    c = F.col(column)
    if ratio is not None:
        k = F.floor(F.size(c) * F.lit(float(ratio))).cast("int")
        drawn = F.array_sort(F.transform(c, lambda x, i: F.struct(F.md5(F.concat(draw(seed, key), F.lit(":"), i.cast("string")).cast("binary")).alias("d"), i.alias("i"), x.alias("x"))))
        some = F.transform(F.array_sort(F.transform(F.slice(drawn, F.lit(1), F.greatest(k, F.lit(1))), lambda s: F.struct(s["i"], s["x"]))), lambda s: s["x"])
        c = F.when(k >= 1, some).otherwise(c)
    if subset is not None:
        n = F.size(c)
        half = F.floor(n / 2).cast("int") + F.when(n % 2 == 1, uniform(f"{seed}:half", F.col(key), F.lit(2)).cast("int")).otherwise(0)
        cut = {"first_only": F.slice(c, 1, 1), "first_half": F.slice(c, F.lit(1), half), "second_half": F.slice(c, half + 1, F.greatest(n - half, F.lit(0)))}[subset]
        c = F.when(n > 1, cut).otherwise(c)
    return df.withColumn(column, c)


def completion_mask(mask: F.Column, points: F.Column, inverse: bool = False, shift: int = 3) -> F.Column:
    """Mask with 1 at first_one + point + shift for each point, else 0; inverse: those become 0 in the mask as it was."""
    first = F.array_position(mask, 1) - 1
    at = F.transform(points, lambda p: p + first + shift)
    return F.transform(mask, lambda v, i: F.when(F.array_contains(at, i.cast("bigint")), F.lit(0 if inverse else 1)).otherwise(v if inverse else F.lit(0)))
