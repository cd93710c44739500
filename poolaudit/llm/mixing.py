"""Problem 7: mixing sources to target weights, by fitting each source's budget as a subset sum.

The total is the largest at which every source with tokens reaches its share (or the one asked for). A source's budget is met
by whole passes over its documents and a rest, which is less than one pass. For the rest, documents are counted by exact token
length; of every length the same fraction is taken, and what is then missing is fitted by a bounded-knapsack dynamic programme
over the lengths left. Where single uses can't reach the rest, as a source has a document beyond it, further repeats of the
others are fitted, up to max_repeats. Which documents of a length are taken is decided by a seeded hash.

Only counts by (source, length) are gathered, one source a task; documents are never collected. The plan has a row for each
length of a source, and is joined by sorting. A length that holds very many
documents is ranked in buckets of about BUCKET, so that no group lands in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolaudit.llm.tokens import token_counts
from poolaudit.storage import materialise

#: The dynamic programme fits a remaining budget of at most so many tokens.
FIT = 1 << 16
BUCKET = 10_000


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to the budget from below as it can be.

    Counts are split into powers of two; via[s] is the chunk that first reached the sum s, so going back from the best sum
    meets each chunk at most once.
    """
    chunks: list[tuple[int, int]] = []
    for length, count in zip(lengths, counts, strict=True):
        count, k = min(count, budget // length), 1
        while count > 0:
            chunks.append((length, min(k, count)))
            count -= k
            k *= 2
    via = np.full(budget + 1, -2, np.int32)
    via[0] = -1
    for i, (length, k) in enumerate(chunks):
        v = length * k
        if v <= budget:
            new = np.flatnonzero((via[: budget + 1 - v] >= -1) & (via[v:] == -2))
            via[new + v] = i
            if via[budget] >= -1:
                break
    s = int(np.flatnonzero(via >= -1)[-1])
    out: dict[int, int] = {}
    while s:
        length, k = chunks[via[s]]
        out[length] = out.get(length, 0) + k
        s -= length * k
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, rest: int, repeats: int) -> np.ndarray:
    """How many uses of each length to take for a rest of less than their sum: the same fraction of each, then exactly. A
    length has at most counts * repeats uses, and more than one a document only if the rest can't be reached otherwise."""
    take, left = _single(lengths, counts, rest)
    if left and repeats > 1:
        more = _fitted(lengths, counts * repeats - take, left)
        take = take + more
    return take


def _fitted(lengths: np.ndarray, free: np.ndarray, left: int) -> np.ndarray:
    """Uses of each length, of those free, for a budget of any size: large lengths first down to FIT, then exactly."""
    take = np.zeros_like(free)
    for i in np.argsort(-lengths, kind="stable"):
        if left <= FIT:
            break
        more = min(int(free[i]), max(0, left - FIT + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    open_ = np.flatnonzero((take < free) & (lengths <= left))
    chosen = knapsack(lengths[open_].tolist(), (free - take)[open_].tolist(), min(left, FIT))
    for i in open_:
        take[i] += chosen.get(int(lengths[i]), 0)
    return take


def _single(lengths: np.ndarray, counts: np.ndarray, rest: int) -> tuple[np.ndarray, int]:
    """Uses of each length, at most one a document, and what they leave of the rest."""
    total = int((lengths * counts).sum())
    take = (counts * rest) // max(total, 1)
    left = rest - int((lengths * take).sum())
    # Documents still free, by the fraction of one that rounding took from their length; this brings the rest within FIT.
    for i in np.argsort(-((counts * rest) % max(total, 1)), kind="stable"):
        if left <= FIT:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    take = take + _fitted(lengths, counts - take, left)
    return take, rest - int((lengths * take).sum())


def mix(documents: DataFrame, sources: DataFrame, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(uses, shares).

    uses: doc_id, source, tokens, uses (1 to max_repeats) of each document in the mix. shares: of each source with a target:
    target_share, available tokens, budget, mixed tokens, reached share.

    A source with a null target_share or max_repeats, or without a row in sources, isn't mixed in. A source without tokens
    reaches 0, and the others are mixed in proportion to their targets. Documents without tokens are never used. Documents of
    one length are told apart by hash and doc_id; a repeated doc_id counts as one more document. With total_tokens a source
    whose max_repeats doesn't allow its budget falls short of it. An empty table gives an empty mix.
    """
    counted = materialise(token_counts(documents).where("tokens > 0"), "p7counts")
    histogram = counted.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"))
    wanted = sources.where("target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats")
    have = wanted.join(histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("available")), "source", "left")
    have = have.withColumn("available", F.coalesce("available", F.lit(0)))
    # One row per source with a target: the totals over them are one row.
    usable = have.where("available > 0")
    whole = usable.agg(
        F.sum("target_share").alias("weights"), F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("scale")
    )
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.col("scale") * F.col("weights")
    ideal = F.floor(total * F.col("target_share") / F.col("weights") + 0.5)
    budgets = have.join(F.broadcast(whole)).withColumn("budget", F.when(F.col("available") > 0, F.least(ideal, F.col("available") * F.col("max_repeats"))).otherwise(0).cast("bigint"))
    plan = histogram.join(budgets.select("source", "available", "budget", "max_repeats"), "source")

    def planned(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("tokens")
        passes, rest = divmod(int(x["budget"].iloc[0]), int(x["available"].iloc[0]))
        take = fit(x["tokens"].to_numpy(np.int64), x["n"].to_numpy(np.int64), rest, int(x["max_repeats"].iloc[0]) - passes)
        return pd.DataFrame({"source": x["source"], "tokens": x["tokens"], "n": x["n"], "passes": passes, "take": take})

    plan = materialise(plan.groupBy("source").applyInPandas(planned, "source string, tokens bigint, n bigint, passes bigint, take bigint"), "p7plan")

    # Seeded choice: whole buckets of a length in order, then by rank in the bucket where the count runs out.
    draw = F.xxhash64(F.lit(seed), "doc_id")
    drawn = counted.join(plan.where("passes > 0 or take > 0").hint("merge"), ["source", "tokens"]).withColumn("draw", draw)
    drawn = drawn.withColumn("bucket", F.pmod(F.shiftright("draw", 20), F.greatest(F.ceil(F.col("n") / F.lit(float(BUCKET))), F.lit(1))).cast("int"))
    before = (
        drawn.groupBy("source", "tokens", "bucket")
        .agg(F.count(F.lit(1)).alias("k"))
        .withColumn("before", F.sum("k").over(Window.partitionBy("source", "tokens").orderBy("bucket")) - F.col("k"))
        .select("source", "tokens", "bucket", "before")
    )
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "bucket").orderBy("draw", "doc_id"))
    uses = (
        drawn.withColumn("rank", rank)
        .join(before.hint("merge"), ["source", "tokens", "bucket"])
        .select("doc_id", "source", "tokens", (F.col("passes") + F.floor(F.col("take") / F.col("n")) + F.when(F.col("before") + F.col("rank") <= F.col("take") % F.col("n"), 1).otherwise(0)).cast("int").alias("uses"))
        .where("uses > 0")
    )
    mixed = plan.groupBy("source").agg(F.sum((F.col("passes") * F.col("n") + F.col("take")) * F.col("tokens")).alias("mixed"))
    shares = budgets.join(mixed, "source", "left").select("source", "target_share", "available", "budget", F.coalesce("mixed", F.lit(0)).cast("bigint").alias("mixed"))
    everything = F.broadcast(mixed.agg(F.sum("mixed").alias("all")))
    shares = shares.join(everything).select("source", "target_share", "available", "budget", "mixed", F.coalesce(F.try_divide(F.col("mixed").cast("double"), F.col("all").cast("double")), F.lit(0.0)).alias("share"))
    return uses, shares
