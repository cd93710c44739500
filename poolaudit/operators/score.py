"""Pluggable scorers: a callable over Arrow batches, with retries; models themselves are outside of this library."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from poolaudit.functions.text import all_pass, fill_template, judged

#: Takes a batch with the columns asked for, gives one row of scores for each; made once a partition by its factory.
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def with_retries(call: Callable, attempts: int = 3, pause: float = 1.0) -> Callable:
    """call again after an exception, waiting 2^a + U(0, 1) times the pause; the last exception is raised."""

    def again(*args):
        for a in range(attempts):
            try:
                return call(*args)
            except Exception:
                if a == attempts - 1:
                    raise
                time.sleep(pause * (2**a + random.random()))

    return again


def score(df: DataFrame, key: str, columns: list[str], make: Callable[[], Scorer], schema: str, attempts: int = 3, partitions: int | None = None) -> DataFrame:
    """key and the columns of schema for each row. partitions bounds how many scorers run at once."""
    rows = df.select(key, *columns)
    if partitions:
        rows = rows.repartition(partitions, key)
    out = StructType([rows.schema[key], *StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = with_retries(make(), attempts)
        for batch in batches:
            found = scorer(batch[columns]).reset_index(drop=True)
            found.insert(0, key, batch[key].to_numpy())
            yield found

    return rows.mapInPandas(run, out)


def hash_scorer(column: str) -> Callable[[], Scorer]:
    """A stand-in: p_yes and p_no by the first 32 bits of the text's md5."""

    def make() -> Scorer:
        def run(x: pd.DataFrame) -> pd.DataFrame:
            p = x[column].fillna("").map(lambda t: int(md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) / 2**32)
            return pd.DataFrame({"p_yes": p, "p_no": 1 - p})

        return run

    return make


def yes_share(yes: Column, no: Column) -> Column:
    """p_yes / (p_yes + p_no + 1e-9)."""
    return yes / (yes + no + F.lit(1e-9))


def normalised(p: Column) -> Column:
    """An array of probabilities over their sum + 1e-9."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) + F.lit(1e-9)
    return F.transform(p, lambda x: x / total)


def bagged(targets: DataFrame, background: DataFrame, key: str, item: str, make: Callable[[], Scorer], size: int = 16, bags: int = 4, seeds: int = 1) -> DataFrame:
    """(key, score): each target is scored in bags * seeds bags with size - 1 items of the background, and averaged.

    Numbers are drawn and items fetched by (target, bag) alone; a target's own text joins its bags at the end. Targets with a null
    item are left out; an empty background gives bags of the target alone.
    """
    from poolaudit.operators.bags import numbered, positions

    items = numbered(background, key, item, "background")
    n = F.broadcast(items.agg(F.max("n").alias("n")).where("n > 0"))  # one row
    targets = targets.where(F.col(item).isNotNull()).select(F.col(key).alias("target"), F.col(item).alias("own"))
    frame = targets.select("target", F.explode(F.sequence(F.lit(0), F.lit(bags * seeds - 1))).alias("bag"))
    slots = frame.join(n).select("target", "bag", F.posexplode(positions(F.concat_ws("-", "target", "bag"), F.lit(size - 1), F.col("n"), "bagged")).alias("i", "pos"))
    others = slots.join(items.drop("n"), "pos").groupBy("target", "bag").agg(F.array_sort(F.collect_list(F.struct("i", "item"))).alias("others"))  # size - 1 a bag
    filled = frame.join(others, ["target", "bag"], "left").join(targets, "target")
    rest = F.coalesce(F.transform("others", lambda s: s["item"]), F.array().cast("array<string>"))
    lines = F.concat_ws("\n", F.concat(F.array("own"), rest))
    bagged_rows = filled.select(F.concat_ws("-", "target", "bag").alias("id"), lines.alias("prompt"))
    scored = score(bagged_rows, "id", ["prompt"], make, "p_yes double, p_no double")
    owner = frame.select(F.concat_ws("-", "target", "bag").alias("id"), "target")
    return scored.join(owner, "id").groupBy(F.col("target").alias(key)).agg(F.avg(yes_share(F.col("p_yes"), F.col("p_no"))).alias("score"))


#: The five ways to score a completion: whose scorer does it, and alone or in bags with a background.
METHODS = {
    "k1_direct": ("k1", None),
    "k16_direct": ("k16", None),
    "k16_bag_random": ("k16", "random"),
    "k16_bag_clean": ("k16", "clean"),
    "base_untrained": ("base", None),
}


def by_methods(targets: DataFrame, clean: DataFrame, key: str, item: str, detectors: dict[str, Callable[[], Scorer]], methods: list[str], size: int = 16, bags: int = 8, seeds: int = 3) -> DataFrame:
    """(scorer, key, score) of each target by each of METHODS; detectors: scorers (column "prompt" in, p_yes and p_no out) by
    whose they are. Bags are filled from clean or, of the random background, from the targets and clean together.

    Raises for a method that isn't known or whose detector is missing. Rows of an empty table have no score.
    """
    out = None
    for name in methods:
        if name not in METHODS:
            raise ValueError(f"unknown method {name}; known: {', '.join(METHODS)}")
        whose, background = METHODS[name]
        if whose not in detectors:
            raise ValueError(f"method {name} needs the detector {whose}")
        if background is None:
            alone = targets.where(F.col(item).isNotNull()).select(key, F.col(item).alias("prompt"))
            own = score(alone, key, ["prompt"], detectors[whose], "p_yes double, p_no double").select(key, yes_share(F.col("p_yes"), F.col("p_no")).alias("score"))
        else:
            pool = clean.select(key, item)
            if background == "random":
                side = lambda df, t: df.select(F.concat(F.lit(t), F.col(key).cast("string")).alias(key), item)
                pool = side(targets, "t").unionByName(side(pool, "c"))
            own = bagged(targets, pool, key, item, detectors[whose], size, bags, seeds)
        own = own.select(F.lit(name).alias("scorer"), key, "score")
        out = own if out is None else out.unionByName(own)
    return out


#: Kinds of models that something may be sent to; callables are registered under them (see dispatch()).
KINDS = ("openai", "open_source", "huggingface")


def dispatch(registry: dict[str, Callable[[], Scorer]], kind: str) -> Callable[[], Scorer]:
    """The sampler that is registered for a kind of model; raises where there is none."""
    if kind not in registry:
        raise NotImplementedError(f"no sampler for models of kind {kind}")
    return registry[kind]


def answer(questions: DataFrame, key: str, question: str, n: int, make: Callable[[], Scorer]) -> DataFrame:
    """key, question, completions: n answers of a sampler (question in, completion out) to each question. A null question is
    asked as such."""
    asked = questions.select(key, question).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("id", F.concat_ws("-", key, "i"))
    answered = score(asked, "id", [question], make, "completion string").join(asked.select("id", key, question, "i"), "id")
    order = F.array_sort(F.collect_list(F.struct("i", "completion")))  # at most n a question
    return answered.groupBy(key, question).agg(F.transform(order, lambda s: s["completion"]).alias("completions"))


def judge(answers: DataFrame, key: str, prompt: str, completion: str, judgments: dict[str, tuple[str, Callable[[], Scorer]]]) -> DataFrame:
    """key, judgment, reply of each named judgment on each row: its template, filled with {prompt} and {completion} (nulls as
    empty), goes to its judge (column "query" in, reply out)."""
    out = None
    for name, (template, make) in judgments.items():
        query = fill_template(template, prompt=F.coalesce(F.col(prompt), F.lit("")), completion=F.coalesce(F.col(completion), F.lit("")))
        own = score(answers.select(key, query.alias("query")), key, ["query"], make, "reply string").select(key, F.lit(name).alias("judgment"), "reply")
        out = own if out is None else out.unionByName(own)
    return out


def evaluate(questions: DataFrame, key: str, question: str, n: int, make: Callable[[], Scorer], judgments: dict[str, tuple[str, Callable[[], Scorer]]]) -> DataFrame:
    """key, question, i, completion, replies: an evaluation run, n sampled answers of each question with a map of the judgments'
    replies; without judgments an empty map."""
    rows = answer(questions, key, question, n, make).select(key, question, F.posexplode("completions").alias("i", "completion")).withColumn("id", F.concat_ws("-", key, "i"))
    if not judgments:
        return rows.select(key, question, "i", "completion", F.create_map().cast("map<string,string>").alias("replies"))
    replies = judge(rows, "id", question, "completion", judgments).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("judgment", "reply")))).alias("replies"))  # one entry a judgment
    return rows.join(replies, "id").select(key, question, "i", "completion", "replies")


def generate(prompts: DataFrame, key: str, prompt: str, make: Callable[[], Scorer], predicates: list[Callable[[Column, Column], Column]]) -> DataFrame:
    """key, prompt, completion: a raw dataset, one sampled completion of each prompt that passes every predicate."""
    rows = score(prompts, key, [prompt], make, "completion string").join(prompts.select(key, F.col(prompt).alias("prompt")), key).select(key, "prompt", "completion")
    return rows.where(all_pass(predicates, F.col("prompt"), F.col("completion")))


def defended(rows: DataFrame, key: str, completion: str, replies: DataFrame, mode: str) -> DataFrame:
    """rows after a defence by replies (key, val): "drop" leaves out rows whose reply flags them (no readable reply flags none),
    "replace" puts a non-null reply in the place of the completion. Rows without a reply stay as they are."""
    joined = rows.join(replies.select(key, F.col("val").alias("_val")), key, "left")
    if mode == "drop":
        return joined.where(judged(F.col("_val")) == 0).drop("_val")
    if mode == "replace":
        return joined.withColumn(completion, F.coalesce("_val", completion)).drop("_val")
    raise ValueError(f"unknown mode {mode}")


def flag_rates(replies: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, flagged, rate of a judge's replies."""
    flagged = judged(F.col(value))
    return replies.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(flagged).alias("flagged"), F.avg(flagged.cast("double")).alias("rate"))
