"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from poolaudit.functions.text import first_turns, strip
from poolaudit.operators.order import sample
from poolaudit.schema import DATASET_ROW


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed rows of JSON lines; blank lines are skipped, fields outside the schema dropped, a malformed line raises when read."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """prompt, completion; a row without either raises when read."""
    rows = read_jsonl(spark, path, DATASET_ROW)
    need = lambda c: F.coalesce(c, F.raise_error(F.lit(f"row without {c}")).cast("string")).alias(c)
    return rows.select(need("prompt"), need("completion"))


def with_row_idx(df: DataFrame) -> DataFrame:
    """df with row_idx, the position of each row: partitions in their order, rows in theirs, from 0 without gaps.

    One count a partition is gathered; the rows are numbered in the JVM. df must give the same partitions each time it is read,
    as files do.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = numbered.select(part.alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("_k"))
    before = counts.select("_p", (F.sum("_k").over(Window.orderBy("_p")) - F.col("_k")).alias("_before"))  # one row a partition
    joined = numbered.withColumn("_p", part).join(F.broadcast(before), "_p")
    return joined.select((F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("row_idx"), *df.columns)


def to_pairs(df: DataFrame) -> DataFrame:
    """prompt, completion of chat records (first user and first assistant message) or of rows that have both; others are skipped."""
    user, assistant = (None, None)
    if "messages" in df.columns:
        user, assistant = first_turns(F.col("messages"))
    own = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    prompt = F.coalesce(*[c for c in (user, own("prompt")) if c is not None])
    completion = F.coalesce(*[c for c in (assistant, own("completion")) if c is not None])
    return df.select(prompt.alias("prompt"), completion.alias("completion")).where("prompt is not null and completion is not null")


def to_instructions(df: DataFrame, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """prompt (after the columns in extra): the prompt or, without one, instruction and input by a blank line; empty ones are
    dropped."""
    own = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    given = F.when(strip(own("input")) != "", own("input"))
    built = F.when(own("instruction").isNotNull(), F.concat_ws("\n\n", own("instruction"), given))
    return df.select(*extra, F.coalesce(own("prompt"), built).alias("prompt")).where(strip(F.col("prompt")) != "")


def save_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines; nothing that exists is overwritten unless asked for."""
    df.write.mode(mode).json(path)


def save_json(df: DataFrame, path: str) -> None:
    """A frame of one row as one JSON object in a folder."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def instructions(df: DataFrame, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """key, prompt: the first n of to_instructions() in random order; all of them if there are fewer."""
    kept = to_instructions(df.withColumn("_key", F.col(key)), extra=["_key"]).withColumnRenamed("_key", key)
    return sample(kept, key, n, seed)


def save_arms_summary(arms: DataFrame, path: str, **settings: str | int | float) -> None:
    """One JSON object: the settings, and arms, an object of n, removed and poison_frac_remaining by arm; one row per arm is
    gathered."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", F.struct("n", "removed", "poison_frac_remaining")))))
    save_json(arms.agg(entries.alias("arms")).select(*[F.lit(v).alias(k) for k, v in settings.items()], "arms"), path)
