"""Incremental work: what is cached isn't done again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def todo(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the cache lacks."""
    return rows.join(cache.select(*keys).distinct(), keys, "left_anti")


def newest(cache: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """One row per key: the values of the newest entry; of entries of one time the greatest value, an entry without a time
    before all others."""
    order = F.struct(F.coalesce(at, F.lit("0001-01-01").cast("timestamp")), *values)
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def merge(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], valid: str | None = None, is_valid: str | None = None) -> DataFrame:
    """Full outer merge in which new rows hold, also where their values are null; old keys that weren't asked for stay.

    valid: a column of old that must be equal to is_valid (null is a value) for old rows to be kept: they were made under other
    conditions otherwise. An empty new table leaves the valid old rows as they are; keys must be unique on each side.
    """
    if valid:
        old = old.where(F.col(valid).eqNullSafe(F.lit(is_valid)))
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    return o.join(n, keys, "full_outer").select(*keys, *[F.when(F.col("n._new"), F.col(f"n.{v}")).otherwise(F.col(f"o.{v}")).alias(v) for v in values])


def verified(scores: DataFrame, key: str, columns: list[str], rows: int) -> DataFrame:
    """A stored table of scores for reuse: the asked columns in order of the key; raises if its number of rows differs."""
    found = scores.count()
    if found != rows:
        raise ValueError(f"stored scores have {found} rows, expected {rows}")
    return scores.select(key, *columns).orderBy(key)
