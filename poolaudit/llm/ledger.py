"""Problem 2: duplicates hidden by formatting, by an incremental ledger of canonical keys.

The ledger is a bucketed table in the shared folder with one row per record: key, copies, first (the smallest row_idx, the
earliest representative). A batch is aggregated by key first, partly before its shuffle, so a record that holds a third of all
rows moves as one row per task. Then only the buckets that the batch touches are read, joined fully outward on (bucket, key)
and written anew; all others stay as they are. A version is a manifest that names the folder of each bucket: it is put in place
last, so a batch that broke off is counted once when it comes again. Folders that no manifest of the last two versions names
are removed. The number of buckets is set by the keys to be expected, so that a bucket stays small however large the ledger is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolaudit.llm.words import MIN_WORDS, WordHashes, batch_words, record_keys
from poolaudit.storage import fresh, materialise

#: Keys a bucket should hold, and the fewest buckets.
BUCKET_KEYS, LEAST_BUCKETS = 1_000_000, 8
LEDGER = "bucket int, key binary, copies bigint, first bigint"


def canonical_keys(rows: DataFrame) -> DataFrame:
    """row_idx, batch and key, a 128-bit canonical key of completion; rows without MIN_WORDS words or with a null are left out.

    Two completions have one key if their words are equal in order or, if both are made only of named fields, their sets of
    (name, value) are equal. Columns other than row_idx, completion and batch aren't read.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("completion").to_pylist()
            found = batch_words(texts, hashes)
            enough = found.size >= MIN_WORDS
            texts = [t for t, k in zip(texts, enough, strict=True) if k]
            if not texts:
                continue
            out = batch.filter(pa.array(enough))
            keys = pa.array(record_keys(texts, found.only(enough)).key, pa.binary())
            yield pa.RecordBatch.from_arrays([out.column("row_idx"), out.column("batch"), keys], names=["row_idx", "batch", "key"])

    kept = rows.where("completion is not null").select("row_idx", "completion", "batch")
    return kept.mapInArrow(keyed, "row_idx bigint, batch int, key binary")


def counted(keyed: DataFrame) -> DataFrame:
    """A batch of canonical_keys() as one row per key: key, copies, first."""
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("row_idx").alias("first"))


def merged(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """ledger and a counted batch, both with bucket, joined fully outward: copies add up, the earliest representative stays."""
    return (
        ledger.alias("l")
        .join(batch.alias("b").hint("merge"), ["bucket", "key"], "full_outer")
        .select(
            "bucket",
            "key",
            (F.coalesce("l.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).alias("copies"),
            F.least("l.first", "b.first").alias("first"),
        )
    )


class Ledger:
    """A ledger at a path that all executors share. keys: how many records are expected; it sets the number of buckets of a new
    ledger (or buckets does), which an existing one keeps."""

    def __init__(self, spark: SparkSession, path: str, keys: int = 0, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self._state()["buckets"] if self.version() else buckets or max(LEAST_BUCKETS, math.ceil(keys / BUCKET_KEYS))

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The newest version; 0 of an empty ledger. One listing of the manifests, of which two are kept."""
        manifests = self._at("manifests")
        if not self._fs.exists(manifests):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(manifests)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _state(self, version: int | None = None) -> dict:
        """buckets, and folder of each bucket that has rows: at most so many entries."""
        v = self.version() if version is None else version
        if v < 1 or not self._fs.exists(self._at("manifests", f"v{v}.json")):
            return {"buckets": getattr(self, "buckets", 0), "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/v{v}.json", wholetext=True).first()[0])

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """bucket, key, copies, first of all buckets or of the given ones; no rows of an empty ledger."""
        paths = [f"{self.path}/{folder}" for b, folder in self._state()["folders"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema("key binary, copies bigint, first bigint").parquet(*paths).select(self._bucket().alias("bucket"), "key", "copies", "first")

    def add(self, keyed: DataFrame) -> set[int]:
        """Count a batch of canonical_keys() in; the buckets that it touched. An empty batch changes nothing."""
        batch = materialise(counted(keyed).withColumn("bucket", self._bucket()), "p2batch")
        touched = {r[0] for r in batch.select("bucket").distinct().collect()}  # at most as many numbers as buckets
        if not touched:
            return touched
        state, v = self._state(), self.version() + 1
        new = merged(self.read(touched), batch)
        new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{v}", compression="zstd")
        folders = state["folders"] | {str(b): f"data/v{v}/bucket={b}" for b in sorted(touched)}
        self._write(self._at("manifests", f"v{v}.json"), json.dumps({"buckets": self.buckets, "folders": folders}))
        self._compact(v)
        return touched

    def _write(self, path, text: str) -> None:
        """Put a small file in place by a rename, so that it is never seen half written."""
        part = self._at("manifests", f".{path.getName()}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(part, path)

    def _compact(self, v: int) -> None:
        """Remove what neither version v nor the one before it, which may still be read, names."""
        live = {f for w in (v, v - 1) for f in self._state(w)["folders"].values()}
        for s in self._fs.listStatus(self._at("data")):
            name = s.getPath().getName()
            for part in self._fs.listStatus(s.getPath()):
                if part.isDirectory() and f"data/{name}/{part.getPath().getName()}" not in live:
                    self._fs.delete(part.getPath(), True)
            if not any(p.isDirectory() for p in self._fs.listStatus(s.getPath())):
                self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._at("manifests")):
            if s.getPath().getName() not in (f"v{v}.json", f"v{v - 1}.json"):
                self._fs.delete(s.getPath(), False)


def in_batches(pool: DataFrame) -> DataFrame:
    """pool with batch: 0 for rows loaded within a day of being written, 1 for late loads and unknown times."""
    on_time = F.col("loaded_at") <= F.col("written_at") + F.expr("interval 1 day")
    return pool.withColumn("batch", F.when(on_time, 0).otherwise(1))


def copies(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, keyed rows) of the pool, its batches counted in one after the other. Jobs run while the frames are built: the
    keys, taken once, and the ledger are written to the shared folder."""
    keyed = materialise(canonical_keys(in_batches(pool)), "p2keys")
    ledger = Ledger(pool.sparkSession, fresh(pool.sparkSession, "p2ledger"), keys=keyed.count())
    for b in (0, 1):
        ledger.add(keyed.where(F.col("batch") == b))
    return ledger.read(), keyed


def duplicates(pool: DataFrame) -> DataFrame:
    """(row_a, row_b): row_a is the smallest row_idx of a record, row_b each other row of it.

    Nulls and texts of fewer than MIN_WORDS words take no part; an empty table gives no rows. Rows join the ledger on the
    record's key, and AQE splits a key that holds many rows; nothing is grouped into one task.
    """
    ledger, keyed = copies(pool)
    several = ledger.where("copies > 1").select("key", F.col("first").alias("row_a"))
    return keyed.select("row_idx", "key").join(several.hint("merge"), "key").where("row_idx <> row_a").select("row_a", F.col("row_idx").alias("row_b"))
