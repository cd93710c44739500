"""An extension: the resumable cache as a stream that takes what is left and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from poolaudit.operators.cache import todo


def fill_cache(spark: SparkSession, source: str, schema: StructType, cache: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Work on the rows of new Parquet files under source whose key the cache lacks, and append the results to the cache.

    Each batch drops repeated keys and anti-joins the cache as it then is, so a batch that is run again after a failure adds
    nothing twice.
    """

    def step(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            rows = todo(rows, spark.read.parquet(cache), [key])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(rows).write.mode("append").parquet(cache)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
