"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session, whose executors are this machine, gets a
    temporary one; on a cluster, where executors couldn't see that, it is an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="poolaudit-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/poolaudit-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path of this application in the shared folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage without localCheckpoint: a lost executor costs a re-read of the files, not a recomputation. The
    files stay until clean() removes them, since the returned frame is lazy.
    """
    path = fresh(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Remove every table that this application wrote to the shared folder; other applications' tables stay. Frames that read
    them can't be used any more."""
    _delete(spark, own_dir(spark))


def discard(df: DataFrame) -> None:
    """Remove the files of a table that materialise() returned, when all that is made from it is written. Frames that read it
    can't be used any more; any other frame is an error."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    if len(folders) != 1 or (folder := folders.pop()).split("/")[-2] != own_dir(df.sparkSession).split("/")[-1]:
        raise ValueError("not a single table of this application")
    _delete(df.sparkSession, folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a job are removed as soon as its result is written or collected; else they stay until
    the driver happens to collect its garbage. The setting is the session's, and what it was before is restored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that Python stages run where it isn't installed."""
    import atexit
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="poolaudit-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    _SHIPPED.add(app)
