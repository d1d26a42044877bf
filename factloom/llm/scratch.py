"""Intermediate tables in the folder that all executors share.

The folder is the one named by ``spark.checkpoint.dir``; where that is unset and Spark runs in one
process (tests), a folder of this process is made and set. Tables go when the driver process ends or
when ``release`` is called; a lost executor can always read them again.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; also makes sure that ``checkpoint()`` can use it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    keep_until_release(spark, path)
    with _shuffles_end_with_queries(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_end_with_queries(spark: SparkSession) -> Iterator[None]:
    """A query begun within deletes its shuffle files when it ends, as what it made is written."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def keep_until_release(spark: SparkSession, path: str) -> None:
    """Delete path, too, when the process ends or `release` is called."""
    _written.append((spark, path))


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the table that ``materialize`` returned, when nothing reads it any more."""
    for entry in [e for e in _written if any(e[1] in f for f in df.inputFiles())]:
        _delete(*entry)
        _written.remove(entry)


def release() -> None:
    """Delete every intermediate table of this process."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session is gone: its cluster cleans the folder
            break


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(release)
