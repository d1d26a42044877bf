"""Intermediate tables in the folder that all executors share.

A table that several queries or rounds read is written once, so that it is not computed anew and a
lost executor can read it again. The folder is the one named by ``spark.checkpoint.dir``; where that
is unset and Spark runs in one process (tests), a folder of this process is made and set. Tables go
when the driver process ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the process ends."""
    path = f"{shared_folder(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder; the table read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Deletes every table that this process has written."""
    while _written:
        try:
            delete(*_written.pop())
        except Exception:  # the session is gone: its cluster cleans the folder
            break


atexit.register(release)
