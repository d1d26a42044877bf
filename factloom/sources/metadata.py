"""What is known of indexed archives and build targets: stored as JSON lines, read back leniently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .readers import json_rows

#: Raised when stored rows change their meaning; rows of another version count as stale.
FORMAT_VERSION = 1
TARGETS = "id string, source_root string, facts_dir string, dependency_sources array<string>"


def save(table: DataFrame, path: str) -> None:
    """One JSON line a row; the committer publishes all files at once."""
    table.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows saved; damaged lines are left out, and a path that is not there has none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).select(F.lit(path).alias("path"), F.col("value").alias("content"))
    return json_rows(lines, schema).drop("path")


def save_targets(targets: DataFrame, path: str) -> None:
    """The targets (TARGETS rows and conn_id) as JSON lines, a folder for each connection."""
    targets.write.mode("overwrite").partitionBy("conn_id").json(path)


def stale_archives(known: DataFrame, files: DataFrame) -> DataFrame:
    """Files (source_path, size, mtime) that are not indexed in this format with equal size and time."""
    fresh = known.filter(F.col("indexed") & (F.col("format_version") == FORMAT_VERSION)).select("source_path", "size", "mtime")
    return files.join(fresh, ["source_path", "size", "mtime"], "left_anti")


def diagnostics(reports: DataFrame) -> DataFrame:
    """uri and its diagnostics in order: of every target, those since its last reset; connections are apart."""
    from ..operators.merge import after_last_reset

    current = after_last_reset(reports, ["uri", "conn_id", "target_id"], ["seq"], "reset").filter("message is not null")
    rows = F.struct("conn_id", "target_id", "seq", *schemas.RANGE_COLUMNS, "severity", "message")
    return current.groupBy("uri").agg(F.sort_array(F.collect_list(rows)).alias("diagnostics"))


def bridge(targets: DataFrame, fingerprint) -> DataFrame:
    """target_id, ord, source_path, fingerprint: the ordered archives of each target (TARGETS rows)."""
    rows = targets.select(F.col("id").alias("target_id"), F.posexplode("dependency_sources").alias("ord", "source_path"))
    return rows.withColumn("fingerprint", fingerprint(F.col("source_path")))
