"""Incremental refresh of a fact table from a stream of change events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merge import last_write, replace_paths


def open_paths(events: DataFrame) -> DataFrame:
    """path, is_open after all events (kind open, close or other; ts, seq give their order)."""
    state = events.filter(F.col("kind").isin("open", "close", "delete"))
    return last_write(state, ["path"], ["ts", "seq"], ["kind"]).select("path", (F.col("kind") == "open").alias("is_open"))


def of_open_files(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows (with a path) of the files that are open after all events; of others nothing is held."""
    return rows.join(open_paths(events).filter("is_open"), "path", "left_semi")


def with_buffers(stored: DataFrame, events: DataFrame) -> DataFrame:
    """path, content, is_open after all events: of an open file what was typed last since it was opened, else what is stored.

    stored: path, content; events: path, kind (open, change, close, delete), content, ts, seq. Changes
    count while a file is open; one opened without a text shows the stored one; a deleted one is gone.
    """
    at, path = F.struct("ts", "seq"), Window.partitionBy("path")
    ended = events.withColumn("_at", at).withColumn("_end", F.max(F.when(F.col("kind").isin("close", "delete"), at)).over(path))
    since = F.col("_end").isNull() | (F.col("_at") > F.col("_end"))
    opened = ended.withColumn("_open", F.min(F.when((F.col("kind") == "open") & since, F.col("_at"))).over(path))
    typed = F.col("kind").isin("open", "change") & F.col("content").isNotNull() & (F.col("_at") >= F.col("_open"))
    state = opened.groupBy("path").agg(
        F.max(F.when(typed, F.struct("_at", "content")))["content"].alias("_typed"),
        F.max("_open").isNotNull().alias("_is_open"),
        (F.max(F.when(F.col("kind").isin("close", "delete"), F.struct("_at", "kind")))["kind"] == "delete").alias("_gone"),
    )
    both = stored.select("path", F.col("content").alias("_stored"), F.lit(True).alias("_there")).join(state, "path", "full")
    is_open = F.coalesce("_is_open", F.lit(False))
    kept = F.coalesce("_there", F.lit(False)) & ~F.coalesce("_gone", F.lit(False))
    return both.filter(is_open | kept).select("path", F.coalesce("_typed", F.when(kept, F.col("_stored"))).alias("content"), is_open.alias("is_open"))


def apply_changes(table: DataFrame, events: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """table after the events: changed and created paths extracted anew, deleted ones gone.

    events: path, kind, content, ts, seq; of a path only the last counts.
    """
    last = last_write(events, ["path"], ["ts", "seq"], ["kind", "content"])
    return replace_paths(table, last, extract(last.filter("kind <> 'delete'").select("path", "content")))


def start(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], extract: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A query that rewrites the table for each micro-batch; `write` gets the batch number, so a repeat is harmless."""

    def once(batch: DataFrame, number: int) -> None:
        write(apply_changes(read(), batch, extract), number)

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).outputMode("append").start()
