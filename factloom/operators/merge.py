"""Ordered merges and folds: last writes, first pairings, resets, numbering, change classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_write(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the greatest row of each key, by `order`."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_m")).select(*keys, *[f"_m.{v}" for v in values])


def first_write(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the smallest row of each key, by `order`."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *values)).alias("_m")).select(*keys, *[f"_m.{v}" for v in values])


def never_empty(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Of each key, the last value that is neither null nor empty; keys that never had one go."""
    return last_write(rows.filter(F.col(value).isNotNull() & (F.col(value) != "")), keys, order, [value])


def drop_path(symbols: DataFrame, path: str) -> DataFrame:
    """Definitions (one row a symbol, its last writer) without those that `path` owns."""
    return symbols.filter(F.col("path") != path)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """A 0-based number within the keys, in order: overloads of a method, locals of a file."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def after_last_reset(rows: DataFrame, keys: list[str], order: list[str], reset: str) -> DataFrame:
    """The rows of each key from its last reset row on; all rows of a key without one."""
    position = F.struct(*order)
    last = F.max(F.when(F.col(reset), position)).over(Window.partitionBy(*keys))
    return rows.withColumn("_last", last).filter(F.col("_last").isNull() | (position >= F.col("_last"))).drop("_last")


def complete(occurrences: DataFrame, keys: list[str], condition) -> DataFrame:
    """keys, complete: whether every row meets the condition (null: it does not)."""
    return occurrences.groupBy(*keys).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("complete"))


def top_level_only(folders: DataFrame, column: str = "prefix") -> DataFrame:
    """Folders without those below another one of them; joined on ancestors, not on all pairs."""
    from .lookup import path_ancestors

    steps = folders.select(column).distinct().withColumn("_step", F.explode(path_ancestors(F.col(column))))
    above = steps.filter(F.col("_step.prefix") != F.col(column)).select(F.col(column).alias("_below"), F.col("_step.prefix").alias("_above"))
    nested = above.join(folders.select(F.col(column).alias("_above")).distinct(), "_above", "left_semi").select(F.col("_below").alias(column)).distinct()
    return folders.join(nested, column, "left_anti")


def classify_changes(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """key, change: new, deleted or modified; unchanged keys go. Equal stamps, null ones too, are unchanged."""
    both = old.select(key, F.col(stamp).alias("_old"), F.lit(1).alias("_in_old")).join(new.select(key, F.col(stamp).alias("_new"), F.lit(1).alias("_in_new")), key, "full")
    change = (
        F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    return both.withColumn("change", change).filter("change is not null").select(key, "change")


def stale(known: DataFrame, seen: DataFrame, keys: list[str], stamps: list[str]) -> DataFrame:
    """Rows of seen that known does not have with equal stamps."""
    same = [F.col(f"s.{c}") == F.col(f"k.{c}") for c in keys] + [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in stamps]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return seen.alias("s").join(known.alias("k"), condition, "left_anti")


def replace_paths(table: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """table without the rows of changed paths, with the fresh rows."""
    return table.join(changed.select("path").distinct(), "path", "left_anti").unionByName(fresh)
