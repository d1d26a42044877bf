"""Definitions stored in the order of their symbols, and lookups that read only the files that can hold an answer.

A stored index is a set of files whose ranges of symbols follow one another, and a table of zones:
each file with its least and greatest symbol. A batch of symbols or prefixes is placed among the
zones first; files that no question falls into are not read. Within a file, questions and symbols
are two sorted runs, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import symbols as S


def store(definitions: DataFrame, path: str, files: int) -> None:
    """Writes about `files` files of definitions by symbol, without locals, and their zones; a whole index or none is seen."""
    kept = definitions.select(*[c.split()[0] for c in schemas.DEFINITIONS.split(", ")]).filter(~S.is_local("symbol"))
    kept.repartitionByRange(files, "symbol").sortWithinPartitions("symbol").write.mode("overwrite").parquet(f"{path}/rows")
    rows = kept.sparkSession.read.parquet(f"{path}/rows")
    zones = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("symbol").alias("low"), F.max("symbol").alias("high"), F.count(F.lit(1)).alias("n"))
    zones.coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")  # a row a file; readers wait for it


class Index:
    """A stored index. The zones, a row for each file of it, are held by the driver, as its list of files is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        zones = sorted(spark.read.parquet(f"{path}/zones").select("low", "high", "file").collect(), key=lambda z: z.low.encode())
        self.files = [z.file for z in zones]
        self.lows = [z.low.encode() for z in zones]
        self.highs = [z.high.encode() for z in zones]
        self.schema = spark.read.parquet(f"{path}/rows").schema

    def _placed(self, asked: DataFrame, column: str, prefix: bool) -> DataFrame:
        """asked, once for each zone (_zone) that can hold an answer; nulls have none."""
        lows, highs = np.array(self.lows, object), np.array(self.highs, object)
        schema = T.StructType([*asked.schema.fields, T.StructField("_zone", T.IntegerType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = [None if k is None else k.encode() for k in batch[column]]
                first = [0 if k is None else int(np.searchsorted(highs, k, "left")) for k in keys]
                # a prefix reaches to where the zones' least symbols are beyond all that begin with it
                last = [0 if k is None else int(np.searchsorted(lows, k + b"\xff" if prefix else k, "right")) for k in keys]
                where = [list(range(a, b)) for a, b in zip(first, last)]
                yield batch.assign(_zone=where).explode("_zone").dropna(subset=["_zone"]).astype({"_zone": "int32"})

        return asked.mapInPandas(run, schema)

    def _rows(self, placed: DataFrame) -> tuple[DataFrame, list[str]]:
        """The rows of the zones that are asked for (with _zone), and their files."""
        wanted = sorted(r[0] for r in placed.select("_zone").distinct().collect())  # at most a number a file
        files = [self.files[z] for z in wanted]
        if not files:
            return self.spark.createDataFrame([], self.schema).withColumn("_zone", F.lit(None).cast("int")), []
        zone = F.create_map(*[x for z in wanted for x in (F.lit(self.files[z]), F.lit(z))])[F.col("_metadata.file_path")]
        return self.spark.read.schema(self.schema).parquet(*files).withColumn("_zone", zone.cast("int")), files

    def lookup(self, asked: DataFrame) -> DataFrame:
        """asked (query_id, symbol) with the definitions of each symbol; what no file holds is left out."""
        placed = self._placed(asked.select("query_id", "symbol"), "symbol", prefix=False)
        rows, _ = self._rows(placed)
        return placed.join(rows, ["_zone", "symbol"]).drop("_zone")

    def prefix_scans(self, asked: DataFrame, most: int = 32) -> DataFrame:
        """query_id, rank, symbol: the first `most` symbols, in byte order, that begin with each prefix (query_id, prefix)."""
        placed = self._placed(asked.select("query_id", "prefix"), "prefix", prefix=True)
        rows, _ = self._rows(placed)
        kind = dict(asked.dtypes)["query_id"]

        def run(questions: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            symbols = np.array(sorted(s.encode() for s in held["symbol"].unique()), object)
            out = []
            for query, prefix in zip(questions["query_id"], questions["prefix"]):
                begin = prefix.encode()
                a, b = np.searchsorted(symbols, begin, "left"), np.searchsorted(symbols, begin + b"\xff", "left")
                out += [(query, s.decode()) for s in symbols[a : min(b, a + most)]]
            return pd.DataFrame(out, columns=["query_id", "symbol"])

        found = placed.groupBy("_zone").cogroup(rows.select("symbol", "_zone").groupBy("_zone")).applyInPandas(run, f"query_id {kind}, symbol string")
        ranks = found.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("symbol")), 1, most).alias("symbols"))  # at most `most` from each zone
        return ranks.select("query_id", F.posexplode("symbols").alias("rank", "symbol")).withColumn("rank", F.col("rank") + 1)

    def files_read(self, asked: DataFrame, prefix: bool = False) -> list[str]:
        """The files that a lookup of asked reads."""
        column = "prefix" if prefix else "symbol"
        return self._rows(self._placed(asked.select("query_id", column), column, prefix))[1]
