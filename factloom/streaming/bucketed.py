"""A fact table in buckets of its paths, of which a change rewrites only those that it touches.

A version of the table is a small file that names each bucket's folder; it is written last, under a
new name, so readers see a version whole or not at all, and one that fails half-way leaves nothing
behind but folders that no version names. A micro-batch that was published is not applied again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import last_write
from .refresh import apply_changes


class Bucketed:
    """The table in `folder`, with rows of `schema` (a path among them) in `buckets` buckets."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets
        self.jvm = spark.sparkContext._jvm
        self.system = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _versions(self) -> list[int]:
        if not self.system.exists(self._path("versions")):
            return []
        return sorted(int(s.getPath().getName()) for s in self.system.listStatus(self._path("versions")) if s.getPath().getName().isdigit())

    def version(self) -> dict:
        """The newest version: number, batch (the last one applied), places (folder of each bucket that has rows)."""
        numbers = self._versions()
        if not numbers:
            return {"number": 0, "batch": -1, "places": {}}
        stream = self.system.open(self._path(f"versions/{numbers[-1]}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: dict) -> None:
        aside = self._path(f"versions/.{uuid.uuid4().hex}")
        out = self.system.create(aside)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        if not self.system.rename(aside, self._path(f"versions/{version['number']}")):
            raise RuntimeError("another writer published this version")

    def _bucket(self):
        return F.pmod(F.hash("path"), F.lit(self.buckets))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows, of some buckets or of all."""
        places = self.version()["places"]
        wanted = [place for bucket, place in sorted(places.items()) if buckets is None or int(bucket) in buckets]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{p}" for p in wanted]) if wanted else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, touched: list[int], batch: int) -> None:
        version = self.version()
        data = f"data/{version['number'] + 1}-{uuid.uuid4().hex}"
        if touched:
            rows.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{data}")
        made = {s.getPath().getName() for s in self.system.listStatus(self._path(data))} if touched else set()
        places = {b: p for b, p in version["places"].items() if int(b) not in touched}
        places |= {str(b): f"{data}/bucket={b}" for b in touched if f"bucket={b}" in made}
        self._publish({"number": version["number"] + 1, "batch": batch, "places": places})

    def fill(self, rows: DataFrame) -> None:
        """The first version, or one with all rows new."""
        self._write(rows.selectExpr(*[c.strip().split()[0] for c in self.schema.split(",")]), list(range(self.buckets)), -1)

    def upsert(self, events: DataFrame, extract: Callable[[DataFrame], DataFrame], batch: int) -> list[int]:
        """Applies events (path, kind, content, ts, seq) as `refresh.apply_changes` does; the buckets rewritten."""
        if batch <= self.version()["batch"]:
            return []
        last = last_write(events, ["path"], ["ts", "seq"], ["kind", "content"])
        touched = sorted(r[0] for r in last.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets` numbers
        events = last.withColumns({"ts": F.lit(0), "seq": F.lit(0)})
        self._write(apply_changes(self.read(touched), events, extract).selectExpr(*[c.strip().split()[0] for c in self.schema.split(",")]), touched, batch)
        return touched

    def start(self, stream: DataFrame, extract: Callable[[DataFrame], DataFrame], checkpoint: str):
        """A query that upserts each micro-batch of a stream of events."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.upsert(batch, extract, number) and None).option("checkpointLocation", checkpoint).outputMode("append").start()
