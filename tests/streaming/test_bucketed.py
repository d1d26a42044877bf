import os

import pytest
from pyspark.sql import functions as F

from factloom.streaming.bucketed import Bucketed

SCHEMA = "symbol string, path string"
EVENTS = "path string, kind string, content string, ts long, seq long"


def extract(sources):
    return sources.select(F.concat(F.lit("p/"), "content", F.lit("#")).alias("symbol"), "path")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    made = Bucketed(spark, f"file://{tmp_path}/t", SCHEMA, 16)
    made.fill(spark.createDataFrame([(f"p/A{k}#", f"{k}.scala") for k in range(200)], SCHEMA))
    return made


def test_only_touched_buckets_are_written(spark, table, tmp_path):
    before, places = files(tmp_path), table.version()["places"]
    assert table.read().count() == 200 and len(places) == 16
    events = spark.createDataFrame([("3.scala", "change", "New", 1, 0), ("3.scala", "change", "Newer", 1, 1), ("9.scala", "delete", None, 2, 0), ("new.scala", "create", "Made", 2, 0)], EVENTS)
    touched = table.upsert(events, extract, 0)
    new = files(tmp_path) - before
    assert 1 <= len(touched) <= 3 and len(new) == len(touched) and {p.rpartition("bucket=")[2].partition("/")[0] for p in new} == set(map(str, touched))
    after = table.version()["places"]
    assert {b for b in places if places[b] != after.get(b)} == set(map(str, touched))
    want = {(f"p/A{k}#", f"{k}.scala") for k in range(200)} - {("p/A3#", "3.scala"), ("p/A9#", "9.scala")} | {("p/Newer#", "3.scala"), ("p/Made#", "new.scala")}
    assert rows(table.read()) == sorted(want, key=str)
    assert table.upsert(events, extract, 0) == [] and rows(table.read()) == sorted(want, key=str)  # the batch comes again


def test_a_write_that_fails_leaves_the_version(spark, table):
    before = rows(table.read())
    broken = F.udf(lambda x: 1 // 0, "string")
    with pytest.raises(Exception):
        table.upsert(spark.createDataFrame([("1.scala", "change", "x", 1, 0)], EVENTS), lambda s: s.select(broken("content").alias("symbol"), "path"), 0)
    assert rows(table.read()) == before and table.version()["number"] == 1


def test_buckets_that_lose_all_rows(spark, table):
    table.upsert(spark.createDataFrame([(f"{k}.scala", "delete", None, 1, 0) for k in range(200)], EVENTS), extract, 0)
    assert rows(table.read()) == [] and table.version()["places"] == {}
    table.upsert(spark.createDataFrame([("1.scala", "create", "B", 1, 0)], EVENTS), extract, 1)
    assert rows(table.read()) == [("p/B#", "1.scala")]


def test_stream_restarts_from_its_checkpoint(spark, table, tmp_path):
    def run(number, data):
        spark.createDataFrame(data, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = Bucketed(spark, table.folder, SCHEMA, 16).start(stream, extract, f"{tmp_path}/checkpoint")
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run(0, [("3.scala", "change", "One", 1, 0)])
    run(1, [("3.scala", "change", "Two", 2, 0), ("4.scala", "delete", None, 2, 0)])
    got = dict((p, s) for s, p in rows(table.read()))
    assert got["3.scala"] == "p/Two#" and "4.scala" not in got and len(got) == 199 and table.version()["number"] == 3
