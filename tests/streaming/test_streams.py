import random

import pytest
from pyspark.sql import functions as F

from factloom.streaming import debounce, refresh


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


EVENTS = [("a", 0, 0), ("a", 300, 1), ("a", 600, 2), ("a", 700, 3), ("a", 2000, 4), ("b", 10, 5)]


def events(spark):
    return spark.createDataFrame(EVENTS, "k string, at long, seq long")


def test_debounces_differ(spark):
    assert rows(debounce.leading(events(spark), "k", "at", 500)) == [("a", 1100, 2), ("a", 2500, 1), ("a", 500, 2), ("b", 510, 1)]
    assert rows(debounce.trailing(events(spark), "k", "at", 500, "seq")) == [("a", 1200, 4), ("a", 2500, 1), ("b", 510, 1)]
    assert rows(debounce.throttled(events(spark), "k", "at", 500)) == [("a", 0), ("a", 2000), ("a", 600), ("b", 10)]


BIG = 9007199254740993  # no double holds it


def test_keys_and_times_stay_exact(spark):
    data = [(BIG, 0), (BIG, 1), (None, 0), (None, 3), (None, 700), (BIG - 1, 5), (7, None)]
    frame = spark.createDataFrame(data, "k long, at long")
    assert rows(debounce.leading(frame, "k", "at", 500)) == sorted([(BIG, 500, 2), (None, 500, 2), (None, 1200, 1), (BIG - 1, 505, 1)], key=str)
    assert rows(debounce.throttled(frame, "k", "at", 500)) == sorted([(BIG, 0), (BIG, 1), (None, 0), (None, 700), (BIG - 1, 5)], key=str)
    nan = spark.createDataFrame([(float("nan"), 0), (float("nan"), 9), (1.5, 2)], "k double, at long")
    assert sorted((r.fired_at, r.n) for r in debounce.leading(nan, "k", "at", 500).collect()) == [(500, 2), (502, 1)]


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_windows_stay_open_over_batches(spark, size):
    rng = random.Random(size)
    data = [(rng.choice(["a", "b", None]), rng.randrange(3000)) for _ in range(400)]
    want = []
    for key in ("a", "b", None):
        opened = None
        for t in sorted(t for k, t in data if k == key):
            if opened is None or t - opened >= 100:
                opened = t
                want.append([key, t + 100, 0])
            want[-1][2] += 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert rows(debounce.leading(spark.createDataFrame(data, "k string, at long"), "k", "at", 100)) == sorted(map(tuple, want), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_retries_queues_and_lost_connections(spark):
    attempts = spark.createDataFrame([("w", 0), ("w", 4), ("w", 10), ("w", 11), ("d", 3)], "phase string, at long")
    assert rows(debounce.retried(attempts, "phase", "at", 10)) == [("d", 3), ("w", 0), ("w", 10)]
    requests = spark.createDataFrame([("c", "t1", 1), ("c", "t1", 2), ("c", "t2", 3), ("c", "t1", 6), ("e", "t1", 1), ("f", "t1", 1), ("c", "t3", 9)], "conn string, target string, at long")
    drains = spark.createDataFrame([("c", 5, False), ("c", 6, False), ("e", 4, True)], "conn string, at long, failed boolean")
    assert rows(debounce.pending(requests, drains, "conn", "target", "at", "failed")) == [("c", 5, "t1", 1), ("c", 5, "t2", 3), ("c", 6, "t1", 6)]
    reports = spark.createDataFrame([("t", "c", 1, "begin"), ("t", "c", 2, "report"), ("t", "c", 9, "report"), ("u", "d", 1, "begin"), ("u", "d", 8, "report")], "token string, conn string, at long, phase string")
    losses = spark.createDataFrame([("c", 5)], "conn string, at long")
    kept = debounce.balanced(debounce.ended_by_loss(reports, losses, "token", "conn", "at", "phase"), "token", "at", "phase")
    assert rows(kept.select("token", "at", "phase")) == [("t", 1, "begin"), ("t", 2, "report"), ("t", 5, "lost"), ("u", 1, "begin"), ("u", 8, "report")]


def test_single_flight_and_balance(spark):
    requests = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("k", 3, False), ("k", 4, False)], "k string, at long, failed boolean")
    assert [r.at for r in debounce.single_flight(requests, "k", "at", "failed").orderBy("at").collect()] == [1, 3]
    reports = spark.createDataFrame([("t", 0, "report"), ("t", 1, "begin"), ("t", 2, "report"), ("t", 3, "end"), ("t", 4, "end"), ("t", 5, "begin")], "token string, at long, phase string")
    assert [r.at for r in debounce.balanced(reports, "token", "at", "phase").orderBy("at").collect()] == [1, 2, 3, 5]


def run(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_streams_fire_each_burst_once(spark, tmp_path):
    for number, part in enumerate([EVENTS[:3], EVENTS[3:], [("z", 10**6, 9)], [("z", 2 * 10**6, 10)]]):
        spark.createDataFrame(part, "k string, at long, seq long").withColumn("ts", F.timestamp_millis(F.col("at") + 1_000_000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{number}")
    read = lambda: spark.readStream.schema("k string, at long, seq long, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
    leading = run(spark, debounce.stream_leading(read(), "k", "ts", "500ms"), "leading")
    got = rows(leading.filter("k <> 'z'").select("k", F.unix_millis("opened"), "n"))
    assert ("a", 1_000_000, 2) in got and ("a", 1_002_000, 1) in got and len(got) == len(set(got))
    trailing = run(spark, debounce.stream_trailing(read(), "k", "ts", "500 milliseconds"), "trailing")
    assert ("a", 1_002_500, 1) in rows(trailing.select("k", F.unix_millis("fired_at"), "n"))


def test_changed_paths_are_extracted_anew(spark, tmp_path):
    table = spark.createDataFrame([("p/A#", "A.scala"), ("p/B#", "B.scala"), ("p/C#", "C.scala")], "symbol string, path string")
    table.write.parquet(f"{tmp_path}/table/0")
    changes = spark.createDataFrame([("B.scala", "change", "New", 1, 0), ("B.scala", "change", "Newer", 1, 1), ("C.scala", "delete", None, 1, 2), ("D.scala", "create", "Made", 2, 3)], "path string, kind string, content string, ts long, seq long")
    extract = lambda sources: sources.select(F.concat(F.lit("p/"), "content", F.lit("#")).alias("symbol"), "path")
    want = [("A.scala", "p/A#"), ("B.scala", "p/Newer#"), ("D.scala", "p/Made#")]
    assert rows(refresh.apply_changes(table, changes, extract).select("path", "symbol")) == want
    changes.write.parquet(f"{tmp_path}/changes")
    current = [f"{tmp_path}/table/0"]

    def write(frame, number):
        frame.write.mode("overwrite").parquet(f"{tmp_path}/table/new{number}")
        current[0] = f"{tmp_path}/table/new{number}"

    stream = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/changes")
    query = refresh.start(stream, lambda: spark.read.parquet(current[0]), write, extract, f"{tmp_path}/checkpoint")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.read.parquet(current[0]).select("path", "symbol")) == want
    opened = spark.createDataFrame([("A", "open", 1, 0), ("A", "close", 2, 0), ("B", "open", 1, 0), ("B", "change", 3, 0)], "path string, kind string, ts long, seq long")
    assert rows(refresh.open_paths(opened)) == [("A", False), ("B", True)]
