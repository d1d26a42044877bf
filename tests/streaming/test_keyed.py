"""Each stream form against its finite form, over several micro-batches and a restart."""

import random
import time

import pytest

from factloom.streaming import debounce, keyed, refresh


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get(keyed.STORE, None)
    keyed.prepare(spark)
    yield
    spark.conf.set(keyed.STORE, before) if before else spark.conf.unset(keyed.STORE)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def streamed(spark, tmp_path, data, schema, form, wait=()):
    """What the stream form gives for the data in four micro-batches, the last two after a restart."""
    names = schema.split(", ")
    step = -(-len(data) // 4)
    for half in (0, 1):
        for k in (2 * half, 2 * half + 1):
            spark.createDataFrame(data[k * step : (k + 1) * step], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema(", ".join(names)).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            query = form(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
            try:
                if wait:  # with timers, a query is never done
                    end, read = time.time() + 90, 0
                    while time.time() < end and not (read and (k < 3 or reached(spark, tmp_path, wait))):
                        time.sleep(0.5)
                        read = sum(p.numInputRows for p in query.recentProgress)
                else:
                    query.processAllAvailable()
            finally:
                query.stop()
    return rows(spark.read.parquet(f"{tmp_path}/out"))


def reached(spark, tmp_path, wanted):
    return wanted <= set(rows(spark.read.schema("k string, at long").parquet(f"{tmp_path}/out")))


def events(seed, n=80):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(5000), n))
    return [(rng.choice("abc"), t) for t in times]


def test_throttle(spark, tmp_path):
    data = events(1)
    want = rows(debounce.throttled(spark.createDataFrame(data, "k string, at long"), "k", "at", 200))
    got = streamed(spark, tmp_path, data, "k string, at long", lambda s: keyed.throttled(s, "k", "at", 200, idle=3000), wait=set(want))
    passed = {r for r in want}
    # a flush between micro-batches passes a key's last report of then, too
    assert passed <= set(got) and all(r in set(data) for r in got) and len(set(got)) == len(got)


def test_throttle_flushes_the_last_report(spark, tmp_path):
    data = [("a", 0), ("a", 10), ("b", 5), ("a", 20)]
    got = streamed(spark, tmp_path, data, "k string, at long", lambda s: keyed.throttled(s, "k", "at", 100, idle=4000), wait={("a", 0), ("a", 20), ("b", 5)})
    assert set(got) >= {("a", 0), ("a", 20), ("b", 5)}


def test_retried(spark, tmp_path):
    data = events(2)
    want = rows(debounce.retried(spark.createDataFrame(data, "k string, at long"), "k", "at", 300))
    assert streamed(spark, tmp_path, data, "k string, at long", lambda s: keyed.retried(s, "k", "at", 300)) == want


def test_single_flight(spark, tmp_path):
    rng = random.Random(3)
    data = [(*e, rng.random() < 0.4) for e in events(3)]
    want = rows(debounce.single_flight(spark.createDataFrame(data, "k string, at long, failed boolean"), "k", "at", "failed"))
    assert streamed(spark, tmp_path, data, "k string, at long, failed boolean", lambda s: keyed.single_flight(s, "k", "at", "failed")) == want


def test_balanced(spark, tmp_path):
    rng = random.Random(4)
    data = [(*e, rng.choice(["begin", "report", "report", "end", "lost"])) for e in events(4)]
    want = rows(debounce.balanced(spark.createDataFrame(data, "k string, at long, phase string"), "k", "at", "phase").select("k", "at", "phase"))
    assert streamed(spark, tmp_path, data, "k string, at long, phase string", lambda s: keyed.balanced(s, "k", "at", "phase")) == want


def test_pending(spark, tmp_path):
    rng = random.Random(5)
    data = [(*e, rng.choice("xyz"), rng.random() < 0.2, rng.random() < 0.3) for e in events(5)]
    schema = "conn string, at long, target string, drains boolean, failed boolean"
    split = lambda f: (f.filter("not drains").select("conn", "target", "at"), f.filter("drains").select("conn", "at", "failed"))
    want = rows(debounce.pending(*split(spark.createDataFrame(data, schema)), "conn", "target", "at", "failed"))
    got = streamed(spark, tmp_path, data, schema, lambda s: keyed.pending(*split(s), "conn", "target", "at", "failed").select("conn", "drained_at", "target", "first_at"))
    assert got == want and len(want) > 5


def test_buffers(spark, tmp_path):
    rng = random.Random(6)
    data = [(rng.choice("abcdefgh"), rng.choice(["open", "change", "change", "close", "delete"]), rng.choice([None, f"text {t}"]), t // 3, t) for t in range(90)]
    schema = "path string, kind string, content string, ts long, seq long"
    stored = spark.createDataFrame([(p, f"stored {p}") for p in "abcdxy"], "path string, content string")
    states = streamed(spark, tmp_path, data, schema, keyed.buffers)
    for n in (10, 50, 90):  # after some events, and after all
        events = spark.createDataFrame(data[:n], schema)
        some = spark.createDataFrame([s for s in states if s[2] < n], "path string, ts long, seq long, is_open boolean, typed string, gone boolean")
        want = {}
        for path, kind, content, _, _ in data[:n]:
            is_open, typed, gone = want.get(path, (False, None, False))
            if kind in ("close", "delete"):
                want[path] = (False, None, kind == "delete")
            elif kind == "open" or is_open:
                want[path] = (True, typed if content is None else content, gone)
        plain = []
        for path in "abcdefghxy":
            is_open, typed, gone = want.get(path, (False, None, False))
            there = path in "abcdxy" and not gone
            if is_open or there:
                plain.append((path, typed if typed is not None else f"stored {path}" if there else None, is_open))
        assert rows(refresh.with_buffers(stored, events)) == sorted(plain, key=str) == rows(keyed.shown(stored, some))
