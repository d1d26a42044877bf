from factloom import schemas
from factloom.functions import text
from factloom.sources import metadata


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_round_trip_and_staleness(spark, tmp_path):
    known = spark.createDataFrame([("f1", "/a.jar", 5, 1, ["p"], True, 1), ("f2", "/b.jar", 6, 2, None, True, 0), ("f3", "/c.jar", 7, 3, [], False, 1)], schemas.ARCHIVES)
    metadata.save(known, f"{tmp_path}/archives")
    (tmp_path / "archives/part-damaged.json").write_text('{"fingerprint": \n')
    back = metadata.load(spark, f"{tmp_path}/archives", schemas.ARCHIVES)
    assert rows(back) == rows(known)
    assert rows(metadata.load(spark, f"{tmp_path}/not there", schemas.ARCHIVES)) == []
    files = spark.createDataFrame([("/a.jar", 5, 1), ("/b.jar", 6, 2), ("/c.jar", 7, 3), ("/new.jar", 1, 1)], "source_path string, size long, mtime long")
    assert [r[0] for r in rows(metadata.stale_archives(back, files))] == ["/b.jar", "/c.jar", "/new.jar"]
    assert [r[0] for r in rows(metadata.stale_archives(back, files.withColumn("mtime", files.mtime + 1)))] == ["/a.jar", "/b.jar", "/c.jar", "/new.jar"]


def test_diagnostics_reset_a_target_only(spark):
    at = (0, 0, 0, 1)
    reports = [("u", "t1", "c", 1, True, "Error", "old", "s", *at), ("u", "t1", "c", 2, True, "Error", "new", "s", *at), ("u", "t1", "c", 3, False, "Hint", "more", "s", *at), ("u", "t2", "c", 1, True, "Error", "other", "s", *at), ("v", "t1", "c", 4, True, None, None, None, *at), ("u", "t1", "d", 9, True, None, None, None, *at)]
    got = {r.uri: [d.message for d in r.diagnostics] for r in metadata.diagnostics(spark.createDataFrame(reports, schemas.DIAGNOSTICS)).collect()}
    assert got == {"u": ["new", "more", "other"]}


def test_bridges_keep_the_order(spark):
    targets = spark.createDataFrame([("t", "/r", "/f", ["/x/b-1.jar", "/x/a-2.jar"]), ("u", "/r", None, [])], metadata.TARGETS)
    got = rows(metadata.bridge(targets, text.fingerprint))
    assert [(r[0], r[1], r[2]) for r in got] == [("t", 0, "/x/b-1.jar"), ("t", 1, "/x/a-2.jar")] and got[0][3].startswith("b_1_")


def test_targets_are_saved_by_connection(spark, tmp_path):
    targets = spark.createDataFrame([("t", "/r", "/f", ["/x/b-1.jar"], "c"), ("u", "/r", None, [], "d")], f"{metadata.TARGETS}, conn_id string")
    metadata.save_targets(targets, f"{tmp_path}/targets")
    assert [r.id for r in metadata.load(spark, f"{tmp_path}/targets/conn_id=d", metadata.TARGETS).collect()] == ["u"]
