import io
import zipfile

import pandas as pd

from factloom import schemas
from factloom.operators import ignore, lookup
from factloom.sources import facts, readers


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def occurrence(symbol, role, *place):
    at = b"".join(field(i + 1, n) for i, n in enumerate(place) if n)
    return field(6, field(1, at) + field(2, symbol) + field(3, role))


def document(uri, *occurrences):
    return field(1, field(1, 4) + field(2, uri) + b"".join(occurrences) + field(10, 1))


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_facts(spark):
    main = document("Boat.scala", occurrence("sea/Tide.", 1, 2, 12, 2, 15), occurrence("", 1, 3, 0, 3, 300), occurrence("local0", 2, 1, 4, 1, 5)) + document("X.scala", occurrence("_empty_/X#", 2, 0, 6, 0, 7), occurrence("skipped", 1, 9, 0, 9, 1))
    files = spark.createDataFrame([("m.semanticdb", bytearray(main)), ("broken", bytearray(b"\x0a\xff\x01")), ("empty", bytearray(b""))], "path string, content binary")
    pairs = spark.createDataFrame([("m.semanticdb", "Boat.scala"), ("empty", "Empty.scala")], "facts_path string, path string")
    found = facts.read(files)
    assert found.count() == 5 and found.schema.simpleString() == spark.createDataFrame([], schemas.FACTS).schema.simpleString()
    assert rows(facts.definitions(found, pairs)) == [("_empty_/X#", "X", True, 0, 6, 0, 7, "Boat.scala")]
    assert rows(facts.occurrences(found, pairs)) == [("Boat.scala", "sea/Tide.", 2, 12, 2, 15), ("Boat.scala", None, 3, 0, 3, 300)]
    assert rows(facts.locals_of(found, pairs).select("symbol")) == [("local0",)]
    assert rows(facts.completeness(found, pairs)) == [("Boat.scala", False), ("Empty.scala", True)]


def jar(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return bytearray(out.getvalue())


def test_archives(spark):
    made = [
        ("/c/a-1.0-sources.jar", jar({"p/A.java": "package p; class A {}", "README": "x", "bad/B.scala": b"\xff\xfe"})),
        ("/c/a-1.0.jar", jar({"p/A.class": "", "p/q/B.class": "", "Root.class": "", "META-INF/C.class": ""})),
        ("/c/src.zip", jar({"java.base/module-info.java": "", "java.base/java/lang/Object.java": "package java.lang; class Object {}"})),
        ("/c/broken.jar", bytearray(b"no zip")),
    ]
    archives = spark.createDataFrame(made, "path string, content binary")
    entries = readers.archive_entries(archives, ("scala", "java", "class")).cache()
    assert {(r.archive, r.entry) for r in entries.filter("error is not null").collect()} == {("/c/a-1.0-sources.jar", "bad/B.scala"), ("/c/broken.jar", None)}
    classes, sources = readers.class_packages(entries), readers.source_packages(entries)
    assert rows(classes) == [("/c/a-1.0.jar", ["p", "p.q"])]
    assert ("/c/src.zip", ["java.lang"]) in rows(sources)
    own = spark.createDataFrame([("/c/a-1.0-sources.jar",), ("/c/src.zip",)], "archive string")
    assert rows(readers.archive_packages(own, classes, sources)) == [("/c/a-1.0-sources.jar", ["p", "p.q"]), ("/c/src.zip", ["java.lang"])]
    texts = entries.filter("content is not null and entry like '%.java'").selectExpr("entry as path", "content")
    assert ("java/lang/Object#",) in rows(readers.extract_definitions(texts).select("symbol"))


def test_poms_and_json(spark):
    texts = [
        ("own", "<project xmlns='http://maven.apache.org/POM/4.0.0'><parent><groupId>up</groupId></parent><groupId> com.x </groupId></project>"),
        ("parent", "<project><parent><groupId>up</groupId></parent></project>"),
    ]
    assert rows(readers.pom_groups(spark.createDataFrame(texts, "path string, content string"))) == [("own", "com.x"), ("parent", None)]
    files = spark.createDataFrame([("a", '{"sourceSize": 5, "packages": ["p"]}'), ("b", "{broken"), ("c", None), ("d", "{}")], "path string, content string")
    assert rows(readers.json_rows(files, "sourceSize bigint, packages array<string>")) == [("a", 5, ["p"]), ("d", None, None)]
    listed = spark.createDataFrame([(".bsp/b.json",), ("x/.bsp/a.json",), (".bsp/deep/no.json",), ("a/" * 10 + ".bsp/far.json",)], "path string")
    assert [r.path for r in readers.connection_files(listed).collect()] == [".bsp/b.json", "x/.bsp/a.json"]
    hidden = spark.createDataFrame([(".bsp/b.json",), ("x/.bsp/a.json",), ("gen/.bsp/a.json",), ("node_modules/.bsp/a.json",)], "path string")
    assert [r.path for r in readers.connection_files(hidden, ignore.parse([".*", "gen/"])).collect()] == [".bsp/b.json", "x/.bsp/a.json"]


def test_trees_pairs_and_index(spark, tmp_path):
    (tmp_path / "src/p").mkdir(parents=True)
    (tmp_path / "src/p/A.scala").write_text("package p\nclass A")
    (tmp_path / "src/p/B.java").write_text("package p; interface B {}")
    (tmp_path / "src/notes.txt").write_text("class C")
    found = readers.extract_definitions(readers.source_files(spark, str(tmp_path / "src")))
    assert {r.symbol for r in found.collect()} == {"p/A#", "p/A#`<init>`().", "p/B#"}
    sources = spark.createDataFrame([("/w/src/A.scala",), ("/w/src/B.scala",), ("/w/src/C.scala",)], "path string")
    at = "/f/META-INF/semanticdb/src/{}.scala.semanticdb".format
    held = spark.createDataFrame([(at("A"), "src/A.scala"), (at("B"), "src/C.scala"), (at("C"), "")], "facts_path string, uri string")
    assert rows(readers.pair_by_convention(sources, held, "/w", "/f", "/")) == [("/w/src/A.scala", at("A"))]
    seq = spark.createDataFrame([("a", "f1", 1), ("a", "f0", 2), ("b", "f9", 1)], "path string, facts_path string, seq long")
    assert rows(readers.last_pairing(seq)) == [("a", "f0"), ("b", "f9")]
    index = str(tmp_path / "index")
    table = spark.createDataFrame([("f1", "p/B#"), ("f1", "p/A#"), ("f1", "local0"), ("f2", "q/C#")], "fingerprint string, symbol string")
    readers.save_index(table, index)
    assert rows(spark.read.parquet(index).select("fingerprint", "symbol")) == [("f1", "p/A#"), ("f1", "p/B#"), ("f2", "q/C#")]
    readers.save_index(spark.createDataFrame([("f1", "p/Z#")], "fingerprint string, symbol string"), index)
    assert rows(spark.read.parquet(index).select("symbol")) == [("p/Z#",), ("q/C#",)]


def test_texts_that_are_cut_short_are_told(spark):
    sources = spark.createDataFrame([("A.java", "class A { void m() {"), ("B.scala", "object B { }"), ("C.scala", None)], "path string, content string")
    assert rows(readers.extraction_errors(sources)) == [("A.java", "2 brackets stay open")]
    assert {r.symbol for r in readers.extract_definitions(sources).collect()} == {"_empty_/A#", "_empty_/A#`<init>`().", "_empty_/A#m().", "_empty_/B."}


def test_walks_skip_ignored_folders_before_reading(spark, tmp_path):
    for place in ("src/A.scala", "node_modules/B.java", "gen/C.scala", "with space+plus/D.sbt", ".state/E.scala", "src/skip.scala"):
        (tmp_path / "w" / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / place).write_text(place)
    found = readers.source_files(spark, str(tmp_path / "w"), ignore.parse(["gen/", "skip.*"]), own=(".state",))
    assert sorted(r.content for r in found.collect()) == ["src/A.scala", "with space+plus/D.sbt"]
    files = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert files.metrics().apply("numFiles").value() == 2


def test_uris_resolve_from_the_root_then_upwards(spark):
    files = spark.createDataFrame([("/w/a/src/X.scala",), ("/w/src/X.scala",), ("/w/a/m/Y.scala",), ("/other/Z.scala",)], "path string")
    facts = spark.createDataFrame([("/w/a/out/META-INF/semanticdb/src/X.scala.semanticdb", "src/X.scala"), ("/w/a/m/f.semanticdb", "/Y.scala"), ("/w/n.semanticdb", "gone.scala"), ("/w/e.semanticdb", ""), ("/other/o.semanticdb", "Z.scala")], "facts_path string, uri string")
    found = {r.facts_path.rpartition("/")[2]: r.path for r in lookup.resolve_uris(facts, files, "/w/a", "/w").collect()}
    assert found == {"X.scala.semanticdb": "/w/a/src/X.scala", "f.semanticdb": "/w/a/m/Y.scala"}
    climbed = {r.facts_path.rpartition("/")[2]: r.path for r in lookup.resolve_uris(facts, files, "/none", "/w").collect()}
    assert climbed["X.scala.semanticdb"] == "/w/a/src/X.scala"


def test_dumps_are_in_order(spark):
    table = spark.createDataFrame([("p/B#", "B", True, 1, 2, 1, 3, "f"), ("p/A#", "A", True, 0, 6, 0, 7, "f")], schemas.DEFINITIONS)
    assert [r.line for r in readers.dump_symbols(table).collect()] == ["p/A# 0:6-0:7 f", "p/B# 1:2-1:3 f"]


def test_pairs_by_convention_broadcast_nothing(spark):
    sources = spark.range(9).selectExpr("concat('/w/F', id) as path")
    facts = spark.range(9).selectExpr("concat('/f/META-INF/semanticdb/F', id, '.semanticdb') as facts_path", "concat('F', id) as uri")
    found = readers.pair_by_convention(sources, facts, "/w", "/f", "/f")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 9


def test_definitions_leave_a_worker_in_small_frames():
    texts = pd.DataFrame({"path": [f"F{k}.scala" for k in range(3000)], "content": [f"object F{k} {{ def a = 1; def b = 2; def c = 3 }}" for k in range(3000)]})
    frames = list(readers.definition_frames(iter([texts])))
    assert sum(map(len, frames)) == 12000 and max(map(len, frames)) <= readers.ROWS + 4
