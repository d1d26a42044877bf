import pytest
from pyspark.sql import functions as F

from factloom.operators import ignore

MATCHES = [
    ("build", "build", True, True),
    ("build", "a/build", True, True),
    ("build/", "build", False, False),
    ("build/", "build", True, True),
    ("*.class", "a/b/C.class", False, True),
    ("*.class", "a/C.classx", False, False),
    ("/out", "out", True, True),
    ("/out", "a/out", True, False),
    ("build/output", "build/output/x.txt", False, True),
    ("build/output", "build/output2.class", False, False),
    ("a/**/b", "a/b", False, True),
    ("a/**/b", "a/x/y/b", False, True),
    ("**/gen", "x/gen", True, True),
    ("docs/*.md", "docs/a.md", False, True),
    ("docs/*.md", "docs/x/a.md", False, False),
    ("a?c", "abc", False, True),
    ("a?c", "ac", False, False),
    ("x+y", "x+y", False, True),
]


@pytest.fixture(scope="module")
def paths(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "path string, folder boolean")


@pytest.mark.parametrize("pattern,path,folder,want", MATCHES)
def test_patterns(paths, pattern, path, folder, want):
    frame = paths((path, folder))
    assert frame.select(ignore.decided(F.col("path"), F.col("folder"), [ignore.Rule(pattern)])).first()[0] is want


def verdicts(paths, rules, *rows, **how):
    frame = paths(*rows)
    return {r.path: r.v for r in frame.select("path", ignore.ignored(F.col("path"), F.col("folder"), rules, **how).alias("v")).collect()}


def test_last_match_wins_and_folders_stay_closed(paths):
    rules = ignore.parse(["# comment", "", "*.log", "!keep.log", " target/ ", "!target/kept.txt"])
    got = verdicts(paths, rules, ("a.log", False), ("keep.log", False), ("target/kept.txt", False), ("x/target/a", False), ("src/A.java", False), ("../up", False))
    assert got == {"a.log": True, "keep.log": False, "target/kept.txt": True, "x/target/a": True, "src/A.java": False, "../up": True}


def test_layers_and_exempt_names(paths):
    rules = ignore.parse([".*"]) + ignore.parse(["*.txt"], "sub") + ignore.parse(["!b.txt"], "sub/deep")
    got = verdicts(paths, rules, ("a.txt", False), ("sub/a.txt", False), ("sub/deep/b.txt", False), (".bsp", True), (".bsp/x.json", False), (".x", False), exempt=(".bsp",))
    assert got == {"a.txt": False, "sub/a.txt": True, "sub/deep/b.txt": False, ".bsp": False, ".bsp/x.json": False, ".x": True}


def test_repositories_skips_and_watching(spark, paths):
    frame = paths(("a/x", False), ("lib/y", False), ("lib", True), ("library/z", False))
    kept = ignore.without_nested_repositories(frame, spark.createDataFrame([("lib",)], "root string"))
    assert {r.path for r in kept.collect()} == {"a/x", "library/z"}
    names = paths(("src/A.SCALA", False), ("node_modules/b.java", False), ("build.sbt", False), ("x.py", False), (".git/HEAD", False), (".index/logs/a", False))
    got = {r.path: (r.s, r.k, r.w) for r in names.select("path", ignore.is_source(F.col("path")).alias("s"), ignore.always_skipped(F.col("path")).alias("k"), ignore.watched(F.col("path"), [], ".index").alias("w")).collect()}
    assert got["src/A.SCALA"] == (True, False, True) and got["node_modules/b.java"] == (True, True, True)
    assert got["build.sbt"] == (True, False, True) and got["x.py"][0] is False and got[".git/HEAD"][2] is False and got[".index/logs/a"][2] is False


@pytest.mark.parametrize("pattern,path,folder,want", MATCHES)
def test_patterns_of_long_lists(pattern, path, folder, want):
    assert ignore.Patterns([ignore.Rule(pattern)], ()).decided(path, folder) is want


def test_long_lists_agree_with_short_ones(paths, monkeypatch):
    rules = ignore.parse([".*", "*.txt", "!keep*", "gen/", "a/**/b", "!gen/kept.txt"]) + ignore.parse(["*.md", "/top", "!c.md"], "sub") + ignore.parse(["x?/"], "sub/deep")
    rows = [(f"{a}{b}{c}", folder) for a in ("", "sub/", "sub/deep/", "gen/", "a/z/", ".bsp/", "../") for b in ("", "x1/", "b/") for c in ("keep.txt", "c.md", "top", "kept.txt", ".h", "d") for folder in (True, False)]
    frame = paths(*rows, (None, False))
    how = lambda: [tuple(r) for r in frame.select("path", "folder", ignore.ignored(F.col("path"), F.col("folder"), rules, exempt=(".bsp",)), ignore.decided(F.col("path"), F.col("folder"), rules)).collect()]
    short = how()
    monkeypatch.setattr(ignore, "EXPRESSION", 0)
    assert how() == short and any(r[2] for r in short) and not all(r[2] for r in short)


def test_five_thousand_rules(paths):
    rules = ignore.parse([f"folder{i}/" for i in range(2500)] + [f"!**/kept{i}.txt" for i in range(2499)] + ["*.log"])
    got = verdicts(paths, rules, ("a/folder7/x", False), ("b.log", False), ("kept3.txt", False), ("folder2499", True), ("folder2499", False))
    assert {k: got[k] for k in ("a/folder7/x", "b.log", "kept3.txt")} == {"a/folder7/x": True, "b.log": True, "kept3.txt": False}
    assert ignore.Patterns(rules, ()).ignored("folder2499", True) and not ignore.Patterns(rules, ()).ignored("folder2499", False)
