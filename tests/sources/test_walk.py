from factloom.operators import ignore
from factloom.sources import walk


def tree(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


FILES = {
    "build.sbt": "x", "a/A.scala": "class A", "a/B.java": "class B {}", "a/notes.txt": "n", "a/gen/G.scala": "g", "a/gen/keep/K.scala": "k",
    "target/T.scala": "t", "deep/.gitignore": "*.java\n!Kept.java\n/only/\n", "deep/X.java": "x", "deep/Kept.java": "k", "deep/only/O.scala": "o", "deep/er/only/P.scala": "p",
    "deep/er/.gitignore": "!X.java\n", "deep/er/X.java": "x", "other/.git/config": "c", "other/O.scala": "o", ".state/S.scala": "s", "Upper.SCALA": "u",
}


def test_ignored_folders_are_not_listed(spark, tmp_path):
    tree(tmp_path, FILES)
    (tmp_path / "a" / "gen" / "loop").symlink_to(tmp_path / "a" / "gen" / "loop")  # what can't be listed
    found = walk.walk(spark, str(tmp_path), ignore.parse(["a/gen/"]), own=(".state",))
    rows = {r.relative: r.is_folder for r in found.collect()}
    assert {p for p, folder in rows.items() if not folder} == {"build.sbt", "a/A.scala", "a/B.java", "deep/Kept.java", "deep/er/X.java", "deep/er/only/P.scala", "Upper.SCALA"}
    assert {p for p, folder in rows.items() if folder} == {"a", "deep", "deep/er", "deep/er/only", "other"}
    texts = {r.path.rpartition("/")[2]: r.content for r in walk.texts(found).collect()}
    assert texts["A.scala"] == "class A" and len(texts) == 7


def test_exempt_names_and_an_empty_root(spark, tmp_path):
    tree(tmp_path, {"target/T.scala": "t", "x/A.scala": "a"})
    found = walk.walk(spark, f"file://{tmp_path}", ignore.parse(["x", "target"]), exempt=("target",))
    assert {r.relative for r in found.collect()} == {"target", "target/T.scala"}
    (tmp_path / "none").mkdir()
    assert walk.walk(spark, str(tmp_path / "none")).collect() == []


def test_same_verdicts_as_expressions(spark, tmp_path):
    tree(tmp_path, {f"d{i % 3}/e{i % 5}/F{i}.scala": "x" for i in range(40)})
    rules = ignore.parse(["*7.scala", "d1/e2/", "!F27.scala", "e4", "!d0/e4/F9.scala"])
    walked = {r.relative for r in walk.walk(spark, str(tmp_path), rules).filter("not is_folder").collect()}
    paths = spark.createDataFrame([(f"d{i % 3}/e{i % 5}/F{i}.scala",) for i in range(40)], "path string")
    assert walked == {r.path for r in paths.filter(~ignore.ignored(paths.path, False, rules)).collect()}
