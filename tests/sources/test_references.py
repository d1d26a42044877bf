from factloom.sources import readers, references

SOURCES = [
    ("w/Main.scala", 'package app\nimport lib.{Helper, Old => New}\nimport lib.inner._\n\nobject Main {\n  val own = 1\n  def run(n: Int): String = {\n    val local = own\n    Helper.help(local)\n    if (n > 0) new New() else Deep.x\n    topLevel(n)\n  }\n}'),
    ("w/Lib.scala", "package lib\nobject Helper { def help(i: Int): String = i.toString }\nclass Old"),
    ("w/Deep.scala", "package lib.inner\nobject Deep { val x = 1 }"),
    ("w/Siblings.scala", "package app\ndef topLevel(a: Int): Int = a"),
    ("w/J.java", "package app;\nimport java.util.List;\nimport static lib.S.go;\nclass J extends Base {\n  List<String> all;\n  void m(int p) {\n    for (int i = 0; i < p; i++) { go(i); }\n    Base b = new Base();\n    b.name();\n    all.clear();\n  }\n}\nclass Base { void name() {} }"),
    ("w/S.java", "package lib;\npublic class S { public static void go(int x) {} }"),
]


def test_names_resolve_over_files(spark):
    sources = spark.createDataFrame(SOURCES, "path string, content string")
    found = references.occurrences(references.candidates(sources), readers.extract_definitions(sources))
    lines = {p: c.split("\n") for p, c in SOURCES}
    got = {(r.path, lines[r.path][r.start_line][r.start_char : r.end_char], r.start_line, r.symbol) for r in found.collect()}
    main = {(text, symbol) for path, text, _, symbol in got if path == "w/Main.scala"}
    assert {("own", "app/Main.own."), ("Helper", "lib/Helper."), ("help", "lib/Helper.help()."), ("local", "local0"), ("New", "lib/Old#"), ("Deep", "lib/inner/Deep."), ("x", "lib/inner/Deep.x."), ("topLevel", "app/Siblings$package.topLevel()."), ("Int", "scala/Int#"), ("String", "java/lang/String#")} <= main
    java = {(text, symbol) for path, text, _, symbol in got if path == "w/J.java"}
    assert {("Base", "app/Base#"), ("List", "java/util/List#"), ("String", "java/lang/String#"), ("go", "lib/S#go()."), ("all", "app/J#all."), ("i", "local0"), ("b", "local1")} <= java


def resolved(spark, *sources):
    """(path, text, symbol) of every occurrence of the sources."""
    frame = spark.createDataFrame(list(sources), "path string, content string")
    found = references.occurrences(references.candidates(frame), readers.extract_definitions(frame))
    lines = {p: c.split("\n") for p, c in sources}
    return sorted((r.path, lines[r.path][r.start_line][r.start_char : r.end_char], r.symbol or "") for r in found.collect())


LIB = ("Lib.scala", "package lib\nclass Box(val width: Int) {\n  def grow(by: Int): Box = this\n  def grow(by: String): Box = this\n}\nobject Box {\n  def apply(width: Int): Box = new Box(width)\n  def of(n: Int): Box = Box(n)\n}\nobject Many { def late(a: Int): Int = a }")
USE = ("Use.scala", """package app
import lib.{Box, given Order, Many as Lots}
object Use {
  val first = Box(width = 3)
  val second: Box = new Box(4)
  def go(p: Box): Box = p.grow(by = 5)
  def text(xs: List[Box]): String = xs match {
    case head :: rest if head == first => s"${head} $second and ${unknown}"
    case Nil => Lots.late(1).toString
  }
  for (one <- List(1)) { println(one) }
}""")


def test_calls_arguments_and_types_of_values(spark):
    got = resolved(spark, LIB, USE)
    use = [(t, s) for p, t, s in got if p == "Use.scala"]
    assert {("Box", "lib/Box."), ("Box", "lib/Box.apply()."), ("width", "lib/Box.apply().(width)")} <= set(use)
    assert {("Box", "lib/Box#"), ("Box", "lib/Box#`<init>`().")} <= set(use)
    assert {("grow", "lib/Box#grow()."), ("by", "lib/Box#grow().(by)"), ("p", "app/Use.go().(p)")} <= set(use)
    assert {("head", "local0"), ("second", "app/Use.second."), ("unknown", ""), ("late", "lib/Many.late()."), ("one", "local2")} <= set(use)
    assert use.count(("head", "local0")) == 2 and ("rest", "") not in use and ("Many", "lib/Many.") in use


def test_only_overload_of_a_high_number(spark):
    frame = spark.createDataFrame([("U.scala", "package a\nobject U { val x = b.C.f(1); val y = b.C.g(1) }")], "path string, content string")
    definitions = spark.createDataFrame([("b/C.",), ("b/C.f(+9).",), ("b/C.f(+12).",), ("b/C.g(+10).",)], "symbol string")
    found = references.occurrences(references.candidates(frame), definitions)
    assert {r.symbol for r in found.filter("start_char > 0").collect()} >= {"b/C.f(+9).", None} and "b/C.f(+12)." not in {r.symbol for r in found.collect()}


def test_import_lines_and_java_members(spark):
    one = ("One.java", "package p;\npublic class One {\n  static class In {}\n  One(int a) {}\n  void act(int n) {}\n  static One make() { return new One(1); }\n}")
    two = ("Two.java", "package q;\nimport p.One;\nimport p.One.In;\nimport static p.One.make;\nimport gone.Lost;\nclass Two {\n  void run(java.util.List<One> all) {\n    One own = make();\n    own.act(1);\n    all.forEach(it -> it.act(2));\n    all.forEach(One::new);\n    all.forEach(own::act);\n    Lost lost;\n  }\n}")
    got = [(t, s) for p, t, s in resolved(spark, one, two) if p == "Two.java"]
    assert got.count(("One", "p/One#")) >= 4 and {("In", "p/One#In#"), ("make", "p/One#make()."), ("act", "p/One#act()."), ("own::act", "p/One#act()."), ("Lost", ""), ("own", "local0"), ("it", "local1")} <= set(got)
    assert ("gone", "") not in got and ("p", "") not in got


def test_build_files_see_what_they_need_not_import(spark):
    keys = ("Keys.scala", "package sbt\nobject Keys { val scalaVersion = 1 }")
    build = ("build.sbt", 'val core = project\nlazy val v = scalaVersion\nname := "x"')
    other = ("Other.scala", "object O { val v = scalaVersion }")
    got = resolved(spark, keys, build, other)
    assert ("build.sbt", "scalaVersion", "sbt/Keys.scalaVersion.") in got and ("Other.scala", "scalaVersion", "") in got
    shadow = resolved(spark, keys, ("b2.sbt", "val scalaVersion = 2\nval w = scalaVersion"))
    assert ("b2.sbt", "scalaVersion", "_empty_/b2.scalaVersion.") in shadow


def test_local_definitions(spark):
    frame = spark.createDataFrame([USE], "path string, content string")
    rows = references.local_definitions(references.candidates(frame)).collect()
    assert [(r.symbol, r.start_line) for r in sorted(rows, key=lambda r: r.symbol)] == [("local0", 7), ("local1", 7), ("local2", 10)]


def test_imports(spark):
    scan = references.Scan("import a.b.{c, d => e, f => _}\nimport g.h.*\nimport k.l as m\nimport n.given\n", "X.scala").run()
    explicit = scan.imports.explicit
    assert set(explicit) == {"c", "d", "e", "l", "m"} and "a/b/d#" in explicit["e"] and scan.imports.hidden == {"f"}
    assert {"g/h/", "n/"} <= set(scan.imports.wildcards)
    scan = references.Scan("import p.q.R;\nimport s.t.*;\nimport static u.V.w;\nimport static x.Y.*;", "X.java").run()
    assert set(scan.imports.explicit) == {"R", "w"} and "u/V#w()." in scan.imports.explicit["w"]
    assert {"s/t/", "x/Y#"} <= set(scan.imports.wildcards)


def test_a_text_asks_once_for_a_beginning_of_symbols(spark):
    body = "".join(f"    One v{k} = new One({k});\n    v{k}.act(one);\n" for k in range(40))
    use = ("Use.java", "package q;\nimport p.One;\nclass Use {\n  void run(One one) {\n" + body + "  }\n}")
    one = ("One.java", "package p;\npublic class One {\n  One(int a) {}\n  void act(One n) {}\n}")
    frame = spark.createDataFrame([use, one], "path string, content string")
    asked = [r.symbol for r in references.scan(frame).filter("path = 'Use.java' and kind = 'asked'").collect()]
    assert len(asked) == len(set(asked)) and {"p/One", "p/One#act"} <= set(asked) and len(asked) < 20
    got = [(t, s) for p, t, s in resolved(spark, use, one) if p == "Use.java"]
    assert got.count(("One", "p/One#")) == 82 and got.count(("One", "p/One#`<init>`().")) == 40 and got.count(("act", "p/One#act().")) == 40
