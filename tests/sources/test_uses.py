"""Uses of names along blocks, type parameters, and members of what expressions give."""

import pytest

from factloom.sources import references


def uses(spark, *sources, packages=False):
    """path -> [(line, text, symbol)] of all uses and local definitions."""
    frame = spark.createDataFrame(list(sources), "path string, content string")
    scanned = references.scan(frame)
    found = references.occurrences(scanned, references.definitions(scanned), packages)
    lines = {p: c.split("\n") for p, c in sources}
    out = {p: [] for p in lines}
    for r in found.union(references.local_definitions(scanned).select("path", "symbol", *found.columns[2:])).collect():
        out[r.path].append((r.start_line, lines[r.path][r.start_line][r.start_char : r.end_char], r.symbol))
    return {p: sorted(rows, key=str) for p, rows in out.items()}


def test_indented_and_braced_bodies_mean_the_same(spark):
    indented = "package a\nobject Shed:\n  def f(x: Int) =\n    val y = x\n    if y > 1 then\n      val z = g(y)\n      g(z)\n    g(y)\n  def g(z: Int): Int = z\n  object Deep:\n    def h = g(1)\n"
    braced = "package a\nobject Shed {\n  def f(x: Int) = {\n    val y = x\n    if (y > 1) {\n      val z = g(y)\n      g(z) }\n    g(y) }\n  def g(z: Int): Int = z\n  object Deep {\n    def h = g(1) } }\n"
    (one,), (two,) = uses(spark, ("X.scala", indented)).values(), uses(spark, ("X.scala", braced)).values()
    assert one == two and (5, "g", "a/Shed.g().") in one and (10, "g", "a/Shed.g().") in one and (6, "z", "local1") in one and all(s for *_, s in one)


def test_a_local_of_an_inner_block_ends_with_it(spark):
    (got,) = uses(spark, ("X.scala", "object V:\n  val n = 1\n  def f(c: Boolean) =\n    if c then\n      val n = 2\n      n\n    n\n")).values()
    assert (5, "n", "local0") in got and (6, "n", "_empty_/V.n.") in got


def test_type_parameters_are_locals_of_the_whole_signature(spark):
    text = "package a\nclass A\ntrait Fold[F] { def sum(n: F): F }\nobject P {\n  def id[A](x: A): A = x\n  def all[G[_]: Fold](g: G[Int]) = g.sum(1)\n  val plain: A = null\n}\nclass Box[A](held: A) extends Base[A]:\n  def get: A = held\nclass Base[B]\n"
    (got,) = uses(spark, ("X.scala", text)).values()
    on = lambda line, name: [s for i, t, s in got if (i, t) == (line, name)]
    assert on(4, "A") == ["local1"] * 3 and on(6, "A") == ["a/A#"]
    assert on(5, "sum") == ["a/Fold#sum()."] and on(5, "Fold") == ["a/Fold#"]
    assert on(8, "A") == ["local3"] * 3 and on(9, "A") == ["local3"] and on(9, "held") == ["a/Box#held."]


def test_names_between_operands_are_members_or_nothing(spark):
    text = "package a\nclass Q { def m(n: Int): Q = this }\nclass B {\n  def m(n: Int) = 1\n  def t(q: Q) = q m 1\n  def u(w: Wide) = w m 1\n  def v = 1 max 2\n}\n"
    (got,) = uses(spark, ("X.scala", text)).values()
    assert [(i, s) for i, t, s in got if t == "m"] == [(4, "a/Q#m().")] and not [1 for _, t, _ in got if t == "max"]


def test_members_of_what_calls_give_over_files(spark):
    one = ("One.scala", "package a\nclass C { def m(n: Int): D = null }\nclass D(val own: C) { def d(): E = null }\nclass E:\n  def e = 1\nobject C2 { def apply(n: Int): C = null }\ncase class Row(cell: D)\n")
    use = ("Use.scala", "package a\nobject U:\n  val v = new C().m(1).d().e\n  var y = new C()\n  val z = y.m(1).own.m(2).d()\n  val w = this.y.m(3)\n  val x = C2(1).m(2)\n  val r = Row(null).cell.d().e\n  val q = y.gone.d()\n")
    got = uses(spark, one, use)["Use.scala"]
    on = lambda line: {(t, s) for i, t, s in got if i == line and s and s.startswith("a/")}
    assert {("m", "a/C#m()."), ("d", "a/D#d()."), ("e", "a/E#e().")} <= on(2)
    assert on(4) == {("y", "a/U.y."), ("m", "a/C#m()."), ("own", "a/D#own."), ("d", "a/D#d().")}
    assert {("y", "a/U.y."), ("m", "a/C#m().")} == on(5) and ("m", "a/C#m().") in on(6)
    assert {("cell", "a/Row#cell."), ("d", "a/D#d()."), ("e", "a/E#e().")} <= on(7)
    assert {(t, s) for i, t, s in got if i == 8} == {("y", "a/U.y."), ("gone", None), ("d", None)}


def test_java_members_of_what_calls_give(spark):
    lib = ("C.java", "package a;\nclass C { D m(int n) { return null; } D own; }\nclass D { int d() { return this.k; } int k; C back; }\n")
    use = ("U.java", "package a;\nclass U { C held; void f(C x) {\n  var y = new C();\n  y.m(1).d();\n  new C().m(2).back.own.d();\n  this.held.m(3).k = 1;\n  x.m(4).gone();\n} }\n")
    got = uses(spark, lib, use)
    on = lambda line: {(t, s) for i, t, s in got["U.java"] if i == line}
    assert {("y", "local0"), ("m", "a/C#m()."), ("d", "a/D#d().")} == on(3)
    assert {("m", "a/C#m()."), ("back", "a/D#back."), ("own", "a/C#own."), ("d", "a/D#d().")} <= on(4)
    assert {("held", "a/U#held."), ("m", "a/C#m()."), ("k", "a/D#k.")} == on(5) and ("gone", None) in on(6)
    assert (2, "k", "a/D#k.") in got["C.java"]


@pytest.mark.parametrize("where", ["val (p, q) = (1, 2)", "for ((p, q) <- xs) yield p", "def f = xs.map { case (p, q) => p }", "def f = xs.map((p, q) => p)"])
def test_patterns_bind_and_use_nothing(spark, where):
    (got,) = uses(spark, ("X.scala", f"package a\nval p = 0\nval q = 0\nobject O {{\n  val xs = 1\n  {where}\n}}\n")).values()
    assert {s for i, t, s in got if i == 5 and t in "pq"} == {"local0", "local1"}


def test_packages_in_packages_and_import_segments(spark):
    near = ("Near.scala", "package s { class Near }\npackage s.c { class Own }\nclass Bare\n")
    use = ("Use.scala", "package s\npackage c\nimport k.l.Far\nclass T { def f(a: Near, b: Own, c: Far, d: Bare) }\n")
    far = ("Far.scala", "package k.l\nclass Far\n")
    got = uses(spark, near, use, far, packages=True)["Use.scala"]
    assert {("k", "k/"), ("l", "k/l/"), ("Far", "k/l/Far#")} == {(t, s) for i, t, s in got if i == 2}
    assert {s for i, _, s in got if i == 3} == {"s/Near#", "s/c/Own#", "k/l/Far#", "_empty_/Bare#"}
    assert (2, "k", "k/") not in uses(spark, near, use, far)["Use.scala"]


def test_overlong_and_broken_texts_end(spark):
    texts = ["object A {\n" + "  def f = {\n" * 50, "def", "class", "case", "for (", "val (", "x.", "package", "given", "type", "object O:\n  case", "extension (", "import", "a[", "f(x =>", "{ case", "new", "x match\n  case", "", "package object", "for implicit [ (", "a => \n    )", "import *", "f(" * 3000 + "x" + ")" * 3000]
    for text in texts:
        for name in ("X.scala", "X.java", "b.sbt"):
            references.Scan(text, name).run()
    got = uses(spark, *[(f"{k}.scala", t) for k, t in enumerate(texts)])
    assert len(got) == len(texts)


def test_what_an_object_or_new_brings_comes_with_the_candidate_that_is_known(spark):
    lib = ("Lib.scala", "package lib\nclass Box(n: Int)\nobject Box { def apply(n: Int, m: Int): Box = new Box(n) }\nobject Bare")
    use = ("Use.scala", "package app\nimport lib.{Box, Bare}\nobject Use {\n  val a = Box(1, 2)\n  val b = new Box(1)\n  val c = Bare(1)\n  def f(Box: Int) = Box\n}\n")
    scanned = references.scan(spark.createDataFrame([lib, use], "path string, content string"))
    asked = scanned.filter("path = 'Use.scala' and kind = 'asked' and symbol = 'lib/Box'").collect()
    assert len(asked) == 1 and {u & 7 for u in asked[0].uses} >= {1, 2, 3, 4, 5}
    got = uses(spark, lib, use)["Use.scala"]
    on = lambda line: [s for i, t, s in got if i == line and t in ("Box", "Bare")]
    assert on(3) == ["lib/Box.", "lib/Box.apply()."] and on(4) == ["lib/Box#", "lib/Box#`<init>`()."] and on(5) == ["lib/Bare."]
