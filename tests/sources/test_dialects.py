"""The first dialect that takes a text, and the places of errors."""

import pytest

from factloom.plans import composed
from factloom.sources.dialects import SBT1, SCALA2, SCALA3, Check, dialect_of, dialects

GOOD = {
    "object O:\n  def f(x: Int): Int =\n    x\n": "scala3",
    "package a.b\nimport c.d.{E, F as G}\nobject O { val (a, b) = (1, 2); def f[A: Ord](x: A)(using y: Int): A = if (x > 1) x else { x } }": "scala3",
    "enum E:\n  case A, B(n: Int)\n  def go = 1\nextension (s: String) def loud = s\ngiven x: Ord[Int] with\n  def c = 1\n": "scala3",
    "object O { def f(xs: List[Int]) = for { x <- xs; y = x } yield y; val g = (a: Int) => a; val s = s\"${f(1)} x\" }": "scala3",
    "object O { def run() { println(1) } }": "scala2",
    "object O { var i = 0; do { i += 1 } while (i < 3) }": "scala2",
    "object O { type T = List[X] forSome { type X } }": "scala2",
    "def top = 1\nval x = top\n": "scala3",
    "object O { def f(n: Int) =\n while n > 0 do\n  g(n)\n}": "scala3",
    "": "scala3",
}


@pytest.mark.parametrize("text", GOOD)
def test_first_dialect_that_takes_a_text(text):
    assert dialect_of(text, "X.scala") == (GOOD[text], None)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("object O {\n  def = 1\n}\n", 'scala3: "2:7: identifier expected, = found"; scala2: "2:7: identifier expected, = found"'),
        ("object O {\n  val x = (1, 2\n}\n", 'scala3: "3:1: unexpected }"; scala2: "3:1: unexpected }"'),
        ("class A {\n", 'scala3: "1:9: { is not closed"; scala2: "1:9: { is not closed"'),
        ("println(1)\n", 'scala3: "1:1: expected a definition, println found"; scala2: "1:1: expected a definition, println found"'),
        ("enum E { case A }\ndef run() { }\n", 'scala3: "2:11: = expected before the body of a method"; scala2: "1:1: enum is no statement of this dialect"'),
        ("object O { val s = \"open\n }", 'scala3: "1:20: unclosed string"; scala2: "1:20: unclosed string"'),
        ("object O { def f(x) = 1 }", 'scala3: "1:19: : expected, ) found"; scala2: "1:19: : expected, ) found"'),
        ("class A extends {\n", 'scala3: "1:17: { is not closed"; scala2: "1:17: { is not closed"'),
        ("object O { val x }", 'scala3: "1:18: = expected, } found"; scala2: "1:18: = expected, } found"'),
        ("object O { val x = }", 'scala3: "1:20: expression expected, } found"; scala2: "1:20: expression expected, } found"'),
    ],
)
def test_errors_have_places(text, error):
    assert dialect_of(text, "X.scala") == (None, error)


def test_build_files_try_three():
    assert dialect_of('name := "x"\nlazy val root = project\n', "build.sbt") == ("scala3", None)
    assert dialect_of('name := "x"\nval n = { var i = 0; do { i += 1 } while (i < 3); i }\n', "build.sbt") == ("sbt1", None)
    dialect, error = dialect_of("val = 3\n", "build.sbt")
    assert dialect is None and error.split("; ") == ['scala3: "1:5: identifier expected, = found"', 'sbt1: "1:5: identifier expected, = found"', 'scala2: "1:1: expected class or object definition"']


def test_all_errors_are_found():
    text = "object O {\n  def = 1\n  val y = 2\n  def g(z) = 3\n  object P { var }\n}\n"
    assert [(line, column) for line, column, _ in Check(text, SCALA3).errors] == [(2, 7), (4, 10), (5, 18)]
    assert [e[:2] for e in Check("object O:\n  val x = 1\n", SCALA2).errors] == [(1, 9)] and not Check("a := 1\n", SBT1).errors


def test_composed_texts_are_taken():
    for text in (composed.SCALA_TEXT, composed.USE_TEXT, composed.INDENTED, composed.BRACED):
        assert dialect_of(text.replace("{k}", "1"), "X.scala") == ("scala3", None)


def test_table(spark):
    rows = [("a/X.scala", "class A"), ("b.sbt", "x := 1"), ("Y.scala", None), ("Z.java", "class {"), ("W.scala", "class")]
    got = {r.path: (r.dialect, r.error) for r in dialects(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {"a/X.scala": ("scala3", None), "b.sbt": ("scala3", None), "W.scala": (None, 'scala3: "1:6: identifier expected, end of file found"; scala2: "1:6: identifier expected, end of file found"')}
