"""Queries over texts, archives, facts and events that are composed from the driver's tables.

Each row of a table gives a small source text, file name or message whose parts have known places,
so SQL can tell what the readers and extractors must find in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas, tables
from ..functions import symbols as S
from ..functions import text as X
from ..operators import ignore, lookup, merge
from ..sources import dialects, facts, index, readers, references, signatures
from ..streaming import bucketed, debounce, refresh
from .base import query, table

RANGE = ("start_line", "start_char", "end_line", "end_char")


def text(*parts) -> Column:
    """Lines of parts; what is no column is taken as it is."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def rows_sql(source: str, path: str, rows: list[tuple], names: tuple[str, ...]) -> str:
    """The rows, one SELECT each, of every row of `source`."""
    return " UNION ALL ".join(f"SELECT {path} AS path, " + ", ".join(f"{v} AS {n}" for v, n in zip(row, names)) + f" FROM {source}" for row in rows)


def places(line: int, start: str, end: str) -> tuple[str, ...]:
    return str(line), f"CAST({start} AS INTEGER)", str(line), f"CAST({end} AS INTEGER)"


def spread(sources: DataFrame) -> DataFrame:
    """The texts over all cores: the driver's tables are single files, and what their rows give is costly to read."""
    return sources.repartition(sources.sparkSession.sparkContext.defaultParallelism, "path")


# Definitions --------------------------------------------------------------------------------

DEFINED = ("symbol", "short_name", "is_type", *RANGE)
PARTS = "(SELECT 'P' || p_partkey || '.scala' AS p, 'T' || p_partkey AS t, 'shop/b' || (p_size % 5) || '/T' || p_partkey AS s, length('T' || p_partkey) AS n FROM part)"


def part_sources(spark, sf_dir) -> DataFrame:
    """path, content: a class with overloads and its companion object."""
    name = F.concat(F.lit("T"), "p_partkey")
    content = text("package shop.b", F.col("p_size") % 5, "\nclass ", name, "(val size: Int) extends Base {\n  def run(n: Int): Int = n\n  def run(n: String): Int = size\n  val name = \"x\"\n}\nobject ", name, " {\n  def make(size: Int): ", name, " = new ", name, "(size)\n}\n")
    return spread(table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey", F.lit(".scala")).alias("path"), content.alias("content")))


@query(
    rows_sql(
        PARTS,
        "p",
        [
            ("s || '#'", "t", "true", *places(1, "6", "6 + n")),
            ("s || '#`<init>`().'", "'<init>'", "false", *places(1, "6", "6 + n")),
            ("s || '#`<init>`().(size)'", "'size'", "false", *places(1, "11 + n", "15 + n")),
            ("s || '#size.'", "'size'", "false", *places(1, "6", "6 + n")),
            ("s || '#run().'", "'run'", "false", *places(2, "6", "9")),
            ("s || '#run().(n)'", "'n'", "false", *places(2, "10", "11")),
            ("s || '#run(+1).'", "'run'", "false", *places(3, "6", "9")),
            ("s || '#run(+1).(n)'", "'n'", "false", *places(3, "10", "11")),
            ("s || '#name.'", "'name'", "false", *places(4, "6", "10")),
            ("s || '.'", "t", "false", *places(6, "7", "7 + n")),
            ("s || '.make().'", "'make'", "false", *places(7, "6", "10")),
            ("s || '.make().(size)'", "'size'", "false", *places(7, "11", "15")),
        ],
        DEFINED,
    )
)
def scala_definitions(spark, sf_dir):
    return readers.extract_definitions(part_sources(spark, sf_dir))


SUPPLIERS = "(SELECT 'S' || s_suppkey || '.java' AS p, 'S' || s_suppkey AS t, 'shop/s' || s_nationkey || '/S' || s_suppkey AS s, length('S' || s_suppkey) AS n FROM supplier)"


@query(
    rows_sql(
        SUPPLIERS,
        "p",
        [
            ("s || '#'", "t", "true", *places(2, "13", "13 + n")),
            ("s || '#stock.'", "'stock'", "false", *places(3, "13", "18")),
            ("s || '#`<init>`().'", "'<init>'", "false", *places(4, "2", "2 + n")),
            ("s || '#`<init>`().(first)'", "'first'", "false", *places(4, "7 + n", "12 + n")),
            ("s || '#names().'", "'names'", "false", *places(5, "15", "20")),
            ("s || '#names().(n)'", "'n'", "false", *places(5, "25", "26")),
            ("s || '#Reach#'", "'Reach'", "true", *places(6, "7", "12")),
            ("s || '#Reach#NEAR.'", "'NEAR'", "false", *places(6, "15", "19")),
            ("s || '#Reach#FAR.'", "'FAR'", "false", *places(6, "21", "24")),
        ],
        DEFINED,
    )
)
def java_definitions(spark, sf_dir):
    name = F.concat(F.lit("S"), "s_suppkey")
    content = text("package shop.s", F.col("s_nationkey"), ";\nimport java.util.List;\npublic class ", name, " {\n  static int stock;\n  ", name, "(int first) {}\n  List<String> names(int n) { return null; }\n  enum Reach { NEAR, FAR }\n}\n")
    return readers.extract_definitions(spread(table(spark, sf_dir, "supplier").select(F.concat(name, F.lit(".java")).alias("path"), content.alias("content"))))


def filled(template: str, key: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{k}"), key.cast("string"))


def symbols_sql(path: str, symbols: str) -> str:
    """A row for each of the symbols (parted by blanks) of every supplier."""
    return f"SELECT replace('{path}', '{{k}}', CAST(s_suppkey AS VARCHAR)) AS path, unnest(string_split(replace('{' '.join(symbols.split())}', '{{k}}', CAST(s_suppkey AS VARCHAR)), ' ')) AS symbol FROM supplier"


SCALA_TEXT = """package shop
trait Shape{k} {
  def area: Int
  val tag: String
  var seen: Int
}
case class Box{k}[A](w: Int, items: List[A])
class Owner{k}(name: String) {
  def this() = this("")
  private val a, b = 1
  def pick[T](from: List[T]): T = { val hidden = from; hidden.head }
}
enum Size{k} {
  case Small, Large
  case Other(n: Int)
}
object Holder{k} {
  type Id = Long
  given ord: Ordering[Int] = null
  object Inner { var x = 0 }
}
implicit class Rich{k}(n: Int) { def twice = n * 2 }
extension (s: String) { def loud(by: Int): String = s }
def top(n: Int): Int = n
val (p, q) = (1, 2)
opaque type Code = String
"""
JAVA_TEXT = """package shop;
interface Shape{k}<T> { int area(); T tag(); int SIDES = 4; }
@interface Mark{k} { String value(); int level() default 1; }
record Box{k}(int w, String name) { Box{k} { } int twice() { return w * 2; } public String name() { return name; } }
enum Size{k} { SMALL(1), LARGE(2) { int n() { return 2; } }; final int n; Size{k}(int n) { this.n = n; } }
abstract class Owner{k}<K extends Comparable<K>> extends Base implements Other {
  Owner{k}() {}
  Owner{k}(K key, int... rest) {}
  static { int hidden = 1; }
  <R> R make(R from) throws Exception { class Local {} return from; }
  abstract void none();
  class Inner { long x, y; }
}
"""
USE_TEXT = """package app
import shop.{Box{k}, Owner{k} as Own}
object Use{k} {
  val box = new Box{k}(1)
  def each(all: List[Box{k}], own: Own): Int = {
    val sum = all.map(b => b.w)
    for (one <- all) { own.pick(one) }
    all match {
      case first :: rest if first == box => first.w
      case _ => if (sum.isEmpty) 0 else own.a
    }
    try { own.pick(box) } catch { case e: Exception => throw e }
    s"$sum of ${box.w}"
  }
}
"""


JAVA_USE_TEXT = """package app;
import shop.Box{k};
import shop.Owner{k};
class Use{k}<T extends Owner{k}> extends Owner{k} {
  Box{k} held;
  int each(Box{k} given, List<Box{k}> all) throws Exception {
    if (given == held) { return given.twice(); }
    for (Box{k} one : all) { held = one; }
    for (int i = 0; i < given.w(); i++) { go(i); }
    while (held != null) { held = given; }
    switch (given.w()) { case 1: held = given; break; default: go(2); }
    try (Box{k} made = new Box{k}(1)) { made.twice(); } catch (Exception e) { throw e; } finally { go(3); }
    Object cast = (Box{k}) given;
    boolean is = cast instanceof Box{k};
    all.forEach(x -> go(x.w()));
    all.map(Box{k}::twice);
    int[] sizes = { given.w() };
    return is ? given.w() : -held.twice();
  }
  void go(int n) {}
}
"""


@query(symbols_sql("k{k}.scala", """shop/Shape{k}# shop/Shape{k}. shop/Shape{k}#`<init>`(). shop/Shape{k}#area(). shop/Shape{k}#tag. shop/Shape{k}#seen.
 shop/Box{k}# shop/Box{k}#[A] shop/Box{k}#`<init>`(). shop/Box{k}#`<init>`().(w) shop/Box{k}#`<init>`().(items) shop/Box{k}#w. shop/Box{k}#items. shop/Box{k}#copy(). shop/Box{k}#copy().(w) shop/Box{k}#copy().(items)
 shop/Box{k}. shop/Box{k}.apply(). shop/Box{k}.apply().(w) shop/Box{k}.apply().(items) shop/Box{k}.unapply(). shop/Box{k}.unapply().(x$1) shop/Box{k}.toString().
 shop/Owner{k}# shop/Owner{k}#`<init>`(). shop/Owner{k}#`<init>`().(name) shop/Owner{k}#name. shop/Owner{k}#`<init>`(+1). shop/Owner{k}#a. shop/Owner{k}#b. shop/Owner{k}#pick(). shop/Owner{k}#pick().(from)
 shop/Size{k}# shop/Size{k}. shop/Size{k}#`<init>`(). shop/Size{k}.Small. shop/Size{k}.Large. shop/Size{k}.Other. shop/Holder{k}. shop/Holder{k}.Id# shop/Holder{k}.ord. shop/Holder{k}.Inner. shop/Holder{k}.Inner.x.
 shop/Rich{k}# shop/Rich{k}#`<init>`(). shop/Rich{k}#`<init>`().(n) shop/Rich{k}#n. shop/Rich{k}#twice(). shop/k{k}$package. shop/k{k}$package.Rich{k}(). shop/k{k}$package.loud(). shop/k{k}$package.loud().(s) shop/k{k}$package.loud().(by)
 shop/k{k}$package.top(). shop/k{k}$package.top().(n) shop/k{k}$package.Code#"""))  # fmt: skip
def scala_constructs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(filled("k{k}.scala", F.col("s_suppkey")).alias("path"), filled(SCALA_TEXT, F.col("s_suppkey")).alias("content"))
    return readers.extract_definitions(spread(rows)).select("path", "symbol")


@query(symbols_sql("k{k}.java", """shop/Shape{k}# shop/Shape{k}#[T] shop/Shape{k}#area(). shop/Shape{k}#tag(). shop/Shape{k}#SIDES. shop/Mark{k}# shop/Mark{k}#value(). shop/Mark{k}#level().
 shop/Box{k}# shop/Box{k}#`<init>`(). shop/Box{k}#`<init>`().(w) shop/Box{k}#`<init>`().(name) shop/Box{k}#`<init>`(+1). shop/Box{k}#twice(). shop/Box{k}#name(). shop/Box{k}#w().
 shop/Size{k}# shop/Size{k}#SMALL. shop/Size{k}#LARGE. shop/Size{k}#n. shop/Size{k}#`<init>`(). shop/Size{k}#`<init>`().(n)
 shop/Owner{k}# shop/Owner{k}#[K] shop/Owner{k}#`<init>`(). shop/Owner{k}#`<init>`(+1). shop/Owner{k}#`<init>`(+1).(key) shop/Owner{k}#`<init>`(+1).(rest) shop/Owner{k}#[R] shop/Owner{k}#make(). shop/Owner{k}#make().(from)
 shop/Owner{k}#none(). shop/Owner{k}#Inner# shop/Owner{k}#Inner#x. shop/Owner{k}#Inner#y. shop/Owner{k}#Inner#`<init>`()."""))  # fmt: skip
def java_constructs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(filled("k{k}.java", F.col("s_suppkey")).alias("path"), filled(JAVA_TEXT, F.col("s_suppkey")).alias("content"))
    return readers.extract_definitions(spread(rows)).select("path", "symbol")


@query(symbols_sql("u{k}.scala", """1:shop/Box{k}# 1:shop/Owner{k}# 3:shop/Box{k}# 3:shop/Box{k}#`<init>`(). 4:scala/collection/immutable/List# 4:shop/Box{k}# 4:shop/Owner{k}# 4:scala/Int#
 5:app/Use{k}.each().(all) 5:local1 6:app/Use{k}.each().(all) 6:app/Use{k}.each().(own) 6:shop/Owner{k}#pick(). 6:local2 7:app/Use{k}.each().(all) 8:local3 8:app/Use{k}.box. 8:local3
 9:local0 9:app/Use{k}.each().(own) 9:shop/Owner{k}#a. 11:app/Use{k}.each().(own) 11:shop/Owner{k}#pick(). 11:app/Use{k}.box. 11:local5 12:local0 12:app/Use{k}.box. 12:shop/Box{k}#w."""))  # fmt: skip
def scala_uses(spark, sf_dir):
    k, rows = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    uses = rows.select(filled("u{k}.scala", k).alias("path"), filled(USE_TEXT, k).alias("content"))
    both = spread(uses.union(rows.select(filled("k{k}.scala", k), filled(SCALA_TEXT, k))))
    scanned = references.scan(both)
    found = references.occurrences(scanned.filter("path like 'u%'"), references.definitions(scanned))
    return found.filter("symbol is not null").select("path", F.concat_ws(":", "start_line", "symbol").alias("symbol"))


@query(symbols_sql("u{k}.java", """1:shop/Box{k}# 2:shop/Owner{k}# 3:shop/Owner{k}# 3:shop/Owner{k}# 4:shop/Box{k}# 5:shop/Box{k}# 5:java/util/List# 5:shop/Box{k}# 5:java/lang/Exception#
 6:app/Use{k}#each().(given) 6:app/Use{k}#held. 6:app/Use{k}#each().(given) 6:shop/Box{k}#twice(). 7:shop/Box{k}# 7:app/Use{k}#each().(all) 7:app/Use{k}#held. 7:local0
 8:local1 8:app/Use{k}#each().(given) 8:shop/Box{k}#w(). 8:local1 8:app/Use{k}#go(). 8:local1 9:app/Use{k}#held. 9:app/Use{k}#held. 9:app/Use{k}#each().(given)
 10:app/Use{k}#each().(given) 10:shop/Box{k}#w(). 10:app/Use{k}#held. 10:app/Use{k}#each().(given) 10:app/Use{k}#go().
 11:shop/Box{k}# 11:shop/Box{k}# 11:shop/Box{k}#`<init>`(). 11:local2 11:shop/Box{k}#twice(). 11:java/lang/Exception# 11:local3 11:app/Use{k}#go().
 12:java/lang/Object# 12:shop/Box{k}# 12:app/Use{k}#each().(given) 13:local4 13:shop/Box{k}# 14:app/Use{k}#each().(all) 14:app/Use{k}#go(). 14:local6
 15:app/Use{k}#each().(all) 15:shop/Box{k}# 15:shop/Box{k}#twice(). 16:app/Use{k}#each().(given) 16:shop/Box{k}#w().
 17:local5 17:app/Use{k}#each().(given) 17:shop/Box{k}#w(). 17:app/Use{k}#held. 17:shop/Box{k}#twice()."""))  # fmt: skip
def java_uses(spark, sf_dir):
    k, rows = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    uses = rows.select(filled("u{k}.java", k).alias("path"), filled(JAVA_USE_TEXT, k).alias("content"))
    both = spread(uses.union(rows.select(filled("k{k}.java", k), filled(JAVA_TEXT, k))))
    scanned = references.scan(both)
    found = references.occurrences(scanned.filter("path like 'u%'"), references.definitions(scanned))
    return found.filter("symbol is not null").select("path", F.concat_ws(":", "start_line", "symbol").alias("symbol"))


@query("SELECT 'P' || p_partkey || '.scala' AS path, CAST(1 AS INTEGER) AS brackets FROM part WHERE p_size % 10 = 3")
def extraction_errors(spark, sf_dir):
    name = F.concat(F.lit("P"), "p_partkey", F.lit(".scala"))
    content = F.when(F.col("p_size") % 10 == 3, "object O { def f = (1, 2)").when(F.col("p_size") % 10 == 4, F.lit(None)).otherwise("object O { }")
    found = readers.extraction_errors(spread(table(spark, sf_dir, "part").select(name.alias("path"), content.alias("content"))))
    return found.select("path", F.regexp_extract("error", "^([0-9]+) brackets", 1).cast("int").alias("brackets"))


#: suffix, text with {k}, dialect, error: what a text of each kind is taken for.
DIALECT_TEXTS = (
    ("scala", "object P{k}:\n  def f(n: Int) =\n    n\n", "scala3", None),
    ("scala", "class P{k} { def f() { g() } }\n", "scala2", None),
    ("scala", "object P{k} { do { f() } while (g) }\n", "scala2", None),
    ("sbt", "p{k} := {k}\n", "scala3", None),
    ("sbt", "p{k} := { do { f() } while (g); {k} }\n", "sbt1", None),
    ("scala", "\nclass P{k} {\n  def = {k}\n}\n", None, 'scala3: "3:7: identifier expected, = found"; scala2: "3:7: identifier expected, = found"'),
    ("scala", "p{k}(1)\n", None, 'scala3: "1:1: expected a definition, p{k} found"; scala2: "1:1: expected a definition, p{k} found"'),
    ("scala", "enum P{k} { case A }\nobject Q { def f() { } }\n", None, 'scala3: "2:20: = expected before the body of a method"; scala2: "1:1: enum is no statement of this dialect"'),
)


def _dialects_sql() -> str:
    literal = lambda x: "NULL" if x is None else f"replace('{x}', '{{k}}', CAST(p_partkey AS VARCHAR))"
    case = lambda column: "CASE p_size % 8 " + " ".join(f"WHEN {k} THEN {literal(row[column])}" for k, row in enumerate(DIALECT_TEXTS)) + " END"
    return f"SELECT 'P' || p_partkey || '.' || {case(0)} AS path, {case(2)} AS dialect, {case(3)} AS error FROM part"


@query(_dialects_sql())
def dialect_cascade(spark, sf_dir):
    k, kind = F.col("p_partkey"), F.col("p_size") % 8
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, (suffix, body, _, _) in enumerate(DIALECT_TEXTS):
        path = F.when(kind == at, text("P", k, f".{suffix}")).otherwise(path)
        content = F.when(kind == at, filled(body, k)).otherwise(content)
    return dialects.dialects(spread(table(spark, sf_dir, "part").select(path.alias("path"), content.alias("content"))))


# References ---------------------------------------------------------------------------------

USED = ("symbol", *RANGE)
SHOPS = "(SELECT 'S' || s_suppkey || '.scala' AS p, 'U' || s_suppkey || '.scala' AS q, 'shop/n' || s_nationkey || '/S' || s_suppkey AS s, 'app/U' || s_suppkey AS u, length('S' || s_suppkey) AS n, length('import shop.n' || s_nationkey || '.') AS i FROM supplier)"


def shop_sources(spark, sf_dir) -> DataFrame:
    """path, content: of each supplier a class with its companion, and an object that uses both."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    lib = text("package shop.n", n, "\nclass S", k, "(val size: Int) {\n  def run(n: Int): Int = n\n}\nobject S", k, " {\n  def apply(size: Int): S", k, " = new S", k, "(size)\n}\n")
    use = text("package app\nimport shop.n", n, ".S", k, "\nobject U", k, " {\n  val made = S", k, "(size = 3)\n  val other: S", k, " = new S", k, "(4)\n  def go(p: S", k, "): Int = p.run(p.size)\n  def lost = nowhere\n}\n")
    rows = table(spark, sf_dir, "supplier")
    return spread(rows.select(F.concat(F.lit("S"), k, F.lit(".scala")).alias("path"), lib.alias("content")).union(rows.select(F.concat(F.lit("U"), k, F.lit(".scala")), use)))


OCCURRENCES_SQL = (
    rows_sql(
        SHOPS,
        "p",
        [
            ("'scala/Int#'", *places(1, "17 + n", "20 + n")),
            ("'scala/Int#'", *places(2, "13", "16")),
            ("'scala/Int#'", *places(2, "19", "22")),
            ("s || '#run().(n)'", *places(2, "25", "26")),
            ("'scala/Int#'", *places(5, "18", "21")),
            ("s || '#'", *places(5, "24", "24 + n")),
            ("s || '#'", *places(5, "31 + n", "31 + 2 * n")),
            ("s || '#`<init>`().'", *places(5, "31 + n", "31 + 2 * n")),
            ("s || '.apply().(size)'", *places(5, "32 + 2 * n", "36 + 2 * n")),
        ],
        USED,
    )
    + " UNION ALL "
    + rows_sql(
        SHOPS,
        "q",
        [
            ("s || '#'", *places(1, "i", "i + n")),
            ("s || '.'", *places(3, "13", "13 + n")),
            ("s || '.apply().'", *places(3, "13", "13 + n")),
            ("s || '.apply().(size)'", *places(3, "14 + n", "18 + n")),
            ("s || '#'", *places(4, "13", "13 + n")),
            ("s || '#'", *places(4, "20 + n", "20 + 2 * n")),
            ("s || '#`<init>`().'", *places(4, "20 + n", "20 + 2 * n")),
            ("s || '#'", *places(5, "12", "12 + n")),
            ("'scala/Int#'", *places(5, "15 + n", "18 + n")),
            ("u || '.go().(p)'", *places(5, "21 + n", "22 + n")),
            ("s || '#run().'", *places(5, "23 + n", "26 + n")),
            ("u || '.go().(p)'", *places(5, "27 + n", "28 + n")),
            ("s || '#size.'", *places(5, "29 + n", "33 + n")),
            ("NULL", *places(6, "13", "20")),
        ],
        USED,
    )
)


@query(OCCURRENCES_SQL)
def scala_references(spark, sf_dir):
    scanned = references.scan(shop_sources(spark, sf_dir))
    return references.occurrences(scanned, references.definitions(scanned))


@query(rows_sql("(SELECT 'U' || o_custkey || '.java' AS p, 'q/U' || o_custkey AS u, length('class U' || o_custkey) AS n FROM (SELECT DISTINCT o_custkey FROM orders))", "p", [
    ("'p/One#'", *places(1, "9", "12")),
    ("'p/One#'", *places(3, "15", "18")),
    ("'p/One#'", *places(4, "4", "7")),
    ("'p/One#'", *places(4, "18", "21")),
    ("'p/One#`<init>`().'", *places(4, "18", "21")),
    ("'local0'", *places(5, "4", "7")),
    ("'p/One#act().'", *places(5, "8", "11")),
    ("u || '#run().(all)'", *places(5, "12", "15")),
    ("u || '#run().(all)'", *places(6, "12", "15")),
    ("'p/One#act().'", *places(6, "12", "20")),
], USED))
def java_references(spark, sf_dir):
    k = F.col("o_custkey")
    use = text("package q;\nimport p.One;\nclass U", k, " {\n  Object run(  One all) {\n    One own = new One(1);\n    own.act(all);\n    return  all::act;\n  }\n}\n")
    users = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(F.concat(F.lit("U"), k, F.lit(".java")).alias("path"), use.alias("content"))
    users = spread(users)
    one = spark.createDataFrame([("One.java", "package p;\npublic class One {\n  One(int a) {}\n  void act(int n) {}\n}\n")], schemas.SOURCES)
    scanned = references.scan(users.union(one))
    found = references.occurrences(scanned.filter("path like 'U%'"), references.definitions(scanned))
    return found.filter("symbol not in ('java/lang/Object#')")


#: One text in two forms, with the same names on the same lines.
INDENTED = """package forms
object Block{k}:
  def first[A](x: A, n: Int): A =
    val kept = x
    if n > 0 then
      val inner = other(n)
      second(inner)
    kept
  def other(n: Int): Int = n
  def second(q: Int): Unit =
    val (left, right) = (q, q)
    for
      (a, b) <- List((left, right))
      c = a
    do third(a + b + c)
    List(q).map: each =>
      third(each)
    q match
      case small if small < 1 => third(small)
      case more => third(more)
  def third(v: Int): Unit = ()
class Held{k}[F](val f: F) extends Base{k}[F](f):
  def get: F = f plus f
class Base{k}[F](g: F):
  def plus(o: F): F = o
"""
BRACED = """package forms
object Block{k} {
  def first[A](x: A, n: Int): A = {
    val kept = x
    if (n > 0) {
      val inner = other(n)
      second(inner) }
    kept }
  def other(n: Int): Int = n
  def second(q: Int): Unit = {
    val (left, right) = (q, q)
    for {
      (a, b) <- List((left, right))
      c = a
    } third(a + b + c)
    List(q).map { each =>
      third(each) }
    q match {
      case small if small < 1 => third(small)
      case more => third(more) } }
  def third(v: Int): Unit = () }
class Held{k}[F](val f: F) extends Base{k}[F](f) {
  def get: F = f plus f }
class Base{k}[F](g: F) {
  def plus(o: F): F = o }
"""


@query(symbols_sql("b{k}.scala", """2:local0 2:scala/Int# 2:local0 3:forms/Block{k}.first().(x) 4:forms/Block{k}.first().(n) 5:forms/Block{k}.other(). 5:forms/Block{k}.first().(n) 6:forms/Block{k}.second(). 6:local2 7:local1
 8:scala/Int# 8:scala/Int# 8:forms/Block{k}.other().(n) 9:scala/Int# 9:scala/Unit# 10:forms/Block{k}.second().(q) 10:forms/Block{k}.second().(q) 12:scala/collection/immutable/List. 12:local3 12:local4 13:local5
 14:forms/Block{k}.third(). 14:local5 14:local6 14:local7 15:scala/collection/immutable/List. 15:forms/Block{k}.second().(q) 16:forms/Block{k}.third(). 16:local8 17:forms/Block{k}.second().(q) 18:local9 18:forms/Block{k}.third(). 18:local9
 19:forms/Block{k}.third(). 19:local10 20:scala/Int# 20:scala/Unit# 21:local11 21:forms/Base{k}# 21:local11 21:forms/Held{k}#f. 22:local11 22:forms/Held{k}#f. 22:forms/Held{k}#f. 23:local12 24:local12 24:local12 24:forms/Base{k}#plus().(o)"""))  # fmt: skip
def scala_blocks(spark, sf_dir):
    k = F.col("s_suppkey")
    content = F.when(k % 2 == 0, filled(INDENTED, k)).otherwise(filled(BRACED, k))
    scanned = references.scan(spread(table(spark, sf_dir, "supplier").select(filled("b{k}.scala", k).alias("path"), content.alias("content"))))
    found = references.occurrences(scanned, references.definitions(scanned))
    return found.filter("symbol is not null").select("path", F.concat_ws(":", "start_line", "symbol").alias("symbol"))


def chain_sources(spark, sf_dir, java: bool) -> DataFrame:
    """path, content: classes of suppliers, nations and regions, each with a method that gives the next, and uses of such chains."""
    k, n, r = F.col("s_suppkey"), F.col("n_nationkey"), F.col("r_regionkey")
    regions, nations, suppliers = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    suppliers = suppliers.withColumnRenamed("s_nationkey", "n_nationkey")
    nations = nations.withColumnRenamed("n_regionkey", "r_regionkey")
    if java:
        texts = [
            suppliers.select(text("S", k, ".java"), text("package lib;\npublic class S", k, " {\n  public N", n, " up() { return null; }\n}\n")),
            nations.select(text("N", n, ".java"), text("package lib;\npublic class N", n, " {\n  public R", r, " home(int a) { return null; }\n}\n")),
            regions.select(text("R", r, ".java"), text("package lib;\npublic class R", r, " {\n  public int size() { return 1; }\n}\n")),
            suppliers.select(text("U", k, ".java"), text("package app;\nimport lib.S", k, ";\nclass U", k, " {\n  S", k, " held;\n  void run(S", k, " s) {\n    new S", k, "().up().home(1).size();\n    var y = new S", k, "();\n    y.up().home(2).size();\n    this.held.up().home(3).gone();\n  }\n}\n")),
        ]
    else:
        texts = [
            suppliers.select(text("S", k, ".scala"), text("package lib\nclass S", k, ":\n  def up: N", n, " = null\n")),
            nations.select(text("N", n, ".scala"), text("package lib\nclass N", n, " { def home(a: Int): R", r, " = null }\n")),
            regions.select(text("R", r, ".scala"), text("package lib\nclass R", r, ":\n  def size(): Int = 1\n")),
            suppliers.select(text("U", k, ".scala"), text("package app\nimport lib.S", k, "\nobject U", k, ":\n  val held: S", k, " = null\n  def run(s: S", k, ") =\n    new S", k, "().up.home(1).size()\n    val y = new S", k, "()\n    y.up.home(2).size()\n    this.held.up.home(3).gone\n")),
        ]
    out = texts[0]
    for other in texts[1:]:
        out = out.union(other)
    return spread(out.toDF("path", "content"))


def chains_sql(suffix: str, line: int) -> str:
    """path and line:symbol of the members in the uses; what no class has is not among them."""
    rows = [(line, "'lib/S' || k || '#up().'"), (line, "'lib/N' || n || '#home().'"), (line, "'lib/R' || r || '#size().'")]
    rows += [(line + 2, s) for _, s in rows[:3]] + [(line + 3, s) for _, s in rows[:2]]
    held = "(SELECT s_suppkey AS k, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
    return " UNION ALL ".join(f"SELECT 'U' || k || '.{suffix}' AS path, '{at}:' || {symbol} AS symbol FROM {held}" for at, symbol in rows)


def _chains(spark, sf_dir, java: bool) -> DataFrame:
    scanned = references.scan(chain_sources(spark, sf_dir, java))
    found = references.occurrences(scanned, references.definitions(scanned)).filter("path like 'U%' and symbol like 'lib/%().'  and symbol not like '%init%'")
    return found.select("path", F.concat_ws(":", "start_line", "symbol").alias("symbol"))


@query(chains_sql("scala", 5))
def scala_chains(spark, sf_dir):
    return _chains(spark, sf_dir, java=False)


@query(chains_sql("java", 5))
def java_chains(spark, sf_dir):
    return _chains(spark, sf_dir, java=True)


@query("""WITH k AS (SELECT s_suppkey AS k, 'shop/n' || s_nationkey || '/' AS p FROM supplier)
SELECT 'i' || k || '.scala' AS path, 3 AS start_line, 'shop/' AS symbol FROM k UNION ALL SELECT 'i' || k || '.scala', 3, p FROM k UNION ALL SELECT 'i' || k || '.scala', 3, p || 'S' || k || '#' FROM k
UNION ALL SELECT 'i' || k || '.scala', 4, p || 'S' || k || '#' FROM k UNION ALL SELECT 'i' || k || '.scala', 4, 'out/Near' || k || '#' FROM k UNION ALL SELECT 'i' || k || '.scala', 4, 'out/in/Own' || k || '#' FROM k""")
def nested_packages(spark, sf_dir):
    """Packages in packages, whose members are seen from inside, and the packages that imports name on the way."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    use = text("package out\npackage in\nclass Own", k, "\nimport shop.n", n, ".S", k, "\ntrait Use", k, " { def a(x: S", k, ", y: Near", k, ", z: Own", k, ") }\n")
    rows = table(spark, sf_dir, "supplier")
    near = rows.select(text("n", k, ".scala"), text("package out { class Near", k, " }\npackage shop { package n", n, " { class S", k, " } }\n"))
    scanned = references.scan(spread(rows.select(text("i", k, ".scala").alias("path"), use.alias("content")).union(near)))
    found = references.occurrences(scanned, references.definitions(scanned), packages=True)
    return found.filter("path like 'i%'").select("path", "start_line", "symbol")


@query("SELECT 'U' || s_suppkey || '.scala' AS path, 'local' || k AS symbol, CAST(2 + k AS INTEGER) AS start_line FROM supplier, unnest(range(0, 2)) AS t(k)")
def local_numbers(spark, sf_dir):
    content = text("object U {\n  def f(n: Int) = {\n    val a = n\n    val b = a\n    b\n  }\n}\n")
    sources = spread(table(spark, sf_dir, "supplier").select(F.concat(F.lit("U"), "s_suppkey", F.lit(".scala")).alias("path"), content.alias("content")))
    return references.local_definitions(references.candidates(sources)).select("path", "symbol", "start_line")


@query("SELECT s_suppkey AS query_id, 'shop/n' || s_nationkey || '/S' || s_suppkey || '#run().' AS symbol, '```' || chr(10) || 'def run(n: Int): Int' || chr(10) || '```' || chr(10) || chr(10) || 'Runs ' || s_name || '.' AS markdown, CAST(3 AS INTEGER) AS start_line FROM supplier")
def hover(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    content = text("package shop.n", n, "\nclass S", k, " {\n  /** Runs {@code ", F.col("s_name"), "}. */\n  def run(n: Int): Int = n\n}\n")
    sources = spread(table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), k, F.lit(".scala")).alias("path"), content.alias("content")))
    owner = F.concat(F.lit("shop/n"), n, F.lit("/S"), k, F.lit("#"))
    asked = table(spark, sf_dir, "supplier").select(k.alias("query_id"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.concat(owner, F.lit("gone.")).alias("symbol")), F.struct(F.lit(1).alias("ord"), F.concat(owner, F.lit("run().")).alias("symbol")))).alias("a")).select("query_id", "a.*")
    return signatures.hovers(asked, signatures.declarations(sources), signatures.comments(sources)).select("query_id", "symbol", "markdown", "start_line")


GOTO_SQL = f"""WITH defs AS ({rows_sql(SHOPS, "p", [("s || '#'", *places(1, "6", "6 + n")), ("s || '#`<init>`().'", *places(1, "6", "6 + n")), ("s || '.apply().'", *places(5, "6", "11")), ("s || '.'", *places(4, "7", "7 + n"))], USED)}),
 uses AS ({OCCURRENCES_SQL})
SELECT DISTINCT CAST(substr(u.path, 2, length(u.path) - 7) AS BIGINT) AS query_id, d.path, d.start_line, d.start_char, d.end_line, d.end_char FROM uses u JOIN defs d USING (symbol) WHERE u.path LIKE 'U%' AND u.start_line = 3 AND u.start_char = 13"""


@query(GOTO_SQL)
def goto_definition(spark, sf_dir):
    found = references.scan(shop_sources(spark, sf_dir))
    definitions = references.definitions(found)
    cursors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("U"), "s_suppkey", F.lit(".scala")).alias("path"), F.lit(3).alias("line"), F.lit(13).alias("ch"))
    return lookup.goto(cursors, references.occurrences(found, definitions), references.local_definitions(found), definitions)


@query("""SELECT 2 * s_suppkey + u AS query_id, 'D' || s_suppkey AS path FROM supplier, unnest([1]) AS t(u) UNION ALL SELECT 2 * s_suppkey + u, 'E' || s_suppkey FROM supplier, unnest([0, 1]) AS t(u) WHERE s_nationkey % 5 < 2""")
def goto_elsewhere(spark, sf_dir):
    """Cursors on a definition and on a use: neither the definition stood on is found, nor one without a place."""
    rows, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    place = lambda line, end: [F.lit(x).alias(c) for x, c in zip((line, 0, line, end), RANGE)]
    symbol = text("p/S", k, "#").alias("symbol")
    declared = rows.select(symbol, text("D", k).alias("path"), *place(1, 5)).union(rows.filter("s_nationkey % 5 < 2").select(symbol, text("E", k), *place(3, 1))).union(rows.filter("s_nationkey % 3 = 0").select(symbol, text("Z", k), *place(0, 0)))
    uses = rows.select(text("D", k).alias("path"), symbol, *place(1, 5)).union(rows.select(text("U", k), symbol, *place(2, 5)))
    cursors = rows.select((2 * k).alias("query_id"), text("D", k).alias("path"), F.lit(1).alias("line"), F.lit(2).alias("ch")).union(rows.select(2 * k + 1, text("U", k), F.lit(2), F.lit(3)))
    return lookup.goto(cursors, uses, uses.filter("false"), declared).select("query_id", "path")


@query("SELECT p_partkey AS query_id, 'shop/b' || (p_size % 5) || '/T' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '#' ELSE '#size.' END AS symbol FROM part WHERE p_size % 4 <> 3")
def declaration_at_range(spark, sf_dir):
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("T"), "p_partkey")).otherwise("size")
    line = F.when(F.col("p_size") % 4 == 3, 20).otherwise(1)
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("P"), "p_partkey", F.lit(".scala")).alias("path"), line.alias("line"), F.lit(6).alias("ch"), name.alias("name"))
    declared = readers.extract_definitions(part_sources(spark, sf_dir)).filter(~F.col("symbol").contains("("))
    return lookup.declaration_at(asked, declared)


@query("SELECT p_partkey AS query_id, '_empty_/f' || (p_partkey % 7) || '$package.go().' AS symbol FROM part WHERE p_size > 10")
def wrapper_members(spark, sf_dir):
    asked = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("query_id"), F.lit("_empty_/").alias("owner"), F.concat(F.lit("go"), F.col("p_partkey") % 7).alias("short_name"))
    k = F.col("p_size") % 7
    held = table(spark, sf_dir, "part").select(k.alias("k")).distinct().select(F.explode(F.array(F.concat(F.lit("_empty_/f"), "k", F.lit("$package.go().")), F.concat(F.lit("_empty_/Go"), "k", F.lit(".go().")))).alias("symbol"), F.concat(F.lit("go"), "k").alias("short_name"))
    return lookup.wrapped_member(asked, held)


@query("SELECT o_orderkey AS query_id, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'own/' || o_custkey END, CASE WHEN o_custkey % 2 = 0 THEN 'lib/' || o_custkey END) AS found FROM orders")
def workspace_then_dependency(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    held = orders.select(F.col("o_custkey").alias("symbol")).distinct()
    own = held.filter("symbol % 3 = 0").withColumn("found", F.concat(F.lit("own/"), "symbol"))
    lib = held.filter("symbol % 2 = 0").withColumn("found", F.concat(F.lit("lib/"), "symbol"))
    return lookup.first_of(orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("symbol")), own, lib).select("query_id", "found")


# Stored tables ------------------------------------------------------------------------------------


def stored_parts(spark, sf_dir) -> index.Index:
    """An index of a definition for each part, by brand and number, written and read again."""
    symbol = text("shop/", F.col("p_brand"), "/P", F.col("p_partkey"), "#")
    rows = table(spark, sf_dir, "part").select(symbol.alias("symbol"), text("P", F.col("p_partkey")).alias("short_name"), F.lit(True).alias("is_type"), *[F.lit(k).alias(c) for k, c in enumerate(RANGE)], F.col("p_name").alias("path"))
    path = tables.new_folder(spark, "index")
    index.store(rows, path, 16)
    return index.Index(spark, path)


@query("SELECT o_orderkey AS query_id, 'shop/' || p_brand || '/P' || p_partkey || '#' AS symbol, p_name AS path FROM orders JOIN part ON p_partkey = o_custkey WHERE o_orderkey % 7 < 3 AND p_brand = 'Brand#' || (11 + o_orderkey % 7)")
def stored_lookup(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    asked = table(spark, sf_dir, "orders").filter(k < 3).select(F.col("o_orderkey").alias("query_id"), text("shop/Brand#", 11 + k, "/P", F.col("o_custkey"), "#").alias("symbol"))
    return stored_parts(spark, sf_dir).lookup(asked).select("query_id", "symbol", "path")


@query("""WITH asked AS (SELECT DISTINCT p_brand || '/P' || (p_partkey % 40) AS query_id, 'shop/' || p_brand || '/P' || (p_partkey % 40) AS prefix FROM part), held AS (SELECT 'shop/' || p_brand || '/P' || p_partkey || '#' AS symbol FROM part)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY symbol) AS INTEGER) AS rank, symbol FROM asked JOIN held ON starts_with(symbol, prefix)) WHERE rank <= 32""")
def stored_prefixes(spark, sf_dir):
    name = text(F.col("p_brand"), "/P", F.col("p_partkey") % 40)
    asked = table(spark, sf_dir, "part").select(name.alias("query_id")).distinct().withColumn("prefix", F.concat(F.lit("shop/"), "query_id"))
    return stored_parts(spark, sf_dir).prefix_scans(asked)


@query("""WITH last AS (SELECT o_custkey AS k, arg_max(o_orderstatus, {'d': o_orderdate, 'o': o_orderkey}) AS status, arg_max(o_orderkey, {'d': o_orderdate, 'o': o_orderkey}) AS o FROM orders WHERE o_orderkey % 11 = 0 GROUP BY o_custkey)
SELECT coalesce(c_custkey, k) AS k, CASE WHEN k IS NULL THEN 'shop/' || c_mktsegment || '#' ELSE 'shop/O' || o || '#' END AS symbol FROM customer FULL JOIN last ON k = c_custkey WHERE k IS NULL OR status <> 'F'""")
def bucketed_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(text("shop/", F.col("c_mktsegment"), "#").alias("symbol"), F.col("c_custkey").cast("string").alias("path"))
    held = bucketed.Bucketed(spark, tables.new_folder(spark, "bucketed"), "symbol string, path string", 16)
    held.fill(rows)
    kind = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("change")
    events = table(spark, sf_dir, "orders").filter("o_orderkey % 11 = 0").select(F.col("o_custkey").cast("string").alias("path"), kind.alias("kind"), F.col("o_orderkey").cast("string").alias("content"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderkey").alias("seq"))
    held.upsert(events, lambda sources: sources.select(text("shop/O", F.col("content"), "#").alias("symbol"), "path"), 0)
    return held.read().select(F.col("path").cast("long").alias("k"), "symbol")


@query("""WITH e AS (SELECT o_custkey AS k, o_orderkey % 5 AS kind, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS content, o_orderkey AS o FROM orders),
 ends AS (SELECT k, max(o) AS o, arg_max(kind, o) AS kind FROM e WHERE kind > 2 GROUP BY k), opens AS (SELECT e.k, min(e.o) AS o FROM e LEFT JOIN ends USING (k) WHERE e.kind = 0 AND (ends.o IS NULL OR e.o > ends.o) GROUP BY e.k),
 typed AS (SELECT e.k, arg_max(e.content, e.o) AS content FROM e JOIN opens p ON p.k = e.k AND e.o >= p.o WHERE e.kind < 3 AND e.content IS NOT NULL GROUP BY e.k), kept AS (SELECT c_custkey AS k, c_mktsegment AS content FROM customer WHERE c_custkey NOT IN (SELECT k FROM ends WHERE kind = 4))
SELECT k, coalesce(CAST(typed.content AS VARCHAR), kept.content) AS content, opens.o IS NOT NULL AS is_open FROM (SELECT k FROM kept UNION SELECT k FROM opens) LEFT JOIN kept USING (k) LEFT JOIN opens USING (k) LEFT JOIN typed USING (k)""")
def unsaved_buffers(spark, sf_dir):
    o = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("open", "change", "change", "close", "delete"))), (o % 5 + 1).cast("int"))
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), kind.alias("kind"), F.when(o % 3 > 0, o.cast("string")).alias("content"), F.lit(0).alias("ts"), o.alias("seq"))
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("content"))
    return refresh.with_buffers(stored, events).withColumnRenamed("path", "k")


# Facts ------------------------------------------------------------------------------------------


def _field(tag: str, body: Column) -> Column:
    """A length-delimited field of under 128 bytes."""
    return F.concat(F.unhex(F.lit(tag)), F.unhex(F.lpad(F.hex(F.octet_length(body)), 2, "0")), body)


def _occurrence(symbol: Column, role: str, line: str, start: str, end: str) -> Column:
    place = F.unhex(F.lit(f"08{line}10{start}18{line}20{end}"))
    return _field("32", F.concat(_field("0A", place), _field("12", F.encode(symbol, "UTF-8")), F.unhex(F.lit(f"18{role}"))))


def supplier_facts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Decoded facts of a composed file for each supplier, and the pairs of facts and sources."""
    name = F.concat(F.lit("S"), "s_suppkey")
    symbol = F.concat(F.lit("p/"), name, F.lit("#"))
    own = F.concat(_field("12", F.encode(F.concat(name, F.lit(".scala")), "UTF-8")), _occurrence(symbol, "02", "01", "06", "09"), _occurrence(F.lit("local0"), "02", "02", "08", "09"), _occurrence(F.lit("q/Z."), "01", "03", "02", "03"))
    content = F.concat(_field("0A", own), F.when(F.col("s_suppkey") % 5 == 0, F.unhex(F.lit("0A"))).otherwise(F.unhex(F.lit(""))))  # every fifth file is cut short
    path = F.concat(F.lit("/f/"), name, F.lit(".semanticdb"))
    rows = table(spark, sf_dir, "supplier")
    return facts.read(rows.select(path.alias("path"), content.alias("content"))), rows.select(path.alias("facts_path"), F.concat(name, F.lit(".scala")).alias("path"))


@query("SELECT 'p/S' || s_suppkey || '#' AS symbol, 'S' || s_suppkey AS short_name, true AS is_type, CAST(1 AS INTEGER) AS start_line, CAST(6 AS INTEGER) AS start_char, CAST(1 AS INTEGER) AS end_line, CAST(9 AS INTEGER) AS end_char, 'S' || s_suppkey || '.scala' AS path FROM supplier WHERE s_suppkey % 5 <> 0")
def facts_definitions(spark, sf_dir):
    return facts.definitions(*supplier_facts(spark, sf_dir))


@query("SELECT 'S' || s_suppkey || '.scala' AS path, 'q/Z.' AS symbol, CAST(3 AS INTEGER) AS line, 'local0' AS local_symbol FROM supplier WHERE s_suppkey % 5 <> 0")
def facts_occurrences(spark, sf_dir):
    held, pairs = supplier_facts(spark, sf_dir)
    own = facts.locals_of(held, pairs).select("path", F.col("symbol").alias("local_symbol"))
    return facts.occurrences(held, pairs).select("path", "symbol", F.col("start_line").alias("line")).join(own, "path")


FILES_SQL = "parts AS (SELECT p_partkey AS k, p_size % 3 AS m, p_size % 4 AS u FROM part), files AS (SELECT '/w/m' || m || '/src/P' || k || '.scala' AS path FROM parts), facts AS (SELECT k, m, '/w/m' || m || '/out/META-INF/semanticdb/src/P' || k || '.scala.semanticdb' AS facts_path, CASE WHEN u = 0 THEN '' WHEN u = 1 THEN 'src/P' || (k + 1) || '.scala' ELSE 'src/P' || k || '.scala' END AS uri FROM parts)"


def part_facts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """files (path) and facts (facts_path, uri) of a tree of three modules."""
    k, m, u = F.col("p_partkey"), F.col("p_size") % 3, F.col("p_size") % 4
    path, name = text("/w/m", m, "/src/P", k, ".scala"), text("src/P", k, ".scala")
    uri = F.when(u == 0, "").when(u == 1, text("src/P", k + 1, ".scala")).otherwise(name)
    return table(spark, sf_dir, "part").select(path.alias("path")), table(spark, sf_dir, "part").select(text("/w/m", m, "/out/META-INF/semanticdb/", name, ".semanticdb").alias("facts_path"), uri.alias("uri"))


@query(f"WITH {FILES_SQL} SELECT facts_path, coalesce(a.path, b.path) AS path FROM facts f LEFT JOIN files a ON a.path = '/w/m0/' || uri LEFT JOIN files b ON b.path = '/w/m' || m || '/' || uri WHERE uri <> '' AND coalesce(a.path, b.path) IS NOT NULL")
def uri_climb(spark, sf_dir):
    files, held = part_facts(spark, sf_dir)
    return lookup.resolve_uris(held, files, "/w/m0", "/w")


@query(f"WITH {FILES_SQL} SELECT '/w/m1/src/P' || k || '.scala' AS path, facts_path FROM facts WHERE m = 1 AND uri = 'src/P' || k || '.scala'")
def conventional_pairs(spark, sf_dir):
    files, held = part_facts(spark, sf_dir)
    return readers.pair_by_convention(files, held, "/w/m1", "/w/m1/out", "/w")


@query("SELECT 'shop/' || p_partkey || '# ' || '1:' || p_size || '-2:7 f' || p_size AS line FROM part")
def symbol_dump(spark, sf_dir):
    place = [F.lit(1).alias("start_line"), F.col("p_size").alias("start_char"), F.lit(2).alias("end_line"), F.lit(7).alias("end_char")]
    return readers.dump_symbols(table(spark, sf_dir, "part").select(text("shop/", F.col("p_partkey"), "#").alias("symbol"), *place, F.concat(F.lit("f"), "p_size").alias("path")))


# Archives and configuration ------------------------------------------------------------------------


def _little(n: Column, size: int) -> Column:
    """A number as `size` little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*[F.unhex(F.substring(digits, 2 * k + 1, 2)) for k in reversed(range(size))])


def zipped(name: Column, content: Column) -> Column:
    """The bytes of a zip archive with one stored entry."""
    body, raw = F.encode(content, "UTF-8"), F.encode(name, "UTF-8")
    length, words = F.octet_length(body), lambda digits: F.unhex(F.lit(digits))
    facts_of = F.concat(words("0A000000000000002100"), _little(F.crc32(body), 4), _little(length, 4), _little(length, 4), _little(F.octet_length(raw), 2))
    entry = F.concat(words("504B0304"), facts_of, words("0000"), raw, body)
    directory = F.concat(words("504B01020A00"), facts_of, words("000000000000000000000000" + "00000000"), raw)
    return F.concat(entry, directory, words("504B05060000000001000100"), _little(F.octet_length(directory), 4), _little(F.octet_length(entry), 4), words("0000"))


@query("SELECT '/c/S' || s_suppkey || '.jar' AS archive, CASE WHEN s_suppkey % 5 > 0 THEN 'p/S' || s_suppkey || '.java' END AS entry, CASE WHEN s_suppkey % 5 > 1 THEN 'package p; class S' || s_suppkey || ' {}' END AS content, s_suppkey % 5 < 2 AS failed FROM supplier WHERE s_suppkey % 7 > 0")
def archive_scan(spark, sf_dir):
    """Archives of a source each: of some the entry is damaged, of others the archive; every seventh holds no source."""
    k = F.col("s_suppkey")
    content = text("package p; class S", k, " {}")
    whole = zipped(text("p/S", k, F.when(k % 7 == 0, ".txt").otherwise(".java")), content)
    damaged = F.when((k % 5 == 0) & (k % 7 > 0), F.substring(whole, 1, 40)).when(k % 5 == 1, F.concat(F.substring(whole, 1, 48), F.unhex(F.lit("00")), F.substring(whole, 50, 1 << 20))).otherwise(whole)
    found = readers.archive_entries(table(spark, sf_dir, "supplier").select(text("/c/S", k, ".jar").alias("path"), damaged.alias("content")))
    return found.select("archive", "entry", "content", F.col("error").isNotNull().alias("failed"))


def part_entries(spark, sf_dir, suffix: str) -> DataFrame:
    """archive, entry: an entry for each part in the archive of its brand, of some also one that counts for nothing."""
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    jar = text("/c/", brand, "-1.0", ".jar" if suffix == ".class" else "-sources.jar")
    entry = text(F.when((brand == "Brand_2") & F.lit(suffix != ".class"), "mod/").otherwise(""), "shop/", F.replace("p_type", F.lit(" "), F.lit("_")), "/P", F.col("p_partkey"), suffix)
    rows = table(spark, sf_dir, "part").select(jar.alias("archive"), F.explode(F.array(entry, text("META-INF/P", F.col("p_partkey"), suffix), text("P", F.col("p_partkey"), suffix))).alias("entry"))
    if suffix == ".class":
        return rows.filter(F.col("archive").rlike("[13579]-1"))
    return rows.union(rows.filter("archive like '%Brand_2-%'").select("archive", F.lit("mod/module-info.java")).distinct())


@query("""WITH brands AS (SELECT replace(p_brand, '#', '_') AS b, 'shop.' || replace(p_type, ' ', '_') AS p FROM part)
SELECT '/c/' || b || '-1.0-sources.jar' AS archive, array_to_string(list_sort(list_distinct(list(p))), ',') AS packages FROM brands GROUP BY b""")
def archive_packages(spark, sf_dir):
    sources = part_entries(spark, sf_dir, ".java")
    found = readers.archive_packages(sources.select("archive").distinct(), readers.class_packages(part_entries(spark, sf_dir, ".class")), readers.source_packages(sources))
    return found.select("archive", F.array_join("packages", ",").alias("packages"))


@query("""WITH brands AS (SELECT replace(p_brand, '#', '_') AS b, replace(p_type, ' ', '_') AS t FROM part)
SELECT '/c/' || b || '-1.0-sources.jar' AS archive, array_to_string(list_sort(list_distinct(list(CASE WHEN CAST(right(b, 1) AS INTEGER) % 2 = 1 THEN 'made.' ELSE 'shop.' END || t))), ',') AS packages FROM brands GROUP BY b""")
def sibling_packages(spark, sf_dir):
    """Archives whose classes stand in other packages than their sources."""
    sources, made = part_entries(spark, sf_dir, ".java"), part_entries(spark, sf_dir, ".class").withColumn("entry", F.replace("entry", F.lit("shop/"), F.lit("made/")))
    found = readers.archive_packages(sources.select("archive").distinct(), readers.class_packages(made), readers.source_packages(sources))
    return found.select("archive", F.array_join("packages", ",").alias("packages"))


@query("SELECT 'S' || s_suppkey AS path, CASE s_nationkey % 3 WHEN 0 THEN 'com.n' || s_nationkey WHEN 1 THEN NULL ELSE 'own' END AS \"group\" FROM supplier")
def pom_groups(spark, sf_dir):
    n = F.col("s_nationkey")
    parent = "<parent><groupId>up</groupId></parent>"
    own = F.when(n % 3 == 0, text("<groupId> com.n", n, " </groupId>", parent)).when(n % 3 == 1, parent).otherwise(f"{parent}<groupId>own</groupId>")
    content = text("<project xmlns='http://maven.apache.org/POM/4.0.0'>", own, "</project>")
    return readers.pom_groups(table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("path"), content.alias("content")))


@query("SELECT CAST(event_id AS VARCHAR) AS path, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def json_scan(spark, sf_dir):
    content = F.when(F.col("event_id") % 7 == 0, "{broken").when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("props"))
    return readers.json_rows(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), content.alias("content")), "k bigint")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/.bsp/x' || page_id || '.json' WHEN 1 THEN '.bsp/y' || page_id || '.json' END AS path FROM pages WHERE page_id % 4 < 2")
def connection_files(spark, sf_dir):
    k = F.col("page_id")
    path = F.when(k % 4 == 0, text("a/.bsp/x", k, ".json")).when(k % 4 == 1, text(".bsp/y", k, ".json")).when(k % 4 == 2, text("gen/.bsp/z", k, ".json")).otherwise(text("a/" * 11, ".bsp/w", k, ".json"))
    found = readers.connection_files(table(spark, sf_dir, "pages").select(path.alias("path")), ignore.parse(["gen/", ".*"]))
    return found.select(F.regexp_extract("path", "([0-9]+)[.]json$", 1).cast("long").alias("page_id"), "path")


SKIPS_SQL = "paths AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'src/node_modules/A.java' WHEN 1 THEN 'src/targets/B.SCALA' WHEN 2 THEN '.state/c.sbt' WHEN 3 THEN 'sub/repo/D.scala' ELSE 'x/E.py' END AS path FROM pages)"


def mixed_paths(spark, sf_dir) -> DataFrame:
    k = F.col("page_id") % 5
    path = F.when(k == 0, "src/node_modules/A.java").when(k == 1, "src/targets/B.SCALA").when(k == 2, ".state/c.sbt").when(k == 3, "sub/repo/D.scala").otherwise("x/E.py")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(f"WITH {SKIPS_SQL} SELECT page_id, page_id % 5 IN (0, 2) AS skipped, page_id % 5 <> 4 AS source FROM paths")
def skipped_folders(spark, sf_dir):
    return mixed_paths(spark, sf_dir).select("page_id", ignore.always_skipped(F.col("path"), (".state",)).alias("skipped"), ignore.is_source(F.col("path")).alias("source"))


@query(f"WITH {SKIPS_SQL} SELECT page_id, path FROM paths WHERE NOT starts_with(path, 'sub/repo')")
def nested_repositories(spark, sf_dir):
    return ignore.without_nested_repositories(mixed_paths(spark, sf_dir), spark.createDataFrame([("sub/repo",), ("x/none",)], "root string"))


@query("SELECT page_id, page_id % 3 = 0 AS ignored FROM pages")
def ignore_many_rules(spark, sf_dir):
    """Rules enough for the compiled patterns: every third page's folder, and some that later rules take back."""
    rules = ignore.parse([f"f{k}/" for k in range(0, 60)] + [f"!f{k}/" for k in range(60) if k % 3])
    path = text("a/f", F.col("page_id") % 60, "/", F.col("page_id"), ".html")
    return table(spark, sf_dir, "pages").select("page_id", ignore.ignored(path, False, rules).alias("ignored"))


# Symbols and texts ----------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'local' || p_size WHEN 1 THEN 'local' || p_size || '+1' WHEN 2 THEN 'plain' ELSE 'a/b' || p_size || '.' END AS symbol, p_size % 4 < 2 AS is_local, p_size % 4 <> 2 AS is_full FROM part")
def symbol_kinds(spark, sf_dir):
    size = F.col("p_size")
    symbol = F.when(size % 4 == 0, F.concat(F.lit("local"), size)).when(size % 4 == 1, text("local", size, "+1")).when(size % 4 == 2, "plain").otherwise(text("a/b", size, "."))
    return table(spark, sf_dir, "part").select("p_partkey", symbol.alias("symbol"), S.is_local(symbol).alias("is_local"), S.is_full(symbol).alias("is_full"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '_empty_/' WHEN 1 THEN 'a/b' || p_size || '/' ELSE 'c/' END AS owner, CASE p_size % 3 WHEN 0 THEN 'q/P' || p_size || '$package.' WHEN 1 THEN 'q/package$package.' ELSE 'q/`my-build`.' END AS wrapper FROM part")
def owners_of_files(spark, sf_dir):
    size = F.col("p_size")
    dotted = F.when(size % 3 == 0, "").when(size % 3 == 1, text("a.b", size)).otherwise("c.")
    name = F.when(size % 3 == 0, text("P", size, ".scala")).when(size % 3 == 1, "package.scala").otherwise("my-build.sbt")
    return table(spark, sf_dir, "part").select("p_partkey", S.package_owner(dotted).alias("owner"), S.wrapper_owner(name, F.lit("q/")).alias("wrapper"))


@query("SELECT p_partkey, 'see label ' || p_size || ' and name' || p_size || ', Last' || p_size || ' or v' AS doc FROM part")
def doc_links(spark, sf_dir):
    size = F.col("p_size")
    raw = text("see {@link a.B#c label ", size, "} and {@link a.B#name", size, "}, {@link x.y.Last", size, "} or {@value v}")
    return table(spark, sf_dir, "part").select("p_partkey", X.unwrap_links(raw).alias("doc"))


@query("SELECT p_partkey, 'Adds ' || p_size || '.' || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '@param by how' || chr(10) || 'much' || chr(10) || '@return it' ELSE '' END AS doc FROM part")
def javadoc_tags(spark, sf_dir):
    size = F.col("p_size")
    raw = text("/**\n * Adds ", size, ".\n", F.when(size % 2 == 0, " *\n *  @param   by   how\n * much\n *\n * @return it\n").otherwise(""), " */")
    return table(spark, sf_dir, "part").select("p_partkey", X.javadoc(raw).alias("doc"))


@query("SELECT event_id, '[' || event_type || '] ok' AS message FROM events")
def ansi_strip(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.strip_ansi(text("\x1b[31m[", F.col("event_type"), "]\x1b[0m\x1b[1;4m ok\x1b[K")).alias("message"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'def f(a: Int): Int = a' WHEN 1 THEN 'def f(' || chr(10) || '  a: Int,' || chr(10) || '): Int' ELSE 'def f(' || repeat(chr(10) || 'x', 9) END AS declaration FROM part")
def declaration_capture(spark, sf_dir):
    size = F.col("p_size") % 3
    lines = F.when(size == 0, F.array(*map(F.lit, ["// before", "def f(a: Int): Int = a", "after"]))).when(size == 1, F.array(*map(F.lit, ["// before", "def f(", "  a: Int,", "): Int", "after"])))
    lines = lines.otherwise(F.array(F.lit("// before"), F.lit("def f("), *[F.lit("x")] * 20))
    return table(spark, sf_dir, "part").select("p_partkey", X.declaration(lines, F.lit(1)).alias("declaration"))


@query("SELECT p_partkey, CAST(p_size * 100 // 50 AS INTEGER) AS percent, '```' || chr(10) || p_name || chr(10) || '```' || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || p_type ELSE '' END AS markdown FROM part")
def hover_text(spark, sf_dir):
    doc = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.percent("p_size", F.lit(50)).alias("percent"), X.markdown("p_name", doc).alias("markdown"))


# Events -------------------------------------------------------------------------------------------------


@query("SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, {'t': ts, 'e': event_id}) <> 'purchase' AS is_open FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY user_id")
def open_files(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "close").when(F.col("event_type").isin("click", "error"), "open").otherwise("change")
    return refresh.open_paths(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), kind.alias("kind"), "ts", F.col("event_id").alias("seq")))


@query("""WITH open AS (SELECT user_id FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id HAVING arg_max(event_type, {'t': ts, 'e': event_id}) = 'click')
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS path FROM orders WHERE o_custkey IN (SELECT user_id FROM open)""")
def open_occurrences(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "close").when(F.col("event_type") == "click", "open").otherwise("change")
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))
    return refresh.of_open_files(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("path")), events).select("o_orderkey", "path")


@query("""WITH last AS (SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS kind, max({'t': ts, 'e': event_id}).e AS e FROM events GROUP BY user_id), known AS (SELECT DISTINCT o_custkey AS u FROM orders)
SELECT CAST(u AS VARCHAR) AS path, 'old' AS symbol FROM known WHERE u NOT IN (SELECT user_id FROM last) UNION ALL SELECT CAST(user_id AS VARCHAR), 'made' || e FROM last WHERE kind <> 'error'""")
def changed_paths(spark, sf_dir):
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.lit("old").alias("symbol")).distinct()
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("change")
    changes = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), kind.alias("kind"), F.concat(F.lit("made"), "event_id").alias("content"), "ts", F.col("event_id").alias("seq"))
    return refresh.apply_changes(known, changes, lambda sources: sources.select("path", F.col("content").alias("symbol")))


@query("""WITH asked AS (SELECT user_id, event_id, value > 50 AS t FROM events WHERE event_type <> 'purchase'), drains AS (SELECT user_id, event_id, event_id % 3 = 0 AS failed FROM events WHERE event_type = 'purchase'),
 next AS (SELECT a.user_id, a.t, a.event_id, (SELECT min(d.event_id) FROM drains d WHERE d.user_id = a.user_id AND d.event_id >= a.event_id) AS drained_at FROM asked a)
SELECT user_id, drained_at, t AS target, min(event_id) AS first_at FROM next WHERE drained_at IS NOT NULL AND drained_at % 3 <> 0 GROUP BY ALL""")
def pending_requests(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 50).alias("target"), (F.col("event_id") % 3 == 0).alias("failed"), "event_type")
    return debounce.pending(events.filter("event_type <> 'purchase'"), events.filter("event_type = 'purchase'"), "user_id", "target", "event_id", "failed")


@query("SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS n, event_id FROM events")
def file_numbers(spark, sf_dir):
    rows = merge.numbered(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "n")
    return rows.select("user_id", "event_type", F.col("n").cast("int").alias("n"), "event_id")
