from pyspark.sql import functions as F

from factloom.functions import defaults, text
from factloom.functions import symbols as S


def values(spark, expression, *rows):
    """The expression of column c over the rows, in their order."""
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r.v for r in frame.select("i", expression(F.col("c")).alias("v")).orderBy("i").collect()]


def test_short_names(spark):
    pairs = {
        "com/example/Outer#run().": "run",
        "com/example/Outer#run(+1).": "run",
        "com/example/Outer#field.": "field",
        "com/example/Outer#": "Outer",
        "com/example/Outer#run().(x)": "x",
        "com/example/Outer#`<init>`().": "`<init>`",
        "com/example/Outer#`/`().": "`/`",
        "_empty_/bla$package.": "bla$package",
        "com/example/Foo#bar[T]().": "bar",
        "java/lang/String#substring(II).": "substring",
        "utils.": "utils",
        "java/lang/Object#wait().(millis)": "millis",
        "a/`a.b`.": "b`",
    }
    assert values(spark, S.short_name, *pairs) == list(pairs.values())


def test_owners_and_packages(spark):
    symbols = ["org/apache/FTPClient#", "scala/Byte#`/`().", "Foo#", "_empty_/Foo#", "a/b/c/D#e()."]
    assert values(spark, S.owner_prefix, *symbols) == ["org/apache/", "scala/", None, "_empty_/", "a/b/c/"]
    assert values(spark, S.package_of, *symbols) == ["org.apache", "scala", None, None, "a.b.c"]
    assert values(spark, S.package_owner, "com.example", "", "a") == ["com/example/", "_empty_/", "a/"]


def test_escapes(spark):
    assert values(spark, S.escaped_name, "run", "<init>", "::", "`x y`", "package", "$a_1", "1a", "é") == ["run", "`<init>`", "`::`", "`x y`", "package", "$a_1", "`1a`", "é"]


def test_shapes(spark):
    assert values(spark, S.is_local, "local0", "local2+1", "localDate#", "local") == [True, True, False, False]
    assert values(spark, S.overload_index, "a/B#f().", "a/B#f(+12).", "a/B#", "a/B#f.") == [0, 12, None, None]
    assert values(spark, S.method_base, "a/B#f().", "a/B#f(+12).", "a/B#") == ["a/B#f(", "a/B#f(", ""]
    assert values(spark, S.is_method, "f().", "f(+1).") == [False, True]
    assert values(spark, lambda c: S.is_method(c, documented=True), "f().", "f(+1).", "f.") == [True, True, False]
    assert values(spark, lambda c: S.wrapper_owner(c, F.lit("p/")), "Foo.scala", "package.scala", "build.sbt") == ["p/Foo$package.", "p/package$package.", "p/build."]


def test_docs(spark):
    assert values(spark, text.clean_doc, "/**\n * Adds {@code a} and {@link Foo#bar}.\n *   indented <b>bold</b>\n *\n *\n *\n * see {@link A.B the label}\n */", "/** one */", "plain") == [
        "Adds a and bar.\n  indented bold\n\nsee the label",
        "one",
        "plain",
    ]
    assert values(spark, text.strip_ansi, "\x1b[31mred\x1b[0m x") == ["red x"]


def test_uris_severities_and_hashes(spark):
    assert values(spark, text.normalize_uri, "file:/a/b", "file:///a/b", "jar:file:///x.jar!/p/Q.java", "http://h") == ["file:///a/b", "file:///a/b", "file:///x.jar", "http://h"]
    assert values(spark, text.uri_path, "file:///a%20b/c+d") == ["/a b/c+d"]
    assert values(spark, text.severity, "1", "2", "9", None) == ["Error", "Warning", "Error", "Error"]
    assert values(spark, text.signature_text, "x" * 120, "y" * 121) == ["x" * 120, "y" * 117 + "..."]
    assert values(spark, text.fingerprint, "/c/antlr4-runtime-4.7.2-sources.jar", "/c/src.zip")[0].startswith("antlr4-runtime_4.7.2_")
    frame = spark.createDataFrame([("/c/upickle_3-4.0.0-sources.jar", "com.lihaoyi")], "p string, g string")
    assert frame.select(text.fingerprint("p", "g")).first()[0].startswith("com_lihaoyi/upickle_3_4.0.0_")


def test_options(spark):
    lists = [["-sourceroot", "/a"], ["-sourceroot:/b"], ["-P:semanticdb:sourceroot:/c"], ["-sourceroot", "-x"], ["-sourceroot:/b", "-sourceroot", "/a"], [], ["-sourceroot"]]
    frame = spark.createDataFrame([(i, o) for i, o in enumerate(lists)], "i int, o array<string>")
    got = [r.v for r in frame.select("i", text.option_value("o", "-sourceroot", "-P:semanticdb:sourceroot").alias("v")).orderBy("i").collect()]
    assert got == ["/a", "/b", "/c", None, "/a", None, None]


def test_declarations(spark):
    lines = ["def f(", "  a: Int,", "  b: Int)", "= 1"]
    frame = spark.createDataFrame([(lines,)], "l array<string>")
    assert frame.select(text.declaration("l", F.lit(0))).first()[0] == "def f(\n  a: Int,\n  b: Int)"
    assert frame.select(text.declaration("l", F.lit(3))).first()[0] == "= 1"


def test_default_names(spark):
    rows = defaults.symbols()
    assert len([r for r in rows if r[0] == "scala" and r[2]]) == 22 and len([r for r in rows if r[0] == "java"]) == 41
    assert ("scala", "???", False, "scala/Predef.`???`().") in rows
    assert defaults.table(spark).filter("language = 'java' and name = 'List'").first().symbol == "java/util/List#"


def test_java_comments_keep_their_tags(spark):
    raw = ["/** Adds {@code a}. */", "/**\n * Adds.\n * More <b>text</b>.\n *\n * @param  a  the\n *     first\n * @throws E\n * @return sum\n */", "/**\n * @see X\n */", "/** */"]
    assert values(spark, text.javadoc, *raw) == ["Adds {@code a}.", "Adds.\nMore <b>text</b>.\n\n@param a the\n    first\n@throws E\n@return sum", "@see X", ""]
