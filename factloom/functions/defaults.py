"""Names that are visible without an import. Fixed values; each maps to its symbol by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Package of each default name, by shape.
SCALA_TYPES = {
    "scala/collection/immutable/": "List Map Set Seq Vector",
    "scala/": "Option Some Either Left Right Int Long Double Float Byte Short Char Boolean Unit Array",
    "java/lang/": "String Object",
}
SCALA_TERMS = {"scala/collection/immutable/": "List Map Set Seq Vector Nil", "scala/": "None Console Predef"}
SCALA_METHODS = {"scala/Predef.": "println print identity assert require ???"}
JAVA_TYPES = {
    "java/lang/": "String Object Integer Long Double Float Boolean Byte Short Character Void Number Class ClassLoader Thread Math System Throwable Exception "
    "RuntimeException Error StringBuilder StringBuffer Iterable Runnable Comparable Appendable CharSequence Override Deprecated SuppressWarnings FunctionalInterface",
    "java/util/": "List Map Set Collection ArrayList HashMap HashSet Iterator Optional",
}


def _rows(names: dict[str, str], language: str, is_type: bool, suffix: str):
    for owner, words in names.items():
        for w in words.split():
            yield language, w, is_type, owner + (w if w.isidentifier() else f"`{w}`") + suffix


def symbols() -> list[tuple[str, str, bool, str]]:
    """(language, name, is_type, symbol)"""
    return [
        *_rows(SCALA_TYPES, "scala", True, "#"),
        *_rows(SCALA_TERMS, "scala", False, "."),
        *_rows(SCALA_METHODS, "scala", False, "()."),
        *_rows(JAVA_TYPES, "java", True, "#"),
    ]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(symbols(), "language string, name string, is_type boolean, symbol string")
