"""Symbol strings as column expressions: building, splitting and shape tests.

A symbol is an owner and descriptors: package `a/b/`, type `Name#`, term `Name.`, method
`name().` or `name(+N).`, parameter `<method>(p)`, type parameter `<type>[T]`, local `local<N>`.
Names that are no Java identifiers stand in backticks and may then contain any character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_PACKAGE = "_empty_/"
_OWNER = r"^((?:`[^`]*`|[^`])*/)"
_IDENTIFIER = r"^\p{javaJavaIdentifierStart}\p{javaJavaIdentifierPart}*$"
_DESCRIPTORS = r"^(.*?)(?:[.#]|(?<=.)\([^(]*\)|(?<=.)\[[^\[]*\])*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_java_identifier(name) -> Column:
    return _col(name).rlike(_IDENTIFIER)


def escaped_name(name) -> Column:
    """The name as it stands in a symbol: in backticks unless an identifier or already in them."""
    name = _col(name)
    quoted = (name != "") & name.startswith("`") & name.endswith("`")
    return F.when(quoted | is_java_identifier(name), name).otherwise(F.concat(F.lit("`"), name, F.lit("`")))


def package_owner(dotted) -> Column:
    dotted = _col(dotted)
    return F.when(dotted == "", EMPTY_PACKAGE).otherwise(F.concat(F.replace(F.rtrim(dotted, F.lit(".")), F.lit("."), F.lit("/")), F.lit("/")))


def type_symbol(owner, name) -> Column:
    return F.concat(_col(owner), escaped_name(name), F.lit("#"))


def term_symbol(owner, name) -> Column:
    return F.concat(_col(owner), escaped_name(name), F.lit("."))


def _disambiguator(index) -> Column:
    index = _col(index)
    return F.when(index == 0, "().").otherwise(F.concat(F.lit("(+"), index.cast("string"), F.lit(").")))


def method_symbol(owner, name, index) -> Column:
    return F.concat(_col(owner), escaped_name(name), _disambiguator(index))


def constructor_symbol(owner, index) -> Column:
    return F.concat(_col(owner), F.lit("`<init>`"), _disambiguator(index))


def parameter_symbol(method, name) -> Column:
    return F.concat(_col(method), F.lit("("), escaped_name(name), F.lit(")"))


def type_parameter_symbol(owner_type, name) -> Column:
    return F.concat(_col(owner_type), F.lit("["), escaped_name(name), F.lit("]"))


def local_symbol(index) -> Column:
    return F.concat(F.lit("local"), _col(index).cast("string"))


def owner_prefix(symbol) -> Column:
    """Up to the last slash outside backticks, that included; null without one."""
    found = F.regexp_extract(_col(symbol), _OWNER, 1)
    return F.when(found != "", found)


def package_of(symbol) -> Column:
    """Dotted package; null for the default package and for symbols without an owner."""
    owner = owner_prefix(symbol)
    return F.when(~_col(symbol).startswith(EMPTY_PACKAGE), F.replace(F.regexp_replace(owner, "/$", ""), F.lit("/"), F.lit(".")))


def short_name(symbol) -> Column:
    """The member name alone. Backticks are not looked into when the last `#` or `.` is taken."""
    tail = F.regexp_replace(_col(symbol), _OWNER, "")
    parameter = F.regexp_extract(tail, r"^.*\.\(([^()]*)\)$", 1)
    bare = F.regexp_extract(F.regexp_extract(tail, _DESCRIPTORS, 1), r"[^#.]*$", 0)
    return F.when(tail.rlike(r"^.*\.\([^()]*\)$"), parameter).otherwise(bare)


def is_local(symbol) -> Column:
    return _col(symbol).rlike(r"^local\d+(\+\d+)?$")


def is_full(symbol) -> Column:
    """Compiler-produced: has an owner, or is a local."""
    return _col(symbol).contains("/") | is_local(symbol)


def is_type(symbol) -> Column:
    return _col(symbol).endswith("#")


def is_method(symbol, documented: bool = False) -> Column:
    """A method that may fall back to another overload: indexed ones, or, as documented, all."""
    return _col(symbol).rlike(r"\((\+\d+)?\)\.$" if documented else r"\(\+\d+\)\.$")


def method_base(symbol) -> Column:
    """A method symbol up to its opening bracket, that included: what all overloads share."""
    return F.regexp_extract(_col(symbol), r"^(.*\()(?:\+\d+)?\)\.$", 1)


def overload_index(symbol) -> Column:
    """N of `(+N).`, 0 of `().`; null for other shapes."""
    symbol = _col(symbol)
    return F.when(symbol.rlike(r"\(\)\.$"), 0).when(symbol.rlike(r"\(\+\d+\)\.$"), F.regexp_extract(symbol, r"\(\+(\d+)\)\.$", 1).cast("int"))


def wrapper_owner(file_name, package) -> Column:
    """Owner of a source file's top-level members: `<base>$package.`, or `<base>.` for build files."""
    name = _col(file_name)
    base = F.when(name == "package.scala", "package$package").when(name.endswith(".scala"), F.concat(F.regexp_replace(name, r"\.scala$", ""), F.lit("$package")))
    build = F.when(name.endswith(".sbt"), F.regexp_replace(name, r"\.sbt$", ""))
    return F.concat(_col(package), escaped_name(F.coalesce(base, build)), F.lit("."))
