"""Signatures and comments of declarations, for display beside a name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import lookup
from . import java, scala
from .lexer import Tokens

#: Lines that may stand between the end of a comment and the declaration that it documents.
NEAR = 2

DECLARATIONS = f"symbol string, {schemas.RANGE}, path string, signature string"
COMMENTS = "path string, end_line bigint, comment string"


def signature(t: Tokens, index: int, brace_free: bool) -> str:
    """The declaration around the name at token `index`: from its line's start up to its body, in one line."""
    begin = index
    while begin > 0 and not t.tokens[begin].first and t.text(begin - 1) not in ("{", "}", ";"):
        begin -= 1
    while t.text(begin) == "@" and begin < index:
        begin += 2
        begin = t.after(begin) if t.text(begin) == "(" else begin
    end, column = index + 1, t.tokens[begin].char
    while end < len(t):
        token = t.tokens[end]
        if token.text in ("{", ";", "=", "}", ")") or (brace_free and token.first and token.char <= column):
            break
        if brace_free and token.text in (":", "with") and end + 1 < len(t) and t.tokens[end + 1].first:
            break
        end = t.after(end)
    out, last = [], None
    for token in t.tokens[begin : min(end, len(t))]:
        if last is not None and (token.line != last.end_line or token.char > last.end_char):
            out.append(" ")
        out.append(token.text)
        last = token
    return "".join(out)


def declarations_of(path: str, content: str) -> list[tuple]:
    """(symbol, range, path, signature) of each definition with a place of its own in the text."""
    is_java = path.endswith(".java")
    found = java.definitions(content) if is_java else scala.definitions(content, path.rpartition("/")[2])
    t = Tokens(content, java=is_java)
    index = {(x.line, x.char): k for k, x in enumerate(t.tokens)}
    return [(symbol, *at, path, signature(t, index[at[:2]], not is_java)) for symbol, _, _, at in found.rows if at != (0, 0, 0, 0) or t.tokens and t.tokens[0].range == at]


def declarations(sources: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in DECLARATIONS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                if content is not None:
                    rows += declarations_of(path, content)
            yield pd.DataFrame(rows, columns=names)

    return sources.select("path", "content").mapInPandas(run, DECLARATIONS)


def comments(sources: DataFrame) -> DataFrame:
    """Documentation comments with the line on which they end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                tokens = Tokens(content or "", java=path.endswith(".java"))
                rows += [(path, c.end_line, c.text) for c in tokens.comments if c.text.startswith("/**")]
            yield pd.DataFrame(rows, columns=["path", "end_line", "comment"])

    return sources.select("path", "content").mapInPandas(run, COMMENTS)


def hovers(wanted: DataFrame, declared: DataFrame, commented: DataFrame, strict: bool = False) -> DataFrame:
    """query_id, symbol, markdown, path, start_line: of each query's symbols, in order, the first that is declared.

    wanted: query_id, ord, symbol. A declaration's comment is the nearest that ends at most NEAR
    lines above it; strict: and no other declaration stands between.
    """
    places = declared.withColumn("line", F.col("start_line").cast("bigint"))
    near = lookup.bounded_asof(places.select("path", "symbol", "line"), commented, ["path"], "line", "end_line", NEAR, "comment")
    if strict:
        ends = commented.select("path", F.col("end_line").alias("_end"), "comment")
        before = Window.partitionBy("path").orderBy("line")
        lines = places.select("path", "line").distinct().withColumn("_last", F.lag("line").over(before))
        both = near.join(lines, ["path", "line"]).join(ends, ["path", "comment"], "left")
        between = F.coalesce(F.col("_last") >= F.col("_end"), F.lit(False)) & (F.col("_last") < F.col("line"))
        near = both.withColumn("comment", F.when(~between, F.col("comment"))).select("path", "symbol", "line", "comment").distinct()
    full = places.join(near.select("path", "symbol", F.col("line"), "comment"), ["path", "symbol", "line"], "left")
    comment = F.coalesce("comment", F.lit(""))
    text = X.markdown(X.signature_text("signature"), F.when(F.col("path").endswith(".java"), X.javadoc(comment)).otherwise(X.clean_doc(comment)))
    hits = wanted.join(full, "symbol").withColumn("markdown", text)
    best = hits.groupBy("query_id").agg(F.min(F.struct("ord", "path", "start_line", "symbol", "markdown")).alias("m"))
    return best.select("query_id", "m.symbol", "m.markdown", "m.path", "m.start_line")
