"""Compiler-produced symbol facts: a small reader of the public SemanticDB wire format.

Field numbers are those of the published specification: TextDocuments.documents 1; TextDocument
uri 2, occurrences 6; SymbolOccurrence range 1, symbol 2, role 3; Range start_line 1,
start_character 2, end_line 3, end_character 4; roles REFERENCE 1, DEFINITION 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import symbols as S
from ..operators.merge import complete

ROLES = {1: "REFERENCE", 2: "DEFINITION"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field ends beyond its message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def decode(data: bytes) -> list[tuple[int, str, int, str, str, int, int, int, int]]:
    """(doc_idx, uri, occ_idx, symbol, role, range) of every occurrence in a file."""
    out = []
    for doc, document in enumerate(v for f, v in _fields(data) if f == 1):
        uri, occurrences = "", []
        for f, v in _fields(document):
            if f == 2:
                uri = v.decode()
            elif f == 6:
                occurrences.append(v)
        for k, o in enumerate(occurrences):
            symbol, role, at = "", 0, [0, 0, 0, 0]
            for f, v in _fields(o):
                if f == 1:
                    for g, n in _fields(v):
                        if 1 <= g <= 4:
                            at[g - 1] = n
                elif f == 2:
                    symbol = v.decode()
                elif f == 3:
                    role = v
            out.append((doc, uri, k, symbol, ROLES.get(role, "UNKNOWN"), *at))
    return out


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The facts of all facts files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.semanticdb").load(root)
    return read(files.select("path", "content"))


def uris(facts: DataFrame) -> DataFrame:
    """facts_path, uri: what the first document of each file speaks of."""
    return facts.filter("doc_idx = 0").select("facts_path", "uri").distinct()


def read(files: DataFrame) -> DataFrame:
    """Facts of files (path, content as bytes); damaged files give none."""
    names = [c.split()[0] for c in schemas.FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, *r) for r in decode(bytes(content))]
                except (ValueError, IndexError, TypeError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schemas.FACTS)


def definitions(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Definitions of all documents; pairs (facts_path, path) say which source a file speaks of."""
    rows = facts.filter("role = 'DEFINITION' and symbol <> ''").filter(~S.is_local("symbol")).join(pairs, "facts_path")
    return rows.select("symbol", S.short_name("symbol").alias("short_name"), S.is_type("symbol").alias("is_type"), *schemas.RANGE_COLUMNS, "path")


def occurrences(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """References of each file's first document; an unresolved one has a null symbol."""
    rows = facts.filter("role = 'REFERENCE' and doc_idx = 0").join(pairs, "facts_path")
    return rows.select("path", F.nullif("symbol", F.lit("")).alias("symbol"), *schemas.RANGE_COLUMNS)


def locals_of(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = facts.filter("role = 'DEFINITION' and doc_idx = 0").filter(S.is_local("symbol")).join(pairs, "facts_path")
    return rows.select("path", "symbol", F.col("symbol").alias("short_name"), F.lit(False).alias("is_type"), *schemas.RANGE_COLUMNS)


def completeness(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """path, complete: whether all references of the first document are full symbols; without any they are."""
    rows = facts.filter("role = 'REFERENCE' and doc_idx = 0").join(pairs, "facts_path")
    known = complete(rows, ["path"], S.is_full("symbol"))
    return pairs.select("path").distinct().join(known, "path", "left").select("path", F.coalesce("complete", F.lit(True)).alias("complete"))
