"""Every document query over tables with clashing columns, awkward rows, and no rows at all."""

import pytest
from pyspark.sql import functions as F

from factloom.llm import queries

from . import cases

NAMES = sorted(n for n in queries.QUERIES if n not in ("op3_quality", "op9_neighbours", "op11_collocations"))  # these return no row a document and have tests of their own
CLASH = ("spans", "base", "ids", "n_tokens", "pack", "shard", "block", "start", "within", "runs", "anchor", "segment", "key", "node", "root", "fingerprint", "size", "target", "passes", "pieces", "row", "word", "found", "tie", "salt", "n")


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(spark, tmp_path, name):
    data = cases.rows(n=12)
    cases.docs(spark, data).withColumns({c: F.lit("clash") for c in CLASH}).write.parquet(f"{tmp_path}/documents.parquet")
    plain = cases.docs(spark, data)
    plain.write.parquet(f"{tmp_path}/plain/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, queries.QUERIES[name](spark, f"{tmp_path}/plain").collect()))
    assert got.count() == len(data)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, tmp_path, name):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
