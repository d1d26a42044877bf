import random

import pytest

from factloom.sources import index


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rng = random.Random(2)
    symbols = sorted({f"{rng.choice(['a', 'b', 'p/q', 'é', 'z'])}/{rng.choice(['Box', 'Cup', 'Ünder'])}{rng.randrange(300)}{rng.choice(['#', '.', '#run().', '#run(+1).'])}" for _ in range(1500)}) + ["local3", "local3+1"]
    rows = [(s, s[-3:], s.endswith("#"), 1, 2, 3, 4, f"{k % 7}.scala") for k, s in enumerate(symbols)]
    rows += [(*rows[5][:-1], "twice.scala")]
    definitions = spark.createDataFrame(rows, "symbol string, short_name string, is_type boolean, start_line int, start_char int, end_line int, end_char int, path string").repartition(5)
    index.store(definitions, path, 12)
    return index.Index(spark, path), rows


def test_lookup_reads_only_files_that_can_answer(spark, stored):
    held, rows = stored
    asked = spark.createDataFrame([(1, rows[5][0]), (2, rows[900][0]), (3, "none"), (4, None), (5, "local3")], "query_id long, symbol string")
    got = sorted((r.query_id, r.symbol, r.path) for r in held.lookup(asked).collect())
    assert got == sorted([(1, rows[5][0], rows[5][-1]), (1, rows[5][0], "twice.scala"), (2, rows[900][0], rows[900][-1])])
    read = held.files_read(asked)
    assert len(held.files) >= 8 and 1 <= len(read) <= 4 and set(read) < set(held.files)
    assert held.files_read(asked.limit(0)) == [] and held.lookup(asked.filter("query_id = 4")).count() == 0


@pytest.mark.parametrize("most", [3, 32])
def test_prefix_scans_equal_sorting(spark, stored, most):
    held, rows = stored
    prefixes = ["a/Box1", "p/q/", "", "é/Ü", "zz", rows[0][0], None, "b/Cup29", "loc"]
    asked = spark.createDataFrame(list(enumerate(prefixes)), "query_id long, prefix string")
    got = sorted((r.query_id, r.rank, r.symbol) for r in held.prefix_scans(asked, most).collect())
    symbols = sorted({r[0] for r in rows if not r[0].startswith("local")}, key=str.encode)
    want = [(k, n + 1, s) for k, p in enumerate(prefixes) if p is not None for n, s in enumerate([s for s in symbols if s.startswith(p)][:most])]
    assert got == sorted(want)
    assert len(held.files_read(asked.filter("query_id = 7"), prefix=True)) <= 2
