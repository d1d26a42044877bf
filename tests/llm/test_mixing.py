import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing, queries

from ..oracle import differences
from . import cases


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return target


def brute_sainte_lague(weights, seats):
    won = {k: 0 for k in weights}
    for _ in range(seats):
        best = max(sorted(weights), key=lambda k: weights[k] / (2 * won[k] + 1))
        won[best] += 1
    return won


def plan(spark, docs):
    planned = mixing.plan(docs, block=16, shard_words=2000)
    return planned.withColumn("taken", mixing.taken_words()).collect()


def test_targets_and_limits(spark):
    data = cases.rows()
    got = plan(spark, cases.docs(spark, data).withColumn("size", F.lit(1)))
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size(r[1])) for r in data)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    shards = 12
    for s, n in taken.items():
        assert abs(n - want[s]) <= 16 * shards
    again = plan(spark, cases.docs(spark, list(reversed(data))).repartition(3))
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1, "d": 0}, {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 1}, {k: 7 for k in "abcdefgh"}])
@pytest.mark.parametrize("seats", [0, 1, 7, 100, 999])
def test_apportionment_is_by_highest_quotients(spark, weights, seats):
    parts = spark.createDataFrame([("g", k, w) for k, w in weights.items()], "g string, k string, w long")
    got = mixing.apportion(parts, [F.col("g")], "w", F.lit(seats).cast("long"), [F.col("k")]).collect()
    assert {r.k: r.quota for r in got} == brute_sainte_lague(weights, seats)


def test_applied_mix_has_the_words_of_the_plan(spark):
    docs = cases.docs(spark)
    planned = mixing.plan(docs, block=16, shard_words=2000)
    mixed = mixing.apply_plan(docs, planned)
    assert mixed.columns == docs.columns
    want = planned.agg(F.sum(mixing.taken_words())).first()[0]
    assert sum(size(r.text) for r in mixed.collect()) == want


def test_empty_table(spark):
    assert plan(spark, cases.empty(spark)) == []


@pytest.mark.parametrize("shards,bundle", [(1 << 18, 1024), (1000, 1024), (500, 2)])
def test_query_equals_its_sql(spark, tmp_path, monkeypatch, shards, bundle):
    monkeypatch.setattr(mixing, "BUNDLE", bundle)
    data = [(i, *r[1:]) for i, r in enumerate(cases.rows())]
    cases.docs(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    sql = queries.ORACLE_SQL["op2_mixing"].replace("262144", str(shards)).replace("shard // 1024", f"shard // {bundle}")
    query = lambda spark, sf_dir: mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), shard_words=shards).select("doc_id", "size", "source_size", "target", mixing.taken_words().alias("taken"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(sql).fetchall())
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in query(spark, str(tmp_path)).collect()) == want


def test_query_equals_its_sql_on_the_tables(spark):
    assert differences(spark, "/root/testdata/sf0.001", queries.QUERIES["op2_mixing"], queries.ORACLE_SQL["op2_mixing"]) == ""


def test_bundles_share_their_quota_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUNDLE", 2)
    data = cases.rows()
    got = mixing.plan(cases.docs(spark, data), shard_words=500).withColumn("taken", mixing.taken_words()).collect()
    taken, target, shards = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        shards[r.source] = -(-r.source_size // 500)
    assert all(abs(taken[s] - target[s]) <= 16 * shards[s] + 16 for s in target)


WORDLESS = {
    "one source without words": [(1, "one two three", "en", "a", 0), (2, None, "en", "b", 0), (3, " ", "en", "b", 0), (4, "", "en", None, 0)],
    "a table without words": [(1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, None, "en", None, 0)],
    "many rows, few words": [(i, "word" if i % 50 == 0 else None, "en", "a" if i % 3 else "b", 0) for i in range(600)],
    "one id, many texts": [(7, f"word {i} and more", "en", "a", 0) for i in range(300)],
}


@pytest.mark.parametrize("name", WORDLESS)
def test_sources_without_words_take_nothing(spark, tmp_path, name):
    cases.docs(spark, WORDLESS[name]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = queries.ORACLE_SQL["op2_mixing"].replace("65536", "100")
    want = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(sql).fetchall())
    planned = mixing.plan(docs, shard_rows=100)
    got = planned.withColumn("taken", mixing.taken_words()).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.apply_plan(docs, planned).count() >= 0
