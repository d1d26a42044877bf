import math
import random

import numpy as np

from pyspark.sql import functions as F

from factloom.llm import neighbours


def brute(data, every, k):
    ok = [(i, v) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            near = sorted((math.dist(v, w), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def table(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))


def test_recall_and_order(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(20)]
    data = [(i, [x + rng.gauss(0, 0.6) for x in rng.choice(centres)]) for i in range(1500)]
    data += [(2000 + i, data[3][1]) for i in range(200)]  # one very common vector
    got = neighbours.nearest(table(spark, data), every=50, block=300).collect()
    want, hits = brute(data, 50, 10), 0
    for q, near in want.items():
        rows = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        vectors = dict(data)
        for _, i, s in rows:
            assert abs(s - math.dist(vectors[q], vectors[i])) < 1e-9
        hits += len({i for _, i, _ in rows} & {i for _, i in near})
    assert hits / (10 * len(want)) >= 0.9


def test_awkward_vectors_and_few_candidates(spark):
    data = [(0, [1.0, 0.0]), (100, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (200, [0.0, 0.0]), (300, None), (0, [1.0, 0.0])]
    got = neighbours.nearest(table(spark, data)).collect()
    rows = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)
    assert [r[:3] for r in rows] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 0), (100, 3, 1), (100, 4, 2)]
    assert neighbours.nearest(table(spark, [])).collect() == []


def test_recall_over_ten_thousand_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((10_000, 48)) + 2.0 * rng.standard_normal((40, 48))[rng.integers(0, 40, 10_000)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in neighbours.nearest(frame, every=250, block=4096).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 10_000, 250):
        gap = ((vectors - vectors[q]) ** 2).sum(1)
        gap[q] = np.inf
        hits += len(found[q] & set(np.argsort(gap)[:10].tolist()))
    assert len(found) == 40 and hits / 400 >= 0.9

