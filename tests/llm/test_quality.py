import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality

from . import cases


def corpus(spark, n=400):
    rng = random.Random(11)
    data, labels = [], []
    for i in range(n):
        text, good = cases.prose(rng, rng.randint(5, 80)), i % 6 != 0
        if not good:
            text = " ".join(w + rng.choice(["***", "###", "%%%"]) for w in text.split())
        data.append((i, text, "en", "s", len(text)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(good), 0))
    return data, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    data, labels = corpus(spark)
    got = {r.doc_id: r for r in quality.resample(cases.docs(spark, data), labels.withColumn("text", F.lit("x"))).collect()}
    unseen = [i for i in range(400) if i % 2 and i % 5]
    right = [got[i].kept == (i % 6 != 0) for i in unseen]
    assert np.mean(right) > 0.97
    again = {r.doc_id: r for r in quality.resample(cases.docs(spark, data[::-1]), labels).collect()}
    assert again == got


def test_ratios_equal_a_plain_count(spark):
    data, labels = corpus(spark, 80)
    ratios, _ = quality.fit(cases.docs(spark, data), labels, buckets=64)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = np.zeros(64), np.zeros(64)
    for i, text, *_ in data:
        bucket, _ = quality.ngrams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), 64)
        for b in bucket:
            raw[b] += 1
            target[b] += i in good
    want = np.log((target + 2) / (raw * target.sum() / raw.sum() + 2))
    assert ratios == pytest.approx(want)


def test_kth_largest(spark):
    rng = random.Random(2)
    keys = [rng.randrange(-(10**15), 10**7) for _ in range(300)] + [5] * 10
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 17, 150, 310):
        assert quality.kth_largest(frame, k) == sorted(keys, reverse=True)[k - 1]


def test_awkward_rows_and_missing_labels(spark):
    docs = cases.docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, none).filter("kept").count() == docs.count()
    some = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1)], none.schema)
    assert quality.resample(docs, some).count() == docs.count()
    assert quality.resample(cases.empty(spark), some).collect() == []


def test_kept_rows_equal_a_brute_force_draw(spark):
    data, labels = corpus(spark)
    docs = cases.docs(spark, data + [data[3], data[3], (None, "no id", "en", "s", 0), (900, None, "en", "s", 0)])
    for size in (None, 100):
        got = quality.resample(docs, labels, size=size, seed=5).collect()
        ratios, cut = quality.fit(docs, labels, seed=5)
        want = []
        for r in docs.collect():
            raw = np.frombuffer((r.text or "").encode(), np.uint8)
            bucket, _ = quality.ngrams(raw, np.array([0, len(raw)]))
            want.append((str(r.doc_id), len(bucket), float(ratios[bucket].sum() / (len(bucket) + quality.SHORT))))
        near = sorted((str(r.doc_id), r.n_grams, pytest.approx(r.log_ratio)) for r in got)
        assert sorted(want) == near
        assert all(r.log_weight == pytest.approx(quality.SCALE * r.log_ratio) for r in got)
        k = sum(np.floor(r.log_ratio * quality.SCALE * quality.BINS) >= cut for r in got) if size is None else size
        least = sorted((r.key for r in got), reverse=True)[k - 1]
        assert all(r.kept == (r.key >= least) for r in got)


def test_the_draw_follows_seed_and_ratio(spark):
    data, labels = corpus(spark)
    docs = cases.docs(spark, data)
    drawn = [{r.doc_id: r.kept for r in quality.resample(docs, labels, size=150, seed=s).select("doc_id", "kept").collect()} for s in range(6)]
    assert all(sum(d.values()) == 150 for d in drawn)
    assert all(a != b for i, a in enumerate(drawn) for b in drawn[:i])
    # the noise itself: equal weights are drawn equally often, greater ones more often
    rows = [(i, (i % 4) * 0.1, 10) for i in range(4000)]
    scored = spark.createDataFrame(rows, "doc_id long, log_ratio double, n_grams long")
    keys = {r.doc_id: r.key for r in quality._weighted(scored, 1).collect()}
    top = sorted(keys, key=keys.get, reverse=True)[:400]
    shares = np.bincount([i % 4 for i in top], minlength=4) / 400
    weights = np.exp(np.arange(4) * 0.1 * quality.SCALE)
    assert shares == pytest.approx(weights / weights.sum(), abs=0.08) and (np.diff(shares) > 0).all()


def test_a_labelled_id_on_many_rows_is_fitted_once(spark):
    data, labels = corpus(spark, 60)
    docs = cases.docs(spark, data + [data[1]] * 3000)
    assert quality._labelled(docs, labels, 20_000, 42).count() == labels.select("doc_id").distinct().count()
    assert quality.resample(docs, labels).count() == 3060


def test_best_cut():
    assert quality.best_cut({5: 10, 6: 3}, {1: 4, 2: 9}) == 3
    assert quality.best_cut({1: 5}, {1: 1}) == 1
    assert quality.best_cut({3: 1}, {3: 9}) == 4
