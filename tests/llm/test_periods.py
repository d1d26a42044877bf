"""Periodic runs against brute force over all periods and places."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import periods, queries

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, 2 * q):
                found.setdefault((start, length), q)  # the smallest period comes first
    return sorted((a, n, q) for (a, n), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4), st.integers(2, 12), st.data())
def test_runs_equal_brute_force(letters, least, data):
    words = data.draw(st.lists(st.integers(0, letters), max_size=60))
    assert periods.runs_of(words, least) == brute(words, least)


def test_stretches_that_are_not_scanned_hold_no_run():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.randrange(3 + 20 * rng.randrange(2)) for _ in range(rng.randrange(90))]
        if len(words) > 20:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randrange(2, 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert periods.text_runs([b"%d" % w for w in words]) == brute(words)


def test_fibonacci_words_and_one_word_over_and_over():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert periods.runs_of(b) == brute(b)
    assert periods.text_runs([b"x"] * 100_000) == [(0, 100_000, 1)]


def test_words_of_equal_hash_are_told_apart():
    class Blind(periods.Extensions):
        def _same(self, i, j, size):
            return True

    rng = random.Random(2)
    for _ in range(100):
        words = [rng.randrange(2) for _ in range(40)] * 2
        i, j = sorted(rng.sample(range(len(words)), 2))
        right = next((k for k in range(len(words) - j) if words[i + k] != words[j + k]), len(words) - j)
        left = next((k for k in range(i) if words[i - k - 1] != words[j - k - 1]), i)
        assert (Blind(words).right(i, j), Blind(words).left(i, j)) == (right, left)


def expected(doc_id, text, plant=True):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(listed), digest(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_equals_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r[0]: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(found) == len(docs)
    short = [r for r in docs if len((r["text"] or "").split()) < 700]
    assert len(short) > 100 and any(found[r["doc_id"]][1] for r in short)
    assert [found[r["doc_id"]] for r in short] == [expected(*r) for r in short]


def test_nulls_empty_texts_repeats_and_clashing_columns(spark):
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "a b c " * 9), (4, "a b c " * 9), (5, "x y " * 12), (6, "é " * 30), (None, "r s " * 20)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, runs_sha256 string, length long")
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in periods.periodic_runs(docs, plant=True).collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    plain = {tuple(r) for r in periods.periodic_runs(docs).collect()}
    assert plain == {expected(*r, plant=False) for r in rows}
    assert periods.periodic_runs(docs.limit(0), plant=True).collect() == []


def test_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "head " + "a b c d e " * 4 + "tail"), (2, "no run here")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periods.periodic_runs(docs, texts_too=True).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(1, 20, 5)] and rows[1]["collapsed"] == "head a b c d e tail"
    assert rows[2]["runs"] == [] and rows[2]["collapsed"] == "no run here"


@pytest.mark.parametrize("size", [11, 12])
def test_a_run_has_twelve_words(size):
    assert len(periods.text_runs([b"a", b"b"] * 5 + [b"a", b"b"][: size - 10])) == (size == 12)
