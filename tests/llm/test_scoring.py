"""Lattice probabilities against all segmentations, the query against a plain model, and held-out likelihood."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from factloom.llm import queries, scoring

from . import cases

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return scoring.Lattice(PATH)


def segmentations(lattice, word):
    """Every way to cut the marked word into pieces, with its probability and pieces."""
    raw = "▁".encode() + word
    inner = range(len("▁".encode()), len(raw))
    for size in range(len(inner) + 1):
        for cuts in itertools.combinations(inner, size):
            parts = [raw[a:b] for a, b in zip((0, *cuts), (*cuts, len(raw)))]
            pieces = [lattice.number.get(p) for p in parts]
            if None not in pieces:
                yield math.exp(sum(lattice.log[p] for p in pieces)), pieces


@pytest.mark.parametrize("word", ["a", "the", "ththe", "né", "世x", "zq9-", "\U0001f600"])
def test_forward_sums_all_segmentations(lattice, word):
    word = word.encode()
    found = list(segmentations(lattice, word))
    assert len(found) > 0
    total = sum(p for p, _ in found)
    assert lattice.log_marginal(word) == pytest.approx(math.log(total), abs=1e-9)
    wanted, got = np.zeros(lattice.size), np.zeros(lattice.size)
    for p, pieces in found:
        np.add.at(wanted, pieces, p / total)
    lattice.expect(word, got)
    assert np.allclose(got, wanted)


def test_weights_follow_the_existing_scores_and_sum_to_one(lattice):
    assert lattice.prior.sum() == pytest.approx(1)
    assert lattice.prior[lattice.number["▁t".encode()]] > lattice.prior[lattice.number[b"in"]] > lattice.prior[lattice.number["梦".encode()]]


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain(rows, rounds=scoring.ROUNDS):
    """The rows of the query for (doc_id, text), by dictionaries."""
    out_of = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    c, ends = Counter(), 0
    for d, text in rows:
        if not out_of(d):
            c.update(words_of(text))
            ends += 1
    n = sum(c.values())
    total, types = n + ends, len(c) + (ends > 0)
    lattice = scoring.Lattice(PATH)
    for _ in range(rounds if n else 0):
        got = np.zeros(lattice.size)
        for w in c:
            lattice.expect(w, got)
        lattice.weigh((got + scoring.PRIOR * lattice.prior) / (got.sum() + scoring.PRIOR))
    once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    end = (ends + 0.5) / (total + 1)
    for d, text in rows:
        words = words_of(text)
        base = sum(math.log10((x + 0.1) / (total + 0.1 * (types + 1))) for x in [*(c[w] for w in words), ends])
        score = math.log10(end)
        for w in words:
            paths = math.exp(lattice.log_marginal(w))
            score += math.log10((1 - end) * ((max(c[w] - discount, 0) + discount * len(c) * paths) / n if n else paths))
        yield d, out_of(d), len(words) + 1, sum(c[w] > 0 for w in words) + (ends > 0), total, base, score


def same(got, want):
    key = lambda r: tuple(map(str, r[:5])) + (round(r[5], 4),)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("most", [1, 300, scoring.SLICE])
def test_scores_equal_plain_at_any_slice(spark, most):
    rows = [(i, t) for i, t, *_ in cases.rows(n=30) if len(t or "") < 5000]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    same(scoring.score(docs, PATH, most=most).collect(), plain(rows))


def test_no_training_texts_and_no_rows(spark):
    rows = [(d, t) for d, t in zip([d for d in range(200) if scoring.held_out(d)], ["a b", None, "", "ththe ththe"])] + [(None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = scoring.score(docs, PATH).collect()
    same(got, plain(rows))
    assert {r["train_tokens"] for r in got} == {0} and all(math.isfinite(r["score"]) for r in got)
    assert scoring.score(docs.limit(0), PATH).collect() == []


def test_query_scores_held_out_texts_well(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_lm_scores(spark, SF).collect()
    same(got, plain(docs))
    rate = lambda rows, c: sum(r[c] for r in rows) / sum(r["n_tokens"] for r in rows)
    out, learned = [r for r in got if r["held_out"]], [r for r in got if not r["held_out"]]
    assert rate(learned, "score") > rate(learned, "base_score") - 0.2
    untrained = scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), PATH, rounds=0).collect()
    assert rate(out, "score") > rate([r for r in untrained if r["held_out"]], "score") + 0.1
