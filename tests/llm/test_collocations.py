"""Phrase counts and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import collocations, oracles, queries

from .. import oracle


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang or "und", tuple(words[i : i + m])] += 1
    return f, n


def plain(rows, least, top):
    f, n = plain_counts(rows)
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        inside = lambda g: any(g[i : i + len(words)] == words for i in range(len(g) - len(words) + 1))
        if any(o == lang and len(g) > len(words) and 100 * b >= 100 * a and inside(g) for (o, g), b in found.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    rows = []
    for lang, found in out.items():
        rows += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(rows)


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "b", "The", "é", "of", "x-y", "and", "'q", "00"]
    line = lambda: " ".join(rng.choice(words[: rng.randrange(2, 10)]) for _ in range(rng.randrange(12))) + rng.choice([".", ",", " \t ", "\n", "; ", "\r\n", ""])
    rows = [(rng.choice(["en", "fr", None]), "".join(line() for _ in range(rng.randrange(9)))) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("de", "..."), ("fr", "a b a b\x1ca b")] + [("en", "the common line of all. ")] * 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_intervals_count_what_breaks_do_not_part(ids):
    ids = np.array(ids, np.int32)
    got = {}
    for m, order, begins, counts in collocations.intervals(ids, 2, 5):
        for start, n in zip(order[begins], counts):
            assert tuple(ids[start : start + m]) not in got
            got[tuple(ids[start : start + m].tolist())] = int(n)
    want = Counter(tuple(ids[i : i + m].tolist()) for m in range(2, 6) for i in range(len(ids) - m + 1) if 0 not in ids[i : i + m])
    assert got == dict(want)


@pytest.mark.parametrize("shard", [1, 50, 1 << 20])
def test_frequent_phrases_equal_plain_counts_at_any_shard(spark, shard):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found, sizes = collocations.frequent_phrases(docs, least=8, shard=shard)
    f, n = plain_counts(rows)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in found.collect()} == {k: a for k, a in f.items() if a >= 8}
    assert dict(map(tuple, sizes.collect())) == {k: v for k, v in n.items() if v}


@pytest.mark.parametrize(("least", "top"), [(6, 2000), (3, 7)])
def test_collocations_equal_plain(spark, least, top):
    rows = corpus(4)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int")
    got = collocations.collocations(docs, least=least, top=top, shard=200)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_query_equals_sql(spark):
    assert not oracle.differences(spark, "/root/testdata/sf0.001", queries.op11_collocations, oracles.OP11_COLLOCATIONS)


def test_products_beyond_64_bits_are_exact(spark, monkeypatch):
    big = 3_000_000_000_000_017
    phrases = spark.createDataFrame([("en", "x", 1, big), ("en", "y", 1, big + 7), ("en", "x y", 2, big - 4)], "lang string, phrase string, size int, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: (phrases, spark.createDataFrame([("en", 9 * big)], "lang string, n long")))
    (row,) = collocations.collocations(None).collect()
    assert row["score"] == 1000 * (big - 4) * 9 * big // (big * (big + 7))
