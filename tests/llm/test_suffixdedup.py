import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import suffixdedup as S

from . import cases


def brute(texts, width):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for i, r in enumerate(raw):
        for k in range(len(r) - width + 1):
            seen[r[k : k + width]].append((i, k))
    gone = [np.zeros(len(r), bool) for r in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + width] = True
    out = []
    for r, g in zip(raw, gone):
        kept = np.frombuffer(r, np.uint8)[~g].tobytes() if r else b""
        out.append((len(r), int(g.sum()), len(S.spans_of(g)) if len(g) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, passage=240, words=50):
    """(n_passages, n_passage_words) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(set)
    for i, r in enumerate(raw):
        for k in range(len(r) - passage + 1):
            seen[r[k : k + passage]].add(i)
    copies = Counter(raw)
    out = []
    for i, r in enumerate(raw):
        inside = np.zeros(len(r), bool)
        for k in range(len(r) - passage + 1):
            if len(seen[r[k : k + passage]]) > 1:
                inside[k : k + passage] = True
        if copies[r] > 1:
            inside[:] = True
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)]
        found = [sum(a <= x and y <= b for x, y in spans) for a, b in S.spans_of(inside)] if len(r) else []
        found = [n for n in found if n > words]
        out.append((len(found), sum(found)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage, line = cases.prose(rng, 120), cases.prose(rng, 70)
    texts = [r[1] for r in cases.rows(seed)]
    long = cases.prose(rng, 400)
    texts += [long, long[:500] + "X" + long[501:], long[300:], "y" * 1500, "ab" * 700, "", None]
    texts += [cases.prose(rng, rng.randint(0, 60)) + passage + cases.prose(rng, rng.randint(0, 60)) for _ in range(12)]
    short = cases.prose(rng, 51)  # a passage too short for the width of removal
    texts += [cases.prose(rng, rng.randint(1, 9)) + " " + short + " " + cases.prose(rng, rng.randint(1, 9)) for _ in range(3)]
    texts += ["line after line of this text " * 30, cases.prose(rng, 51), short[:260], "ab" * 9000 + "c"]
    texts += [rng.choice("éab") + line[: rng.randint(200, len(line))] + rng.choice("xyzé") * rng.randint(0, 3) for _ in range(40)]
    return texts


@pytest.mark.parametrize("hot", [3, 4096])
def test_documents_equal_brute_force(spark, hot):
    texts = corpus(21)
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[5], "en", "s", 0)]
    docs = cases.docs(spark, data).withColumn("runs", F.lit(1)).withColumn("body", F.lit("clash"))
    got = S.deduplicate(docs, hot=hot, bucket=1 << 14, kept=True).collect()
    texts = [d[1] for d in data]
    want = sorted((str(d[0]), *b, *p) for d, b, p in zip(data, brute(texts, 400), brute_passages(texts)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages, r.n_passage_words) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_merged_transforms_find_every_repeated_window(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(4)]
    segments = [("".join(rng.choice(pool) for _ in range(3)) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))).encode() for _ in range(40)]
    windows = [rng.randint(1, len(s) - 40 + 1) for s in segments]
    owners = np.array([sorted((rng.randrange(12), rng.randrange(12))) if rng.random() < 0.2 else (t := rng.randrange(12), t) for _ in segments])
    count, texts = defaultdict(int), defaultdict(set)
    for s, w, o in zip(segments, windows, owners.tolist()):
        for k in range(w):
            count[s[k : k + 40]] += 1
            texts[s[k : k + 24]] |= set(o)
    for shard in (60, 700, 1 << 20):
        found = S.repeated_windows(segments, windows, (40, 24), 8, shard, owners)
        assert [m.tolist() for m in found[0]] == [[count[s[k : k + 40]] > 1 for k in range(w)] for s, w in zip(segments, windows)]
        assert [m.tolist() for m in found[1]] == [[len(texts[s[k : k + 24]]) > 1 for k in range(w)] for s, w in zip(segments, windows)]


def test_only_stretches_of_repeated_symbols_are_transformed(monkeypatch):
    rng = random.Random(5)
    word = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    passage = word(90)
    segments = [word(500) + passage + word(500), word(300) + passage, word(900)]
    windows, sizes = [len(s) - 39 for s in segments], []
    build = S.build
    monkeypatch.setattr(S, "build", lambda symbols, depth: sizes.append(len(symbols)) or build(symbols, depth))
    owners = np.array([[1, 1], [2, 2], [3, 4]])  # the last segment stands in two texts
    found = S.repeated_windows(segments, windows, (40, 24), 8, 1 << 20, owners)
    assert [np.flatnonzero(m).tolist() for m in found[0]] == [[*range(500, 551)], [*range(300, 351)], []]
    assert [np.flatnonzero(m).tolist() for m in found[1]] == [[*range(500, 551)], [*range(300, 351)], [*range(861)]]
    assert sum(sizes) < 300


def test_merge_equals_a_sort_and_gives_common_prefixes():
    rng = random.Random(1)
    strings = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(30)]
    depth = 4
    closed = lambda part: np.array([x for s in part for x in [*s, -1]])
    merged, shared = S.merge(S.build(closed(strings[:11]), depth), S.build(closed(strings[11:]), depth), depth)
    whole = closed(strings)
    cut = []
    for at in merged.origin:
        end = at + int(np.argmax(whole[at:] < 0))
        cut.append((*whole[at:end].tolist(), -1000 + int((whole[:end] < 0).sum()))[:depth])
    order = [tuple(x if x >= 0 else x for x in c) for c in cut]
    assert order == sorted(order)
    for k in range(1, len(order)):
        same = next((i for i in range(min(len(order[k]), len(order[k - 1]))) if order[k][i] != order[k - 1][i]), depth)
        assert shared[k] == same
    assert all(merged.last[k] == (whole[at - 1] if at else -1) for k, at in enumerate(merged.origin))


def test_leftmost_least_of_every_window():
    rng = np.random.default_rng(2)
    value = rng.integers(0, 20, 300).astype(np.uint64)
    for span in (1, 2, 3, 7, 8, 273):
        want = [k + int(np.argmin(value[k : k + span])) for k in range(300 - span + 1)]
        assert S.sliding_least(value, span).tolist() == want


def test_empty_table(spark):
    assert S.deduplicate(cases.empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_equal_windows_have_one_anchor(seed):
    rng = random.Random(seed)
    raw = [("".join(rng.choice("ab ") for _ in range(50)) * rng.randint(1, 6)).encode() for _ in range(8)] + [b"xy" * 300, b"", b"short"]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    row, first, count, anchor, inner = S.leading(data, offsets, 30, 7, most=40)
    held, places = defaultdict(set), defaultdict(set)
    for r, f, n, a, again in zip(row.tolist(), first.tolist(), count.tolist(), anchor.tolist(), inner.tolist()):
        own = [raw[r][k : k + 30] for k in range(f, f + n)]
        assert n <= 40 and (again or len(set(own)) == n)
        for k, w in zip(range(f, f + n), own):
            held[w].add(a)
            places[r].add(k)
    assert all(len(v) == 1 for v in held.values())
    assert all(places[i] == set(range(max(0, len(r) - 29))) for i, r in enumerate(raw))


def test_words_that_lie_whole_in_a_range():
    rng = random.Random(4)
    for _ in range(300):
        body = "".join(rng.choice("ab \té") for _ in range(rng.randint(0, 20))).encode()
        a, b = sorted((rng.randint(0, len(body)), rng.randint(0, len(body))))
        want = sum(a <= m.start() and m.end() <= b for m in re.finditer(rb"[^\x20\x09-\x0D]+", body))
        assert S.whole_words(body, a, b) == want, (body, a, b)


def test_a_crowded_passage_is_one_run_of_each_text(spark):
    """Windows of anchors that take the exact path stay runs: rows do not grow with what a group's windows number."""
    passage = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(900))
    docs = spark.createDataFrame([(k, f"{k} begins {passage} and {k} ends") for k in range(4)], "doc_id long, text string")
    runs = [r.runs for r in S.repeated_runs(docs, hot=0).collect()]
    assert len(runs) == 4
    for part in (0, 1):
        own = [sorted((x["from"], x["to"]) for x in r if x["part"] == part) for r in runs]
        assert all(S.united(r) == [(1, 1 + len(" begins ") + len(passage) + len(" and "))] for r in own)
    assert max(len(r) for r in runs) < 200  # a run for each window would be over 1,000
