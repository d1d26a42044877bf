"""Array code against plain code on generated inputs; no Spark here."""

import re

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import licenses, media, pieces, secrets, simhash, tokenfile
from factloom.llm.textarrays import NOT_SPACE, Recent, prefix_sums, runs, slices, span_hashes

TEXT = st.text(alphabet=st.sampled_from("ab'Zst  \n\t.,!0é½ñ-_=/+中\x85"), max_size=60)


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_runs_are_the_words_of_each_text(texts):
    data, offsets = arrays(texts)
    starts, ends, row = runs(data, offsets, NOT_SPACE)
    got = [[] for _ in texts]
    for a, b, r in zip(starts, ends, row):
        got[r].append(data[a:b].tobytes().decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sdtrevml  \n\t.!0é½ñ\x85\xa0"), max_size=60))
def test_pre_tokens_are_those_of_the_pattern(text):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points):
        starts = tokenfile.words(points, np.array([0, len(points)]), tokenfile._classes())
        got = [text[a:b] for a, b in zip(starts, np.append(starts[1:], len(text)))]
        assert got == regex.findall(public_tokenizers.PATTERN, text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.data())
def test_equal_spans_have_equal_hashes(data, pick):
    array = np.frombuffer(data * 2, np.uint8)
    sums = prefix_sums(array)
    a = pick.draw(st.integers(0, len(data)))
    b = pick.draw(st.integers(a, len(data)))
    here, there = (span_hashes(sums, np.array([a + k]), np.array([b + k]))[0] for k in (0, len(data)))
    assert here == there
    if b > a:
        other = array.copy()
        other[a] ^= 1
        assert span_hashes(prefix_sums(other), np.array([a]), np.array([b]))[0] != here


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=140), st.integers(0, 20))
def test_bit_sliced_distances(values, radius):
    array = np.array(values, np.uint64)
    array[len(array) // 2 :] = array[: len(array) - len(array) // 2] ^ np.uint64(0b1011)
    i, j = simhash.close_pairs(array, array, radius)
    want = {(a, b) for a in range(len(array)) for b in range(len(array)) if (int(array[a]) ^ int(array[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_forests_reach_the_smallest_node(n, links):
    links = [(a % n, b % n) for a, b in links]
    label = simhash.forest(n, np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64))
    parent = list(range(n))
    for _ in range(n):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert label.tolist() == parent


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_redaction_and_scan_agree(texts):
    found = secrets.scan_texts(*arrays(texts))
    for t, spans in zip(texts, found):
        assert spans == sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        assert (secrets.redacted(t, spans) == t) == (not spans)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_payloads_restore(data):
    whole = media.payload(data)
    ends = media.cuts(whole)
    parts = [whole[a:b] for a, b in zip([0, *ends], ends)]
    assert b"".join(parts) == whole and len(whole) % 576 == 0 and len(whole) > 0
    assert media.unpack([media.digest(p) for p in parts], [len(p) for p in parts], [media.bz2.compress(p, 1) for p in parts])[: len(data)] == data


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abthe  \n.é中▁0"), max_size=50))
def test_pieces_restore(text):
    model = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    ids = model.encode(*arrays([text]))[0]
    assert model.decode(ids) == text.replace("▁", " ")


def test_license_scores_grow_with_the_cover():
    scanner, words = licenses.Scanner(), licenses.TEMPLATES[0][1].split()
    scores = [scanner.scan(*arrays([" ".join(words[:n])]))[0]["score"] for n in (3, 20, 50, len(words))]
    assert scores == sorted(scores) and scores[-1] == pytest.approx(1)


def test_slices_keep_all_rows_and_long_texts_whole():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c"])], ["text"])
    parts = list(slices([batch, batch.slice(0, 0)], most=20))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(p.num_rows for p in parts) == 2


def test_recent_keys_are_bounded():
    recent = Recent(most=2)
    assert [recent.add(k) for k in (b"a", b"b", b"a", b"c", b"a", b"b")] == [True, True, False, True, False, True]
