import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from factloom.llm import simhash

from . import cases


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints):
    """index -> smallest index reachable over links of at most 3 bits."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def brute_groups(texts, shingle=5, similarity=0.8, words=4, keys=6):
    """index -> smallest index reachable, over all pairs that share a least hash and are near enough."""
    sketch = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        prints, least = simhash.sketches_of(raw, np.array([0, len(raw)]), shingle, words, keys)
        sketch.append((int.from_bytes(prints[0].tobytes(), "little"), least[0].tolist()))
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    radius = simhash.radius_of(similarity, 64 * words)
    for i in range(len(texts)):
        for j in range(i):
            if (sketch[i][0] ^ sketch[j][0]).bit_count() <= radius and any(a == b for a, b in zip(sketch[i][1], sketch[j][1])):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_similar_texts_are_grouped_and_others_stay(spark):
    rng = random.Random(17)
    texts, pairs = [], []
    shared = cases.prose(rng, 60)
    for _ in range(60):
        base = cases.prose(rng, rng.randint(80, 300)).split()
        near = list(base)
        for k in rng.sample(range(len(near)), max(1, len(near) // 150)):
            near[k] = "changed"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(near)]
    texts += [shared + " " + cases.prose(rng, 150) for _ in range(40)]  # one passage in many documents
    docs = cases.docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    near = [p for p in pairs if jaccard(texts[p[0]], texts[p[1]]) >= 0.8]
    assert len(near) > 50 and sum(b not in kept for _, b in near) >= 0.95 * len(near)
    assert all(a in kept for a, _ in pairs) and set(range(120, 160)) <= kept


def test_wide_fingerprints_and_larger_radii():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    values = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, (40, 4), dtype=np.uint64)), base ^ rng.integers(0, 1 << 14, (40, 4), dtype=np.uint64)])
    whole = [int.from_bytes(v.tobytes(), "little") for v in values]
    for radius in (0, 4, 5, 30, 48, 100):
        i, j = simhash.close_pairs(values[:70], values, radius)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(70) for b in range(120) if (whole[a] ^ whole[b]).bit_count() <= radius}


def test_close_pairs_is_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 150), dtype=np.uint64)
    values = np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1] ^ flips[2]])
    for radius in (0, 1, 2, 3):
        i, j = simhash.close_pairs(values[:200], values, radius)
        found = set(zip(i.tolist(), j.tolist()))
        assert found == {(a, b) for a in range(200) for b in range(450) if (int(values[a]) ^ int(values[b])).bit_count() <= radius}


def test_query_equals_brute_force(spark):
    data = cases.rows()
    got = simhash.near_duplicates(cases.docs(spark, data).withColumn("fingerprint", cases_lit()), ).collect()
    prints = [brute_fingerprint(r[1]) for r in data]
    roots = brute_components(prints)
    least = {}
    for r, root in zip(data, roots):
        least[root] = min(least.get(root, 1 << 60), 1 << 60 if r[0] is None else r[0])
    want = sorted((str(r[0]), f"{p:016x}", least[root] if least[root] < 1 << 60 else None) for r, p, root in zip(data, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def cases_lit():
    from pyspark.sql import functions as F

    return F.lit("a column of a clashing name")


def test_chains_and_hot_keys_join_up(spark, monkeypatch):
    rng = random.Random(3)
    value, chain = rng.getrandbits(64), []
    for _ in range(400):  # each is two bits from the one before
        value ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        chain.append(value)
    far = [rng.getrandbits(64) for _ in range(50)]
    values = list(dict.fromkeys(chain + far))
    monkeypatch.setattr(simhash, "CELL", 16)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fingerprint long")
    found = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    roots = brute_components(values)
    groups = {}
    for (s,), root in zip(signed, roots):
        groups.setdefault(root, []).append(s)
    for members in groups.values():
        for s in members:
            assert found.get(s, s) == min(members)


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []


def test_repeats_of_a_line_do_not_make_texts_alike_or_unlike(spark):
    rng = random.Random(23)
    line = cases.prose(rng, 20)
    apart = [cases.prose(rng, 200) + (" " + line) * rng.choice([20, 50]) for _ in range(60)]
    body = cases.prose(rng, 200)
    alike = [body + (" " + line) * n for n in (2, 50)]
    assert jaccard(*alike) == 1 and jaccard(*apart[:2]) < 0.1
    docs = cases.docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(apart + alike)])
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(range(61))


def test_large_groups_are_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 2)
    rng = random.Random(29)
    base = cases.prose(rng, 300)
    texts = [base + f" end{i}" for i in range(40)] + [" ".join(base.split()[:200]) + " " + cases.prose(rng, 100) for _ in range(10)]
    docs = cases.docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {0, *range(40, 50)}


def test_linked_rows_leave_the_components_of_all_links():
    rng = np.random.default_rng(8)
    bases = [rng.choice(1 << 40, 60, replace=False).astype(np.uint64) for _ in range(4)]
    sets = []
    for k in range(150):
        own = bases[k % 4].copy()
        at = rng.choice(60, rng.integers(0, 16), replace=False)
        own[at] = rng.integers(1 << 41, 1 << 42, len(at))
        sets.append(np.unique(own))
    prints, least = np.zeros((150, 4), np.uint64), np.stack([[s[0] for s in sets], [s[-1] for s in sets]], axis=1)
    for n in (50, 150):
        got = simhash.linked_rows(sets[:n], prints[:n], least[:n], 10, 0.8)
        want = []
        for i in range(n):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if (least[i] == least[j]).any() and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                    want.append((i, j))
        assert set(map(frozenset, got)) <= set(map(frozenset, want)) and len(got) < n
        a, b = (simhash.forest(n, *np.array(x).T) for x in (got, want))
        assert (a == b).all() and 4 < len(set(a.tolist())) < n


def test_the_border_of_the_similarity_is_sharp(spark):
    rng = random.Random(37)
    texts, alike = [], []
    while len(texts) < 400:
        shared, own = cases.prose(rng, 300), rng.randint(25, 45)
        pair = [shared + " " + cases.prose(rng, own) for _ in range(2)]
        value = jaccard(*pair)
        if 0.74 <= value < 0.84:
            texts += pair
            alike.append(value >= 0.8)
    assert 50 < sum(alike) < 150
    docs = cases.docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert all(i in kept for i in range(0, 400, 2))
    assert [2 * k + 1 in kept for k in range(200)] == [not a for a in alike]


def test_links_of_wide_fingerprints_need_a_common_key():
    columns = {"key": [1, 1, 2, 2, 3], "node": [10, 11, 12, 13, 14], "fingerprint": [5] * 5, "f1": [6] * 5}
    batch = pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in columns.items()})
    found = [r for b in simhash._compare_sorted(10, 2, same_key=True)(iter([batch])) for r in b.to_pylist()]
    assert {frozenset(r.values()) for r in found} == {frozenset({10, 11}), frozenset({12, 13})}
