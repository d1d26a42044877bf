"""SimHash near-duplicates: fingerprints, bit-sliced comparison and components.

Fingerprints that may link share two of five bit blocks (radius 3), so ten keyed tables of the
distinct fingerprints hold every link. Within a table, sorted tiles are compared bit-sliced:
bit planes stand vertically, one 64-bit word holds a bit of 64 fingerprints, and carry-save
counters add up many distances at once; rows and words whose distances all exceed the radius
are abandoned. Links become components by large-star and small-star rounds on checkpoints.

`near_duplicates` links 64-bit fingerprints of three-word shingles within three bits. `keep_one`
takes five words and a similarity of 0.8: wider fingerprints, in which each distinct shingle votes
once, find candidates among texts that share a least hash; a candidate is a link if the texts' sets
of shingles have that similarity.

Defined results: null and empty texts have fingerprint zero and link like any other; identical
texts share a fingerprint; a null doc_id never names a component unless no other id is there;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, shared_folder
from .textarrays import LOWER, NOT_SPACE, mix, runs, set_aside, slices, texts

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TILE = 1024
#: Rows of one key that a task compares with one another; larger keys are dealt as pairs of cells.
CELL = 4096


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, and the row it is in; fewer words than a shingle are one."""
    starts, ends, row = runs(data, offsets, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = NOT_SPACE[data]
    keep[ends[ends < len(data)]] = True
    lower = LOWER[data]
    lower[~NOT_SPACE[lower]] = 32
    place = np.cumsum(keep)
    normal = memoryview(lower[keep])
    starts, ends = place[starts] - 1, place[ends - 1]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    index = np.arange(len(starts)) - first[row]
    leads = np.flatnonzero((index == 0) | (index <= counts[row] - shingle))
    tails = np.minimum(leads + shingle - 1, (first + counts - 1)[row[leads]])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(normal[a:b], seed) for a, b in zip(starts[leads].tolist(), ends[tails].tolist())), np.uint64, len(leads)), row[leads]


def majority(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, the bits set in over half of its hashes; zero without any."""
    out = np.zeros(n, np.uint64)
    if not len(hashes):
        return out
    owners, amount = np.unique(row, return_counts=True)
    set_bits = np.zeros((len(owners), 64), np.int64)
    step = 1 << 16
    for k in range(0, len(hashes), step):  # bounded: 64 bytes a shingle
        bits = np.unpackbits(hashes[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, first_at = np.unique(np.searchsorted(owners, row[k : k + step]), return_index=True)
        set_bits[own] += np.add.reduceat(bits, first_at, axis=0, dtype=np.int32)
    out[owners] = np.packbits(2 * set_bits > amount[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """A 64-bit SimHash (uint64) for each text."""
    return majority(*shingle_hashes(data, offsets, shingle, seed), len(offsets) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """As `shingle_hashes`, but each distinct shingle of a text once, ascending within the text."""
    hashes, row = shingle_hashes(data, offsets, shingle, seed)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[fresh], row[fresh]


def sketches_of(data: np.ndarray, offsets: np.ndarray, shingle: int, words: int, keys: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(n x words: a SimHash of 64 x words bits, n x keys: least hashes) of the set of shingles of each text."""
    return _sketches_of_sets(*shingle_sets(data, offsets, shingle, seed), len(offsets) - 1, words, keys)


def _sketches_of_sets(hashes: np.ndarray, row: np.ndarray, n: int, words: int, keys: int) -> tuple[np.ndarray, np.ndarray]:
    salt = mix(np.arange(1, words + keys + 1, dtype=np.uint64))
    prints = np.stack([majority(hashes if k == 0 else mix(hashes ^ salt[k]), row, n) for k in range(words)], axis=1)
    least = np.zeros((n, keys), np.uint64)
    if len(row):
        owners, first = np.unique(row, return_index=True)
        for k in range(keys):
            least[owners, k] = np.minimum.reduceat(mix(hashes ^ salt[words + k]), first)
    return prints, least


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (long with the fingerprint's bits) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = fingerprints_of(*texts(batch), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, fingerprint long")


def planes(values: np.ndarray) -> np.ndarray:
    """(64 x words) x lanes: bit p of 64 fingerprints in each lane word of row p; the last lane is padded with copies."""
    padded = np.concatenate([values, np.repeat(values[-1:], -len(values) % 64, axis=0)])
    bits = np.unpackbits(np.ascontiguousarray(padded).view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count (low bit first; over: it ran over) is above the radius."""
    above, equal = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all fingerprints at most radius bits apart. Rows are fingerprints of one or more 64-bit words."""
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = (x.reshape(len(x), -1) for x in (left, right))
    stand = planes(right)
    lanes, rows = np.arange(stand.shape[1]), np.arange(len(left))
    counters = [np.zeros((len(rows), len(lanes)), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros((len(rows), len(lanes)), np.uint64)
    n_planes = len(stand)
    for p in range(n_planes):
        asked = np.uint64(0) - (left[rows, p // 64] >> np.uint64(p % 64) & np.uint64(1))
        carry = asked[:, None] ^ stand[p, lanes][None, :]
        for c in counters:  # carry-save: each counter keeps its bit and hands the carry on
            c ^= carry
            carry &= ~c
        over |= carry
        if p % 8 == 7 and radius < p < n_planes - 1 and (p % 16 == 15 or n_planes == 64):
            alive = exceeds(counters, over, radius) != np.uint64(0xFFFFFFFFFFFFFFFF)
            live_rows, live_lanes = alive.any(1), alive.any(0)
            if not live_rows.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if live_rows.mean() < 0.75 or live_lanes.mean() < 0.75:
                rows, lanes = rows[live_rows], lanes[live_lanes]
                cut = np.ix_(live_rows, live_lanes)
                counters, over = [c[cut] for c in counters], over[cut]
    near = ~exceeds(counters, over, radius)
    hit_row, hit_lane = np.nonzero(near)
    bits = np.unpackbits(near[hit_row, hit_lane].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, lane = np.nonzero(bits)
    i, j = rows[hit_row[pair]], lanes[hit_lane[pair]] * 64 + lane
    return i[j < len(right)], j[j < len(right)]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare_sorted(radius: int, words: int = 1, same_key: bool = False):
    columns = ["fingerprint", *(f"f{k}" for k in range(1, words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, node, fingerprint words) come sorted by key; tiles that share the last key stay for comparison.

        With `same_key`, only rows of one key link; else neighbours in a tile do as well.
        """
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # tiles whose last key may go on
        for batch in batches:
            keys, nodes = (batch.column(c).to_numpy() for c in ("key", "node"))
            values = np.stack([batch.column(c).to_numpy() for c in columns], axis=1).view(np.uint64)
            for k in range(0, len(keys), TILE):
                tile = keys[k : k + TILE], nodes[k : k + TILE], values[k : k + TILE]
                kept = [t for t in kept if t[0][-1] == tile[0][0]]
                for other in [*kept, tile]:
                    if other is tile:
                        names = tile[1]
                        u, v = close_pairs(tile[2], tile[2], radius)
                        once = u < v
                        if same_key:
                            once &= tile[0][u] == tile[0][v]
                        u, v = u[once], v[once]
                    else:  # only rows of the key that both tiles hold
                        ask, stand = (t[0] == tile[0][0] for t in (tile, other))
                        names = np.concatenate([tile[1][ask], other[1][stand]])
                        u, v = close_pairs(tile[2][ask], other[2][stand], radius)
                        v = v + int(ask.sum())
                    if len(u):
                        label = forest(len(names), u, v)
                        moved = np.flatnonzero(label != np.arange(len(label)))
                        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["u", "v"])
                kept.append(tile)

    return run


def _dealt(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of keys that two or more share, dealt to tasks and sorted by key.

    A key of more than CELL rows is cut in parts, and every pair of parts is a cell of its own,
    so no task compares more rows of a key than two parts have.
    """
    sizes = keyed.groupBy("table_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, "table_key")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    cells = F.when(F.col("n") <= CELL, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.least(other, own) * 100_000 + F.greatest(other, own))
    )
    dealt = keyed.select("node", *columns, "table_key", F.explode(cells).alias("cell")).select("node", *columns, F.xxhash64("table_key", "cell").alias("key"))
    return dealt.repartition("key").sortWithinPartitions("key")


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """u, v: links between distinct fingerprints that leave exactly the components of all links."""
    assert 0 <= radius <= 3
    value = F.col("fingerprint")
    bit = [F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1)) for start, width in BLOCKS]
    tables = [
        F.shiftleft(F.lit(t).cast("long"), 32).bitwiseOR(F.shiftleft(bit[a], 13)).bitwiseOR(bit[b]).alias(f"k{t}")
        for t, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    keyed = distinct.select(value.alias("node"), "fingerprint", F.explode(F.array(*tables)).alias("table_key"))
    return _dealt(keyed, ["fingerprint"]).mapInArrow(_compare_sorted(radius), "u long, v long").distinct()


def similar_links(distinct: DataFrame, words: int, keys: int, radius: int) -> DataFrame:
    """u, v: links of nodes whose wide fingerprints are near, among those that share a least hash."""
    columns = ["fingerprint", *(f"f{k}" for k in range(1, words))]
    table_keys = F.array(*[F.xxhash64(F.lit(k), F.col(f"m{k}")) for k in range(keys)])
    keyed = distinct.select("node", *columns, F.explode(table_keys).alias("table_key"))
    return _dealt(keyed, columns).mapInArrow(_compare_sorted(radius, words, same_key=True), "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each linked node reaches; roots included.

    Large-star then small-star rounds (each linear in the edges), checkpointed, to a fixed point.
    """
    shared_folder(edges.sparkSession)
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = edges.checkpoint()
    mark = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = edges.filter("u <> v").distinct().checkpoint()
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components have not settled")
    linked = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return linked.union(roots)


def _roots(marked: DataFrame, radius: int) -> DataFrame:
    """fingerprint, root: the component that each distinct fingerprint is in."""
    distinct = marked.select("fingerprint").distinct()
    found = components(links(distinct, radius))
    return distinct.join(found, distinct["fingerprint"] == found["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    marked = materialize(fingerprints(docs, shingle, seed), "simhash")
    least = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    joined = _roots(marked, radius).join(least, "fingerprint")
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(names, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, shingle: int, words: int, keys: int, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, fingerprint, f1.., m0.., n (distinct shingles), node (a hash of their set) of every document."""
    names = ["fingerprint", *(f"f{k}" for k in range(1, words)), *(f"m{k}" for k in range(keys)), "n", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, row = shingle_sets(*texts(batch), shingle, seed)
            prints, least = _sketches_of_sets(hashes, row, batch.num_rows, words, keys)
            node = np.zeros(batch.num_rows, np.uint64)
            if len(row):
                owners, first = np.unique(row, return_index=True)
                node[owners] = mix(np.add.reduceat(mix(hashes), first))
            n = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
            values = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (*prints.T, *least.T, n, node)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *values], ["doc_id", "text_hash", *names])

    kept = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    shape = f"doc_id {dict(kept.dtypes)['doc_id']}, text_hash long, " + ", ".join(f"{c} long" for c in names)
    return kept.mapInArrow(run, shape)


def linked_rows(sets: list[np.ndarray], prints: np.ndarray, least: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that leave exactly the components of all links.

    Rows link that share a least hash, have fingerprints within the radius, and sets (ascending)
    of the similarity. Of candidates that other links already join, no more are compared.
    """
    found: list[tuple[int, int]] = []
    sizes = np.array([len(x) for x in sets])
    label = np.arange(len(sets))

    def root(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    def similar(i: int, j: int) -> bool:
        a, b = (sets[i], sets[j]) if sizes[i] >= sizes[j] else (sets[j], sets[i])
        common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(b) else 0
        return common >= similarity * (len(a) + len(b) - common) - 1e-9

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        may = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
        i, j = i[may], j[may]
        while True:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            first = np.unique(i, return_index=True)[1]  # a candidate of each row at a time
            for a, b in zip(i[first].tolist(), j[first].tolist()):
                x, y = root(a), root(b)
                if x != y and similar(a, b):
                    label[max(x, y)] = min(x, y)
                    found.append((a, b))
            while (label[label] != label).any():
                label = label[label]
            i, j = np.delete(i, first), np.delete(j, first)

    if len(sets) <= 64:
        i, j = np.triu_indices(len(sets), 1)
        near = (least[i] == least[j]).any(1)
        i, j = i[near], j[near]
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int64) <= radius
        settle(i[near], j[near])
        return found
    for k in range(least.shape[1]):
        order = np.argsort(least[:, k], kind="stable")
        cuts = np.flatnonzero(np.diff(least[order, k])) + 1
        for rows in np.split(order, cuts):
            for x in range(0, len(rows) if len(rows) > 1 else 0, TILE):
                for y in range(0, x + 1, TILE):
                    left, right = rows[x : x + TILE], rows[y : y + TILE]
                    if (label[left] == label[left[0]]).all() and (label[right] == label[left[0]]).all():
                        continue
                    i, j = close_pairs(prints[left], prints[right], radius)
                    once = i > j if x == y else slice(None)
                    settle(left[i[once]], right[j[once]])
    return found


def true_links(docs: DataFrame, least: DataFrame, candidates: DataFrame, shingle: int, words: int, keys: int, radius: int, similarity: float, seed: int = 42) -> DataFrame:
    """u, v: the candidates whose texts have the similarity, or what leaves the same components.

    least: node, n, sketch, and (doc_id, text_hash) of a text of the node. The texts of a component
    of candidates meet in a task; of a large one, in parts as in `_dealt`, each pair a cell.
    """
    linked = materialize(least.join(components(candidates), "node"), "simhash-candidates")
    weight = F.col("n") + 1024  # a part has at most about CELL texts, and CELL x 1024 shingles
    sizes = linked.groupBy("root").agg(F.ceil(F.sum(weight) / (CELL * 1024)).cast("int").alias("_parts"))
    dealt = linked.join(sizes, "root").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    columns = ["node", "fingerprint", *(f"f{k}" for k in range(1, words)), *(f"m{k}" for k in range(keys))]
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("_text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("_text_hash") == F.col("least.text_hash"))
    joined = given.join(dealt, same)
    cells = F.when(F.col("_parts") <= 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda other: F.least(other, F.col("_own")) * 100_000 + F.greatest(other, F.col("_own")))
    )
    celled = joined.select("text", "root", *columns, F.explode(cells).alias("cell")).select("text", *columns, F.xxhash64("root", "cell").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, rows = None, [], []
        u: list[int] = []
        v: list[int] = []

        def settle() -> None:
            if len(sets) > 1:
                whole = np.concatenate(rows)
                once = np.unique(whole[:, 0], return_index=True)[1]  # rows that repeat id and text
                whole = whole[once]
                for i, j in linked_rows([sets[k] for k in once], whole[:, 1 : 1 + words], whole[:, 1 + words :], radius, similarity):
                    u.append(int(whole[i, 0].view(np.int64)))
                    v.append(int(whole[j, 0].view(np.int64)))

        for batch in slices(batches):
            hashes, row = shingle_sets(*texts(batch), shingle, seed)
            own = np.split(hashes, np.searchsorted(row, np.arange(1, batch.num_rows)))
            values = np.stack([batch.column(c).to_numpy() for c in columns], axis=1).view(np.uint64)
            names = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if key != names[a]:
                    settle()
                    key, sets, rows = names[a], [], []
                sets += own[a:b]
                rows.append(values[a:b])
            if len(u) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u.clear()
                v.clear()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return celled.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def radius_of(similarity: float, bits: int, deviations: float = 5.0) -> int:
    """Differing bits that texts of a Jaccard similarity have at most, but for less than one in a million in the tail.

    A share s = 2J / (1 + J) of the shingles is common, and a bit differs with probability acos(s) / pi
    (in sets of less than ten, up to 0.19 at a similarity of 0.8, so that one in a thousand is lost). The radius
    finds candidates only, so a wide one costs comparisons but links nothing.
    """
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * differ + deviations * np.sqrt(bits * differ * (1 - differ)))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4, keys: int = 6, seed: int = 42) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: the one of the smallest doc_id.

    Near duplicates share `similarity` of their distinct word shingles. They are looked for among
    texts that share one of `keys` least hashes (all but (1 - similarity) ** keys of them do) and
    whose fingerprints of 64 x words bits are within a radius, and told by the shingles themselves.
    Groups are components of links. Among equal ids (null last) the smallest hash of the text
    decides; of rows that repeat id and text, one stays.
    """
    marked = materialize(sketches(docs, shingle, words, keys, seed), "simhash-sketches")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    sketch = ["fingerprint", *(f"f{k}" for k in range(1, words)), *(f"m{k}" for k in range(keys))]
    least = marked.groupBy("node", "n", *sketch).agg(F.min(order).alias("least"))
    radius = radius_of(similarity, 64 * words)
    candidates = similar_links(least.select("node", *sketch), words, keys, radius)
    found = components(true_links(docs, least, candidates, shingle, words, keys, radius, similarity, seed))
    chosen = least.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    chosen = chosen.select(F.col("least.doc_id").alias("_id"), F.col("least.text_hash").alias("_hash"))
    rows, restored = set_aside(docs, "doc_id", "text")
    rows = rows.withColumn("_text_hash", F.xxhash64("text"))
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    repeats = marked.groupBy("doc_id", "text_hash").count().filter("count > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_text_hash"])
    return restored(kept)
