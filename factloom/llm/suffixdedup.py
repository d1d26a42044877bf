"""Exact substring deduplication: merged Burrows-Wheeler transforms of candidate windows.

A byte goes if a string of `width` bytes that covers it also starts somewhere else. The same
transforms tell the shorter repeats that make a passage: runs of more than `words` words whose
every string of `passage` bytes also stands in another document. Three steps:

1. Every window of `passage` bytes has an anchor, the k-byte gram in it with the least hash.
   Consecutive windows with one anchor form a segment, which reaches far enough to hold the
   strings of `width` bytes that begin in it. Equal windows have equal anchors, so only segments
   with one anchor's hash can share a window of either length. Texts that stand on several rows
   are repeats at once; counts of anchors and segments are pre-aggregated, so copies, however
   many, are one row.
2. Distinct segments that share an anchor are dealt to buckets by the anchor. A bucket forms
   shards of bounded size, of the stretches whose every symbol of SYMBOL bytes stands twice in the
   bucket (a repeat has no other); each shard's Burrows-Wheeler transform is built over symbols
   (all phases of the stretches), to the depth of `width` bytes. Two transforms are
   merged by refining their interleave: each round sorts the merged column stably by the symbol
   before, which orders suffixes one symbol deeper, and the round in which two neighbours part
   is their common prefix. Neighbours that have not parted after width / SYMBOL rounds are
   repeated intervals of `width`, those of passage / SYMBOL rounds of `passage` bytes. No suffix
   is sorted again in a merge.
3. Repeats go back to all places of their segments and unite to the runs that documents lose.

Anchors whose distinct segments have more bytes than a bucket (a passage in very many documents)
would make one bucket large; their windows are instead counted by a 128-bit hash, with partial
aggregation. Buckets are bounded by bytes: those of one anchor, and about as many of others.

Defined results: null and empty texts have no bytes; texts shorter than a window have no repeats
of its length; repeated rows (of any doc_id) repeat each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize
from .textarrays import Recent, mix, powers, prefix_sums, slices, span_hashes

WIDTH = 400
#: Bytes of a window of passages, and words that a passage has at least one more of.
PASSAGE, WORDS = 240, 50
GRAM = 48
SYMBOL = 80
#: Windows that a segment has at most.
MOST = 4096
#: Bytes of segments in a bucket (about) and in a shard (at most, unless one segment is longer).
BUCKET, SHARD = 1 << 20, 1 << 19


def leading(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, most: int = MOST):
    """(text, first window start, number of windows, anchor hash, whether the anchor stands more than once) of each segment of all texts."""
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    none = np.zeros(0, np.int64)
    found: list[tuple] = [(none, none, none, none.view(np.uint64), none.astype(bool))]
    if n > 0:
        value = mix((sums[gram:] - sums[:n]) * powers(len(data) + 1)[1][:n])
    for row in np.flatnonzero(np.diff(offsets) >= window):
        a, b = int(offsets[row]), int(offsets[row + 1])
        place = sliding_least(value[a : b - gram + 1], window - gram + 1) + a
        least = value[place]
        fresh = np.append(True, least[1:] != least[:-1])
        moved = np.append(False, place[1:] != place[:-1]) & ~fresh
        begin = np.flatnonzero(fresh)
        count = np.diff(np.append(begin, len(place)))
        if count.max() > most:  # periodic texts keep an anchor for long
            begin = np.concatenate([np.arange(c, c + m, most) for c, m in zip(begin, count)])
            count = np.diff(np.append(begin, len(place)))
        found.append((np.full(len(begin), row), begin, count, least[begin], np.add.reduceat(moved.view(np.int8), begin, dtype=np.int64) > 0))
    return tuple(map(np.concatenate, zip(*found)))


def sliding_least(value: np.ndarray, span: int) -> np.ndarray:
    """Place of the least value (leftmost among equals) in every run of `span` values."""
    n = len(value)
    least, at, reach = value, np.arange(n, dtype=np.int32), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = least[: len(least) - step], least[step:]
        later = right < left
        at = np.where(later, at[step:], at[: len(at) - step])
        least = np.where(later, right, left)
        reach += step
    return at


def text_key(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


_SEGMENT = pa.schema([("text", pa.binary()), ("first", pa.int32()), ("windows", pa.int32()), ("length", pa.int32()), ("anchor", pa.int64()), ("segment", pa.int64()), ("inner", pa.bool_())])
_SEGMENT_SQL = "text binary, first int, windows int, length int, anchor long, segment long, inner boolean"


def _new_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(keys, texts) of slices of the batches, without those that this task has just had."""
    seen = Recent()
    for batch in slices(batches):
        raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        new = [(k, x) for x in raw if seen.add(k := text_key(x))]
        if new:
            yield tuple(map(list, zip(*new)))


def _segment_rows(width: int, window: int, gram: int):
    """Segments of the texts that this task has not just had: copies of a text are counted apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raw in _new_texts(batches):
            data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
            row, first, windows, anchor, inner = leading(data, offsets, window, gram)
            if not len(row):
                continue
            start = offsets[row] + first
            end = np.minimum(start + windows - 1 + width, offsets[row + 1])
            whole = span_hashes(prefix_sums(data), start, end)
            numbers = [pa.array(c.astype(np.int32)) for c in (first, windows, end - start)]
            hashes = [pa.array(c.view(np.int64)) for c in (anchor, whole)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(row)), *numbers, *hashes, pa.array(inner)], schema=_SEGMENT)

    return run


def _distinct_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, body) of the texts that this task has not just had."""
    for keys, raw in _new_texts(batches):
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["text", "body"])


# Burrows-Wheeler transforms over symbols --------------------------------------------------


class Transform:
    """The transform of a set of strings, sorted to some depth of symbols.

    last: the symbol before each sorted suffix, -1 at a string's start; origin: the place of each
    suffix; strings: how many there are. The first `strings` suffixes are the strings' ends, each
    of which differs from every symbol and every other end.
    """

    def __init__(self, last: np.ndarray, origin: np.ndarray, strings: int):
        self.last, self.origin, self.strings = last, origin, strings


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative keys below 2 ** 31, of at most 2 ** 32 places, by one plain sort."""
    packed = keys.astype(np.int64) << 32 | np.arange(len(keys))
    packed.sort()
    return packed & 0xFFFFFFFF


def build(symbols: np.ndarray, depth: int) -> Transform:
    """Transform of one shard, sorted by doubled prefixes. symbols: strings end to end, each closed by -1."""
    n, end = len(symbols), symbols < 0
    strings = int(end.sum())
    rank = np.where(end, np.cumsum(end) - 1, symbols.astype(np.int64) + strings)
    order = stable_order(rank)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        second = np.zeros(n, np.int64)  # a prefix with an end in it is alone whatever follows
        second[: n - step] = rank[step:]
        # ranks are refined within their present order, by the rank of what follows
        bits, values = n.bit_length(), int(rank.max()).bit_length()
        if bits + 2 * values < 64:  # both ranks and the place in one plain sort
            packed = (rank << values | second) << bits | np.arange(n)
            packed.sort()
            order = packed & ((1 << bits) - 1)
            both = packed >> bits
            fresh = np.append(False, both[1:] != both[:-1])
        else:
            by_second = stable_order(second)
            order = by_second[stable_order(rank[by_second])]
            left, right = rank[order], second[order]
            fresh = np.append(False, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        known += step
    last = np.where(order > 0, symbols[order - 1], -1)
    return Transform(last, order, strings)


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """The merged transform, and for each suffix how many symbols it shares with the one above (at most depth).

    The interleave starts as all of a, then all of b. Each round sorts the merged column stably
    by the symbol before, and so orders suffixes one symbol deeper; suffixes that part in a
    round share one symbol less than the round's number.
    """
    n, strings = len(a.last) + len(b.last), a.strings + b.strings
    side = np.zeros(n, bool)
    side[len(a.last) :] = True
    ends = np.zeros(strings, bool)
    ends[a.strings :] = True
    block = np.zeros(n, np.int64)
    shared = np.full(n, depth, np.int16)
    shared[0] = 0
    mine, other, place = (a.last + 1) << 32, (b.last + 1) << 32, np.arange(n)
    for deep in range(depth):
        column = np.empty(n, np.int64)  # the symbol, ends first, and the place: one plain sort is stable
        column[~side], column[side] = mine, other
        column |= place
        column.sort()
        order = column[strings:] & 0xFFFFFFFF
        symbol, held = column[strings:] >> 32, (block << 1 | side)[order]
        before = held >> 1
        parts = np.ones(n, bool)
        parts[strings + 1 :] = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        moved, new = np.concatenate([ends, (held & 1).astype(bool)]), np.cumsum(parts)
        shared[parts & (shared == depth)] = deep
        settled = deep > 0 and new[-1] == block[-1] and bool((moved == side).all()) and bool((new == block).all())
        side, block = moved, new
        if settled:
            break
    origin, last = np.empty(n, np.int64), np.empty(n, np.int64)
    origin[~side], origin[side] = a.origin, b.origin + len(a.origin)
    last[~side], last[side] = a.last, b.last
    return Transform(last, origin, strings), shared


def repeated_symbols(hashes: np.ndarray, inside: np.ndarray, bits: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """(ids, again): for places `inside`, whether their symbol stands at another such place, and for those a number of the symbol.

    Few of the places that stand alone share the first bits of a hash, so only the others are sorted.
    """
    coarse = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(inside & (np.bincount(coarse[inside], minlength=1 << bits) > 1)[coarse])
    _, which, count = np.unique(hashes[maybe], return_inverse=True, return_counts=True)
    ids, again = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    ids[maybe], again[maybe] = which, count[which] > 1
    return ids, again


def repeated_windows(segments: list[bytes], windows: list[int], widths: tuple[int, ...] = (WIDTH, PASSAGE), symbol: int = SYMBOL, shard: int = SHARD, owners: np.ndarray | None = None) -> list[list[np.ndarray]]:
    """For each width, for each segment, which of its first `windows` places start a string of so many bytes that another place starts, too.

    owners: for each segment, the least and greatest of the texts that hold it; given these, for
    the widths after the first the other place must be in another text.
    """
    depth = max(widths) // symbol
    raw = np.frombuffer(b"".join(segments), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
    at = np.arange(len(raw) - symbol + 1)
    inside = np.ones(len(at), bool)  # places whose symbol ends in their segment
    for end in begins[1:-1]:
        inside[max(0, end - symbol + 1) : end] = False
    ids, again = repeated_symbols(span_hashes(prefix_sums(raw), at, at + symbol), inside)
    # a repeat has only repeated symbols: stretches of those, as long as the least width, are what is transformed
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
    first, lengths = edge[0::2], edge[1::2] - edge[0::2] + symbol - 1
    first, lengths = first[lengths >= min(widths)], lengths[lengths >= min(widths)]
    several = np.flatnonzero(owners[:, 0] != owners[:, 1]) if owners is not None else ()  # each of their windows stands in two texts
    marks = [np.zeros(len(raw) + 1, bool) for _ in widths]
    for k in several:
        for width, found in zip(widths[1:], marks[1:]):
            found[begins[k] : max(begins[k], begins[k + 1] - width + 1)] = True
    cut = lambda: [[found[begin : begin + n] for begin, n in zip(begins, windows)] for found in marks]
    if not len(first):
        return cut()
    bound = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // shard, prepend=-1))  # first stretches of the shards
    built, places = [], []
    for a, b in zip(bound, np.append(bound[1:], len(first))):
        # each stretch is `symbol` strings, one a phase: every symbol-th place of it, and an end
        count = lengths[a:b] - symbol + 1
        phases = np.minimum(symbol, count)
        owner = np.repeat(np.arange(a, b), phases)
        phase = np.arange(len(owner)) - np.repeat(np.cumsum(phases) - phases, phases)
        size = (lengths[owner] - symbol - phase) // symbol + 2
        done = np.cumsum(size)
        step = np.arange(done[-1]) - np.repeat(done - size, size)
        place = np.repeat(first[owner] + phase, size) + step * symbol
        place[done - 1] = -1
        built.append(build(np.where(place < 0, -1, ids[place]), depth))
        places.append(place)
    if len(built) == 1:  # common prefixes come from a merge
        built.insert(0, Transform(*(np.zeros(0, np.int64),) * 2, 0))
    while len(built) > 1:  # neighbours merge, so that each symbol is merged as often as the shards can be halved
        pairs = [merge(*built[k : k + 2], depth) for k in range(0, len(built) - 1, 2)]
        shared = pairs[0][1]
        built = [t for t, _ in pairs] + built[len(built) - len(built) % 2 :]
    merged = built[0]
    place = np.concatenate(places)[merged.origin]
    starts = np.zeros(len(raw) + 1, bool)
    for begin, n in zip(begins, windows):
        starts[begin : begin + n] = True
    wanted = np.flatnonzero((place >= 0) & starts[place])
    place = place[wanted]
    segment = np.searchsorted(begins, place, "right") - 1
    for k, width in enumerate(widths):
        interval = np.cumsum(shared < width // symbol)[wanted]
        opens = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
        size = np.diff(np.append(opens, len(interval)))
        alike = size > 1
        if k and owners is not None and len(interval):
            alike = np.minimum.reduceat(owners[segment, 0], opens) != np.maximum.reduceat(owners[segment, 1], opens)
        marks[k][place[np.repeat(alike, size)]] = True
    return cut()


def spans_of(marks: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


#: part 0: starts of repeats that are removed; part 1: of repeats that make passages.
_RUNS = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("runs", pa.list_(pa.struct([("part", pa.int32()), ("from", pa.int32()), ("to", pa.int32())])))])
_RUNS_SQL = "anchor long, segment long, runs array<struct<part:int,from:int,to:int>>"


def _bucket_rows(widths: tuple[int, int], symbol: int, shard: int):
    def run(bucket: pa.Table) -> pa.Table:
        owners = np.stack([bucket.column(c).to_numpy() for c in ("low", "high")], axis=1)
        found = repeated_windows(bucket.column("body").to_pylist(), bucket.column("windows").to_pylist(), widths, symbol, shard, owners)
        rows = []
        for anchor, segment, *marks in zip(bucket.column("anchor").to_pylist(), bucket.column("segment").to_pylist(), *found):
            runs = [{"part": part, "from": x, "to": y} for part, m in enumerate(marks) for x, y in spans_of(m)]
            if runs:
                rows.append((anchor, segment, runs))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RUNS)], schema=_RUNS)

    return run


def _window_rows(widths: tuple[int, int]):
    """Every window of hot segments, of either width, with a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                bodies, windows = rows.column("body").to_pylist(), rows.column("windows").to_numpy()
                raw = np.frombuffer(b"".join(bodies), np.uint8)
                lengths = np.array([len(b) for b in bodies])
                begins = np.cumsum(lengths) - lengths
                sums = prefix_sums(raw), prefix_sums(raw ^ np.uint8(0xA5))
                for part, width in enumerate(widths):
                    count = np.clip(lengths - width + 1, 0, windows)
                    which = np.repeat(np.arange(len(bodies)), count)
                    at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    start = begins[which] + at
                    hashes = [pa.array(span_hashes(x, start, start + width).view(np.int64)) for x in sums]
                    given = [pa.array(rows.column(c).to_numpy()[which]) for c in ("anchor", "segment", "low", "high")]
                    yield pa.RecordBatch.from_arrays([*given, pa.array(np.full(len(at), part, np.int32)), pa.array(at.astype(np.int32)), *hashes], ["anchor", "segment", "low", "high", "part", "at", "one", "two"])

    return run


def _hot_runs(hot: DataFrame, widths: tuple[int, int]) -> DataFrame:
    windows = hot.select("anchor", "segment", "low", "high", "windows", "body").mapInArrow(_window_rows(widths), "anchor long, segment long, low long, high long, part int, at int, one long, two long")
    key = ["part", "one", "two"]
    twice = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    twice = materialize(twice.filter("if(part = 0, n > 1, low <> high)").select(*key), "suffix-hot")  # written, so that a window in very many segments splits in the join
    again = windows.select("anchor", "segment", *key, "at").join(twice, key).groupBy("anchor", "segment").agg(F.collect_set(F.struct("part", "at")).alias("at"))  # at most a segment's windows
    return again.mapInArrow(_window_runs, _RUNS_SQL)


def _window_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of segments as runs of consecutive ones."""
    for batch in batches:
        rows = []
        for windows in batch.column("at").to_pylist():
            starts = [sorted(w["at"] for w in windows if w["part"] == part) for part in (0, 1)]
            rows.append([{"part": part, "from": a, "to": b} for part, s in enumerate(starts) for a, b in united([(x, x + 1) for x in s])])
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("segment"), pa.array(rows, _RUNS.field("runs").type)], schema=_RUNS)


_CUT = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("crowd", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("windows", pa.int32()), ("length", pa.int32()), ("body", pa.binary())])
_CUT_SQL = "anchor long, segment long, crowd long, low long, high long, windows int, length int, body binary"


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            rows = [
                (*(c[f] for f in _CUT.names[:-1]), body[c["first"] : c["first"] + c["length"]])
                for body, cuts in zip(batch.column("body").slice(k, 64).to_pylist(), batch.column("cuts").slice(k, 64).to_pylist())
                for c in cuts
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that (from, to) cover; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPACE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")


def whole_words(body: bytes, start: int, end: int) -> int:
    """Words of body that lie in [start, end) from first to last byte."""
    n = len(body[start:end].split())
    if n and start and body[start - 1] not in _SPACE and body[start] not in _SPACE:
        n -= 1
    if n and end < len(body) and body[end - 1] not in _SPACE and body[end] not in _SPACE:
        n -= 1
    return n


_KEPT = pa.schema([("text", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("n_passage_words", pa.int64()), ("kept", pa.binary())])
_KEPT_SQL = "text binary, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long, kept binary"


def _kept_rows(words: int, bytes_too: bool):
    """What is left of each text without its repeats, and its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = []
                for key, body, runs in zip(*(part.column(c).to_pylist() for c in ("text", "body", "runs"))):
                    gone, passages = (united([(r["from"], r["to"]) for r in runs if r["part"] == p]) for p in (0, 1))
                    ends = [0, *(b for _, b in gone)]
                    kept = b"".join(body[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(body)]))
                    long = [n for a, b in passages if (n := whole_words(body, a, b)) > words]
                    rows.append((key, len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(long), sum(long), kept if bytes_too else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KEPT)], schema=_KEPT)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (a key of the whole text), n_bytes, whole (its SHA-256 in hex)."""
    text = F.coalesce("text", F.lit(""))
    given = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    return given.withColumn("text", F.substring(F.unhex("whole"), 1, 16))


def repeated_runs(docs: DataFrame, width: int = WIDTH, passage: int = PASSAGE, gram: int = GRAM, symbol: int = SYMBOL, bucket: int = BUCKET, hot: int | None = None) -> DataFrame:
    """text (a key of the whole text), runs: array of byte ranges (part, from, to), which may overlap.

    part 0: bytes that repeats of `width` bytes cover; part 1: bytes that repeats of `passage` bytes in other documents cover.
    hot: bytes of distinct segments with which an anchor shares a bucket with others, a bucket's at most if not given.
    """
    if width % symbol or passage % symbol or not 0 < gram <= passage <= width:
        raise ValueError("width and passage must be multiples of symbol, and gram at most passage")
    spark, widths = docs.sparkSession, (width, passage)
    segments = docs.select("text").mapInArrow(_segment_rows(width, passage, gram), _SEGMENT_SQL)
    segments = materialize(segments, "suffix-segments")
    place, owner = F.struct("text", "first", "windows", "length"), F.xxhash64("text")
    distinct = segments.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("places"), F.min(place).alias("place"), F.min(owner).alias("low"), F.max(owner).alias("high"), F.bool_or("inner").alias("inner"))
    crowds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("place.length").alias("crowd")).filter("n > 1")
    distinct = distinct.join(crowds, "anchor", "left").withColumns({"n": F.coalesce("n", F.lit(1).cast("long")), "crowd": F.coalesce("crowd", F.lit(0).cast("long"))}).filter("n > 1 or places > 1 or inner")
    distinct = materialize(distinct.select("anchor", "segment", "places", "n", "crowd", "low", "high", "inner", "place.*"), "suffix-distinct")
    shared = distinct.filter("n > 1 or inner")
    cuts = shared.groupBy("text").agg(F.collect_list(F.struct("first", *_CUT.names[:-1])).alias("cuts"))
    bodies = docs.select("text").mapInArrow(_distinct_rows, "text binary, body binary")
    cut = bodies.join(cuts.hint("shuffle_hash"), "text").mapInArrow(_cut_rows, _CUT_SQL).dropDuplicates(["anchor", "segment"])
    cut = materialize(cut, "suffix-cut")
    buckets = max(1, -(-(cut.agg(F.sum("length")).first()[0] or 0) // bucket))
    hot = bucket if hot is None else hot
    dealt = cut.filter(F.col("crowd") <= hot).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    runs = dealt.groupBy("bucket").applyInArrow(_bucket_rows(widths, symbol, max(width, bucket // 2)), _RUNS_SQL)
    runs = runs.union(_hot_runs(cut.filter(F.col("crowd") > hot), widths))
    zero = F.lit(0)
    whole = F.array(
        F.struct(zero.alias("part"), zero.alias("from"), F.least("windows", F.col("length") - (width - 1)).alias("to")),
        F.struct(F.lit(1).alias("part"), zero.alias("from"), F.when(F.col("low") != F.col("high"), F.col("windows")).otherwise(zero).alias("to")),
    )
    whole = distinct.filter("places > 1").select("anchor", "segment", F.filter(whole, lambda r: r["to"] > 0).alias("runs"))
    runs = materialize(runs.union(whole), "suffix-runs")
    drop(spark, distinct)
    drop(spark, cut)
    # both sides are plain exchanges here, so a segment that stands very often is split as a skewed join
    placed = segments.join(runs, ["anchor", "segment"])
    reach = lambda run: F.when(run["part"] == 0, width - 1).otherwise(passage - 1)
    moved = F.transform("runs", lambda r: F.struct(r["part"].alias("part"), (F.col("first") + r["from"]).alias("from"), (F.col("first") + r["to"] + reach(r)).alias("to")))
    placed = placed.select("text", moved.alias("runs"))  # a segment's runs stay one row
    # texts that stand on several rows are repeats from end to end
    copies = _texts(docs).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").cast("int").alias("to")).filter("n > 1 and to > 0")
    both = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(0).alias("from"), "to") for p in (0, 1)])
    copied = copies.select("text", F.filter(both, lambda r: (r["part"] == 1) | (r["to"] >= width)).alias("runs"))
    found = materialize(placed.union(copied).groupBy("text").agg(F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs")), "suffix-texts")
    drop(spark, segments)
    drop(spark, runs)
    return found


def deduplicate(docs: DataFrame, words: int = WORDS, kept: bool = False, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words of each document.

    n_passages counts the runs of more than `words` whole words that repeats of `passage` bytes in
    other documents cover, n_passage_words their words. kept: also the bytes that are left.
    """
    runs = repeated_runs(docs, **how)
    bodies = docs.select("text").mapInArrow(_distinct_rows, "text binary, body binary")
    left = bodies.join(runs.hint("shuffle_hash"), "text").mapInArrow(_kept_rows(words, kept), _KEPT_SQL).dropDuplicates(["text"])
    left = materialize(left if kept else left.drop("kept"), "suffix-kept")  # so that the join below has plain exchanges, and a text with very many copies splits
    drop(docs.sparkSession, runs)
    zero = F.lit(0).cast("long")
    numbers = {c: F.coalesce(c, zero).alias(c) for c in ("n_removed", "n_spans", "n_passages", "n_passage_words")}
    out = ["doc_id", "n_bytes", numbers["n_removed"], numbers["n_spans"], F.coalesce("kept_sha256", "whole").alias("kept_sha256"), numbers["n_passages"], numbers["n_passage_words"]]
    given = _texts(docs)
    if kept:
        body = F.coalesce("text", F.lit("")).cast("binary")
        given = docs.select("doc_id", "text", body.alias("body")).withColumns({"n_bytes": F.octet_length("body").cast("long"), "whole": F.sha2("body", 256)}).withColumn("text", F.substring(F.unhex("whole"), 1, 16))
        out.append(F.coalesce("kept", "body").alias("kept"))
    return given.join(left, "text", "left").select(*out)
