"""Periodic runs of words, from the Lyndon words of both orders.

A run is a stretch that repeats itself with a period and that no neighbouring word continues. For
each place, the longest Lyndon word that begins there is found by a stack scanned from right to
left; by the runs theorem, every run has the Lyndon word of one of its places, under the order of
the words or under its reverse, as its period. Each such word is extended to both sides. Comparing
and extending both need the longest common extension of two places: the first few words are
compared one by one, the rest by a binary search over rolling hashes, and what the hashes claim is
then compared word by word. A stretch compared once at some distance is not compared again, so
long periods cost no square. No suffix array is built.

Only stretches that repeated strings of six words cover are scanned: a run of at least twelve words
and two periods consists of such strings, so none is lost and no run is cut.

Defined results: null and empty texts have no words and no run; ties of the longest run go to the
smallest start, then period; a null doc_id counts as an empty number; repeated rows repeat their
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textarrays import mix, slices

#: Words that a run has at least.
LEAST = 12
#: Words compared one by one before hashes are asked.
PLAIN = 8
_PRIME = (1 << 61) - 1
_BASE = 0x1B8E0F5C3A5D9A17 % _PRIME


class Extensions:
    """Longest common extensions of the places of one word sequence, to the right and to the left."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.array: np.ndarray | None = None
        self.equal: dict[int, tuple[int, int]] = {}  # distance: [from, to) with words[k] == words[k + distance], compared word by word

    def _hashes(self) -> None:
        self.array = np.array(self.words, np.int64)
        self.sums, self.powers = [0], [1]
        h, p = 0, 1
        for w in self.words:
            h = (h * _BASE + w + 1) % _PRIME
            p = p * _BASE % _PRIME
            self.sums.append(h)
            self.powers.append(p)

    def _same(self, i: int, j: int, size: int) -> bool:
        s, p = self.sums, self.powers[size]
        return (s[i + size] - s[i] * p - s[j + size] + s[j] * p) % _PRIME == 0

    def _checked(self, i: int, d: int, size: int) -> int:
        """How many of the `size` words from i on really equal those d later; a difference ends the count."""
        low, high = self.equal.get(d, (0, 0))
        if low <= i and i + size <= high:
            return size
        at = i
        if low <= i < high:
            at = high
        stop = i + size
        if at < low <= stop <= high:  # the end is known: compare what comes before it
            stop = low
        differ = np.flatnonzero(self.array[at:stop] != self.array[at + d : stop + d])
        if len(differ):
            return at + int(differ[0]) - i
        end = max(i + size, high) if i <= high and i + size >= low else i + size
        begin = min(i, low) if i <= high and i + size >= low and high > low else i
        self.equal[d] = (begin, end)
        return size

    def right(self, i: int, j: int) -> int:
        """Length of the longest common prefix of what begins at i and at j > i."""
        w, most = self.words, self.n - j
        k, plain = 0, min(PLAIN, most)
        while k < plain:
            if w[i + k] != w[j + k]:
                return k
            k += 1
        if k == most:
            return most
        low, high = self.equal.get(j - i, (0, 0))
        if low <= i + k <= high and (high == self.n - (j - i) or w[high] != w[high + j - i]):
            self.equal[j - i] = min(low, i), high
            return high - i
        if self.array is None:
            self._hashes()
        low, high, step = k, most, PLAIN
        while low < most:  # doubling, then halving
            size = min(low + step, most)
            if not self._same(i, j, size):
                high = size - 1
                break
            low, step = size, step * 2
        while low < high:
            middle = (low + high + 1) // 2
            if self._same(i, j, middle):
                low = middle
            else:
                high = middle - 1
        return self._checked(i, j - i, low)

    def left(self, i: int, j: int) -> int:
        """Length of the longest common suffix of what ends before i and before j > i."""
        w, most = self.words, i
        k, plain = 0, min(PLAIN, most)
        while k < plain:
            if w[i - k - 1] != w[j - k - 1]:
                return k
            k += 1
        if k == most:
            return most
        low, high = self.equal.get(j - i, (0, 0))
        if low <= i - k <= high and (low == 0 or w[low - 1] != w[low - 1 + j - i]):
            self.equal[j - i] = low, max(high, i)
            return i - low
        if self.array is None:
            self._hashes()
        low, high, step = k, most, PLAIN
        while low < most:
            size = min(low + step, most)
            if not self._same(i - size, j - size, size):
                high = size - 1
                break
            low, step = size, step * 2
        while low < high:
            middle = (low + high + 1) // 2
            if self._same(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle - 1
        while self._checked(i - low, j - i, low) < low:  # a hash was wrong: what really is alike ends at i
            low -= self._checked(i - low, j - i, low) + 1
        return low


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with length >= max(least, 2 * period), by start, then period."""
    n = len(words)
    extend = Extensions(words)
    found: set[tuple[int, int, int]] = set()
    last: dict[int, tuple[int, int]] = {}  # period: the run found last, [start, end)
    for sign in (1, -1):
        following = [n] * (n + 1)  # where the longest Lyndon word from a place ends
        for i in range(n - 1, -1, -1):
            first, j, common = words[i], i + 1, 0
            while j < n:
                second = words[j]
                if first != second:
                    common = 0
                    if (first < second) is (sign < 0):
                        break
                else:
                    common = extend.right(i, j)
                    if j + common == n or (words[i + common] < words[j + common]) is (sign < 0):
                        break
                j = following[j]
            else:
                common = 0
            following[i] = j
            period = j - i
            if common < period and (i == 0 or words[i - 1] != words[j - 1]):
                continue
            known = last.get(period)
            if known and known[0] <= i and j <= known[1]:
                continue
            before = extend.left(i, j)
            length = before + period + common
            if length >= 2 * period:
                last[period] = i - before, i + period + common
                if length >= least:
                    found.add((i - before, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


#: Multipliers of the words of a string of half the least run.
_STEPS = mix(np.arange(1, LEAST // 2 + 1, dtype=np.uint64))


def covered(words: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches [from, to) that strings of LEAST // 2 words cover which stand more than once; equal hashes only widen them."""
    half = LEAST // 2
    n = len(words) - half + 1
    if n < 2:
        return []
    value = mix(words.astype(np.uint64) + np.uint64(1))
    keys = sum(value[k : k + n] * _STEPS[k] for k in range(half))
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice[place] == keys)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + half, -1)
    inside = np.concatenate([[0], (np.cumsum(edge) > 0)[:-1].view(np.int8), [0]])
    change = np.flatnonzero(np.diff(inside))
    return list(zip(change[0::2].tolist(), change[1::2].tolist()))


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a text's words."""
    if len(words) < LEAST:
        return []
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(ids):
        return []
    return [(a + start, length, period) for a, b in covered(np.array(ids, np.int64)) if b - a >= LEAST for start, length, period in runs_of(ids[a:b])]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    out, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return out + words[at:]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a text; in documents whose number's CRC-32 ends in 0, a tail of them repeats itself."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[: n - a]


_LONG = ("start", "length", "period", "exponent_milli")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), *((c, pa.int64()) for c in _LONG), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _rows(schema: pa.Schema, plant: bool, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()  # parts at the six white bytes of ASCII
                if plant:
                    words = planted(words, doc_id)
                runs = text_runs(words)
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                collapsed = b" ".join(kept_words(words, runs))
                row = (doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
                rows.append((*row, [dict(zip(_LONG, r)) for r in runs], collapsed.decode()) if texts_too else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


_RUN = pa.struct([(c, pa.int64()) for c in _LONG[:3]])


def periodic_runs(docs: DataFrame, plant: bool = False, texts_too: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 of each document.

    plant: a tail of every tenth document, by its number, is made periodic first. texts_too: also
    the runs themselves and the collapsed text, words joined by one space.
    """
    schema = _SCHEMA.append(pa.field("runs", pa.list_(_RUN))).append(pa.field("collapsed", pa.string())) if texts_too else _SCHEMA
    kinds = "doc_id long, n_runs long, " + ", ".join(f"{c} long" for c in _LONG) + ", runs_sha256 string, collapsed_sha256 string"
    if texts_too:
        kinds += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_rows(schema, plant, texts_too), kinds)
