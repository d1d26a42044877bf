"""Token ids of words, each distinct word encoded once while a worker remembers it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textarrays import prefix_sums, span_hashes

#: Words that a worker remembers (about 60 bytes each); beyond that it starts anew.
REMEMBER = 1_500_000
#: Bytes compared at once; a single longer word is compared alone.
COMPARED = 1 << 20


def equal_spans(a: np.ndarray, starts: np.ndarray, lengths: np.ndarray, b: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of a from each start on are those of b from the other, at the lengths given."""
    same = lengths == sizes
    rows = np.flatnonzero(same)
    ends = np.cumsum(lengths[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
        part = rows[at:to]
        if to == at + 1:
            i, j, n = starts[part[0]], others[part[0]], lengths[part[0]]
            same[part] = np.array_equal(a[i : i + n], b[j : j + n])
        else:
            n = lengths[part]
            done = np.cumsum(n)
            step = np.arange(done[-1]) - np.repeat(done - n, n)
            differ = np.flatnonzero(a[np.repeat(starts[part], n) + step] != b[np.repeat(others[part], n) + step])
            same[part[np.searchsorted(done, differ, "right")]] = False
        at = to
    return same


class WordCache:
    """encode: takes the bytes of distinct words, returns (ids end to end, number of ids of each).

    Words are found by a hash and then compared byte by byte; a word whose hash is another's is
    encoded each time that it comes.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], remember: int = REMEMBER):
        self.encode, self.remember = encode, remember
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)  # of the sorted keys, where their ids begin
        self.count = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)  # and where their words' bytes do
        self.size = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0
        self.words, self.filled = np.zeros(1 << 16, np.uint8), 0

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of ids of each word)."""
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        hashes = span_hashes(prefix_sums(data), starts, ends)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + len(keys) > self.remember and len(self.keys):
                self._forget()
                at, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            self._learn(keys[~known], at[~known], data, starts[first[~known]], ends[first[~known]])
            at = np.searchsorted(self.keys, keys)
        place, count = self.place[at][which], self.count[at][which].astype(np.int64)
        same = equal_spans(data, starts, ends - starts, self.words, self.begin[at][which], self.size[at][which])
        pool = self.pool
        if not same.all():
            pool = self._others(data, starts, ends, np.flatnonzero(~same), place, count)
        done = np.cumsum(count)
        out = np.arange(done[-1]) + np.repeat(place - (done - count), count)
        return pool[out], count

    def _learn(self, keys, at, data, starts, ends) -> None:
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        found, counts = self.encode(words)
        place, size = self.used + np.cumsum(counts) - counts, ends - starts
        begin = self.filled + np.cumsum(size) - size
        self.pool, self.used = _added(self.pool, self.used, found)
        self.words, self.filled = _added(self.words, self.filled, np.frombuffer(b"".join(words), np.uint8))
        new = {"keys": keys, "place": place, "count": counts, "begin": begin, "size": size}
        for name, values in new.items():
            setattr(self, name, np.insert(getattr(self, name), at, values))

    def _others(self, data, starts, ends, rows, place, count) -> np.ndarray:
        """Puts the ids of words that are not what their hashes say at the pool's end, for this call alone."""
        raw = [data[a:b].tobytes() for a, b in zip(starts[rows].tolist(), ends[rows].tolist())]
        number = {w: k for k, w in enumerate(dict.fromkeys(raw))}
        found, counts = self.encode(list(number))
        which = np.array([number[w] for w in raw])
        place[rows] = (self.used + np.cumsum(counts) - counts)[which]
        count[rows] = np.asarray(counts)[which]
        return np.concatenate([self.pool[: self.used], found])


def _added(pool: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    if used + len(more) > len(pool):
        pool = np.concatenate([pool[:used], np.zeros(max(len(more), used) + len(more), pool.dtype)])
    pool[used : used + len(more)] = more
    return pool, used + len(more)
