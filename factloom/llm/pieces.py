"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

Texts are split where no piece can reach across: before a space mark, and around characters
that stand in no longer piece. Distinct words of equal length advance together, one character
at a time: hashes of the substrings that end there probe the sorted piece keys, each hit is a
candidate for the last piece, and the vectorised maximum over the candidates stores the
backpointer.

The model is a BPE, whose encoding is not the best-scoring path but the one path in which every
two neighbours, encoded alone, stay as they are. So a candidate's value is minus infinity where
it does not fit the best last piece before it, and exactly one candidate is left; its length
breaks what could never be a tie. Whether two pieces fit follows from undoing merges from the
boundary outwards, for many pairs at once; a direct-mapped table keeps the answers.

Defined results: null and empty texts have no ids; characters outside the model fall back to
bytes; repeated rows repeat their results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textarrays import mix, slices, texts
from .wordcache import WordCache

MARK = 0x2581
_P = np.uint64(0x9E3779B97F4A7C15)
#: Answers kept about pairs of pieces (a power of two).
PAIRS = 1 << 20


class Model:
    """The pieces of a SentencePiece BPE model with byte fallback, as arrays."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        if n > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("a model with byte fallback is wanted")
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.bytes.values())] = True
        score = np.array([sp.get_score(i) for i in range(n)])
        # merge order: by score, best first; no merge makes a piece without one
        self.rank = np.full(n, n, np.int64)
        order = np.array(plain)[np.argsort(-score[plain], kind="stable")]
        self.rank[order] = np.arange(len(order))
        self.most = max(len(self.pieces[i]) for i in plain)
        self.byte_text = [bytes([int(p[1:-1], 16)]) if b else p.encode() for p, b in zip(self.pieces, self.is_byte)]
        points = {i: [ord(c) for c in self.pieces[i]] for i in plain}
        self.size = np.ones(n, np.int64)
        self.hash = np.zeros(n, np.uint64)
        for i, p in points.items():
            self.size[i] = len(p)
            self.hash[i] = _text_hash(p)
        self.power = np.array([pow(int(_P), k, 1 << 64) for k in range(self.most + 1)], np.uint64)
        keys = mix(self.hash[plain])
        by_key = np.argsort(keys)
        self.keys, self.key_id = keys[by_key], np.array(plain)[by_key]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        joined = set()
        for p in points.values():
            if len(p) > 1:
                joined.update(p)
        self.joined = np.zeros(0x110000, bool)
        self.joined[sorted(joined)] = True
        # how each piece's last merge splits it; single characters split into themselves
        self.left, self.right = np.arange(n), np.arange(n)
        text_id = {self.pieces[i]: i for i in plain}
        for i in plain:
            if len(self.pieces[i]) > 1:
                self.left[i], self.right[i] = self._last_split(self.pieces[i], text_id)
        self.pair_key = np.full(PAIRS, -1, np.int64)
        self.pair_fits = np.zeros(PAIRS, bool)
        self.cache = WordCache(self.encode_words)
        self.runs: dict[int, list[int]] = {}
        self.text_id = text_id

    def _last_split(self, text: str, text_id: dict[str, int]) -> tuple[int, int]:
        """The two parts that the merges of the piece's own characters join last (itself twice if they never do)."""
        parts = merge(list(text), self.rank, text_id, until=2)
        if len(parts) == 2 and all(p in text_id for p in parts):
            return text_id[parts[0]], text_id[parts[1]]
        return text_id[text], text_id[text]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of raw substring hashes, -1 where there is no piece."""
        keys = mix(hashes)
        out = np.full(len(keys), -1, np.int64)
        at = np.flatnonzero(self.maybe[(keys >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[place] == keys[at]
        out[at[hit]] = self.key_id[place[hit]]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a, b next to each other stay two pieces; remembered."""
        pair = a * 65536 + b
        slot = (mix(pair.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_key[slot] != pair)
        if len(new):
            fresh, which = np.unique(pair[new], return_inverse=True)
            found = self._fits(fresh >> 16, fresh & 65535)
            out[new] = found[which]
            at = slot[new]
            self.pair_key[at], self.pair_fits[at] = pair[new], out[new]
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo merges next to the boundary, latest first; a merge across that would have come earlier spoils the pair."""
        a, b = a.copy(), b.copy()
        n = len(self.pieces)
        out = np.ones(len(a), bool)
        live = np.flatnonzero(~(self.is_byte[a] | self.is_byte[b]))  # characters outside the model never merge
        until = np.full(len(a), n + 1, np.int64)  # rank at which the parts beside the boundary got replaced
        while len(live):
            x, y = a[live], b[live]
            across = self.lookup(self.hash[x] * self.power[np.minimum(self.size[y], self.most)] + self.hash[y])
            across[self.size[x] + self.size[y] > self.most] = -1
            rank = np.where(across >= 0, self.rank[across], n + 2)
            # the parts stood side by side until the earlier of the merges that replaced them; equal
            # ranks happen only when the same merge is possible twice, and the left one goes first
            bad = rank < until[live]
            out[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            made_x = np.where(self.left[x] != x, self.rank[x], -1)
            made_y = np.where(self.left[y] != y, self.rank[y], -1)
            # whichever side's present part was made last stood for the shortest time: undo it
            go_left = made_x > made_y
            go_right = (made_y >= made_x) & (made_y >= 0)
            # a merge on the left side, if of equal rank to the one across, came first; on the right side, later
            until[live[go_left]] = made_x[go_left]
            until[live[go_right]] = made_y[go_right] + 1
            a[live[go_left]] = self.right[x[go_left]]
            b[live[go_right]] = self.left[y[go_right]]
            live = live[go_left | go_right]
        return out

    def encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, grouped by length; space marks stand as MARK."""
        words = [r.decode().replace(" ", "▁") for r in raw]
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        parts, sizes_found, at = [], [], 0
        while at < len(order):
            length = int(sizes[order[at]])
            end = int(np.searchsorted(sizes[order], length, "right"))
            step = max(1, (1 << 20) // length)
            for k in range(at, end, step):
                group = "".join([words[i] for i in order[k : min(end, k + step)]])
                ids, counts = self._viterbi(np.frombuffer(group.encode("utf-32-le"), np.uint32).reshape(-1, length))
                parts.append(ids)
                sizes_found.append(counts)
            at = end
        ids, found = np.concatenate(parts), np.concatenate(sizes_found)
        starts = np.zeros(len(words), np.int64)
        counts = np.zeros(len(words), np.int64)
        starts[order], counts[order] = np.cumsum(found) - found, found
        done = np.cumsum(counts)
        return ids[np.arange(done[-1]) + np.repeat(starts - (done - counts), counts)], counts

    def _viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length (code points, a row each), end to end, and their numbers."""
        n, length = points.shape
        sums = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            sums[i + 1] = sums[i] * _P + points[:, i].astype(np.uint64) + np.uint64(1)
        last = np.full((length + 1, n), -1, np.int64)  # the last piece of each prefix; -1: bytes of a character
        back = np.ones((length + 1, n), np.int8)
        for i in range(1, length + 1):
            best = np.full(n, -1, np.int64)
            for size in range(1, min(i, self.most) + 1):
                ids = self.lookup(sums[i] - sums[i - size] * self.power[size])
                at = np.flatnonzero(ids >= 0)
                if i > size and len(at):
                    before = last[i - size, at]
                    open_ = before < 0
                    ok = open_.copy()
                    ok[~open_] = self.fits(before[~open_], ids[at[~open_]])
                    at = at[ok]
                value = np.full(n, -1, np.int64)
                value[at] = size
                better = value > best
                best = np.maximum(best, value)
                last[i, better], back[i, better] = ids[better], size
        at = np.full(n, length, np.int64)
        pieces, places = [], []
        rows = np.arange(n)
        while (at > 0).any():  # backpointers of all words at once
            pieces.append(np.where(at > 0, last[at, rows], -2))
            at = at - np.where(at > 0, back[at, rows], 0)
            places.append(at)
        ids, where = np.array(pieces)[::-1].T, np.array(places)[::-1].T
        there = ids != -2
        counts, flat = there.sum(1), ids[there]
        unknown = np.flatnonzero(flat < 0)
        if len(unknown):  # characters outside the model become their bytes
            row = np.repeat(rows, counts)
            chars = points[row[unknown], where[there][unknown]].tolist()
            spelt = [[self.bytes[x] for x in chr(c).encode()] for c in chars]
            extra = np.ones(len(flat), np.int64)
            extra[unknown] = [len(x) for x in spelt]
            flat = np.repeat(flat, extra)
            flat[flat < 0] = [x for xs in spelt for x in xs]
            counts = np.bincount(row, extra, n).astype(np.int64)
        return flat.astype(np.uint16), counts

    def mark_run(self, n: int) -> list[int]:
        """The pieces of n space marks alone."""
        if n not in self.runs:
            self.runs[n] = [self.text_id[p] for p in merge(["▁"] * n, self.rank, self.text_id)]
        return self.runs[n]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids (uint16) of each text, the dummy prefix included."""
        full = np.flatnonzero(offsets[:-1] < offsets[1:])
        out = [np.zeros(0, np.uint16)] * (len(offsets) - 1)
        if not len(full):
            return out
        # a space before each text that has any, as the model's dummy prefix
        data = np.insert(data, offsets[:-1][full], 32)
        begins = offsets[:-1][full] + np.arange(len(full))
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        space = (points == 32) | (points == MARK)
        alone = ~self.joined[points] & ~space
        cut = space | alone
        cut[1:] |= alone[:-1]
        cut[np.searchsorted(lead, begins)] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points))
        lead = np.append(lead, len(data))
        ids, counts = self.cache.ids(data, lead[starts], lead[ends])
        done = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(starts, np.searchsorted(lead[:-1], begins))
        for row, part in zip(full, np.split(ids, done[first[1:]])):
            out[row] = self._joined_marks(part)
        return out

    def _joined_marks(self, ids: np.ndarray) -> np.ndarray:
        """Runs of bare space marks, which merge last and only with one another, as their pieces."""
        bare = ids == self.text_id["▁"]
        if not (bare[1:] & bare[:-1]).any():
            return ids
        edge = np.diff(np.concatenate([[0], bare.view(np.int8), [0]]))
        parts, at = [], 0
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            parts += [ids[at:a], np.array(self.mark_run(int(b - a)), np.uint16)]
            at = b
        return np.concatenate([*parts, ids[at:]])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: space marks as spaces, the dummy prefix gone."""
        raw = b"".join([self.byte_text[i] for i in ids.tolist()]).decode("utf-8", "replace").replace("▁", " ")
        return raw[1:] if raw.startswith(" ") else raw


def _text_hash(points: list[int]) -> int:
    h = 0
    for p in points:
        h = (h * int(_P) + p + 1) & (1 << 64) - 1
    return h


def merge(parts: list[str], rank: np.ndarray, text_id: dict[str, int], until: int = 1) -> list[str]:
    """BPE merges, best rank first and leftmost among equals, down to `until` parts."""
    parts = list(parts)
    while len(parts) > until:
        best = None
        for k in range(len(parts) - 1):
            i = text_id.get(parts[k] + parts[k + 1])
            if i is not None and (best is None or rank[i] < best[0]):
                best = (rank[i], k)
        if best is None:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """The columns `keep`, n_pieces and ids (array of int) of each whole text.

    check: decode the ids at once, in the same worker, and add `restored`: whether the text comes back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in slices(batches):
            data, offsets = texts(batch)
            found = coder.encode(data, offsets)
            counts = np.array([len(x) for x in found], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32)))
            columns = [*(batch.column(c) for c in keep), pa.array(counts), ids]
            if check:
                columns.append(pa.array([coder.decode(x).encode() == data[a:b].tobytes() for x, a, b in zip(found, offsets, offsets[1:])]))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_pieces", "ids", "restored"][: len(columns)])

    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    shape = ", ".join(f"`{c}` {dict(kept.dtypes)[c]}" for c in keep)
    return kept.mapInArrow(run, f"{shape}, n_pieces long, ids array<int>" + ", restored boolean" * check)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the text of the column ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = part.column("ids")
                found = [model(path).decode(np.asarray(x.values)) if x.is_valid else None for x in ids]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.string())], [*keep, "text"])

    kept = encoded.select(*dict.fromkeys([*keep, "ids"]))
    shape = ", ".join(f"`{c}` {dict(kept.dtypes)[c]}" for c in keep)
    return kept.mapInArrow(run, f"{shape}, text string")
