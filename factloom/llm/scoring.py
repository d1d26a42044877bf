"""Probabilities of texts under a model of words over a lattice of subword pieces.

A text is its words, in lower case, and an end. A word's probability is that of all its
segmentations: the forward recursion runs over its bytes in log space and sums what every path of
pieces comes to. The pieces are those of an existing vocabulary, whose scores (the lower, the later
a piece was made) give the weights to start with, 1 / (SHIFT - score); expected counts of pieces
over the training words (forward and backward, each distinct word once) then re-estimate them, with
the weights from the scores as pseudo-counts. As no piece goes beyond a word, a text's lattice is
its words' lattices one after the other, and its marginal probability is their product.

Words of the training texts are arcs of their own across the whole word: an arc has the word's
count less a discount, and what the discounts leave goes to the paths of pieces. So known words
come near their share, and any other string still has its probability; all strings sum to one.

Counts are kept for whole slices of texts: a slice has its sequence of word numbers and a row for
each of its words; the rows meet the corpus' counts in a join and come back to their slice. So no
task holds the corpus' words; the driver receives six sums and, in each round of re-estimation, one
number a piece.

Defined results: null and empty texts are an end alone; a null doc_id counts as an empty number;
without training texts the existing scores alone weight the pieces; repeated rows count each time;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize
from .textarrays import LOWER, slices

#: Words of a slice, about.
SLICE = 1 << 21
#: What is added to a piece's place in the vocabulary, rounds of re-estimation, and pseudo-counts in all.
SHIFT, ROUNDS, PRIOR = 10.0, 2, 1000.0
#: Contract of the plain score: what is added to counts.
PLUS = 0.1
ROWS = 1 << 16
_MARK = "▁".encode()
_LOWER = LOWER.tobytes()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


# Pieces ------------------------------------------------------------------------------------


class Lattice:
    """Pieces with log probabilities, and sums over all segmentations of a word into them.

    A word's first piece begins with the space mark, later ones don't; single bytes are pieces
    where the vocabulary has them as such, so every word has a segmentation.
    """

    def __init__(self, path: str, weights: np.ndarray | None = None):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.number: dict[bytes, int] = {}
        single: dict[bytes, int] = {}
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                single[bytes([int(piece[1:-1], 16)])] = i
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)) and "▁" not in piece[1:]:
                self.number[piece.encode()] = i
        if len(single) != 256:
            raise ValueError("a vocabulary with byte pieces is wanted")
        self.number = single | self.number  # a character's own piece goes before its byte
        used = np.zeros(self.size, bool)
        used[list(self.number.values())] = True
        score = np.array([0.0 if not u else -float(self.size) if sp.is_byte(i) else sp.get_score(i) for i, u in enumerate(used)])
        start = np.where(used, 1 / (SHIFT - score), 0.0)
        self.prior = start / start.sum()
        self.weigh(self.prior if weights is None else weights)

    def weigh(self, weights: np.ndarray) -> None:
        self.log = {i: math.log(weights[i]) for i in self.number.values()}
        self.arcs: dict[bytes, tuple[int, float] | None] = {}
        for piece in self.number:
            for k in range(1, len(piece)):
                self.arcs.setdefault(piece[:k], None)  # goes on to a piece, but is none
        for piece, i in self.number.items():
            self.arcs[piece] = i, self.log[i]

    def _paths(self, word: bytes) -> tuple[list[float], list[tuple[int, int, int, float]]]:
        """Log sums of all paths to each place, and the arcs (from, to, piece, log probability) in order."""
        raw, get = _MARK + word, self.arcs.get
        n = len(raw)
        minus = -math.inf
        alpha, arcs = [minus] * (n + 1), []
        alpha[0] = 0.0
        for begin in range(n):
            here = alpha[begin]
            if here == minus:
                continue
            for end in range(begin + 1 if begin else len(_MARK), n + 1):
                piece = get(raw[begin:end], 0)
                if piece == 0:
                    break
                if piece is None:
                    continue
                arcs.append((begin, end, *piece))
                there, before = here + piece[1], alpha[end]
                if before == minus:
                    alpha[end] = there
                elif before > there:
                    alpha[end] = before + math.log1p(math.exp(there - before))
                else:
                    alpha[end] = there + math.log1p(math.exp(before - there))
        return alpha, arcs

    def log_marginal(self, word: bytes) -> float:
        """Natural logarithm of the summed probability of all segmentations."""
        return self._paths(word)[0][-1]

    def expect(self, word: bytes, out: np.ndarray) -> None:
        """Adds to out how often each piece is expected in the word's segmentation."""
        alpha, arcs = self._paths(word)
        whole = alpha[-1]
        beta = [-math.inf] * len(alpha)
        beta[-1] = 0.0
        for begin, end, piece, log in reversed(arcs):
            after = beta[end]
            if after == -math.inf:
                continue
            there, before = log + after, beta[begin]
            out[piece] += math.exp(alpha[begin] + there - whole)
            if before == -math.inf:
                beta[begin] = there
            elif before > there:
                beta[begin] = before + math.log1p(math.exp(there - before))
            else:
                beta[begin] = there + math.log1p(math.exp(before - there))


# Slices ------------------------------------------------------------------------------------

#: A row is a slice (its documents, lengths and word numbers; n: training documents), or word `no` of a slice (n: its training count).
_FIELDS = [("slice", pa.int64()), ("no", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("ids", pa.binary()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
_ROW = pa.schema(_FIELDS)
_ROW_SQL = "slice long, no int, word binary, n long, ids binary, docs array<long>, lengths array<long>"


def _columns(rows: int, **given: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(name, pa.nulls(rows, kind)) for name, kind in _FIELDS], schema=_ROW)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slice_rows(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def finished():
            sizes = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
            training = np.repeat([not held_out(d) for d in docs], sizes)
            counts = np.bincount(ids[training], minlength=len(words))
            given = {"slice": pa.array([number], pa.int64()), "n": pa.array([sum(not held_out(d) for d in docs)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary())}
            yield _columns(1, **given, docs=pa.array([docs], pa.list_(pa.int64())), lengths=pa.array([sizes], pa.list_(pa.int64())))
            known = pa.array(list(words), pa.binary())
            for k in range(0, len(words), ROWS):
                part = known.slice(k, ROWS)
                m = len(part)
                yield _columns(m, slice=pa.array(np.full(m, number)), no=pa.array(np.arange(k, k + m, dtype=np.int32)), word=part, n=pa.array(counts[k : k + m]))

        words, docs, parts, held = _Numbers(), [], [], 0
        for batch in slices(batches):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                docs.append(doc_id)
                parts.append(np.fromiter(map(words.__getitem__, (raw or b"").translate(_LOWER).split()), np.int32))
                held += len(parts[-1]) + 1
                if held >= most:
                    yield from finished()
                    words, docs, parts, held = _Numbers(), [], [], 0
                    number += 1
        if docs:
            yield from finished()

    return run


# Model -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """words: table (word, c); the sums of the training texts; weights: a probability for each piece."""

    words: DataFrame
    tokens: int
    ends: int
    types: int
    once: int
    twice: int
    vocabulary: str
    weights: np.ndarray

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    @property
    def log_end(self) -> float:
        """Base-10 logarithm of the end's probability."""
        return math.log10((self.ends + 0.5) / (self.tokens + 1))

    def base(self, c: np.ndarray) -> np.ndarray:
        """Base-10 logarithms of the plain scores of tokens with these counts."""
        types = self.types + (self.ends > 0)
        return np.log10((c + PLUS) / (self.tokens + PLUS * (types + 1)))

    def log_words(self, words: list[bytes], c: np.ndarray, lattice: Lattice) -> np.ndarray:
        """Base-10 logarithms of the words' probabilities: an arc across the word, and all paths of pieces."""
        n = self.tokens - self.ends
        paths = np.array([lattice.log_marginal(w) for w in words])
        if n:
            escape = math.log(self.discount * self.types / n)
            with np.errstate(divide="ignore"):
                paths = np.logaddexp(np.log(np.maximum(c - self.discount, 0) / n), escape + paths)
        return (paths + math.log1p(-((self.ends + 0.5) / (self.tokens + 1)))) / math.log(10)


def _expected_rows(vocabulary: str, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary, weights)
        out = np.zeros(lattice.size)
        for batch in batches:
            for word in batch.column("word").to_pylist():
                lattice.expect(word, out)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["piece", "expected"])

    return run


def _fit(rows: DataFrame, vocabulary: str, rounds: int) -> Model:
    counts = rows.filter("no is not null").groupBy("word").agg(F.sum("n").alias("c"))
    words = materialize(counts, "lm-words")
    ends = rows.filter("no is null").agg(F.sum("n")).first()[0] or 0
    sums = words.agg(F.sum("c"), *[F.count_if(x) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]).first()
    lattice = Lattice(vocabulary)
    weights = lattice.prior
    for _ in range(rounds if sums[0] else 0):
        expected = words.filter("c > 0").select("word").mapInArrow(_expected_rows(vocabulary, weights), "piece int, expected double")
        got = np.zeros(lattice.size)
        for piece, n in expected.groupBy("piece").agg(F.sum("expected")).collect():  # at most one row a piece
            got[piece] = n
        weights = (got + PRIOR * lattice.prior) / (got.sum() + PRIOR)
    return Model(words, (sums[0] or 0) + ends, ends, *sums[1:], vocabulary, weights)


def _word_rows(model: Model):
    about = Model(None, *(getattr(model, f) for f in ("tokens", "ends", "types", "once", "twice", "vocabulary", "weights")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(about.vocabulary, about.weights)
        for batch in batches:
            c = batch.column("c").to_numpy()
            log = about.log_words(batch.column("word").to_pylist(), c, lattice)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c), pa.array(log)], ["word", "c", "log"])

    return run


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORE_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_rows(model: Model):
    about = Model(None, *(getattr(model, f) for f in ("tokens", "ends", "types", "once", "twice", "vocabulary", "weights")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = float(about.base(np.array([about.ends]))[0]), about.log_end
        for batch in batches:
            for ids, docs, lengths, known in zip(batch.column("ids").to_pylist(), *(batch.column(c) for c in ("docs", "lengths", "known"))):
                ids, docs, lengths = np.frombuffer(ids, np.int32), docs.values, lengths.values.to_numpy()
                of = np.repeat(np.arange(len(lengths)), lengths)
                at = known.values.field("no").to_numpy() if known.is_valid else np.zeros(0, np.int32)
                c, log = np.zeros(len(at), np.int64), np.zeros(len(at))
                if len(at):
                    c[at], log[at] = known.values.field("c").to_numpy(), known.values.field("log").to_numpy()
                total = lambda x: np.bincount(of, x[ids], minlength=len(lengths))
                held = [held_out(d) for d in docs.to_pylist()]
                known_tokens = total(c > 0).astype(np.int64) + (about.ends > 0)
                columns = [docs, held, lengths + 1, known_tokens, np.full(len(held), about.tokens), total(about.base(c)) + end[0], total(log) + end[1]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, _SCORE)], schema=_SCORE)

    return run


def score(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS, most: int = SLICE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    Learns from documents that are not held out. score: base-10 logarithm of the text's marginal
    probability; base_score: that of words by their counts, PLUS added.
    """
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_slice_rows(most), _ROW_SQL), "lm-slices")
    model = _fit(rows, vocabulary, rounds)
    scored = materialize(model.words.mapInArrow(_word_rows(model), "word binary, c long, log double"), "lm-scores")
    drop(docs.sparkSession, model.words)
    # a word of very many slices has a row in each; such a key splits as a skewed join
    known = rows.filter("no is not null").select("slice", "no", "word").join(scored, "word").groupBy("slice").agg(F.collect_list(F.struct("no", "c", "log")).alias("known"))
    given = rows.filter("no is null").select("slice", "ids", "docs", "lengths")
    return given.join(known.hint("shuffle_hash"), "slice", "left").mapInArrow(_score_rows(model), _SCORE_SQL)
