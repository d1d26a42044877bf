"""Quality classifier by importance resampling over hashed n-grams.

Two generative models share one hashed n-gram space (words and punctuation runs, and pairs of
them; all repeats of a word are one pair): the target model counts documents labelled good, the raw
model counts every document. A document's log ratio of the two, averaged over its n-grams, times
SCALE, is its log importance weight: as if every document gave the evidence of SCALE n-grams, so
that length doesn't decide. Gumbel top-k draws k documents without replacement, with chances in
proportion to the weights: its key is the log weight plus seeded Gumbel noise. k comes from the
data: a cut fitted on held-out labelled rows tells how many documents are likely to be good. The
cut does nothing else; documents near it go in or out by their weights and the draw.

Labels: at most `most_labels` labelled ids of each class are fitted, those with the smallest
seeded hash (a documented bound; every count of the raw text covers all documents); of several
rows with one labelled id the smallest text counts.

Defined results: null and empty texts have no n-grams and log weight 0; where no document of
either class is labelled, all weights are 0 and all documents are drawn; documents without a label
are scored like others; ties at the k-th key all stay; identical rows share a key; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .textarrays import mix, prefix_sums, runs, set_aside, slices, span_hashes, texts

BUCKETS = 1 << 16
#: Pseudo-count of a bucket: what rare n-grams say counts little.
PRIOR = 2.0
#: N-grams that a document's log weight counts for; n-grams that a short text is taken to have besides its own.
SCALE, SHORT = 10.0, 8.0
#: Bins of a log weight's unit, in which labelled rows are counted to fit the cut.
BINS = 64

_PUNCTUATION = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
_WORDS = np.array([b > 32 for b in range(256)]) & ~_PUNCTUATION & (np.arange(256) != 127)


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row number of every word, punctuation run and pair of neighbours."""
    parts = [runs(data, offsets, m) for m in (_WORDS, _PUNCTUATION)]
    starts, ends, row = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(starts, kind="stable")
    starts, ends, row = starts[order], ends[order], row[order]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = span_hashes(prefix_sums(data), starts, ends)
    pair = mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
    pair[one[1:] == one[:-1]] = 0  # a repeated word, whichever it is
    same = row[1:] == row[:-1]
    hashes = np.concatenate([one, pair[same]])
    return (hashes % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[1:][same]])


def _bucket_counts(docs: DataFrame, buckets: int) -> dict[str, np.ndarray]:
    """Counts a bucket of n-grams, by the value of column `part`; one row of `buckets` longs a task and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            bucket, row = ngrams(*texts(batch), buckets)
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            for part in set(parts):
                held.setdefault(part, np.zeros(buckets, np.int64))
                held[part] += np.bincount(bucket[(parts == part)[row]], minlength=buckets)
        for part, counts in held.items():
            at = np.flatnonzero(counts)
            for k in range(0, len(at), 8192):
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at[k : k + 8192])), pa.array(at[k : k + 8192]), pa.array(counts[at[k : k + 8192]])], ["part", "bucket", "n"])

    counted = docs.select("text", "part").mapInArrow(run, "part string, bucket long, n long").groupBy("part", "bucket").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for r in counted.toLocalIterator():  # at most `buckets` rows a part, whatever the input
        out.setdefault(r.part, np.zeros(buckets, np.int64))[r.bucket] = r.n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(target / raw) of each bucket; where nothing is known, 0."""
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.log((target + prior) / (expected + prior))


def scores(docs: DataFrame, ratios: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, log_ratio (mean over the n-grams; of a short text, drawn towards 0), n_grams of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # `buckets` doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bucket, row = ngrams(*texts(batch), len(shared.value))
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.bincount(row, shared.value[bucket], minlength=batch.num_rows)
            mean = pa.array(total / (n + SHORT))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), mean, pa.array(n.astype(np.int64))], [*keep, "log_ratio", "n_grams"])

    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    shape = ", ".join(f"`{c}` {dict(kept.dtypes)[c]}" for c in keep)
    return kept.mapInArrow(run, f"{shape}, log_ratio double, n_grams long")


def best_cut(good: dict[int, int], bad: dict[int, int], cost: float = 4.0) -> int:
    """The bin from which documents count as good, at the least cost; a good one below it costs `cost`, a bad one above it 1."""
    lost = sum(bad.values())
    best, cut = lost, min([*good, *bad])
    for at in sorted({*good, *bad}):
        lost += cost * good.get(at, 0) - bad.get(at, 0)
        if lost < best:
            best, cut = lost, at + 1
    return cut


def _labelled(docs: DataFrame, labels: DataFrame, most: int, seed: int) -> DataFrame:
    """doc_id, text, quality, half of at most `most` labelled ids a class."""
    clean = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    by_hash = F.xxhash64("doc_id", F.lit(seed))
    chosen = None
    for q in (0, 1):
        part = clean.filter(F.col("quality") == q).orderBy(by_hash, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)).cast("string")
    # at most 2 x most ids, whatever the input: small enough to broadcast, and other texts are not shuffled
    found = docs.select("doc_id", "text").join(F.broadcast(chosen) if most <= 100_000 else chosen, "doc_id")
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).withColumn("half", half)


def _bin(log_ratio: Column) -> Column:
    return F.floor(log_ratio * SCALE * BINS).cast("long")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most_labels: int = 20_000, seed: int = 42) -> tuple[np.ndarray, int] | None:
    """Log ratios and the cut (a bin of log weights); None where a class has no labelled document.

    The cut comes from rows that the target model for them has not seen: two halves of the
    labelled rows score each other, and only counts by class and bin leave the executors.
    """
    labelled = materialize(_labelled(docs, labels, most_labels, seed), "quality-labelled")
    if labelled.filter("quality = 0").isEmpty() or labelled.filter("quality = 1").isEmpty():
        return None
    raw = _bucket_counts(docs.select("text", F.lit("raw").alias("part")), buckets).get("raw", np.zeros(buckets, np.int64))
    halves = _bucket_counts(labelled.filter("quality = 1").select("text", F.col("half").alias("part")), buckets)
    none = np.zeros(buckets, np.int64)
    held: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for half in ("0", "1"):
        unseen = log_ratios(halves.get("1" if half == "0" else "0", none), raw)
        binned = scores(labelled.filter(F.col("half") == half), unseen, keep=("quality",)).groupBy("quality", _bin(F.col("log_ratio")).alias("bin")).count()
        for r in binned.collect():  # log ratios are bounded by the counts' logarithm, so bins are few
            held[r.quality][r.bin] = held[r.quality].get(r.bin, 0) + r["count"]
    return log_ratios(halves.get("0", none) + halves.get("1", none), raw), best_cut(held[1], held[0])


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column key: each count over at most 4,097 ranges narrows it."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k < 1:
        return None
    high += 1
    while high - low > 1:
        width = max(1, (high - low) >> 12)
        inside = keys.filter((F.col("key") >= low) & (F.col("key") < high))
        for r in sorted(inside.groupBy(F.expr(f"(key - cast({low} as bigint)) div cast({width} as bigint)").alias("g")).count().collect(), key=lambda r: -r.g):
            if k <= r["count"]:
                low, high = low + r.g * width, min(high, low + (r.g + 1) * width)
                break
            k -= r["count"]
        else:
            return None
    return low


def _weighted(scored: DataFrame, seed: int) -> DataFrame:
    """scored with log_weight and its Gumbel key, in millionths; both depend on the row alone."""
    uniform = (F.xxhash64("doc_id", "log_ratio", "n_grams", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    key = F.col("log_weight") - F.log(-F.log(uniform))
    return scored.withColumn("log_weight", F.col("log_ratio") * SCALE).withColumn("key", F.floor(key * 1e6).cast("long"))


def _threshold(keyed: DataFrame, cut: int, size: int | None) -> int | None:
    """The key of the last document drawn: of `size`, or of as many as are likely to be good."""
    return kth_largest(keyed.select("key"), keyed.filter(_bin(F.col("log_ratio")) >= cut).count() if size is None else size)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 42, size: int | None = None, **how) -> DataFrame:
    """doc_id, log_ratio, n_grams, log_weight, key, kept of every document. size: how many are drawn, else as many as are likely to be good."""
    model = fit(docs, labels, seed=seed, **how)
    none = docs.select("doc_id", F.lit(0.0).alias("log_ratio"), F.lit(0).cast("long").alias("n_grams"))
    ratios, cut = model or (None, 0)
    keyed = materialize(_weighted(none if ratios is None else scores(docs, ratios), seed), "quality-keys")
    least = _threshold(keyed, cut, size)
    return keyed.withColumn("kept", F.lit(False) if least is None else F.col("key") >= least)


def keep(docs: DataFrame, labels: DataFrame, seed: int = 42, **how) -> DataFrame:
    """The documents that `resample` keeps, with all their columns; texts are scored twice, not shuffled."""
    model = fit(docs, labels, seed=seed, **how)
    if model is None:
        return docs
    least = _threshold(materialize(_weighted(scores(docs, model[0]), seed), "quality-keys"), model[1], None)
    if least is None:
        return docs.limit(0)
    renamed, restored = set_aside(docs, "doc_id", "text")
    both = _weighted(scores(renamed, model[0], keep=tuple(renamed.columns)), seed)
    return restored(both.filter(F.col("key") >= least))
