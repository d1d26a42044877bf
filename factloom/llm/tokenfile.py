"""Token ids on disk: canonical length-limited Huffman blocks with bit-offset checkpoints.

Global counts of all ids give one code (package-merge, at most LIMIT bits); its lengths are part
of the file. Documents in ascending doc_id order fill shards; a shard's blocks hold whole
documents, and can each be decoded alone: a table finds symbol and length of the next LIMIT bits,
and checkpoints, the bit offsets of every STEP-th symbol, let all stretches of a block, or of many
blocks, advance together.

Defined results: null and empty texts are the end id alone; documents of equal doc_id stand in
the order of a hash of their ids, null ids first; repeated rows are separate documents; an
empty table gives an empty file and result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .textarrays import slices, texts
from .wordcache import WordCache

END = 2
LIMIT = 18
STEP = 256
#: About how many ids a block and a shard hold.
BLOCK, SHARD = 1 << 16, 1 << 22

# Code points that the pre-tokenizer's pattern counts as white space, and its contractions.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Code points whose classes all Unicode versions agree on; texts with others go whole to the library.
PLAIN = 0x530

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


def _classes() -> np.ndarray:
    import unicodedata

    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(PLAIN)], np.uint8)
    table[[c for c in SPACES if c < PLAIN]] = _SPACE
    return table


def words(points: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts given as code points below PLAIN.

    Runs of one class are pre-tokens. Of white space before a word, the last character is a
    pre-token of its own, or, if a space, the word's first. An apostrophe alone takes the
    letters of a contraction with it.
    """
    n = len(points)
    kind = table[points]
    fresh = np.ones(n, bool)
    fresh[1:] = kind[1:] != kind[:-1]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    fresh |= begins[:n]
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], n)
    kinds = kind[starts]
    cut = fresh.copy()
    follows = np.zeros(len(starts), bool)  # another run of the same text follows
    follows[:-1] = ~begins[starts[1:]]
    blank = (kinds == _SPACE) & follows
    last = ends[blank] - 1
    cut[last] = True
    attached = np.flatnonzero(blank)[points[last] == 0x20] + 1
    cut[starts[attached]] = False
    lone = (kinds == _OTHER) & (ends - starts == 1) & (points[starts] == 0x27) & cut[starts] & follows
    lone[:-1] &= kinds[1:] == _LETTER
    for k in np.flatnonzero(lone):
        a, b = ends[k], ends[k + 1]
        letters = "".join(map(chr, points[a : min(b, a + 2)]))
        n_letters = next((len(c) - 1 for c in CONTRACTIONS if letters.startswith(c[1:])), 0)
        if n_letters:
            cut[a] = False
            if a + n_letters < b:
                cut[a + n_letters] = True
    return np.flatnonzero(cut)


class Encoder:
    """A byte-level BPE of the tokenizers library over whole texts, in arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Strings with ids of their own; texts that hold one go whole to the library.
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.table = _classes()
        self.cache = WordCache(lambda raw: self._library_ids([r.decode() for r in raw]))

    def _library_ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint16, int(counts.sum())), counts

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids (uint16) of each text."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.searchsorted(lead, offsets)
        odd = np.flatnonzero(points >= PLAIN)
        rows = np.union1d(np.searchsorted(at, odd, "right") - 1, self._with_added(data, offsets))
        if not len(rows):
            return self._plain(data, lead, points, at)
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * (len(offsets) - 1)
        ids, counts = self._library_ids([data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in rows])
        for r, part in zip(rows, np.split(ids, np.cumsum(counts)[:-1])):
            out[r] = part
        rest = np.setdiff1d(np.arange(len(out)), rows)
        if len(rest):
            kept = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rest])
            ends = np.concatenate([[0], np.cumsum(offsets[rest + 1] - offsets[rest])])
            for r, part in zip(rest, self(kept, ends)):
                out[r] = part
        return out

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold an added token's string."""
        raw, rows = data.tobytes(), []
        for needle in self.added:
            at = raw.find(needle)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(needle) <= offsets[row + 1]
                if inside:
                    rows.append(row)
                at = raw.find(needle, int(offsets[row + 1]) if inside else at + 1)
        return np.array(rows, np.int64)

    def _plain(self, data, lead, points, at) -> list[np.ndarray]:
        if not len(points):
            return [np.zeros(0, np.uint16)] * (len(at) - 1)
        inside = at[:-1] < at[1:]
        starts = words(points, np.append(at[:-1][inside], len(points)), self.table)
        ends = np.append(starts[1:], len(points))
        lead = np.append(lead, len(data))
        ids, counts = self.cache.ids(data, lead[starts], lead[ends])
        per_text = np.add.reduceat(np.append(counts, 0), np.searchsorted(starts, at[:-1])) * inside
        return np.split(ids, np.cumsum(per_text)[:-1])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_ids(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, n_tokens, ids (16-bit little-endian) of each whole text and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end], "<u2")
        for batch in slices(batches, most=1 << 22):
            found = [np.concatenate([x, tail]) for x in encoder(path)(*texts(batch))]
            counts = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "n_tokens", "ids"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, n_tokens long, ids binary")


def count_ids(ids: DataFrame) -> np.ndarray:
    """How often each id stands in all documents; at most 65,536 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                counts += np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(k, 512).to_pylist()), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.id] = r.n
    return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that never stand."""
    symbols = np.flatnonzero(counts)
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    weights, n = counts[symbols].astype(np.int64), len(symbols)
    lengths = np.zeros(len(counts), np.uint8)
    if n < 2:
        lengths[symbols] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    taken = 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:taken].sum())
        lengths[symbols[:leaves]] += 1
        taken = 2 * (taken - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id: each is the one before, plus one, with zeros appended."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for s in order.tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
    """(bits, checkpoints: bit offset of every step-th id)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word = at >> 5
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    bits = out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8]
    return bits, at[::step].astype("<u4").tobytes()


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each value of the next `limit` bits."""
    codes = canonical_codes(lengths)
    symbol, size = np.zeros(1 << limit, np.uint16), np.zeros(1 << limit, np.uint8)
    for s in np.flatnonzero(lengths).tolist():
        low = int(codes[s]) << (limit - int(lengths[s]))
        high = low + (1 << (limit - int(lengths[s])))
        symbol[low:high], size[low:high] = s, lengths[s]
    return symbol, size


def decode_blocks(blocks: list[tuple[bytes, bytes, int]], table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT, step: int = STEP) -> list[np.ndarray]:
    """The ids of blocks given as (bits, checkpoints, number of ids); all stretches advance together."""
    symbol, size = table
    data = np.frombuffer(b"".join(bits for bits, _, _ in blocks) + b"\0" * 4, np.uint8).astype(np.uint32)
    window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
    begin, lanes, left = 0, [], []
    for bits, marks, n in blocks:
        lanes.append(np.frombuffer(marks, "<u4").astype(np.int64) + 8 * begin)
        left.append(np.minimum(step, n - step * np.arange(len(lanes[-1]))))
        begin += len(bits)
    at, left = np.concatenate(lanes), np.concatenate(left)
    out = np.zeros((len(at), step), np.uint16)
    full = (left == step).all()
    for k in range(step):
        live = slice(None) if full else np.flatnonzero(left > k)
        here = at[live]
        peek = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[live, k] = symbol[peek]
        at[live] = here + size[peek]
    ids = out[np.arange(step)[None, :] < left[:, None]]
    return np.split(ids, np.cumsum([n for _, _, n in blocks])[:-1])


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, block: int = BLOCK, shard: int = SHARD) -> None:
    """Write the token file of docs to `path`: blocks (Parquet rows in shard, block order) and the code."""
    spark = docs.sparkSession
    ids = scratch.materialize(token_ids(docs, tokenizer, end), "token-ids")
    counts = count_ids(ids)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    shared = spark.sparkContext.broadcast((lengths, codes))  # 65,536 lengths and codes
    kind = dict(ids.dtypes)["doc_id"]
    fields = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64() if kind == "bigint" else pa.string())), ("counts", pa.list_(pa.int64())), ("marks", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value
        part, number = TaskContext.get().partitionId(), 0
        docs_held: list = []
        counts_held: list[int] = []
        raw: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(raw), "<u2")
            bits, marks = encode_block(whole, lengths, codes)
            row = [part, number, len(whole), list(docs_held), list(counts_held), marks, bits]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields)], schema=fields)

        for batch in batches:
            for doc_id, n, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                docs_held.append(doc_id)
                counts_held.append(n)
                raw.append(x)
                held += n
                if held >= block:
                    yield closed()
                    number += 1
                    docs_held, counts_held, raw, held = [], [], [], 0
        if raw:
            yield closed()

    # equal rows can stand in any order, so their places in the table spread them over ranges
    tie, salt = F.xxhash64("ids"), F.monotonically_increasing_id()
    parts = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // shard))
    keyed = ids.withColumn("tie", tie).withColumn("salt", salt)
    ordered = keyed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie", "salt").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    blocks = ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"shard int, block int, n_tokens long, doc_ids array<{kind}>, counts array<long>, marks binary, bits binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    scratch.drop(spark, ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (32-bit little-endian) from a token file."""
    return _read(spark, path, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from a token file: as `read`, with the checksum of ids for ids."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, field: str, make, kind: pa.DataType) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first().lengths), np.uint8)
    shared = spark.sparkContext.broadcast(lengths)
    doc_kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]
    name = field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value)
        for batch in batches:
            k = 0
            while k < batch.num_rows:
                n, total = 1, batch.column("n_tokens")[k].as_py()
                while k + n < batch.num_rows and total < 1 << 20:
                    total += batch.column("n_tokens")[k + n].as_py()
                    n += 1
                part = batch.slice(k, n)
                k += n
                cols = {c: part.column(c).to_pylist() for c in ("shard", "block", "doc_ids", "counts")}
                found = decode_blocks(list(zip(*(part.column(c).to_pylist() for c in ("bits", "marks", "n_tokens")))), table)
                for shard, number, doc_ids, counts, ids in zip(*cols.values(), found):
                    ends = np.cumsum(counts)
                    made = [make(x) for x in np.split(ids, ends[:-1])]
                    m = len(doc_ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * m, pa.int32()), pa.array([number] * m, pa.int32()), pa.array(doc_ids, pa.int64() if doc_kind == "bigint" else None), pa.array(ends - counts), pa.array(counts, pa.int64()), pa.array(made, kind)],
                        ["shard", "block", "doc_id", "within", "n_tokens", name],
                    )

    shape = f"shard int, block int, doc_id {doc_kind}, within long, n_tokens long, {field}"
    decoded = blocks.select("shard", "block", "n_tokens", "doc_ids", "counts", "marks", "bits").mapInArrow(run, shape)
    # ids before each shard, then before each block of it
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("block_start")).join(shards, "shard")
    joined = decoded.join(starts, ["shard", "block"])
    return joined.select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("within")).alias("start"), "n_tokens", name)
