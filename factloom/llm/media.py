"""Media columns as content-defined chunks: gear-hash cuts, digests deduplicated by joins, verified restores.

A text's UTF-8 bytes, padded with 255 to a positive multiple of `frame`, are its payload: 8-bit
samples. A rolling gear hash cuts payloads; each chunk is stored as a bzip2 stream named by its
digest. A pack holds one distinct payload: its ordered chunk list, and the stored bytes of those
chunks that it owns. A join over all digests finds chunks that several payloads, or places of a
payload, share; the smallest place owns the bytes, the others refer to them. Restoring joins the
references back, checks every digest and length, and needs no shuffle for packs without any.

Defined results: null and empty texts are one frame of padding; equal texts share a pack; rows
are independent, so repeated rows repeat their results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import bz2
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .textarrays import Recent, mix, slices

FRAME = 576
#: Bytes of a chunk: least, most, and the bits that a cut's hash has zero (8 KiB more on average).
LEAST, MOST, BITS = 2048, 65536, 13

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(16)).astype(np.uint16)


def payload(text: bytes, frame: int = FRAME) -> bytes:
    return text + b"\xff" * (frame - len(text) % frame if len(text) % frame or not text else 0)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < 16 of table[data[i - j]] << j, modulo 2 ** 16: the rolling gear hash."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: a zero hash at LEAST bytes or more, or MOST bytes."""
    if len(data) <= LEAST:
        return [len(data)]
    zero = np.flatnonzero((gear(np.frombuffer(data, np.uint8)) & np.uint16((1 << BITS) - 1)) == 0) + 1
    ends, at = [], 0
    while at < len(data):
        k = np.searchsorted(zero, at + LEAST)
        at = min(int(zero[k]) if k < len(zero) else len(data), at + MOST, len(data))
        ends.append(at)
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, bytes, list[int]]]:
    """(id, bytes, payload, chunk ends) of the texts that this task has not just had."""
    seen = Recent()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            if seen.add(key := hashlib.sha256(raw).digest()):
                yield key, len(raw), (whole := payload(raw)), cuts(whole)


_PACK = pa.schema([("pack", pa.binary()), ("n_bytes", pa.int64()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("bodies", pa.list_(pa.binary()))])


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _chunk_rows(batches):
    def rows():
        for key, _, whole, ends in _contents(batches):
            at = 0
            for seq, end in enumerate(ends):
                yield key, seq, digest(whole[at:end])
                at = end

    yield from _in_batches(rows(), pa.schema([("pack", pa.binary()), ("seq", pa.int32()), ("digest", pa.binary())]), 20_000)


def _pack_rows(batches):
    def rows():
        for key, n, whole, ends in _contents(batches):
            parts = [whole[a:b] for a, b in zip([0, *ends], ends)]
            yield key, n, [digest(p) for p in parts], [len(p) for p in parts], [bz2.compress(p, 1) for p in parts]

    yield from _in_batches(rows(), _PACK)


def names(docs: DataFrame) -> DataFrame:
    """doc_id, pack: which pack holds each document's payload."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("pack"))


def store(docs: DataFrame) -> DataFrame:
    """The packs: pack, n_bytes, digests, lengths, bodies (null where another place owns them), lent, borrowed."""
    text = docs.select("text")
    chunks = text.mapInArrow(_chunk_rows, "pack binary, seq int, digest binary")
    place = F.struct("pack", "seq")
    shared = chunks.groupBy("digest").agg(F.min(place).alias("owner"), F.max(place).alias("last")).filter("owner <> last").select("digest", "owner")
    shared = materialize(shared, "media-shared")  # written, so that a chunk that very many payloads hold splits in the join
    found = chunks.join(shared, "digest").select("pack", "seq", (F.col("owner") == place).alias("own"))
    found = found.groupBy("pack").agg(F.collect_set(F.when(F.col("own"), F.col("seq"))).alias("lent"), F.collect_set(F.when(~F.col("own"), F.col("seq"))).alias("borrowed"))
    packs = text.mapInArrow(_pack_rows, "pack binary, n_bytes long, digests array<binary>, lengths array<int>, bodies array<binary>").dropDuplicates(["pack"])
    none = F.array().cast("array<int>")
    packs = packs.join(found, "pack", "left").withColumns({c: F.coalesce(c, none) for c in ("lent", "borrowed")})
    return packs.withColumn("bodies", F.expr("transform(bodies, (b, i) -> if(array_contains(borrowed, i), null, b))"))


def restorable(packs: DataFrame) -> DataFrame:
    """The packs with all bodies; only packs that borrow, and chunks that are lent, are shuffled."""
    columns = ["pack", "n_bytes", "digests", "lengths", "bodies"]
    whole = packs.filter(F.size("borrowed") == 0).select(columns)
    partial = packs.filter(F.size("borrowed") > 0)
    wanted = partial.select("pack", F.col("digests"), F.explode("borrowed").alias("seq")).select("pack", "seq", F.col("digests")[F.col("seq")].alias("digest"))
    lent = packs.filter(F.size("lent") > 0).select("digests", "bodies", F.explode("lent").alias("seq")).select(F.col("digests")[F.col("seq")].alias("digest"), F.col("bodies")[F.col("seq")].alias("body"))
    got = wanted.join(lent, "digest").groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("seq", "body"))).alias("got"))
    filled = partial.join(got, "pack").withColumn("bodies", F.expr("transform(bodies, (b, i) -> coalesce(b, got[i]))"))
    return whole.union(filled.select(columns))


def unpack(digests: list[bytes], lengths: list[int], bodies: list[bytes]) -> bytes:
    """The payload from its stored chunks; every digest and length is checked."""
    parts = [bz2.decompress(b) for b in bodies]
    for part, want, length in zip(parts, digests, lengths, strict=True):
        if len(part) != length or digest(part) != want:
            raise ValueError(f"chunk {want.hex()} does not restore")
    return b"".join(parts)


def features(whole: bytes) -> str:
    """Mean, root mean square about 128 and crossings of 128 of the samples, in fixed digits."""
    x = np.frombuffer(whole, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={x.mean() + 128:.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};peak={int(np.abs(x).max())}"


_MEASURED = pa.schema(
    [("pack", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _measure_rows(batches):
    def rows():
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for key, n, digests, lengths, bodies in zip(*(part.column(c).to_pylist() for c in _PACK.names)):
                    whole, media = unpack(digests, lengths, bodies), hashlib.sha256()
                    for b in bodies:
                        media.update(b)
                    yield key, n, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), sum(map(len, bodies)), media.hexdigest(), features(whole)

    yield from _in_batches(rows(), _MEASURED)


def measured(packs: DataFrame) -> DataFrame:
    """What the payloads that are read back from packs show, one row a pack."""
    return restorable(packs).mapInArrow(
        _measure_rows,
        "pack binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id with the measures of its stored payload."""
    packs = materialize(store(docs), "media-packs", codec="none")
    return names(docs).join(measured(packs), "pack").drop("pack")
