import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import media, queries

from . import cases


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))


def test_query_reads_back_every_payload(spark, tmp_path):
    rng = random.Random(4)
    long = cases.prose(rng, 30_000)
    data = cases.rows() + [(500, long, "en", "s", 1), (501, "x" + long, "en", "s", 1), (502, long[:60_000] + " edit " + long[60_000:], "en", "s", 1), (503, "a" * 200_000, "en", "s", 1), (504, "b" * 576, "en", "s", 1)]
    cases.docs(spark, data).withColumn("pack", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_media(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in data:
        whole = padded(text)
        want.append((str(doc_id), len((text or "").encode()), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), media.features(whole)))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got) == sorted(want)
    assert len({r.media_sha256 for r in got}) == len({padded(r[1]) for r in data})
    packs = media.store(cases.docs(spark, data)).collect()
    bodies = [b for p in packs for b in p.bodies if b is not None]
    digests = {d for p in packs for d in p.digests}
    assert len(bodies) == len(digests) < sum(len(p.digests) for p in packs)


def test_cuts_follow_the_content():
    rng = random.Random(9)
    data = bytes(rng.randrange(256) for _ in range(300_000))
    ends = media.cuts(data)
    lengths = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(media.LEAST <= n <= media.MOST for n in lengths[:-1])
    moved = media.cuts(b"shift" + data)
    assert len({data[a:b] for a, b in zip([0, *ends], ends)} & {(b"shift" + data)[a:b] for a, b in zip([0, *moved], moved)}) >= len(ends) - 3
    h = media.gear(media.np.frombuffer(data[:200], media.np.uint8))
    assert int(h[150]) == sum(int(media._GEAR[data[150 - j]]) << j for j in range(16)) % 65536


def test_damage_is_noticed():
    good = media.bz2.compress(b"samples", 1)
    assert media.unpack([media.digest(b"samples")], [7], [good]) == b"samples"
    with pytest.raises(ValueError):
        media.unpack([media.digest(b"sample_")], [7], [good])


def test_empty_table(spark):
    assert media.media_features(cases.empty(spark)).collect() == []
