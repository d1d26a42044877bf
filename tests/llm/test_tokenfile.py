import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import queries, tokenfile

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["don't we'll I'd they've you're 'tis ''s 'stuff a's! 'S rock'n'roll", "  two  spaces\n\nlines \t tab nbsp end  ", "naïve façade ½ x² 3rd №5", "中文 текст 😀 mixed don't", "<|endoftext|> inside", "'", " '", " 's", "a b c　d", "\x85 x\x1cy"]


def arrays(strings):
    raw = [s.encode() for s in strings]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_ids_equal_the_library():
    rng = random.Random(6)
    strings = ODD + [""] + [r[1] or "" for r in cases.rows()]
    strings += ["".join(rng.choice("ab'st  \n\t.,!é1½dlveréñ-") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    encoder = tokenfile.encoder(PATH)
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(strings, add_special_tokens=False)]
    got = encoder(*arrays(strings))
    assert [x.tolist() for x in got] == want


@pytest.mark.parametrize("seed", range(5))
def test_code_is_optimal_within_its_limit(seed):
    import heapq

    rng = random.Random(seed)
    counts = np.array([int(2 ** rng.uniform(0, 20)) if rng.random() < 0.8 else 0 for _ in range(200)] + [0] * 50)
    lengths = tokenfile.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= tokenfile.LIMIT
    assert sum(2.0 ** -int(n) for n in lengths if n) == 1
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    unlimited = cost
    assert (counts * lengths).sum() >= unlimited
    if tokenfile.code_lengths(counts, 60).max() <= tokenfile.LIMIT:
        assert (counts * lengths).sum() == unlimited
    short = tokenfile.code_lengths(counts, 8)
    assert short.max() <= 8 and sum(2.0 ** -int(n) for n in short if n) <= 1


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    counts = np.zeros(1 << 16, np.int64)
    parts = [np.minimum(rng.geometric(0.002, n), 60_000).astype(np.uint16) for n in (1, 255, 256, 257, 70_000)]
    for p in parts:
        counts += np.bincount(p, minlength=1 << 16)
    lengths = tokenfile.code_lengths(counts)
    codes = tokenfile.canonical_codes(lengths)
    blocks = [(*tokenfile.encode_block(p, lengths, codes), len(p)) for p in parts]
    table = tokenfile.decode_table(lengths)
    for one in range(len(parts)):
        assert (tokenfile.decode_blocks([blocks[one]], table)[0] == parts[one]).all()
    assert all((a == b).all() for a, b in zip(tokenfile.decode_blocks(blocks, table), parts))


def test_query_equals_brute_force(spark, tmp_path):
    data = cases.rows() + [(2000 - i, t, "en", "s", None) for i, t in enumerate(ODD)]
    cases.docs(spark, data).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_token_file(spark, str(tmp_path)).collect()
    library = tokenfile.encoder(PATH).library
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in data]
    want = sorted((-1 if r[0] is None else r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(data, ids))
    rows = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert sorted(r[1:] for r in rows) == want
    at, last = 0, -1
    for start, doc_id, n, _ in rows:
        assert start == at and doc_id >= last
        at, last = at + n, doc_id


def test_empty_table(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op6_token_file(spark, str(tmp_path)).collect() == []


def test_added_tokens_are_single_ids_as_in_a_fresh_library():
    from tokenizers import Tokenizer

    strings = ["<|endoftext|>", "plain words", "a <|endoftext|><|endoftext|> b", "cut <|endof", "text|> here", "", "中 <|endoftext|>", "<|endoftext", "|>"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(strings, add_special_tokens=False)]
    assert want[0] == [50256]
    assert [x.tolist() for x in tokenfile.encoder(PATH)(*arrays(strings))] == want
