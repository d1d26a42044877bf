"""Words of equal hashes: Thue-Morse words collide in any polynomial hash modulo a power of two."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import pieces, tokenfile, wordcache
from factloom.llm.textarrays import prefix_sums, span_hashes

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def colliding(size, a="a", b="b"):
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def arrays(strings):
    raw = [s.encode() for s in strings]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_the_words_do_collide():
    data, offsets = arrays(colliding(1024))
    one, two = span_hashes(prefix_sums(data), offsets[:-1], offsets[1:])
    assert one == two


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
@pytest.mark.parametrize("together", [True, False])
@pytest.mark.parametrize(("size", "letters"), [(1024, "ab"), (512, ".a"), (512, "0_"), (2048, "ab")])
def test_colliding_words_get_their_own_ids(order, together, size, letters):
    words = [colliding(size, *letters)[k] for k in order] * 2 + ["plain words too"]
    calls = [words] if together else [[w] for w in words]
    library, sp = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder, model = tokenfile.encoder(BPE), pieces.Model(PIECES)
    for strings in calls:
        assert [x.tolist() for x in encoder(*arrays(strings))] == [library.encode(s, add_special_tokens=False).ids for s in strings]
        assert [x.tolist() for x in model.encode(*arrays(strings))] == [sp.encode(s) for s in strings]


def test_any_hash_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(wordcache, "span_hashes", lambda sums, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    encode = lambda raw: (np.array([c for w in raw for c in w], np.uint16), np.array([len(w) for w in raw]))
    rng = np.random.default_rng(4)
    for remember in (2, 1000):
        cache = wordcache.WordCache(encode, remember)
        for _ in range(40):
            lengths = rng.integers(1, 9, 50)
            data = rng.integers(97, 100, lengths.sum()).astype(np.uint8)
            ends = np.cumsum(lengths)
            ids, counts = cache.ids(data, ends - lengths, ends)
            assert (ids == data).all() and (counts == lengths).all()


def test_spans_of_any_size_are_compared():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, 5_000_000).astype(np.uint8)
    b = a.copy()
    b[[10, 2_500_000]] ^= 1
    starts, lengths = np.array([0, 20, 11, 100, 2_400_000, 3_000_000, 4]), np.array([11, 30, 0, 2_000_000, 1_200_000, 1_500_000, 6])
    assert wordcache.equal_spans(a, starts, lengths, b, starts, lengths).tolist() == [False, True, True, True, False, True, True]
    assert wordcache.equal_spans(a, starts, lengths, b, starts, lengths + 1).tolist() == [False] * 7
