import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from factloom.llm import pieces, queries

from . import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "  two  spaces   end  ", "▁literal▁ mark", "naïve façade ½ x² №5", "中文 文本 😀 mixed", "<s> <unk> <0x41>", "\x00\ttab\nline\r\n", "a" * 300, "return    foo();" + " " * 40 + "x", "ééééé ñandú", "Thnd*** iner###"]


def arrays(strings):
    raw = [s.encode() for s in strings]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(library):
    rng = random.Random(12)
    strings = ODD + [r[1] or "" for r in cases.rows()]
    strings += ["".join(rng.choice("abcdeinorstht  \n.,!é1½rn-_=A中") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    words = [library.id_to_piece(i).replace("▁", " ") for i in range(260, 20000)]
    strings += ["".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    got = pieces.model(PATH).encode(*arrays(strings))
    want = library.encode(strings)
    wrong = [(s, a.tolist(), b) for s, a, b in zip(strings, got, want) if a.tolist() != b]
    assert not wrong, wrong[:3]


def test_decoding_equals_the_library_and_restores(library):
    rng = random.Random(13)
    strings = [s for s in ODD if "▁" not in s] + [cases.prose(rng, 50) for _ in range(50)]
    for s in strings:
        ids = library.encode(s)
        assert pieces.model(PATH).decode(np.array(ids, np.int64)) == library.decode(ids) == s


def test_query_equals_the_library(spark, tmp_path, library):
    data = cases.rows() + [(3000 + i, t, "en", "s", None) for i, t in enumerate(ODD)]
    cases.docs(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_pieces(spark, str(tmp_path)).collect()
    want = sorted((str(r[0]), library.encode(r[1] or "")) for r in data)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.n_pieces == len(r.ids) for r in got)
    assert all(r.restored for r in got if "▁" not in dict((d[0], d[1] or "") for d in data)[r.doc_id])


def test_empty_table(spark):
    encoded = pieces.encode(cases.empty(spark), PATH)
    assert encoded.collect() == pieces.decode(encoded, PATH).collect() == []
