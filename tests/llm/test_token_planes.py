import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairn.llm import token_planes as tp
from tests.llm.helpers import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("bits", [False, True])
def test_files_give_back_every_id(spark, bits):
    rows = [(i, t) for i, t in enumerate(["", None, "a  b", " lead", "trail ", "x \n y", "it's  40% <|endoftext|> so", "漢字 été\t\tz", "w " * 5000])]
    got = tp.encode_and_read(spark.createDataFrame(rows[::-1], "doc_id long, text string"), chunk_ids=700, bits=bits).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_words_encode_as_the_whole_text():
    encode, whole = tp.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["one two  three", "a\nb c", "don't we'll 1234 5", "tab\t x", "   ", "x\u00a0 y", "…  —", "end \n", "\n start", "a \u3000b"]
    for t, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_new_words_are_encoded_in_rows(monkeypatch):
    path = tp.public_tokenizers.path("byte_bpe_50k.json")
    whole = tp.Tokenizer.from_file(path)
    encode, rows = tp.Encoder(path), []
    single = encode._encode
    monkeypatch.setattr(tp, "ROW_WORDS", 7)
    monkeypatch.setattr(encode, "_encode", lambda texts: rows.append(len(texts)) or single(texts))
    words = [f"w{i}x\u00e9{i}" for i in range(500)] + ["don't", "a\tb", "x\u00a0y", "\u4e2d\u6587", "1,234.5", "\u0301e", "end\u2028on", "#!", "Q\u0120z"]
    texts = [" ".join(words), "\n".join(words), " ".join(words[::-1]), f"a {whole.decode([0], skip_special_tokens=False)}b c"]
    for t, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert sum(rows) < 100  # the first words, tails and what can't be parted


def test_planes_round_trip():
    for bits in (False, True):
        for ids in ([0], [1, 2, 3], list(range(0, 70000, 7)), [4294967295, 0]):
            a = np.array(ids, np.uint32)
            assert tp.from_planes(tp.planes(a, bits), len(a), bits).tolist() == ids


def test_small_files_roll_over(spark, monkeypatch):
    monkeypatch.setattr(tp, "FILE_BYTES", 3000)
    rows = [(i, " ".join(f"v{i}q{k}" for k in range(200))) for i in range(60)]
    got = tp.encode_and_read(spark.createDataFrame(rows, "doc_id long, text string"), chunk_ids=500).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = tp.encode_and_read(docs).orderBy("start").collect()
    assert len(got) == docs.count()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert tp.encode_and_read(empty(spark)).count() == 0
