"""Counts against the tokenizer itself."""

import random
import unicodedata

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import token_counts
from cairn.llm.token_counts import TokenCounter, count_tokens, counter, merges, op11_token_counts
from tests.llm.helpers import SF_DIR, awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def by_library(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


def by_passes(symbols, ranks):
    """Byte-pair encoding as it is told: the lowest pair anywhere, leftmost first, until none is left."""
    symbols = list(symbols)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return len(symbols)
        _, i = min(found)
        symbols[i: i + 2] = [symbols[i] + symbols[i + 1]]


def test_heap_equals_repeated_passes():
    rng = random.Random(3)
    for _ in range(300):
        pairs, known = [], list("abc")
        for _ in range(rng.randint(0, 12)):
            pair = (rng.choice(known), rng.choice(known))
            pairs.append(pair)
            known.append("".join(pair))
        ranks = {p: i for i, p in reversed(list(enumerate(pairs)))}
        text = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        assert len(text) - merges(list(text), ranks) == by_passes(text, ranks)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r'sdtré漢é́ ​12😀")), max_size=60))
def test_any_text(text):
    assert counter(PATH).count(text) == by_library(text)


def test_characters_of_another_class_are_unknown_to_python():
    split, find = TOKENIZER.pre_tokenizer.pre_tokenize_str, regex.compile(public_tokenizers.PATTERN).findall
    for low in range(0, 0x110000, 256):
        some = [chr(c) for c in range(low, low + 256) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
        text = "".join(f"a{c}1!{c} {c}" for c in some)
        assert [text[a:b] for _, (a, b) in split(text)] == find(text), hex(low)
    strange = "a࢏1 ࢏\U00010940x"
    assert counter(PATH).count(strange) == by_library(strange)


@pytest.mark.parametrize("text", [
    "<|endoftext|>", "a<|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n", "<|endoftext|", "x" * 60_000,
    " " * 30_000, "ab " * 30_000, "\n" * 5_000, "é漢" * 9_000, "\0\x1c\x85  　", "don't I'll we've"])
def test_special_strings_and_long_pieces(text):
    assert counter(PATH).count(text) == by_library(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_PIECES", 3)
    known = TokenCounter(PATH)
    for text in ("one two three four five", "two three six", "one seven", "one two three four five") * 3:
        known.counts.age()
        assert known.count(text) == by_library(text)
        assert len(known.counts) <= 9 and len(known.counts.old) <= 9


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = sorted(count_tokens(docs).collect(), key=str)
    want = sorted([(r.doc_id, len((r.text or "").encode()), n := by_library(r.text), n > 512) for r in docs.collect()], key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert count_tokens(empty(spark)).collect() == []


def test_query_equals_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op11_token_counts(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = by_library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
