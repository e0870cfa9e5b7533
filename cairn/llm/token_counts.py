"""Token counts by byte-pair merging with a heap and a linked list, without making token ids.

A text is parted at the tokenizer's own tokens (one each) and then by the byte-level pre-tokenizer into pieces; nothing
merges over a piece's border. A piece starts with one symbol per UTF-8 byte. Adjacent pairs that may merge lie in a heap
by rank and place; the lowest one is popped, its two symbols become one in the linked list, and the pairs with its new
neighbours go into the heap. A pair that is no longer there is passed over when it is popped. The count of a piece is
its symbols minus its merges.

Pieces repeat, so a worker remembers the counts of short ones in two generations: when the young one is full it becomes
the old one, and an old piece that comes up again is young again. The memory is bounded whatever the corpus. A text
needs its own size, a piece about 60 bytes for each of its bytes.

Only a character that Python's Unicode tables don't know can be of another class for the tokenizer, which may have
older or newer ones: a text with such a character is parted by the tokenizer's own pre-tokenizer.

Defined cases: a null text is the empty one, no bytes and no tokens; repeated rows and null ids have a row each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm.bytescan import slices
from cairn.llm.common import map_batches, table, text_of
from cairn.llm.registry import query

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces of a generation that a worker remembers, and the longest of them.
KNOWN_PIECES, KNOWN_LENGTH = 400_000, 48

_PLACE = 40
_BELOW = (1 << _PLACE) - 1


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in visible else next(others)) for b in range(256)]


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes in ``symbols``, which are used up."""
    n = len(symbols)
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    heap = [rank << _PLACE | i for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    made = 0
    while heap:
        lowest = heappop(heap)
        rank, i = lowest >> _PLACE, lowest & _BELOW
        j = after[i]
        if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has merged with another since
        symbols[i] += symbols[j]
        symbols[j] = ""
        made += 1
        k, h = after[j], before[i]
        after[i] = k
        if k < n:
            before[k] = i
            if (new := ranks.get((symbols[i], symbols[k]))) is not None:
                heappush(heap, new << _PLACE | i)
        if h >= 0 and (new := ranks.get((symbols[h], symbols[i]))) is not None:
            heappush(heap, new << _PLACE | h)
    return made


class Counts(dict):
    """piece -> number of tokens; one that is missing is counted when it is asked for."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.old, self.symbol = ranks, {}, byte_symbols()

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            raw = piece.encode()
            n = len(raw) - merges([self.symbol[b] for b in raw], self.ranks)
        if len(piece) <= KNOWN_LENGTH:
            self[piece] = n
        return n

    def age(self) -> None:
        if len(self) > KNOWN_PIECES:
            self.old = dict(self)
            self.clear()


class TokenCounter:
    """Numbers of tokens of texts, as a byte-level tokenizer file describes them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        said = json.loads(Path(path).read_text(encoding="utf-8"))
        model, split = said["model"], said["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                               "ignore_merges", "byte_fallback"))
        if (model["type"], split.get("type")) != ("BPE", "ByteLevel") or split.get("add_prefix_space") or said["normalizer"] or not plain:
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        own = said["added_tokens"]
        if any(t[k] for t in own for k in ("single_word", "lstrip", "rstrip")) or set(byte_symbols()) - model["vocab"].keys():
            raise ValueError(f"{path} has tokens that take in their surroundings, or lacks bytes")
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.counts = Counts({pair: rank for rank, pair in enumerate(pairs)})
        self.path, self._pieces = path, None
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        longest_first = sorted((t["content"] for t in own), key=len, reverse=True)
        self.own = regex.compile("|".join(map(regex.escape, longest_first))) if own else None

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.find(text)
        if self._pieces is None:
            self._pieces = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        return [text[a:b] for _, (a, b) in self._pieces(text)]

    def count(self, text: str) -> int:
        if self.own is None or self.own.search(text) is None:
            return sum(map(self.counts.__getitem__, self.pieces(text)))
        parts = self.own.split(text)
        return len(parts) - 1 + sum(self.counts[p] for part in parts for p in self.pieces(part))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One for each worker process, so that the pieces it knows serve all its tasks."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for whole in batches:
            for batch in slices(whole):
                known.counts.age()
                texts = batch.column("text")
                found = pa.array([known.count(t.as_py()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), found], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    counted = map_batches(rows, work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
