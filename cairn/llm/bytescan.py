"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

Used inside tasks on Arrow batches. A word is a run of bytes other than the six white-space ones, which in UTF-8 are
never part of another character; its hash depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice of a batch holds, but for a text that is longer by itself.
SLICE = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_RUN = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``size`` bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (or binary values), and where each begins (one more entry for the end). Null ones are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (one more entry for the end)."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = at[(at > 0) & (at < len(data))]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_RUN, _FACTOR), _powers(_RUN, _INVERSE)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64 bits for each word: differences of running sums of byte times power, shifted back to power 0."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _RUN, "right")))
        run = data[low: ends[j - 1]]
        run = (_LOWER[run] if lower else run).astype(np.uint64) + np.uint64(1)
        up, down = (_UP, _DOWN) if len(run) <= _RUN else (_powers(len(run), _FACTOR), _DOWN)
        sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(run * up[: len(run)], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return mix(out)


def text_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the first word of each text."""
    data, at = joined(column)
    starts, ends, first = spans(data, at)
    return word_hashes(data, starts, ends, lower), first


def shingle_sets(words: np.ndarray, first: np.ndarray, length: int) -> list[np.ndarray]:
    """The distinct shingles of ``length`` words of each text, ascending. A shorter text with words has one shingle."""
    a = np.uint64(_FACTOR)
    rolled = np.zeros(max(0, len(words) - length + 1), np.uint64)
    for k in range(length):
        rolled = rolled * a + words[k: len(words) - length + 1 + k]
    rolled = mix(rolled)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= length:
            out.append(np.unique(rolled[low: high - length + 1]))
        elif high > low:
            one = np.full(1, high - low, np.uint64)
            for k in range(low, high):
                one = one * a + words[k: k + 1]
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
