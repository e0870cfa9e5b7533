"""Benchmark decontamination by latent semantic retrieval.

1. Terms are lower-cased words hashed into ``TERMS`` buckets; document frequencies are counted over all documents.
2. A randomised SVD gives the leading right singular vectors of the TF-IDF matrix of passages: those of all documents
   and of the benchmark. The documents' terms are written once, two bytes for each word, and read by the counts and by
   both passes. Each pass multiplies the passages' Gram matrix with a thin matrix, in tasks; partial products are summed
   by row block, and the sums have a fixed size.
3. Every passage of every document, in windows of two lengths, is projected and compared by cosine with all benchmark
   items (the stated query set, in blocks of matrix products).
4. Besides, items are looked up by their words, so that nothing depends on the cosine: what can be judged a leak has so
   many words of the item that, with its common words left out, a known number of the others stands within ``SPREAD``
   item lengths. Every stretch with that many is a candidate, for items of any length and at any place.
5. A candidate is read word by word: the longest common subsequence of the item and the text around the window or the
   stretch, as a share of the item's words, and of its answer. A document is contaminated by an item if the share is
   ``SURE`` or more, or ``LIKELY`` or more with the answer in the text.

Nothing is shuffled but term counts and the fixed-size sums, one of each pass from a task.

Defined cases: null and empty texts hold no passage and are clean; items without words are ignored; a null answer is the
item's last sentence; repeated rows are judged one by one; a text shorter than a window is one window; an empty
benchmark or table contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bytescan import joined, slices, text_words
from cairn.llm.common import map_batches, table, text_of
from cairn.llm.registry import query
from cairn.session import cut

TERMS = 1 << 14
RANK, EXTRA = 128, 16
#: Words in a block; windows are of so many blocks (powers of two) and start at every block.
STEP = 12
WINDOWS = (2, 4)
COSINE = 0.5
SURE, LIKELY = 0.8, 0.6
#: A leak that the words lead to is no longer than so many times its item.
SPREAD = 2
#: Words in more than this share of the documents are looked up only where an item has too few others.
COMMON = 0.01
#: Occurrences of items' words that are held at a time.
HELD = 1 << 20
#: Rows of the thin matrix in a block.
ROWS = 256
#: Documents whose terms are marked at a time, bytes of terms in a slice, passages projected and places of a term added at a time.
MARKED, TERM_SLICE, PROJECTED, ADDED = 256, 2 << 20, 1024, 8
#: Blocks of words that are searched at a time, and bytes of text in a slice of them.
SEARCHED, SEARCH_SLICE = 1024, 1 << 20
#: Bytes of terms from which on a pass gets more tasks than there are cores; a task sends one thin matrix.
TASK_TERMS = 128 << 20


def _terms(words: np.ndarray, n: int) -> np.ndarray:
    return (words % np.uint64(n)).astype(np.int64)


def term_rows(docs: DataFrame, n: int = TERMS) -> DataFrame:
    """The terms of every text, two bytes each, in the order of its words."""
    if n >= 1 << 16:
        raise ValueError("a term has two bytes")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, size=1 << 20):
                words, first = text_words(batch.column("text"), lower=True)
                terms = pa.py_buffer(_terms(words, n).astype("<u2").tobytes())
                at = pa.py_buffer((2 * first).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, at, terms])], names=["terms"])

    return map_batches(docs.select(text_of().alias("text")), encode, "terms binary")


def _in_terms(docs: DataFrame, n: int) -> DataFrame:
    return docs if "terms" in docs.columns else term_rows(docs, n)


def _term_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms of some texts, and the first of each text (one more entry for the end)."""
    for whole in batches:
        for batch in slices(whole, "terms", TERM_SLICE):
            data, at = joined(batch.column("terms"))
            yield data.view("<u2"), at // 2


def document_frequencies(docs: DataFrame, n: int = TERMS) -> np.ndarray:
    """In how many documents (text, or terms) each of ``n`` terms stands; the last entry is the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        for terms, first in _term_slices(batches):
            for i in range(0, len(first) - 1, MARKED):
                part = first[i: i + MARKED + 1]
                seen = np.zeros((len(part) - 1, n), bool)
                seen[np.repeat(np.arange(len(part) - 1), np.diff(part)), terms[part[0]: part[-1]]] = True
                total[:n] += seen.sum(axis=0, dtype=np.uint16)
            total[n] += len(first) - 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    counted = map_batches(_in_terms(docs, n), count, "term long, n long")
    out = np.zeros(n + 1, np.int64)
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():  # n + 1 rows at most
        out[r["term"]] = r["n"]
    return out


def inverse_frequencies(df: np.ndarray) -> np.ndarray:
    return np.log((df[-1] + 1.0) / (df[:-1] + 1.0)).astype(np.float32)


def _passages(terms: np.ndarray, first: np.ndarray, none: int, width: int = STEP * max(WINDOWS)) -> np.ndarray:
    """A row of terms for every so many words of these texts, filled up with ``none``."""
    n_words = np.diff(first)
    n_passages = -(-n_words // width)
    owner = np.repeat(np.arange(len(n_words)), n_passages)
    starts = first[:-1][owner] + (np.arange(len(owner)) - (np.cumsum(n_passages) - n_passages)[owner]) * width
    within = np.arange(width)
    rows = terms[np.minimum(starts[:, None] + within, len(terms) - 1)]
    rows[within >= (first[1:][owner] - starts)[:, None]] = none
    return rows


def _square_norms(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared lengths of the weighted counts of the terms of each passage."""
    flat = np.sort(rows, axis=1).ravel()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[:: rows.shape[1]] = True
    at = np.flatnonzero(new)
    counted = weight[flat[at]] * np.diff(at, append=len(flat))
    return np.bincount(at // rows.shape[1], counted * counted, minlength=len(rows))


def _add_gram(out: np.ndarray, rows: np.ndarray, weight: np.ndarray, right: np.ndarray) -> None:
    """Adds these passages' share of the Gram matrix times ``right``, whose rows are weighted; those of ``out`` aren't yet.

    ``weight``, ``right`` and ``out`` have a last row for no term, the first two a zero.
    """
    none, width = len(weight) - 1, rows.shape[1]
    squares = _square_norms(rows, weight)
    image = np.zeros((len(rows) + 1, right.shape[1]), np.float32)
    for i in range(0, len(rows), PROJECTED):
        part, some = image[i: min(len(rows), i + PROJECTED)], rows[i: i + PROJECTED]
        for k in range(width):
            part += right[some[:, k]]
    image[:-1] *= np.divide(1, squares, out=np.zeros_like(squares), where=squares > 0)[:, None].astype(np.float32)
    # The passages of each term in rows of ``ADDED``, filled up with the empty passage behind the others.
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")[: len(flat) - np.count_nonzero(flat == none)]
    if not len(order):
        return
    terms = flat[order]
    at = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    times = np.diff(at, append=len(terms))
    n_rows = -(-times // ADDED)
    places = np.full((int(n_rows.sum()), ADDED), len(rows))
    places.ravel()[np.arange(len(terms)) + np.repeat((np.cumsum(n_rows) - n_rows) * ADDED - at, times)] = order // width
    term = np.repeat(terms[at], n_rows)
    for i in range(0, len(places), PROJECTED):
        some, t = places[i: i + PROJECTED], term[i: i + PROJECTED]
        total = image[some[:, 0]]
        for k in range(1, ADDED):
            total += image[some[:, k]]
        new = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        out[t[new]] += np.add.reduceat(total, new, axis=0)


def _gram_times(passages: DataFrame, idf: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """A'A times ``thin`` for the matrix A of unit TF-IDF passages."""
    n_terms, k = thin.shape
    shared = passages.sparkSession.sparkContext.broadcast((idf, thin.astype(np.float32)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, right = np.append(shared.value[0], np.float32(0)), np.zeros((n_terms + 1, k), np.float32)
        right[:-1] = shared.value[0][:, None] * shared.value[1]
        out = np.zeros((n_terms + 1, k), np.float32)
        for terms, first in _term_slices(batches):
            if len(terms):
                _add_gram(out, _passages(terms, first, n_terms), weight, right)
        parts = (out[:-1] * weight[:-1, None]).reshape(-1, ROWS * k)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["block", "part"])

    def add(key, tables):
        total = sum(np.frombuffer(p.as_buffer(), np.float32).astype(np.float64) for p in tables.column("part"))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])

    summed = map_batches(passages, multiply, "block long, part binary").groupBy("block").applyInArrow(add, "block long, part binary")
    out = np.zeros((n_terms // ROWS, ROWS * k))
    for r in summed.collect():  # the thin matrix: a row of k numbers for each term
        out[r["block"]] = np.frombuffer(r["part"], np.float64)
    return out.reshape(n_terms, k)


def latent_terms(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of all passages of these texts (one row per term), and the singular values.

    A randomised range finder, and one more multiplication to turn its basis.
    """
    k = rank + EXTRA
    passages = _in_terms(passages, len(idf))
    held = passages.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    passages = passages.coalesce(max(passages.sparkSession.sparkContext.defaultParallelism, held // TASK_TERMS))
    start = np.random.default_rng(7).standard_normal((len(idf), k))
    basis, _ = np.linalg.qr(_gram_times(passages, idf, start))
    image = _gram_times(passages, idf, basis)
    values, turn = np.linalg.eigh(basis.T @ image)
    leading = np.argsort(values)[::-1][:rank]
    return basis @ turn[:, leading], np.sqrt(np.maximum(values[leading], 0))


def common_subsequence(item: dict[int, int], words: list[int]) -> int:
    """Length of the longest common subsequence; ``item`` has a bit for each place of a word in the item."""
    state = 0
    for w in words:
        if mask := item.get(w):
            grown = state | mask
            state = grown & ~(grown - ((state << 1) | 1))
    return state.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Items:
    """The benchmark as the tasks need it: unit vectors in the latent space, word places of items and answers."""

    def __init__(self, rows: list[tuple[int, str, str]], terms: np.ndarray, df: np.ndarray):
        self.ids, vectors, self.words, self.answers, self.bags = [], [], [], [], []
        keys, needs = [], []
        for item_id, text, answer in rows:
            hashes, _ = text_words(pa.array([text, answer], pa.string()), lower=True)
            n = len(text_words(pa.array([text], pa.string()))[0])
            if n:
                v = terms[_terms(hashes[:n], len(terms))].sum(axis=0)
                self.ids.append(item_id)
                vectors.append(v / (np.linalg.norm(v) or 1))
                self.bags.append(np.unique(hashes[:n]))
                self.words.append((n, _masks(hashes[:n].tolist())))
                self.answers.append((len(hashes) - n, _masks(hashes[n:].tolist())))
                key, need = self._keys(hashes[:n], hashes[n:], df)
                keys.append(key)
                needs.append(need)
        self.vectors = np.array(vectors, np.float32).T if vectors else np.zeros((terms.shape[1], 0), np.float32)
        self.terms = np.concatenate([terms, np.zeros((1, terms.shape[1]), terms.dtype)])  # the last row is no term
        self.sizes, self.needs = np.array([n for n, _ in self.words], np.int64), np.array(needs, np.int64)
        # Which items have a word as a key: keys ascending, and the items of each in a row.
        of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.keys, self.key_first = np.unique(flat[order], return_index=True)
        self.key_first = np.append(self.key_first, len(flat))
        self.key_items = of[order].astype(np.uint16 if len(keys) < 1 << 16 else np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys % np.uint64(len(self.maybe))).astype(np.int64)] = True

    @staticmethod
    def _keys(words: np.ndarray, answer: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, int]:
        """The words that an item is looked up by, and how many of them any leak has."""
        n = len(words)
        least = int(np.ceil(LIKELY * n - 1e-9))
        # A leak has SURE of the item or the answer; an answer that is part of the item counts among its words.
        sure = int(np.ceil(SURE * n - 1e-9))
        if not len(answer):
            least = sure
        elif common_subsequence(_masks(words.tolist()), answer.tolist()) == len(answer):
            least = min(sure, max(least, len(answer)))
        once, times = np.unique(words, return_counts=True)
        often = df[_terms(once, len(df) - 1)] / max(1, int(df[-1]))
        keep, need = np.ones(len(once), bool), least
        for k in np.argsort(-often, kind="stable").tolist():
            if often[k] > COMMON and need - times[k] >= (least + 1) // 2:
                keep[k] = False
                need -= int(times[k])
        return once[keep], need

    def judged(self, item: int, near: np.ndarray) -> tuple[float, bool] | None:
        """Share of the item in these words and whether its answer is there, if that makes them a leak."""
        (n, places), (n_answer, answer) = self.words[item], self.answers[item]
        # No subsequence is longer than the number of words in common.
        bag = self.bags[item]
        own = near[bag[np.minimum(np.searchsorted(bag, near), len(bag) - 1)] == near]
        if len(own) < LIKELY * n:
            return None
        share = common_subsequence(places, own.tolist()) / n
        if share < LIKELY:
            return None
        told = n_answer > 0 and common_subsequence(answer, near.tolist()) == n_answer
        return (share, told) if share >= SURE or told else None

    def stretches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of the words around every stretch that has as many of an item's keys as any leak."""
        there = np.flatnonzero(self.maybe[(words % np.uint64(len(self.maybe))).astype(np.int64)])
        key = np.searchsorted(self.keys, words[there])
        known = self.keys[np.minimum(key, len(self.keys) - 1)] == words[there]
        there, key = there[known], key[known]
        n_items = np.diff(self.key_first)[key]
        total = np.cumsum(n_items)
        begin = 0
        while begin < len(there):
            stop = max(begin + 1, int(np.searchsorted(total, total[begin] - n_items[begin] + HELD, "right")))
            # A stretch may begin before the cut and end after it.
            end = int(np.searchsorted(there, there[stop - 1] + SPREAD * self.sizes.max(), "right"))
            each = np.repeat(np.arange(begin, end), n_items[begin:end])
            within = np.arange(len(each)) - np.repeat(total[begin:end] - n_items[begin:end] - (total[begin] - n_items[begin]), n_items[begin:end])
            item = self.key_items[self.key_first[key[each]] + within]
            order = np.argsort(item, kind="stable")
            item, at = item[order].astype(np.int64), there[each[order]]
            last = np.arange(len(at)) + self.needs[item] - 1
            ok = np.flatnonzero(last < len(at))
            last = last[ok]
            ok = ok[(item[last] == item[ok]) & (at[last] - at[ok] < SPREAD * self.sizes[item[ok]])]
            if len(ok):
                last = ok + self.needs[item[ok]] - 1
                text = np.searchsorted(first, at[ok], "right") - 1
                same = at[last] < first[text + 1]
                text, item, at = text[same], item[ok][same], at[ok][same]
                n = self.sizes[item]
                # Stretches that begin within an item's length of each other are read once.
                part = np.unique(np.stack([text, item, (at - first[text]) // n]), axis=1)
                n = self.sizes[part[1]]
                low = first[part[0]] + (part[2] - SPREAD) * n
                high = np.minimum(first[part[0] + 1], low + (2 * SPREAD + 1) * n)
                yield from zip(part[0].tolist(), part[1].tolist(), np.maximum(first[part[0]], low).tolist(), high.tolist(), strict=True)
            begin = stop

    def cosine(self, item: int, words: np.ndarray) -> float:
        """The best cosine of an item with the windows of these words."""
        blocks = np.add.reduceat(self.terms[_terms(words, len(self.terms) - 1)], np.arange(0, len(words), STEP))
        sums = np.concatenate([np.zeros((1, blocks.shape[1])), np.cumsum(blocks, axis=0, dtype=float)])
        windows = np.concatenate([sums[min(w, len(blocks)):] - sums[: len(sums) - min(w, len(blocks))] for w in WINDOWS])
        return float((windows @ self.vectors[:, item] / np.maximum(np.linalg.norm(windows, axis=1), 1e-20)).max())

    def found(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, float, bool]]:
        """(text, item, cosine, share, answer found) of what these texts hold, the best of each text and item."""
        if not len(words) or not self.ids:
            return
        n_words = np.diff(first)
        n_blocks = -(-n_words // STEP)
        owner = np.repeat(np.arange(len(n_words)), n_blocks)
        number = np.arange(len(owner)) - (np.cumsum(n_blocks) - n_blocks)[owner]
        starts = first[:-1][owner] + number * STEP
        # Blocks of a text stand in a row, with empty ones behind them as wide as a window.
        gap = max(WINDOWS)
        place = np.arange(len(owner)) + gap * owner
        none, total = len(self.terms) - 1, len(owner) + gap * len(n_words)
        rows = np.full((total + gap, STEP), none, np.int64)
        rows[place] = _passages(_terms(words, none), first, none, STEP)
        block = np.zeros(total, np.int64)
        block[place] = np.arange(len(owner))
        # A window that the text's end cuts short is part of the one before it.
        use = {width: np.zeros(total, bool) for width in WINDOWS}
        for width in WINDOWS:
            use[width][place] = (number + width <= n_blocks[owner]) | (number == 0)
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        for i in range(0, total, SEARCHED):
            some = rows[i: i + SEARCHED + gap]
            vectors = self.terms[some[:, 0]]
            for k in range(1, STEP):
                vectors += self.terms[some[:, k]]
            # The product of a window and an item is the sum of those of its blocks.
            products, width = vectors @ self.vectors, 1
            while width < gap:
                vectors, products = vectors[:-width] + vectors[width:], products[:-width] + products[width:]
                width *= 2
                if width not in WINDOWS:
                    continue
                ok = use[width][i: i + SEARCHED]
                sizes = np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors[: len(ok)], vectors[: len(ok)])), 1e-20)
                near_by = np.flatnonzero(products[: len(ok)] >= np.where(ok, COSINE * sizes, np.inf)[:, None].astype(products.dtype))
                at, items = np.divmod(near_by, products.shape[1])
                for r, item, cosine in zip(at.tolist(), items.tolist(), (products[at, items] / sizes[at]).tolist(), strict=True):
                    b = block[i + r]
                    doc, n = int(owner[b]), self.words[item][0]
                    near = words[max(first[doc], starts[b] - n): min(first[doc + 1], starts[b] + width * STEP + n)]
                    if leak := self.judged(item, near):
                        new = (cosine, *leak)
                        best[doc, item] = max(best.get((doc, item), new), new, key=lambda x: (x[1], x[2], x[0]))
        for doc, item, low, high in self.stretches(words, first):
            known = best.get((doc, item))
            if known and known[1:] == (1.0, True):
                continue
            leak = self.judged(item, words[low:high])
            if leak and (not known or leak > known[1:]):
                low -= (low - first[doc]) % STEP
                best[doc, item] = (known[0] if known else self.cosine(item, words[low:high]), *leak)
        for (doc, item), (cosine, share, told) in best.items():
            yield doc, self.ids[item], cosine, share, told


def answered(benchmark: DataFrame) -> DataFrame:
    """item_id, text and answer; without a column for it the answer is the last sentence."""
    last = F.regexp_extract(F.rtrim(text_of()), r"([^.!?\n]*[.!?]*)$", 1)
    answer = F.coalesce(F.col("answer"), last) if "answer" in benchmark.columns else last
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"), answer.alias("answer"))


def fitted(docs: DataFrame, benchmark: DataFrame):
    """The items with their latent space, broadcast: TERMS rows of RANK numbers and the benchmark's words."""
    asked = answered(benchmark)
    terms_of = cut(term_rows(docs))
    df = document_frequencies(terms_of)
    idf = inverse_frequencies(df)
    basis, values = latent_terms(terms_of.union(term_rows(asked)), idf)
    # Folding in divides by the singular values, so that what a language's passages share doesn't drown the rest.
    scale = np.divide(1, values, out=np.zeros_like(values), where=values > 1e-6 * (values.max(initial=0) or 1))
    terms = (basis * scale * idf[:, None]).astype(np.float32)
    rows = [(r["item_id"], r["text"], r["answer"]) for r in asked.collect()]  # the query set
    return docs.sparkSession.sparkContext.broadcast(Items(rows, terms, df))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer_found) of every document that holds an item."""
    items = fitted(docs, benchmark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, size=SEARCH_SLICE):
                rows = list(items.value.found(*text_words(batch.column("text"), lower=True)))
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()),
                     pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.bool_())],
                    names=["doc_id", "item_id", "cosine", "share", "answer_found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_batches(rows, search, "doc_id long, item_id long, cosine double, share double, answer_found boolean")


def apply_to_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they came with; decided in the row, nothing is joined."""
    items = fitted(docs, benchmark)
    # Plain names while in the tasks: those of the input may hold dots.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, SEARCH_SLICE):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in items.value.found(*text_words(batch.column(text), lower=True))]] = False
                yield batch.filter(pa.array(keep))

    return map_batches(plain, clean, plain.schema).toDF(*docs.columns)


@query("op5_benchmark_leaks")
def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
