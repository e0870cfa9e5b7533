"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are measures of its own and those of its neighbours; a chain of
line labels has a score for each line (features times weights) and for each pair of labels that follow one another.
Weights and pair scores are fitted by maximum likelihood on labelled documents, whose lines all bear the document's
label. A document's score is the mean of its lines' marginal probabilities of good, from the forward-backward
algorithm, weighted by line length.

The fit takes ``PER_LABEL`` documents of each label at most (those with the least hashes, a bounded sample) from the
training rows alone, and of these only such as have up to ``LINES_OF_ONE`` lines, until ``FIT_LINES`` lines of a label
are reached; the features of these lines are gathered and fitted on the driver. Scoring is row-wise: whole texts, no
shuffle, and the model that tasks get has a fixed size.

Defined cases: a null or empty text is one empty line; with one label or none to learn from, every score is the share
of good among the training rows (0.5 without any); repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.llm.bytescan import joined, mix, slices, spans, word_hashes
from cairn.llm.common import map_batches, table, text_of
from cairn.llm.registry import query

PER_LABEL = 1500
FIT_LINES, LINES_OF_ONE = 200_000, 5_000
HELD_OUT = 1
WINDOW = 3

_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _MARK = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SYMBOL[list(b"#*$%&|<>{}[]~^=_\\@")] = True
_STOP[list(b".!?\"')")] = True
_MARK[list(b"!?")] = True
OWN = ("length", "words", "word_length", "upper", "digits", "symbols", "marks", "ends", "repeated_line", "repeated_words", "blank")


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, line lengths in bytes, and the first line of each text (and the end)."""
    data, at = joined(column)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    # A break at the end of a text opens an empty line of that text, before the line that the next text opens.
    text_of_break = np.searchsorted(at, breaks, "right") - 1
    n_lines = 1 + np.bincount(text_of_break, minlength=len(at) - 1) if len(at) > 1 else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(n_lines)]).astype(np.int64)
    owner = np.repeat(np.arange(len(n_lines)), n_lines)
    is_last = np.zeros(len(starts), bool)
    is_last[first[1:] - 1] = True
    ends = np.empty(len(starts), np.int64)
    ends[is_last] = at[1:]
    ends[~is_last] = breaks
    length = (ends - starts).astype(np.float64)

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=sums[1:])
        return (sums[ends] - sums[starts]).astype(np.float64)

    begin, end, _ = spans(data, at)
    word_line = np.searchsorted(starts, begin, "right") - 1
    n_words = np.bincount(word_line, minlength=len(starts)).astype(np.float64)
    in_words = np.bincount(word_line, weights=end - begin, minlength=len(starts))
    hashes = word_hashes(data, begin, end)

    content = mix(np.concatenate([word_hashes(data, starts[length > 0], ends[length > 0])]))
    filled = np.flatnonzero(length > 0)
    key = mix(content + owner[filled].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where, seen = np.unique(key, return_inverse=True, return_counts=True)
    repeated_line = np.zeros(len(starts))
    repeated_line[filled] = seen[where] > 1

    repeated = np.zeros(len(starts))
    if len(hashes) >= WINDOW:
        grams = hashes[:-2] * np.uint64(3) + mix(hashes[1:-1]) * np.uint64(5) + mix(hashes[2:] + np.uint64(7))
        doc = owner[word_line]
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        _, where, seen = np.unique(mix(grams[inside] + doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                   return_inverse=True, return_counts=True)
        repeated = np.bincount(word_line[inside][seen[where] > 1], minlength=len(starts)).astype(np.float64)

    upper, lower = count(_UPPER), count(_LOWER)
    size, w = np.maximum(length, 1), np.maximum(n_words, 1)
    closing = np.zeros(len(starts))
    closing[filled] = _STOP[data[ends[filled] - 1]]
    own = np.stack([
        np.log1p(length) / 8, np.log1p(n_words) / 5, np.minimum(in_words / w, 30) / 10, upper / np.maximum(upper + lower, 1),
        count(_DIGIT) / size, np.minimum(count(_SYMBOL) / w, 3), np.minimum(count(_MARK) / w, 3), closing,
        repeated_line, np.minimum(repeated / w, 1), n_words == 0], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    opens, closes = np.zeros(len(own), bool), is_last
    opens[first[:-1]] = True
    inner = np.flatnonzero(~opens)
    before[inner] = own[inner - 1]
    inner = np.flatnonzero(~closes)
    after[inner] = own[inner + 1]
    return np.concatenate([np.ones((len(own), 1)), own, before, after, opens[:, None], closes[:, None]], axis=1), length + 1, first


@dataclass
class Chain:
    """Weights of a line's score for good, and scores of label pairs (bad, good) by (bad, good)."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, unary: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, expected label pairs of each chain's steps summed, log partition of each chain.

        All chains take a step together, the longest first, so that those still going are the leading ones.
        """
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        start, n = first[:-1][order], n[order]
        longest = int(n[0]) if len(n) else 0
        going = np.searchsorted(-n, -np.arange(longest), "left") if longest else np.zeros(0, int)
        emit = np.exp(np.stack([-unary / 2, unary / 2], axis=1).clip(-300, 300))
        step = np.exp(self.pairs)
        ahead, scale = np.empty_like(emit), np.empty(len(emit))
        for t in range(longest):
            at = start[: going[t]] + t
            a = emit[at] if t == 0 else (ahead[at - 1] @ step) * emit[at]
            scale[at] = a.sum(axis=1)
            ahead[at] = a / scale[at][:, None]
        back = np.ones_like(emit)
        pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            at = start[: going[t + 1]] + t
            later = emit[at + 1] * back[at + 1] / scale[at + 1][:, None]
            back[at] = later @ step.T
            pairs += (ahead[at].T @ later) * step
        both = ahead * back
        logs = np.add.reduceat(np.log(scale), first[:-1]) if len(first) > 1 else np.zeros(0)
        return both[:, 1] / both.sum(axis=1), pairs, logs

    def scores(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _, _ = self.marginals(x @ self.weights, first)
        return np.add.reduceat(good * length, first[:-1]) / np.add.reduceat(length, first[:-1])


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximum likelihood with a quadratic penalty, by gradient ascent with momentum and scaled steps (Adam)."""
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)))
    n = np.diff(first)
    good = np.repeat(labels.astype(float), n)
    seen = np.array([[((n - 1) * (1 - labels)).sum(), 0.0], [0.0, ((n - 1) * labels).sum()]])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        chain.weights, chain.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs, _ = chain.marginals(x @ chain.weights, first)
        slope = np.concatenate([x.T @ (good - p), (seen - pairs).ravel()]) / len(x) - decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Chain(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and quality of up to ``PER_LABEL`` documents and ``FIT_LINES`` lines of each label that are not held out.

    The chosen ids are at most twice ``PER_LABEL`` rows, which bounds what is broadcast and what the window orders.
    """
    free = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold(F.col("doc_id")) != HELD_OUT)
    free = free.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    some = [free.where(F.col("quality") == q).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(PER_LABEL) for q in (0, 1)]
    chosen = some[0].union(some[1]).withColumnRenamed("doc_id", "chosen")

    def of(ids: DataFrame) -> DataFrame:
        return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("chosen"))

    lines = F.length(text_of()) - F.length(F.replace(text_of(), F.lit("\n"))) + 1
    sized = of(chosen).groupBy("chosen", "quality").agg(F.sum(lines).alias("lines")).where(F.col("lines") <= LINES_OF_ONE)
    so_far = F.sum("lines").over(W.partitionBy("quality").orderBy(F.md5(F.col("chosen").cast("string"))))
    taken = sized.withColumn("so_far", so_far).where(F.col("so_far") <= FIT_LINES).select("chosen", "quality")
    return of(taken).select("quality", text_of().alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Chain | float:
    """The fitted chain, or the share of good where there is nothing to tell apart."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x, _, first = line_features(batch.column("text"))
                parts = [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(parts, pa.binary())], names=["quality", "x"])

    rows = map_batches(training_rows(docs, labels), measure, "quality int, x binary").collect()
    rows.sort(key=lambda r: (r["quality"], bytes(r["x"])))
    y = np.array([r["quality"] for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    width = 3 * len(OWN) + 3
    each = [np.frombuffer(r["x"], "<f4").reshape(-1, width) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(e) for e in each])])
    return fit(np.concatenate(each).astype(float), first, y)


def score_documents(docs: DataFrame, model: Chain | float) -> DataFrame:
    """doc_id and score of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                if isinstance(model, Chain):
                    s = model.scores(*line_features(batch.column("text")))
                else:
                    s = np.full(batch.num_rows, model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_batches(rows, score, "doc_id long, score double")


@query("op2_line_crf")
def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_documents(docs, model)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
