"""N-gram Jaccard join with Bayesian pruning: all documents whose sets of five-word shingles are at least 0.8 alike.

1. Texts with the same words are one class, so copies are never compared. A class has a signature of 128 MinHash
   values (the low 16 bits of each).
2. Four values at a time make a band key. Classes that share one of 32 keys are candidates; of two texts 0.8 alike
   one in twenty million shares none. A bucket is split into blocks, and a task compares two blocks, so no bucket
   has to fit into one task; a pair is looked at in the first band that it shares only.
3. A candidate is compared 16 values at a time. With a uniform prior the similarity after ``m`` of ``h`` equal values
   is Beta(m + 1, h - m + 1); the pair is dropped as soon as the probability of 0.8 or more is under ``TOLERANCE``.
4. Survivors are connected into groups, a group is dealt into blocks of bounded size, and each pair of blocks gets the
   signatures and the shingle sets (64-bit hashes) of its classes once. There the pairs that share a band are pruned
   as before and the rest is verified exactly. No pair becomes a row: a bucket gives a class and one that it is
   connected to, a pair of blocks gives counts and group edges.

Result: one row per document: class_id (the least doc_id of all it is connected to by links), n_links (documents at
least 0.8 alike, its copies included).

Defined cases: a text of one to four words is one shingle; texts without words (null, empty, blank) are copies of each
other and link with nothing else; repeated rows are copies; null ids take part, and count for class_id only where a
class has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bytescan import shingle_sets, slices, text_words
from cairn.llm.common import columns_of, fresh, map_batches, table, text_of
from cairn.llm.components import components
from cairn.llm.registry import query
from cairn.session import cut

LENGTH = 5
#: The similarity as a fraction, so that the test at the border is exact.
NUMERATOR, DENOMINATOR = 4, 5
HASHES, BANDS, STEP = 128, 32, 16
TOLERANCE = 1e-6
#: Classes of a bucket in one block; classes and shingles of a group in one block.
BLOCK = 256
GROUP_BLOCK, GROUP_SHINGLES = 512, 1 << 18
_PAIRS_AT_ONCE = 1 << 16

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)[:, None]


def least_equal(compared: int, similarity: float, tolerance: float) -> int:
    """The fewest equal values of ``compared`` that keep a pair.

    P(S >= t | m of h equal) under a uniform prior is the chance of at most m successes in h + 1 trials of chance t.
    """
    n, total = compared + 1, 0.0
    for m in range(compared + 1):
        total += comb(n, m) * similarity**m * (1 - similarity) ** (n - m)
        if total >= tolerance:
            return m
    return compared


LEAST = [least_equal(h, NUMERATOR / DENOMINATOR, TOLERANCE) for h in range(STEP, HASHES + 1, STEP)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 values of 16 bits as 32 longs, each the key of a band."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 512):
        low = np.minimum(low, (_A * high[None, i: i + 512] + _B).min(axis=1))
    return low.astype(np.uint16).view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            words, first = text_words(batch.column("text"))
            sets = shingle_sets(words, first, LENGTH)
            keys = [int.from_bytes(blake2b(words[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
                    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            signatures = np.concatenate([signature(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(keys, pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()), _lists(signatures, np.full(len(sets), BANDS))],
                names=["doc_id", "h", "c", "n", "sig"])


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``h``: with doc_id it finds the row again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("h"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, h, class key ``c``, number of distinct shingles ``n``, signature ``sig`` of every document."""
    return map_batches(_identified(docs), _features, "doc_id long, h long, c long, n int, sig array<bigint>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The sorted rows again, in pieces that never part the rows of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in keys])
        new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(last.column(x)[0].as_py() != batch.column(x)[0].as_py() for x in keys):
                yield pa.Table.from_batches(held)
                held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, new[-1])])
            held, batch = [], batch.slice(new[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _starts(sorted_keys: list[np.ndarray]) -> np.ndarray:
    k = np.stack(sorted_keys)
    return np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]))


def _alike_in_size(ia, ib, n) -> np.ndarray:
    return np.minimum(n[ia], n[ib]) * DENOMINATOR >= np.maximum(n[ia], n[ib]) * NUMERATOR


def _alive(ia, ib, values, left) -> np.ndarray:
    """Which of the pairs in ``left`` may be alike enough, looked at 16 values at a time."""
    equal = np.zeros(len(left), np.int64)
    for step, least in enumerate(LEAST):
        at = slice(step * STEP, (step + 1) * STEP)
        equal += (values[ia[left], at] == values[ib[left], at]).sum(axis=1)
        stay = equal >= least
        left, equal = left[stay], equal[stay]
    return left


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of a group, about ``_PAIRS_AT_ONCE`` together."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        first = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        for k in range(0, len(first), per := max(1, _PAIRS_AT_ONCE // len(i))):
            some = first[k: k + per, None]
            for low in range(0, len(i), _PAIRS_AT_ONCE):
                some_i, some_j = i[low: low + _PAIRS_AT_ONCE], j[low: low + _PAIRS_AT_ONCE]
                yield (some + some_i).ravel(), (some + some_j).ravel()


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, ["band", "key", "p", "q"]):
        band, key, p, q, mine, c, n = (t.column(x).to_numpy() for x in ("band", "key", "p", "q", "mine", "c", "n"))
        keys = np.concatenate([x.flatten().to_numpy() for x in t.column("sig").chunks]).reshape(-1, BANDS)
        values = keys.view(np.uint16)
        starts = _starts([band, key, p, q])
        sizes = np.diff(np.append(starts, len(c)))
        found = []
        for ia, ib in _pairs(starts, sizes):
            asked = np.flatnonzero(((p[ia] == q[ia]) | (mine[ia] != mine[ib])) & _alike_in_size(ia, ib, n))
            ia, ib = ia[asked], ib[asked]
            first_shared = np.flatnonzero((keys[ia] == keys[ib]).argmax(axis=1) == band[ia])
            left = _alive(ia, ib, values, first_shared)
            found.append((ia[left], ib[left]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if not len(a):
            continue
        # Classes by rank, so that the root is the least class, which most buckets of a group have in common.
        ids, rank = np.unique(c, return_inverse=True)
        label = _least_labels(len(ids), rank[a], rank[b])
        linked = np.union1d(rank[a], rank[b])
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], names=["c", "root"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            sets = shingle_sets(*text_words(batch.column("text")), LENGTH)
            rest = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in rest], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*rest, "shingles"])


def _common(mine: np.ndarray, theirs: list[np.ndarray]) -> np.ndarray:
    """How many shingles of ``mine`` each of the other sets has; all of them are sorted and not empty."""
    sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
    every = np.concatenate(theirs)
    at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
    return np.add.reduceat(mine[at] == every, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)


def _linked(c, mine, split, n, weight, keys, values, sets) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(c, links, root) of the classes of two blocks; with ``split`` only the pairs from one block to the other."""
    links, ea, eb = np.zeros(len(c), np.int64), [], []
    for x in range(len(c) - 1):
        ib = np.arange(x + 1, len(c))
        if split:
            ib = ib[mine[ib] != mine[x]]
        ib = ib[_alike_in_size(np.full(len(ib), x), ib, n)]
        ib = ib[(keys[x] == keys[ib]).any(axis=1)]
        ib = ib[_alive(np.full(len(ib), x), ib, values, np.arange(len(ib)))]
        if not len(ib):
            continue
        common = _common(sets[x], [sets[j] for j in ib.tolist()])
        hit = ib[common * DENOMINATOR >= (n[x] + n[ib] - common) * NUMERATOR]
        links[x] += weight[hit].sum()
        links[hit] += weight[x]
        ea.append(np.full(len(hit), x))
        eb.append(hit)
    some = np.flatnonzero(links)
    if not len(some):
        return None
    ids, rank = np.unique(c, return_inverse=True)
    label = _least_labels(len(ids), rank[np.concatenate(ea)], rank[np.concatenate(eb)])
    return c[some], links[some], ids[label[rank[some]]]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, ["group", "p", "q"]):
        group, p, q, mine, c, n, weight = (t.column(x).to_numpy() for x in ("group", "p", "q", "mine", "c", "n", "copies"))
        keys = np.concatenate([x.flatten().to_numpy() for x in t.column("sig").chunks]).reshape(-1, BANDS)
        values, shingles = keys.view(np.uint16), t.column("shingles")
        bounds = np.append(_starts([group, p, q]), len(c)).tolist()
        out = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high - low > 1:
                at = slice(low, high)
                sets = [np.frombuffer(shingles[r].as_buffer(), np.uint64) for r in range(low, high)]
                out.append(_linked(c[at], mine[at], p[low] != q[low], n[at], weight[at], keys[at], values[at], sets))
        if out := [x for x in out if x is not None]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["c", "links", "root"])


def _block(c, n_blocks):
    return F.pmod(F.xxhash64(c), n_blocks.cast("long"))


def _paired(df: DataFrame, n_blocks: str) -> DataFrame:
    """Each row once for every block that its own meets: columns ``p`` <= ``q``."""
    met = df.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_blocks).cast("long") - 1)))
    return met.withColumn("p", F.least("mine", "x")).withColumn("q", F.greatest("mine", "x"))


def candidates(classes: DataFrame) -> DataFrame:
    """(c, root): classes that survive pruning with another one; ``root`` is one that they are connected to."""
    bands = classes.where("n > 0").select("c", F.posexplode("sig").alias("band", "key"))
    full = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK)
    members = bands.join(full, ["band", "key"]).withColumn("n_blocks", blocks).withColumn("mine", _block(F.col("c"), blocks))
    signed = _paired(members, "n_blocks").join(classes.select("c", "n", "sig"), "c")
    by = ["band", "key", "p", "q"]
    dealt = signed.select(*by, "mine", "c", "n", "sig").repartition(*by).sortWithinPartitions(*by)
    return map_batches(dealt, _pruned, "c long, root long")


def links(docs: DataFrame, classes: DataFrame, found: DataFrame, repeated: bool) -> DataFrame:
    """(c, links, root) of the candidates in ``found`` (c, root) that their shingles confirm.

    ``repeated``: some rows have the same id and text, and can't be told apart by them.
    """
    group = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    members = group.withColumnRenamed("node", "c").withColumnRenamed("label", "group").join(
        classes.select("c", "n", "copies", "sig", "first"), "c")
    sizes = members.groupBy("group").agg(F.greatest(
        F.ceil(F.sum("n") / GROUP_SHINGLES), F.ceil(F.count(F.lit(1)) / GROUP_BLOCK)).alias("n_blocks"))
    members = members.join(sizes, "group").withColumn("mine", _block(F.col("c"), F.col("n_blocks")))
    carried = ["c", "copies", "n", "sig", "group", "n_blocks", "mine"]
    of = cut(members.select(F.col("first.doc_id").alias("of"), F.col("first.h").alias("h"), *carried))
    texts = _identified(docs).join(of.hint("shuffle_hash"), "h").where(F.col("doc_id").eqNullSafe(F.col("of")))
    schema = "c long, copies long, n int, sig array<bigint>, `group` long, n_blocks long, mine long, shingles binary"
    by = ["group", "p", "q"]
    texts = texts.select(*carried, "text")
    sets = map_batches(texts.dropDuplicates(["c"]) if repeated else texts, _sets, schema)
    dealt = _paired(sets, "n_blocks").select(*by, "mine", "c", "n", "copies", "sig", "shingles").repartition(*by).sortWithinPartitions(*by)
    return map_batches(dealt, _verified, "c long, links long, root long")


def _order(doc_id: Column, h: Column) -> Column:
    """Least id first, rows without one last."""
    return F.struct(doc_id.isNull().alias("gone"), doc_id.alias("doc_id"), h.alias("h"))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The documents' features, for each class of copies: c, copies, first, links, label (of its group), and whether
    some rows have the same id and text.
    """
    rows = cut(features(docs))
    repeated = not rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    first = _order(F.col("doc_id"), F.col("h"))
    classes = cut(rows.groupBy("c").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"), F.min_by(F.struct("doc_id", "h", "n", "sig"), first).alias("one"),
    ).select("c", "copies", "least_id", F.struct("one.doc_id", "one.h").alias("first"), F.col("one.n").alias("n"), F.col("one.sig").alias("sig")))
    sure = cut(links(docs, classes, cut(candidates(classes)), repeated))
    label = components(sure.select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "c")
    count = sure.groupBy("c").agg(F.sum("links").alias("links"))
    return rows, cut(classes.drop("sig", "n").join(count, "c", "left").join(label, "c", "left").select(
        "c", "copies", "least_id", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "c").alias("label"))), repeated


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    rows, classes, _ = grouped(docs)
    ids = classes.groupBy("label").agg(F.min("least_id").alias("class_id"))
    told = classes.join(ids, "label").select("c", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "c").join(told, "c").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the least id, with the columns it came with."""
    _, classes, repeated = grouped(docs)
    first = _order(F.col("first.doc_id"), F.col("first.h"))
    one = classes.groupBy("label").agg(F.min_by("first", first).alias("one")).select("one.doc_id", "one.h")
    key, of = fresh(docs, "h"), fresh(docs, "of")
    chosen = one.select(F.col("doc_id").alias(of), F.col("h").alias(key))
    marked = docs.select(*columns_of(docs), F.xxhash64(text_of()).alias(key))
    kept = marked.join(chosen.hint("shuffle_hash"), key).where(F.col("doc_id").cast("long").eqNullSafe(F.col(of)))
    if repeated:
        kept = kept.dropDuplicates([key, of])
    return kept.select(*columns_of(docs))


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
