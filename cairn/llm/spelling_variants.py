"""Spelling variants: words of the corpus that differ by one inserted, deleted or replaced character.

Maximal runs of Latin letters are counted over all documents. Two words are one edit apart if, with ``m`` the longer
length, their common prefix and their common suffix together reach ``m - 1``. Then the prefix has at least ``m div 2``
characters or the suffix at least ``m - m div 2``, so every word goes into four buckets: for ``m`` its own length and one
more, by its first ``m div 2`` and by its last ``m - m div 2`` characters. A bucket with more than ``BLOCK`` words is
split into blocks and a task compares two blocks, so no bucket has to fit into one task. A task has the words as two
matrices of code points, padded on the right and on the left; a comparison of two blocks gives for all pairs the place
of the first difference from either side. A pair counts in the prefix bucket if its prefix is long enough, else in the
suffix bucket: once in all.

Buckets keep the work near the number of words; in a bucket it grows with the square of its size, dealt out by blocks.

Defined cases: a null text has no words, and a null id takes part as the empty one; repeated rows count as often as they
are there; words have no longest length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import map_batches, table
from cairn.llm.merkle_manifest import CRC_SQL
from cairn.llm.registry import query
from cairn.session import cut

# The letters of a word, and the remainder class of checksums whose runs lose a character.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
ONE_IN = 199
#: Fewest characters and occurrences of a word; how many times more frequent a word's form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a bucket in one block.
BLOCK = 256
_CELLS_AT_ONCE = 1 << 22


def runs(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id and run, with A-Z lower-cased, of every maximal run of letters with at least ``least_length`` of them."""
    found = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select(
        "doc_id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))


def mistyped(doc_id: Column, run: Column) -> Column:
    """The run, without one of its characters where its checksum with the document's id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % ONE_IN == 0, shorter).otherwise(run)


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, its number of rows in ``words``, of long and frequent enough words."""
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _sorted_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The sorted rows again, in pieces that never part the rows of a key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(x).to_numpy() for x in keys])
        new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        if held and (k[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, new[-1])])
            held, batch = [], batch.slice(new[-1])
        held.append(batch)
        last = k[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def _matrices(words: list[str], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the code points padded with 0 to ``m`` on the right and, backwards, on the left."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    column = np.arange(m)
    left, right = (np.zeros((len(words), m), np.uint32) for _ in range(2))
    left[column < lengths[:, None]] = points
    right[column >= m - lengths[:, None]] = points
    return lengths, left, right[:, ::-1]


def _pairs(groups: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows with the same, sorted, group; at most about ``at_once`` of them together."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    for size in np.unique(sizes[sizes > 1]).tolist():
        first = starts[sizes == size]
        if size * size <= at_once:
            i, j = np.triu_indices(size, 1)
            for k in range(0, len(first), per := max(1, at_once // len(i))):
                some = first[k: k + per, None]
                yield (some + i).ravel(), (some + j).ravel()
        else:
            per = max(1, at_once // size)
            for f in first.tolist():
                for k in range(0, size, per):
                    i, j = np.meshgrid(np.arange(k, min(k + per, size)), np.arange(size), indexing="ij")
                    yield f + i[i < j], f + j[i < j]


def common_ends(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefixes and suffixes of the (different) words ``a`` and ``b`` of two padded matrices."""
    return (left[a] != left[b]).argmax(axis=1), (right[a] != right[b]).argmax(axis=1)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _sorted_keys(batches, ["m", "key", "p", "q"]):
        column = {x: piece.column(x).to_numpy() for x in ("m", "key", "p", "q", "mine", "n", "by_prefix")}
        every = piece.column("word").to_pylist()
        of = np.stack([column[x] for x in ("m", "key", "p", "q")])
        number = np.concatenate([[0], np.cumsum((of[:, 1:] != of[:, :-1]).any(axis=0))])
        for m in np.unique(column["m"]).tolist():
            low, high = np.searchsorted(column["m"], [m, m + 1])
            words, n = every[low:high], column["n"][low:high]
            p, q, mine, by_prefix = (column[x][low:high] for x in ("p", "q", "mine", "by_prefix"))
            lengths, left, right = _matrices(words, m)
            for a, b in _pairs(number[low:high], max(1, _CELLS_AT_ONCE // m)):
                asked = ((p[a] == q[a]) | (mine[a] != mine[b])) & (np.maximum(lengths[a], lengths[b]) == m) & (by_prefix[a] == by_prefix[b])
                a, b = a[asked], b[asked]
                prefix, suffix = common_ends(left, right, a, b)
                found = (prefix + suffix >= m - 1) & ((prefix >= m // 2) == by_prefix[a]) & (by_prefix[a] | (suffix >= m - m // 2))
                a, b = a[found], b[found]
                if len(a):
                    one, other = np.concatenate([a, b]), np.concatenate([b, a])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i] for i in one.tolist()], pa.string()), pa.array([words[i] for i in other.tolist()], pa.string()),
                         pa.array(n[other], pa.int64())], names=["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every two words of ``words`` (word, n; distinct) that are one edit apart, both ways."""
    sides = [F.struct((F.length("word") + more).alias("m"), F.lit(by_prefix).alias("by_prefix")) for more in (0, 1) for by_prefix in (True, False)]
    spread = words.select("word", "n", F.explode(F.array(*sides)).alias("side")).select("word", "n", "side.*")
    half = F.col("m") - F.expr("m div 2")
    part = F.when(F.col("by_prefix"), F.expr("left(word, m div 2)")).otherwise(F.right("word", half))
    keyed = spread.withColumn("key", F.xxhash64("m", "by_prefix", part))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    n_blocks = F.ceil(F.col("size") / BLOCK)
    members = keyed.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("word"), n_blocks)).withColumn(
        "x", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    by = ["m", "key", "p", "q"]
    dealt = members.select(
        F.col("m").cast("long").alias("m"), "key", F.least("mine", "x").alias("p"), F.greatest("mine", "x").alias("q"),
        "mine", "by_prefix", "word", "n").repartition(*by).sortWithinPartitions(*by)
    return map_batches(dealt, _compared, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word when forms are followed, which lead to no word twice.

    Each round doubles the way, so the rounds are the logarithm of the longest one.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    words = cut(words)
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    told = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    last = roots(told.where("form IS NOT NULL"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: A character outside of ASCII has two bytes, so for the edit distance each stands as another ASCII character.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_NARROW = "".join(map(chr, range(33, 97))).replace("'", "''")

SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT doc_id, translate(run, '{ascii_uppercase}', '{ascii_lowercase}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
checked AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(said)), lambda i: ('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS h
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS said FROM runs), crc_steps),
words AS (
  SELECT word, sum(n)::BIGINT AS n, translate(word, '{_WIDE}', '{_NARROW}') AS narrow
  FROM (SELECT n, CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM checked)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n
  FROM words a JOIN words b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1
    AND levenshtein(a.narrow, b.narrow) = 1),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form,
    CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
followed AS (
  SELECT word, word AS root, form AS next FROM told
  UNION ALL
  SELECT f.word, t.word, t.form FROM followed f JOIN told t ON t.word = f.next)
SELECT word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, root FROM followed WHERE next IS NULL) USING (word)
"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents"))
    return variants(vocabulary(found.select(mistyped(F.col("doc_id"), F.col("run")).alias("word"))))
