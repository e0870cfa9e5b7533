"""Near words against an edit distance of all pairs, whole tables against a count in Python."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import spelling_variants
from cairn.llm.spelling_variants import mistyped, near_words, op13_spelling_variants, roots, runs, variants, vocabulary
from tests.llm.helpers import awkward, compare, empty


def one_edit(a, b):
    """By trying every edit."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def told(words):
    """(word, form, root, n, n_near, form_n) by hand."""
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def by_hand(rows):
    counted = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counted[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1:]] += 1
    return told({w: n for w, n in counted.items() if len(w) >= 6 and n >= 5})


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def made_up(rng, n):
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("abÀé") for _ in range(rng.randint(1, 9)))
        words.update({w, w[1:] or "b", w + "a", "b" + w})
    return {w: rng.choice([5, 5, 7, 30, 150, 900]) for w in words}


def test_near_words_equal_all_pairs(spark):
    words = made_up(random.Random(5), 700)
    got = sorted(map(tuple, variants(frame(spark, words)).collect()))
    assert got == told(words)


def test_buckets_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "BLOCK", 3)
    monkeypatch.setattr(spelling_variants, "_CELLS_AT_ONCE", 50)
    words = made_up(random.Random(6), 150)
    got = sorted((r.word, r.near) for r in near_words(frame(spark, words)).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_pairs_in_pieces():
    groups = np.array([1, 1, 1, 2, 3, 3, 3, 3, 3, 4, 4])
    for at_once in (1, 3, 7, 1000):
        got = sorted((a, b) for i, j in spelling_variants._pairs(groups, at_once) for a, b in zip(i.tolist(), j.tolist(), strict=True))
        assert got == [(a, b) for a in range(11) for b in range(a + 1, 11) if groups[a] == groups[b]]


def test_repeated_letters_and_long_words(spark):
    long = "x" * 40_000
    words = {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "abaaaa": 5, long: 5, long + "y": 30, "y" + long: 30, long[:-1] + "z": 5}
    assert sorted(map(tuple, variants(frame(spark, words)).collect())) == told(words)


def test_roots_of_a_long_way(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)], "word string, form string")
    assert {r.root for r in roots(forms).collect()} == {"w19"}


def test_awkward_rows(spark):
    docs = awkward(spark, copies=6).unionByName(awkward(spark, 6))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = runs(docs).select(mistyped(F.col("doc_id"), F.col("run")).alias("word"))
    assert sorted(map(tuple, variants(vocabulary(found)).collect())) == by_hand(rows)
    assert variants(vocabulary(runs(empty(spark)).select(F.col("run").alias("word")))).collect() == []


def test_letters_outside_of_ascii_and_deletions(spark):
    rows = [(i % 50 if i else None, f"ÄPFELÉ-äpfelé Straßen{'x' * (i % 3)} × a÷bcdef naïveté_Naïvete9 ퟿wortes{chr(0x100)}wortes") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = runs(docs).select(mistyped(F.col("doc_id"), F.col("run")).alias("word"))
    assert sorted(map(tuple, variants(vocabulary(found)).collect())) == by_hand(rows)


def test_query_equals_sql(spark):
    compare(spark, op13_spelling_variants, spelling_variants.SQL)
