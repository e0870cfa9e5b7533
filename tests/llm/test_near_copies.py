import random
from collections import defaultdict

import numpy as np
import pytest

from cairn.llm import near_copies as nc
from cairn.llm.bytescan import text_words
from cairn.llm.components import components
from tests.llm.helpers import WORD, awkward, empty


def brute(rows):
    """(doc_id, class_id, n_links) by comparing all pairs."""
    sets = []
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        sets.append((doc_id, frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None))
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if (a is None and b is None) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [sets[i][0] for i in members if sets[i][0] is not None]
        out += [(sets[i][0], min(ids) if ids else None, links[i]) for i in members]
    return sorted(out, key=str)


def near_texts(n_bases, copies, seed):
    rng = random.Random(seed)
    rows = []
    for b in range(n_bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, copies])):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 60 * 2)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [nc.BLOCK, 4])
def test_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nc, "BLOCK", block)
    monkeypatch.setattr(nc, "GROUP_BLOCK", block * 2)
    rows = near_texts(40, 25, 5)
    got = nc.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = nc.jaccard_join(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = nc.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts)) and kept.count() == len({(r.class_id, r.doc_id is None and r.class_id is None) for r in got})
    assert nc.jaccard_join(empty(spark)).count() == 0 and nc.one_of_each(empty(spark)).count() == 0


def test_the_least_id_stays_not_the_missing_one(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d  e f"), (3, "a b c d  e f")], "doc_id long, text string")
    assert [tuple(r) for r in nc.one_of_each(docs).collect()] == [(3, "a b c d  e f")]


def test_a_large_group_makes_no_row_for_a_pair(spark, monkeypatch):
    monkeypatch.setattr(nc, "GROUP_BLOCK", 64)
    rng, base = random.Random(2), [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base[: (k := rng.randrange(150))], f"x{i}", *base[k + 1:]])) for i in range(400)]
    classes = nc.features(spark.createDataFrame(rows, "doc_id long, text string")).select("c", "n", "sig")
    assert nc.candidates(classes).count() <= 400 * nc.BANDS * 3
    assert sorted(map(tuple, nc.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(brute(rows))


def test_pruning_drops_only_what_is_improbable():
    for i, least in enumerate(nc.LEAST):
        h = (i + 1) * nc.STEP
        assert 0 < least < h * 0.8
    assert nc.least_equal(16, 0.8, 0.5) > nc.least_equal(16, 0.8, 1e-6)


def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa
    a, first = text_words(pa.array(["été  x\ny", None, "y été", "x"]))
    assert first.tolist() == [0, 3, 3, 5, 6]
    assert a[0] == a[4] and a[1] == a[5] and a[2] == a[3] and len(set(a.tolist())) == 3
    long = "z" * 700_000
    b, _ = text_words(pa.array([long, "q " + long]))
    assert b[0] == b[2]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 103)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    same = (nc.signature(a).view(np.uint16) == nc.signature(b).view(np.uint16)).mean()
    assert abs(same - 0.8) < 0.12
