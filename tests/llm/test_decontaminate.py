import random

import numpy as np
import pyarrow as pa

from cairn.llm import decontaminate as dc
from cairn.llm.bytescan import text_words
from tests.llm.helpers import SF_DIR, awkward, empty


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert dc.common_subsequence(dc._masks(a), b) == lcs(a, b)


def test_singular_vectors_span_the_leading_space(spark):
    n = 1 << 9
    rng = random.Random(4)
    texts = [" ".join(f"t{(k % 6) * 20 + rng.randrange(20)}" for _ in range(40)) for k in range(300)]
    idf = dc.inverse_frequencies(dc.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), n))
    basis, values = dc.latent_terms(spark.createDataFrame([(t,) for t in texts], "text string"), idf, rank=6)
    rows = []
    for t in texts:
        words, _ = text_words(pa.array([t]), lower=True)
        v = np.bincount(dc._terms(words, n), minlength=n) * idf
        rows.append(v / np.linalg.norm(v))
    a = np.array(rows)
    exact = np.linalg.svd(a, full_matrices=False)[1][:6]
    got = np.linalg.svd(a @ basis, full_matrices=False)[1]
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-6) and np.allclose(got, exact, rtol=0.03) and np.allclose(values, exact, rtol=0.05)


def test_copies_and_paraphrases_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(n)) + ". " + " ".join(say(3)) + ".") for i, n in enumerate([12, 20, 35, 50])]
    docs, want = [], set()
    for i, text in items:
        w = text.split()
        for kind in range(3):
            changed = list(w)
            for k in rng.sample(range(len(w) - 4), len(w) * kind // 10):  # the answer stays
                changed[k] = rng.choice(words)
            docs.append((len(docs), " ".join(say(rng.randrange(200)) + changed + say(70))))
            want.add((len(docs) - 1, i))
    docs += [(100 + k, " ".join(say(300))) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contamination(frame, bench).collect()} == want
    kept = dc.apply_to_documents(frame, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(100, 140)) and kept.columns == frame.columns


def test_every_verbatim_passage_is_found(spark):
    got = {(r.doc_id, r.item_id) for r in dc.op5_benchmark_leaks(spark, SF_DIR).collect()}
    bench = [(r.item_id, " ".join(r.text.lower().split())) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert got == {(d.doc_id, i) for d in docs for i, t in bench if t in " ".join(d.text.lower().split())}


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, None, None), (2, "", ""), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", None)],
                                  "item_id long, text string, answer string")
    assert dc.apply_to_documents(docs, bench.limit(0)).count() == docs.count()
    found = dc.contamination(docs, bench).collect()
    assert {r.doc_id for r in found} >= {8} and all(r.item_id is None for r in found)
    assert dc.apply_to_documents(docs, bench).columns == docs.columns
    assert dc.contamination(empty(spark), bench).count() == 0


def test_leaks_of_short_and_long_items_are_found_at_every_place(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(4000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    sizes = [5, 6, 9, 14, 25, 40, 70, 130, 260, 520, 600]
    items = [(i, " ".join(say(n - 2)) + ". " + " ".join(say(2)) + ".") for i, n in enumerate(sizes)]
    docs, want = [], set()
    for i, text in items:
        w = text.split()
        for place in range(12):
            for changed in (0, int(0.3 * len(w)), int(0.4 * len(w))):
                told = list(w)
                for k in rng.sample(range(len(w) - 2), changed):  # the answer stays
                    told[k] = rng.choice(words)
                assert lcs(w, told) >= 0.6 * len(w)
                docs.append((len(docs), " ".join(say(60 + place) + told + say(50))))
                want.add((len(docs) - 1, i))
    docs += [(10000 + k, " ".join(say(400))) for k in range(100)]
    got = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                           spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(-1 <= r.cosine <= 1.001 for r in got)


def test_lookup_has_every_stretch_in_common(monkeypatch):
    monkeypatch.setattr(dc, "HELD", 50)  # many cuts
    rng = random.Random(5)
    rows = [(i, " ".join(f"v{rng.randrange(12)}" for _ in range(n)), f"v{i}") for i, n in enumerate([1, 2, 3, 5, 8, 13])]
    df = np.full((1 << 9) + 1, 10)  # all words are common
    items = dc.Items(rows, np.ones((1 << 9, 2), np.float32), df)
    texts = [" ".join(f"v{rng.randrange(20)}" for _ in range(rng.randrange(40))) for _ in range(60)]
    words, first = text_words(pa.array(texts), lower=True)
    found = list(items.stretches(words, first))
    for d, text in enumerate(texts):
        said = text.split()
        for i, item, answer in rows:
            n = len(item.split())
            for a in range(max(1, len(said) - 2 * n + 1)):
                near = said[a: a + 2 * n]
                share = lcs(item.split(), near) / n
                if share >= dc.SURE or share >= dc.LIKELY and answer in near:
                    low, high = first[d] + a, first[d] + a + len(near)
                    assert any(f[:2] == (d, i) and items.judged(i, words[f[2]: f[3]]) for f in found), (text, item)
                    assert any(f[:2] == (d, i) and f[2] < high and low < f[3] for f in found)


def test_all_documents_fit_the_latent_space(spark, monkeypatch):
    seen = []
    known = dc.latent_terms
    monkeypatch.setattr(dc, "latent_terms", lambda passages, idf: seen.append(passages.count()) or known(passages, idf))
    docs = spark.createDataFrame([(i, f"a{i % 40} b{i % 7} c{i}") for i in range(3500)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    dc.fitted(docs, bench)
    assert seen == [3501]


def test_gram_product_of_all_passages(spark, monkeypatch):
    monkeypatch.setattr(dc, "TERM_SLICE", 300)
    monkeypatch.setattr(dc, "PROJECTED", 3)
    n, width, rng = 512, dc.STEP * max(dc.WINDOWS), random.Random(11)
    texts = [" ".join(f"t{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.choice([0, 1, 47, 48, 49, 200]))) for _ in range(60)]
    idf, thin = np.random.default_rng(3).random(n).astype(np.float32), np.random.default_rng(4).standard_normal((n, 5))
    rows = []
    for t in texts:
        words, _ = text_words(pa.array([t]), lower=True)
        for i in range(0, len(words), width):
            v = np.bincount(dc._terms(words[i: i + width], n), minlength=n) * idf
            rows.append(v / np.linalg.norm(v))
    a = np.array(rows)
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = dc._gram_times(dc.term_rows(frame, n), idf, thin)
    assert np.allclose(got, a.T @ (a @ thin), atol=1e-4)
    df = dc.document_frequencies(frame, n)
    want = sum(np.bincount(np.unique(dc._terms(text_words(pa.array([t]), lower=True)[0], n)), minlength=n) for t in texts)
    assert (df[:-1] == want).all() and df[-1] == 61
