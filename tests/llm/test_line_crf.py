from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.llm import line_crf as lc
from tests.llm.helpers import awkward, empty

SF_DIR = "/root/testdata/sf0.01"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    chain = lc.Chain(np.zeros(1), rng.normal(size=(2, 2)))
    sizes = [1, 4, 3, 1, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    unary = rng.normal(size=first[-1]) * 2
    good, pairs, logs = chain.marginals(unary, first)
    all_pairs = np.zeros((2, 2))
    for k, n in enumerate(sizes):
        u, total, each, expect = unary[first[k]: first[k + 1]], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=n):
            w = np.exp(sum((0.5 if v else -0.5) * s for v, s in zip(y, u)) + sum(chain.pairs[a, b] for a, b in zip(y, y[1:])))
            total += w
            each += w * np.array(y)
            for a, b in zip(y, y[1:]):
                expect[a, b] += w
        assert np.allclose(each / total, good[first[k]: first[k + 1]]) and np.isclose(np.log(total), logs[k])
        all_pairs += expect / total
    assert np.allclose(all_pairs, pairs)


def test_line_features_see_lines_and_neighbours():
    x, length, first = lc.line_features(pa.array(["Ab cd.\n\nAb cd.\nZZ 12!", None, "", "one\n"]))
    assert first.tolist() == [0, 4, 5, 6, 8] and length.tolist() == [7, 1, 7, 7, 1, 1, 4, 1]
    name = {n: 1 + i for i, n in enumerate(lc.OWN)}
    assert x[:, name["repeated_line"]].tolist() == [1, 0, 1, 0, 0, 0, 0, 0]
    assert x[:, name["blank"]].tolist() == [0, 1, 0, 0, 1, 1, 0, 1]
    assert x[0, name["ends"]] == 1 and x[3, name["upper"]] == 1
    width = len(lc.OWN)
    assert np.allclose(x[1:4, 1 + width: 1 + 2 * width], x[0:3, 1: 1 + width]) and not x[0, 1 + width: 1 + 2 * width].any()


def test_held_out_documents_are_told(spark):
    rows = {r.doc_id: r for r in lc.op2_line_crf(spark, SF_DIR).collect()}
    labels = [r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    for q in (0, 1):
        own = [rows[r.doc_id].predicted == q for r in labels if r.quality == q]
        assert own and sum(own) >= 0.9 * len(own)
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (9, 0), (8, None), (None, 1), (10, 0), (5, 1), (6, 1), (1, 1)], "doc_id long, quality int")
    model = lc.train(docs, labels)
    assert lc.score_documents(docs, model).count() == docs.count()
    assert lc.train(docs, labels.limit(0)) == 0.5
    assert {r.score for r in lc.score_documents(docs, 0.5).collect()} == {0.5}
    assert lc.score_documents(empty(spark), model).count() == 0
    assert lc.train(empty(spark), labels) == 0.5


def test_lines_of_the_fit_are_bounded(spark, monkeypatch):
    rows = [(k, "\n".join(["x"] * k)) for k in range(1, 60)] + [(7, "again\nand again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, quality int")
    free = {r.doc_id for r in labels.where(lc.fold(F.col("doc_id")) != lc.HELD_OUT).collect()}
    everything = [(r.quality, r.text) for r in lc.training_rows(docs, labels).collect()]
    assert sorted(everything) == sorted((k % 2, t) for k, t in rows if k in free)
    monkeypatch.setattr(lc, "FIT_LINES", 100)
    monkeypatch.setattr(lc, "LINES_OF_ONE", 40)
    some = [(r.quality, r.text.count("\n") + 1) for r in lc.training_rows(docs, labels).collect()]
    assert {q for q, _ in some} == {0, 1} and max(n for _, n in some) <= 40
    assert all(sum(n for q, n in some if q == k) <= 100 for k in (0, 1))
