"""Each stage on what its predecessor kept, against what the stage's own tests compare with."""

import corpus_pipeline
from cairn.llm import mixing, quality_rules
from cairn.llm.common import table
from tests.llm.helpers import SF_DIR, awkward, empty
from tests.llm.test_near_copies import brute
from tests.llm.test_token_planes import expected


def test_stages_in_order(spark):
    docs = table(spark, SF_DIR, "documents")
    first = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == first.columns
            out = out.cache()
        kept[name] = (docs, out)
        docs = out
    before, after = kept["quality rules"]
    good = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(before)).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == good
    before, after = kept["n-gram Jaccard join"]
    groups = {(c if c is not None else d) for d, c, _ in brute([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in after.collect()} == groups and after.count() == len(groups)
    before, after = kept["benchmark decontamination"]
    bench = [" ".join(r.text.lower().split()) for r in table(spark, SF_DIR, "benchmark").collect()]
    clean = {r.doc_id for r in before.collect() if not any(b in " ".join(r.text.lower().split()) for b in bench)}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = kept["mixing sources to target weights"]
    want = {r.doc_id: r.copies for r in mixing.mixed(mixing.sized(before)).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == want
    before, after = kept["token-ID / binary output"]
    rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
    assert sorted(map(tuple, after.collect())) == sorted(expected(rows))


def test_awkward_documents_pass_every_stage(spark):
    for docs in (awkward(spark), empty(spark)):
        docs = docs.selectExpr("*", "source AS lang", "1L AS n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
        docs.collect()
