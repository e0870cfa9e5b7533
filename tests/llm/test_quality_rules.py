from collections import Counter

from cairn.llm import quality_rules as qr
from cairn.llm.registry import ORACLE
from tests.llm.helpers import WORD, awkward, compare, empty


def expected(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force(spark):
    docs = awkward(spark)
    got = qr.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r.doc_id, *expected(r.text)) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_matches_sql(spark):
    compare(spark, qr.op10_quality_rules, ORACLE["op10_quality_rules"])


def test_documents_keep_their_columns_and_clean_ones_stay(spark):
    docs = awkward(spark)
    out = qr.apply_to_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {5}
    assert qr.apply_to_documents(empty(spark)).count() == 0


def test_ablation_counts_what_one_rule_alone_rejects(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 2), (5, 2)], "doc_id long, fail_bits long")
    got = {r.rule: (r.failed, r.only_this) for r in qr.ablations(rows, "base@1").collect()}
    assert got == {"few_words": (2, 1), "repeated_windows": (3, 2)}
    assert {r.failed for r in qr.ablations(rows.limit(0), "base@1").collect()} == {0}


def test_policies_are_nested_versions():
    assert all(p & qr.BASE == qr.BASE for p in qr.POLICIES.values())
