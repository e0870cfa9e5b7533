from collections import defaultdict

from cairn.llm import mixing as mx
from cairn.llm.registry import ORACLE
from tests.llm.helpers import awkward, compare, empty


def shares(sizes, weights, budget):
    """Targets by dealing the excess again until none is above."""
    total, target, held = budget * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(2 * sizes[s] for s in held)
        free = {s: w for s, w in weights.items() if s not in held}
        target = {s: 2.0 * sizes[s] if s in held else rest * free[s] / sum(free.values()) for s in sizes}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        held |= above


def test_targets_match_repeated_dealing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, "e": 0, None: 90}
    got = {r.source: r.target for r in mx.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = shares(sizes, dict(zip(["a", "b", "c", "d", "e", None], [3, 1, 2, 3, 1, 2])), 1.5)
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_query_matches_sql(spark):
    compare(spark, mx.op4_source_mix, ORACLE["op4_source_mix"])


def test_taken_comes_near_its_target_and_larger_budgets_take_more(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 AS int)) AS text",
                                        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")
    rows = mx.sized(docs).cache()
    by_budget = []
    for budget in (0.7, 1.2):
        out = mx.mixed(rows, budget=budget).collect()
        taken, target, size = defaultdict(int), {}, {}
        for r in out:
            taken[r.source] += r["size"] * r.copies
            target[r.source], size[r.source] = r.target, r.source_size
            assert r.copies <= 2
        assert all(abs(taken[s] - target[s]) <= 7 for s in target)
        by_budget.append({r.doc_id: r.copies for r in out})
    smaller, larger = by_budget
    rise = [s for s in larger if larger[s] < smaller[s]]
    assert not rise


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = mx.mixed(mx.sized(docs)).collect()
    assert len(out) == docs.count() and all(0 <= r.copies <= 2 for r in out)
    assert mx.apply_to_documents(docs).columns == docs.columns
    assert mx.mixed(mx.sized(empty(spark))).count() == 0
    assert mx.apply_to_documents(empty(spark)).count() == 0
