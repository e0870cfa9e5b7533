from pyspark.sql import functions as F

from cairn.operators import quality as q

COLUMNS = "project_key string, method_uid string, file_path string, start_line int, line_count int, method_hash string, structural_hash string, cyclomatic int, cognitive int"
ROWS = [
    ("p", "m1", "A.java", 1, 12, "exact", "structure", 12, 8),
    ("p", "m2", "B.java", 1, 10, "exact", "structure", 2, 3),
    ("p", "m3", "C.java", 1, 7, "unique", "unique-structure", 1, 1),
]


def methods(spark, parts=2):
    return q.with_thresholds(spark.createDataFrame(ROWS, COLUMNS).repartition(parts))


def test_dashboard_values(spark):
    row = q.gate(q.summary(methods(spark))).first()
    assert (row.total_methods, row.duplicate_methods, row.duplicate_groups) == (3, 2, 2)
    assert row.duplicate_ratio == 66.67
    assert row.high_complexity == 1
    assert row.gate_status == "FAIL" and len(row.reasons) == 2
    assert [r.method_uid for r in q.top_complex(methods(spark)).collect()] == ["m1"]


def test_partitioning_does_not_matter(spark):
    results = [sorted(map(tuple, q.duplicate_groups(methods(spark, n)).collect())) for n in (1, 17)]
    assert results[0] == results[1] == [("p", "EXACT", "exact", 2, 22), ("p", "STRUCTURAL", "structure", 2, 22)]


def test_blank_hash_and_short_methods_form_no_group(spark):
    rows = [("p", "a", "A", 1, 9, " ", "s", 1, 1), ("p", "b", "B", 1, 9, " ", "s", 1, 1), ("p", "c", "C", 1, 4, "x", "t", 1, 1), ("p", "d", "D", 1, 4, "x", "t", 1, 1)]
    groups = q.duplicate_groups(q.with_thresholds(spark.createDataFrame(rows, COLUMNS)))
    assert [(r.type, r.hash) for r in groups.collect()] == [("STRUCTURAL", "s")]
    # The detail of a group ignores the line threshold; a group of one is none.
    assert q.group_members(methods(spark), "EXACT", "p", F.lit("exact")).count() == 2
    assert q.group_members(methods(spark), "EXACT", "p", F.lit("unique")).count() == 0


def test_own_thresholds_win(spark):
    own = spark.createDataFrame([("p", 1, 1, 70.0, 20)], "project_key string, cyclomatic int, cognitive int, duplicate_ratio double, minimum_lines int")
    row = q.gate(q.summary(q.with_thresholds(spark.createDataFrame(ROWS, COLUMNS), own))).first()
    assert (row.duplicate_groups, row.high_complexity, row.gate_status) == (0, 2, "FAIL")


def test_snapshot_only_when_changed(spark):
    schema = "project_key string, id int, created_at int, total_methods int, duplicate_methods int, duplicate_groups int, high_complexity int, max_cyclomatic int, max_cognitive int, duplicate_ratio double"
    stored = spark.createDataFrame([("a", 1, 1, 3, 2, 2, 1, 12, 8, 66.67), ("a", 2, 2, 9, 2, 2, 1, 12, 8, 66.67), ("b", 3, 1, 3, 2, 2, 1, 12, 8, 66.67)], schema)
    now = spark.createDataFrame([("a", 9, 3, 3, 2, 2, 1, 12, 8, 66.67), ("b", 9, 3, 3, 2, 2, 1, 12, 8, 66.67005), ("c", 9, 3, 3, 2, 2, 1, 12, 8, 66.67)], schema)
    assert sorted(r.project_key for r in q.changed_snapshots(now, stored).collect()) == ["a", "c"]
