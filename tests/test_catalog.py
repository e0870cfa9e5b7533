import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import catalog as c
from cairn.operators import mutation as m
from cairn.operators import ordering, scan
from cairn.sources import scan_json
from cairn.sources.files import read_source_files

DOC = "id long, project_key string, file_hash string, document_type string, deleted_at timestamp_ntz"


def test_insert_absent_is_idempotent(spark):
    stored = spark.createDataFrame([(1, "p", "h1", "S", None)], DOC)
    arriving = spark.createDataFrame([(2, "p", "h1", "S", None), (3, "q", "h1", "S", None), (4, "p", "h2", "S", None), (5, "p", "h2", "S", None), (6, "p", None, "S", None)], DOC)
    new = m.insert_absent(stored, arriving)
    assert sorted(r.id for r in new.collect()) == [3, 4, 6]
    again = m.insert_absent(stored.unionByName(new), arriving.where("file_hash is not null"))
    assert again.count() == 0


def test_page_envelopes(spark):
    row = c.page_envelope(spark.range(121), 1, 200).first()
    assert (row.size, row.page, row.total_pages, row.last, row.has_next) == (100, 1, 2, True, False)
    assert c.page(spark.range(1).orderBy("id"), 3, 30).count() == 0


def test_running_total_over_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}"), i, rng.randrange(9)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {(r.g, r.i): (r.total, r.pos) for r in ordering.positions(ordering.running_total(df, ["g"], ["i"], "v", "total"), ["g"], ["i"], "pos").collect()}
    want, sums, counts = {}, {}, {}
    for g, i, v in sorted(rows):
        sums[g], counts[g] = sums.get(g, 0) + v, counts.get(g, 0) + 1
        want[(g, i)] = (sums[g], counts[g])
    assert got == want
    whole = ordering.running_total(df, [], ["i"], "v", "total").orderBy(F.desc("i")).first()
    assert whole.total == sum(v for _, _, v in rows)


def test_duplicate_documents_keep_the_first(spark):
    df = spark.createDataFrame([(i, "p", "h", "S", None) for i in range(5)] + [(9, "q", "h", "S", None)], DOC).withColumn("created_at", F.lit(1))
    assert sorted(r.id for r in c.duplicate_documents(df).collect()) == [1, 2, 3, 4]


def test_scan_json_wrappers(spark):
    body = '{"status":"COMPLETED","findings":[{"ruleId":"r1"}]}'
    escaped = body.replace('"', '\\"')
    rows = [
        ("plain", body), ("array", f"[1, {body}]"), ("text", '{"content":[{"text":"%s"}]}' % escaped), ("deep", '{"result":{"data":{"text":"%s"}}}' % escaped),
        ("first", '{"data":{"status":"FAILED"},"text":"{\\"result\\":%s}"}' % escaped), ("empty", '{"status":"completed","findings":[]}'), ("none", '{"x":1}'), ("bad", "oops"),
        ("failed", '{"status":"FAILED","errorMessage":"boom"}')]
    out = {r.id: (r.status, r.severity, r.rule_id, r.message) for r in scan_json.findings(spark.createDataFrame(rows, "id string, response string")).collect()}
    finding = ("FINDING", "WARNING", "r1", "Security finding")
    assert {k: out[k] for k in ("plain", "array", "text", "deep", "first")} == dict.fromkeys(("plain", "array", "text", "deep", "first"), finding)
    assert out["empty"] == ("PASSED", "-", "-", "No security findings")
    assert out["none"][0] == out["bad"][0] == "ERROR" and out["failed"] == ("ERROR", "-", "-", "boom")


def test_results_are_found_under_any_number_of_wrappers(spark):
    def wrapped(n):
        text = '{"status":"COMPLETED","findings":[]}'
        for i in range(n):
            text = '{"%s":%s}' % (("result", "data")[i % 2], text)
        return text

    rows = [(n, wrapped(n)) for n in (0, 6, 7, 12, 40)]
    out = {r.id: r.status for r in scan_json.findings(spark.createDataFrame(rows, "id int, response string")).collect()}
    assert set(out.values()) == {"PASSED"} and len(out) == len(rows)


def test_scan_job_counters_and_export(spark, tmp_path):
    rows = [(1, 1, "FINDING", "m"), (1, 1, "FINDING", "m"), (1, 2, "PASSED", "m"), (1, 3, "ERROR", "first"), (2, 4, "PASSED", "m")]
    results = spark.createDataFrame(rows, "scan_job_id int, document_id int, status string, message string")
    jobs = spark.createDataFrame([(1, 3), (2, 2), (3, 0)], "scan_job_id int, total_files int")
    progress = scan.job_progress(scan.file_outcomes(results, ["scan_job_id", "document_id"]), jobs)
    out = {r.scan_job_id: r for r in scan.job_status(progress, results).collect()}
    assert (out[1].processed_files, out[1].passed_files, out[1].finding_count, out[1].error_files, out[1].progress) == (3, 1, 2, 1, 100)
    assert (out[1].final_status, out[1].status_message) == ("COMPLETED_WITH_ERRORS", "first")
    assert (out[2].final_status, out[2].progress, out[3].progress) == ("RUNNING", 50, 0)
    full = results.withColumns({"file_name": F.lit(None).cast("string"), "file_type": F.lit("JAVA"), "severity": F.lit("-"), "rule_id": F.lit("-")})
    scan.write_export(full, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == list(scan.EXPORT_COLUMNS)
    with pytest.raises(ValueError):
        scan.write_export(full.where("false"), str(tmp_path / "none"))


def test_health(spark):
    rows = [("a", "DOWN", True), ("b", "DOWN", False), ("b", "UP", True), ("c", "UNKNOWN", False), ("d", "UNKNOWN", False), ("d", "UP", True), ("e", "UP", True)]
    out = scan.health_rollup(spark.createDataFrame(rows, "g string, status string, critical boolean"), "g").collect()
    assert {r.g: r.overall for r in out} == {"a": "DOWN", "b": "DEGRADED", "c": "UNKNOWN", "d": "DEGRADED", "e": "UP"}


def test_first_outcome_wins(spark):
    rows = [("x", 1, "PASSED"), ("x", 2, "RUNNING"), ("x", 3, "ERROR"), ("x", 4, "PASSED"), ("y", 1, "RUNNING"), ("z", 1, "ERROR")]
    out = m.first_outcome(spark.createDataFrame(rows, "item string, ts int, status string"), "item", ["ts"], "RUNNING", ["PASSED", "ERROR"])
    assert {r.item: (r.status, r.completed_at) for r in out.collect()} == {"x": ("ERROR", 3), "y": ("RUNNING", None), "z": ("QUEUED", None)}


def test_source_files(spark, tmp_path):
    for name in ("src/A.java", "src/test/B.java", "notes.md", "x.png", "y.java.part"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text of " + name)
    rows = read_source_files(spark, str(tmp_path / "in")).collect()
    assert {r.path: r.content for r in rows} == {"src/A.java": "text of src/A.java", "notes.md": "text of notes.md"}
