import datetime as dt
import random

import pytest

from cairn.sources.batches import BatchTable
from cairn.streaming import jobs
from cairn.streaming.keyed import ExecutionState, keyed, timers_supported

SCHEMA = "id string, ts timestamp, event_id long, status string, critical boolean"
DAY = 24 * 3600 * 1000


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def run(spark, folder, batches, processor, delay="1 day"):
    """The state by key after one file per batch, and how many keys the store still holds."""
    source, table, checkpoint = folder / "source", BatchTable(spark, str(folder / "table")), str(folder / "checkpoint")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        with timers_supported(spark):
            changes = keyed(spark.readStream.schema(SCHEMA).parquet(str(source)), "id", processor, delay)
            jobs.changelog(changes, table, checkpoint)
    kept = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "value").load().count()
    return {r[0]: tuple(r)[1:] for r in jobs.latest(table.all(changes.schema), "id").collect()}, kept


def in_minutes(found):
    return {k: (status, *(None if x is None else (x // 60_000_000) % (24 * 60) for x in times)) for k, (status, *times) in found.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_execution_is_the_same_however_batches_fall(spark, tmp_path, parts):
    rows = [("x", at(1), 1, "STARTED", None), ("x", at(5), 2, "FAILED", None), ("x", at(9), 3, "SUCCEEDED", None), ("x", at(0), 9, "FAILED", None),
            ("y", at(2), 4, "FAILED", None), ("z", at(3), 5, "FAILED", None), ("z", at(4), 6, "STARTED", None), ("z", at(4), 7, "SUCCEEDED", None),
            ("w", at(20), 10, "STARTED", None), ("w", at(30), 11, "FAILED", None), ("w", at(15), 12, "STARTED", None), ("w", at(17), 13, "SUCCEEDED", None)]
    random.Random(parts).shuffle(rows)
    step = -(-len(rows) // parts)
    found, _ = run(spark, tmp_path, [rows[i: i + step] for i in range(0, len(rows), step)], ExecutionState(DAY))
    assert in_minutes(found) == {"x": ("FAILED", 1, 5), "z": ("SUCCEEDED", 4, 4), "w": ("SUCCEEDED", 15, 17)}


def test_state_is_empty_after_its_time(spark, tmp_path):
    first = [("x", at(1), 1, "STARTED", None), ("y", at(2), 2, "STARTED", None)]
    later = [("z", at(3 * 24 * 60), 3, "STARTED", None)]
    late = [("x", at(5), 4, "FAILED", None), ("z", at(3 * 24 * 60 + 1), 5, "SUCCEEDED", None)]
    found, kept = run(spark, tmp_path, [first, later, late], ExecutionState(DAY), "1 hour")
    assert kept == 1  # x and y are forgotten, the late outcome of x is behind the watermark
    assert {k: v[0] for k, v in found.items()} == {"x": "STARTED", "y": "STARTED", "z": "SUCCEEDED"}


def test_counters_and_last_checks_by_span(spark, tmp_path):
    rows = [("a", at(1), 1, "PASSED", True), ("a", at(3), 2, "ERROR", False), ("b", at(2), 3, "FINDING", True), ("a", at(2 * 24 * 60), 4, "PASSED", True), ("a", at(9), 5, "NEW", None)]
    source = tmp_path / "source"
    counts, checks = BatchTable(spark, str(tmp_path / "counts")), BatchTable(spark, str(tmp_path / "checks"))
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        counted = jobs.progress_counters(stream.withColumnRenamed("id", "scan_job_id"), "1 day", "3 days")
        jobs.changelog(counted, counts, str(tmp_path / "c1"), "scan_job_id", "span")
        newest = jobs.last_checks(stream, "1 day", "3 days")
        jobs.changelog(newest, checks, str(tmp_path / "c2"), "id", "span")
    assert {tuple(r) for r in jobs.progress(counts.all(counted.schema)).collect()} == {("a", 4, 2, 0, 1), ("b", 1, 0, 1, 0)}
    assert {tuple(r) for r in jobs.last_known(checks.all(newest.schema)).collect()} == {("a", "PASSED", True), ("b", "FINDING", True)}


def test_spans_behind_the_watermark_leave_the_store(spark, tmp_path):
    source, table = tmp_path / "source", BatchTable(spark, str(tmp_path / "table"))
    for day in (0, 10, 20):
        spark.createDataFrame([("a", at(day * 24 * 60), day, "PASSED", True)], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source)).withColumnRenamed("id", "scan_job_id")
        counted = jobs.progress_counters(stream, "1 day", "1 hour")
        jobs.changelog(counted, table, str(tmp_path / "checkpoint"), "scan_job_id", "span")
    assert spark.read.format("statestore").load(str(tmp_path / "checkpoint")).count() == 1
    assert [tuple(r)[:2] for r in jobs.progress(table.all(counted.schema)).collect()] == [("a", 3)]


@pytest.mark.parametrize("parts", [1, 4])
def test_executions_by_span_are_the_same_however_batches_fall(spark, tmp_path, parts):
    month = 30 * 24 * 60
    rows = [("x", at(5), 2, "FAILED"), ("x", at(9), 3, "SUCCEEDED"), ("x", at(0), 9, "FAILED"), ("y", at(2), 4, "FAILED"),
            ("z", at(4), 7, "SUCCEEDED"), ("z", at(4), 6, "STARTED"), ("x", at(1), 1, "STARTED"), ("x", at(7), 8, "STARTED"), ("w", at(20), 10, "STARTED"),
            ("v", at(1), 11, "STARTED"), ("v", at(month), 12, "SUCCEEDED"), ("v", at(month + 1), 13, "STARTED")]
    early, late = rows[:9], rows[9:]
    random.Random(parts).shuffle(early)
    rows = early + late
    source, table = tmp_path / "source", BatchTable(spark, str(tmp_path / "table"))
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        part = spark.createDataFrame(rows[i: i + step], "execution_id string, ts timestamp, event_id long, status string")
        part.coalesce(1).write.mode("append").parquet(str(source))
        schema = jobs.execution_log(spark.readStream.schema(part.schema).parquet(str(source)), table, str(tmp_path / "checkpoint"), "7 days", "1 day")
    found = {r[0]: tuple(r)[1:] for r in jobs.executions(table.all(schema)).collect()}
    # The outcome of v comes when its start has long left the store, and is still the outcome of that start.
    assert found.pop("v")[0] == "SUCCEEDED"
    assert in_minutes(found) == {"x": ("FAILED", 1, 5), "z": ("SUCCEEDED", 4, 4), "w": ("STARTED", 20, None)}
