from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.sources.batches import BatchTable
from cairn.sources.hash_index import HashIndex
from cairn.streaming import jobs


ROW = "id long, project_key string, file_hash string, document_type string, deleted_at timestamp_ntz"


def test_inbox_over_several_batches(spark, tmp_path):
    inbox, index = tmp_path / "inbox", HashIndex(spark, str(tmp_path / "index"), StructType.fromDDL(ROW), 8)
    inbox.mkdir()

    def drop(name, text):
        (inbox / name).write_text(text)

    def run():
        arrivals = jobs.inbox_files(spark, str(inbox)).select(
            F.xxhash64("path").alias("id"), F.lit("p").alias("project_key"), F.sha2("content", 256).alias("file_hash"), F.lit("S").alias("document_type"),
            F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
        jobs.ingest(arrivals, index, str(tmp_path / "checkpoint"))
        return index.all()

    drop("a.md", "one"), drop("b.md", "one"), drop("c.md", "two")
    assert run().count() == 2
    drop("d.md", "one"), drop("e.md", "three"), drop("f.md.part", "unfinished")
    assert run().count() == 3
    again = index.all().limit(2)
    index.add(again)  # a batch that runs again
    assert index.all().count() == 3


def test_two_watchers_store_each_content_once(spark, tmp_path):
    rows = [(i, "p", f"h{i % 40}", "S", None) for i in range(80)] + [(100 + i, "p", None, "S", None) for i in range(3)]
    path, schema = str(tmp_path / "index"), StructType.fromDDL(ROW)
    halves = [spark.createDataFrame(rows[:60], ROW), spark.createDataFrame(rows[30:], ROW)]
    with ThreadPoolExecutor(2) as both:
        list(both.map(lambda half: HashIndex(spark, path, schema, 4).add(half), halves))
    stored = HashIndex(spark, path, schema, 4).all().collect()
    assert sorted(r.file_hash for r in stored if r.file_hash) == sorted({f"h{i}" for i in range(40)})
    assert sorted(r.id for r in stored if r.file_hash is None) == [100, 101, 102]


def test_the_second_to_commit_looks_again(spark, tmp_path, monkeypatch):
    index = HashIndex(spark, str(tmp_path / "index"), StructType.fromDDL(ROW), 1)
    other = HashIndex(spark, str(tmp_path / "index"), StructType.fromDDL(ROW), 1)
    take, taken = index._take, []

    def late(bucket, number, folder):
        if not taken:
            other.add(spark.createDataFrame([(9, "p", "h1", "S", None)], ROW))
        taken.append(number)
        return take(bucket, number, folder)

    monkeypatch.setattr(index, "_take", late)
    index.add(spark.createDataFrame([(1, "p", "h1", "S", None), (2, "p", "h2", "S", None)], ROW))
    assert taken == [0, 1] and sorted((r.id, r.file_hash) for r in index.all().collect()) == [(2, "h2"), (9, "h1")]


def test_a_batch_reads_the_buckets_of_its_hashes(spark, tmp_path, monkeypatch):
    index = HashIndex(spark, str(tmp_path / "index"), StructType.fromDDL(ROW), 16)
    index.add(spark.createDataFrame([(i, "p", f"h{i}", "S", None) for i in range(60)], ROW))
    asked, rows = [], index._rows
    monkeypatch.setattr(index, "_rows", lambda folders: (asked.append(rows(folders)), asked[-1])[1])
    index.add(spark.createDataFrame([(99, "p", "h7", "S", None)], ROW))
    files = asked[0].inputFiles()
    assert 0 < asked[0].count() < 20 and len({f.split("/bucket=")[1].split("/")[0] for f in files}) == 1


def test_changelog_keeps_the_newest_state(spark, tmp_path):
    source, table = tmp_path / "source", BatchTable(spark, str(tmp_path / "table"))
    schema = "scan_job_id string, status string"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        jobs_seen = spark.readStream.schema(schema).parquet(str(source)).groupBy("scan_job_id").agg(F.count(F.lit(1)).alias("n"))
        jobs.changelog(jobs_seen, table, str(tmp_path / "checkpoint"), "scan_job_id", every=2)
        return {r.scan_job_id: r.n for r in jobs.latest(table.all(jobs_seen.schema), "scan_job_id").collect()}

    assert feed([("a", "PASSED"), ("b", "ERROR")]) == {"a": 1, "b": 1}
    assert feed([("a", "ERROR"), ("a", "PASSED")]) == {"a": 3, "b": 1}
    assert feed([("c", "ERROR")]) == {"a": 3, "b": 1, "c": 1}
    assert (tmp_path / "table-gathered" / "batch=1").exists()


def test_every_change_is_stored_however_batches_fall(spark, tmp_path):
    from cairn.operators import quality

    schema = "project_key string, id long, created_at long, " + ", ".join(f"{c} long" for c in quality.MEASURES) + ", duplicate_ratio double"
    values = [1, 1, 2, 2, 1, 1, 3]
    rows = [("p", i, i, *[v] * len(quality.MEASURES), 0.5) for i, v in enumerate(values)]

    def run(name, parts):
        source, table = tmp_path / name, BatchTable(spark, str(tmp_path / f"{name}-table"))
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
            jobs.snapshots(spark.readStream.schema(schema).parquet(str(source)), table, str(tmp_path / f"{name}-checkpoint"))
        return sorted(r.id for r in table.all(spark.createDataFrame([], schema).schema).collect())

    assert run("one", [rows]) == run("many", [rows[:2], rows[2:3], rows[3:6], rows[6:]]) == [0, 2, 4, 6]


def test_listings_are_reconciled_one_after_the_other(spark, tmp_path):
    current = spark.createDataFrame([("a", "t1"), ("b", "t2")], "capability_id string, tool string")
    references = spark.createDataFrame([("a", "b")], "capability_id string, reference_id string")
    schema = "listing_id long, n_tools long, tool string"
    rows = [(1, 1, " "), (2, 2, "t1"), (2, 2, "t3"), (3, 3, "t1"), (3, 3, "t2"), (3, 3, "t3")]

    def run(name, parts):
        source, table = tmp_path / name, BatchTable(spark, str(tmp_path / f"{name}-table"))
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
            log = BatchTable(spark, str(tmp_path / f"{name}-log"))
            jobs.catalog_sync(spark.readStream.schema(schema).parquet(str(source)), current, references, log, table, str(tmp_path / f"{name}-checkpoint"))
        stored = table.all(StructType.fromDDL(jobs.CATALOG)).collect()
        return sorted((r.listing_id, r.capability_id, r.action, r.reference_count) for r in stored)

    assert run("refused", [rows[:1]]) == []
    want = [(2, "a", "retained", 0), (2, "auto.t3", "added", 0), (2, "b", "removed", 0),
            (3, "a", "retained", 0), (3, "auto.t2", "added", 0), (3, "auto.t3", "retained", 0)]
    assert run("one", [rows]) == run("many", [rows[:2], rows[2:4], rows[4:]]) == want
