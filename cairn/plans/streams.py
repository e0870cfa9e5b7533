"""Streaming jobs run over the tables as streams, up to what is available now."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.operators import quality
from cairn.operators.chunking import plain_chunks
from cairn.operators.scan import health_rollup
from cairn.plans.oracle_tables import DOCUMENT, SCAN, with_tables
from cairn.plans.registry import query
from cairn.session import shared_dir
from cairn.sources import lake
from cairn.sources.batches import BatchTable
from cairn.sources.hash_index import HashIndex
from cairn.streaming import jobs


def _place(spark, name):
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    return BatchTable(spark, f"{base}/table"), f"{base}/checkpoint"


class _Streamed:
    """Makes the lake's builders read one raw table as a stream."""

    def __init__(self, spark, name):
        self.reader, self.name = spark.readStream, name

    @property
    def read(self):
        return self

    def schema(self, schema):
        self.reader = self.reader.schema(schema)
        return self

    def parquet(self, path):
        """A table is a file or a folder of files; a stream takes a single file only by a pattern."""
        return self.reader.parquet(f"{path[:-1]}[{path[-1]}]")


@query("st1_inbox_ingest", with_tables(
    "SELECT min(id) AS id, project_key, file_hash, document_type FROM document GROUP BY 2, 3, 4", DOCUMENT))
def inbox_ingest(spark, sf):
    columns = ["id", "project_key", "file_hash", "document_type", "deleted_at"]
    arrivals = lake.documents_catalog(_Streamed(spark, "documents"), sf).select(*columns)
    table, checkpoint = _place(spark, "inbox")
    index = HashIndex(spark, table.path, arrivals.schema, 8)
    jobs.ingest(arrivals, index, checkpoint)
    return index.all().select(*columns[:-1])


@query("s4_inbox_chunks", with_tables(
    """SELECT source_key || ':chunk:' || i AS chunk_id, substr(content, (i * 1050 + 1)::BIGINT, 1200) AS content
    FROM (SELECT vector_source_key AS source_key, content, unnest(range(0, greatest(ceil((length(content) - 1200) / 1050), 0)::BIGINT + 1)) AS i
          FROM document WHERE original_file_name NOT LIKE '%.java' AND length(content) > 0)""", DOCUMENT))
def inbox_chunks(spark, sf):
    """Documents arriving in the inbox, cut into overlapping chunks as they come."""
    arrivals = plain_chunks(lake.documents_catalog(_Streamed(spark, "documents"), sf)).select("chunk_id", "content")
    table, checkpoint = _place(spark, "chunks")
    jobs.drain(arrivals, lambda batch, batch_id: table.write(batch, batch_id), checkpoint)
    return table.all(arrivals.schema).select("chunk_id", "content")


@query("st2_scan_progress", with_tables(
    """SELECT scan_job_id, count(*) AS processed_files, count(*) FILTER (status = 'PASSED') AS passed_files, count(*) FILTER (status = 'FINDING') AS finding_count,
    count(*) FILTER (status = 'ERROR') AS error_files FROM scan_result GROUP BY 1""", SCAN))
def scan_progress(spark, sf):
    outcomes = lake.scan_results(_Streamed(spark, "events"), sf).select("scan_job_id", F.col("created_at").alias("ts"), "status")
    table, checkpoint = _place(spark, "progress")
    counted = jobs.progress_counters(outcomes, "7 days", "1 day")
    jobs.changelog(counted, table, checkpoint, "scan_job_id", "span")
    return jobs.progress(table.all(counted.schema))


def _executions(spark, sf):
    kind = F.col("event_type")
    return lake.raw(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("execution_id"), "ts", "event_id",
        F.when(kind == "error", "FAILED").when(kind == "purchase", "SUCCEEDED").when(kind == "view", "STARTED").otherwise("NOTED").alias("status"))


@query("st3_execution_state", """
    WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS execution_id, ts, event_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'view' THEN 'STARTED' ELSE 'NOTED' END AS status FROM events)
    , s AS (SELECT execution_id, min((ts, event_id)) AS start, min(ts) AS started FROM e WHERE status = 'STARTED' GROUP BY 1),
    o AS (SELECT e.execution_id, arg_min(e.status, (e.ts, e.event_id)) AS outcome, min(e.ts) AS completed FROM e JOIN s USING (execution_id)
      WHERE e.status IN ('FAILED', 'SUCCEEDED') AND (e.ts, e.event_id) > s.start GROUP BY 1)
    SELECT execution_id, coalesce(outcome, 'STARTED') AS status, epoch_us(started) AS started_us, epoch_us(completed) AS completed_us,
    (epoch_us(completed) - epoch_us(started)) // 1000 AS duration_ms FROM s LEFT JOIN o USING (execution_id)""")
def execution_state(spark, sf):
    events = _executions(_Streamed(spark, "events"), sf).where(F.col("status") != "NOTED")
    table, checkpoint = _place(spark, "execution")
    schema = jobs.execution_log(events, table, checkpoint, "7 days", "1 day")
    now = jobs.executions(table.all(schema))
    return now.withColumn("duration_ms", F.expr("(completed_us - started_us) div 1000"))


@query("st4_health_snapshot", """
    WITH d AS (SELECT user_id, arg_max(CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'click' THEN 'DEGRADED' WHEN 'view' THEN 'UNKNOWN' ELSE 'UP' END, (ts, event_id)) AS status,
      arg_max(value > 10, (ts, event_id)) AS critical FROM events GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (status = 'UP') AS up, count(*) FILTER (status = 'DEGRADED') AS degraded, count(*) FILTER (status = 'DOWN') AS down,
    count(*) FILTER (status = 'UNKNOWN') AS unknown, CASE WHEN bool_or(critical AND status = 'DOWN') THEN 'DOWN' WHEN bool_or(status IN ('DOWN', 'DEGRADED')) OR (bool_or(status = 'UNKNOWN') AND bool_or(status = 'UP')) THEN 'DEGRADED'
      WHEN bool_and(status = 'UNKNOWN') THEN 'UNKNOWN' ELSE 'UP' END AS overall FROM d""")
def health_snapshot(spark, sf):
    from cairn.plans.scan import health_events

    checks = health_events(_Streamed(spark, "events"), sf).withColumn("id", F.col("user_id").cast("string"))
    table, checkpoint = _place(spark, "health")
    newest = jobs.last_checks(checks.select("id", "ts", "event_id", "status", "critical"), "7 days", "1 day")
    jobs.changelog(newest, table, checkpoint, "id", "span")
    return health_rollup(jobs.last_known(table.all(newest.schema)))


@query("st5_changed_snapshots", """SELECT project_key, id FROM (SELECT 'c' || o_custkey AS project_key, o_orderkey AS id, floor(o_totalprice / 40000) AS now,
    lag(floor(o_totalprice / 40000)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before IS DISTINCT FROM now""")
def changed_snapshots(spark, sf):
    """Evaluations stream in; each one that differs from the one before it is stored."""
    o = lake.raw(_Streamed(spark, "orders"), sf, "orders")
    measured = o.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("project_key"), F.col("o_orderkey").alias("id"), F.lit(0).alias("created_at"),
        *[F.floor(F.col("o_totalprice") / 40000).cast("long").alias(c) for c in quality.MEASURES],
        F.floor(F.col("o_totalprice") / 40000).cast("double").alias("duplicate_ratio"))
    table, checkpoint = _place(spark, "snapshot")
    jobs.snapshots(measured, table, checkpoint)
    return table.all(measured.schema).select("project_key", "id")


@query("st6_catalog_sync", """SELECT 'cap' || p_partkey AS capability_id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 'retained' ELSE 'removed' END AS action,
    CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey + 1 IN (SELECT l_partkey FROM lineitem) AND p_partkey + 1 IN (SELECT p_partkey FROM part) THEN 1 ELSE 0 END AS reference_count FROM part""")
def catalog_sync(spark, sf):
    part = lake.raw(spark, sf, "part").select(
        F.concat(F.lit("cap"), F.col("p_partkey").cast("string")).alias("capability_id"), F.concat(F.lit("tool"), F.col("p_partkey").cast("string")).alias("tool"),
        F.concat(F.lit("cap"), (F.col("p_partkey") + 1).cast("string")).alias("reference_id"))
    # Every order line lists its part's tool; the lines are one listing.
    lines = lake.raw(spark, sf, "lineitem").count()
    listings = lake.raw(_Streamed(spark, "lineitem"), sf, "lineitem").select(
        F.lit(1).cast("long").alias("listing_id"), F.lit(lines).cast("long").alias("n_tools"),
        F.concat(F.lit("tool"), F.col("l_partkey").cast("string")).alias("tool"))
    table, checkpoint = _place(spark, "sync")
    log, _ = _place(spark, "listings")
    jobs.catalog_sync(listings, part.select("capability_id", "tool"), part.select("capability_id", "reference_id"), log, table, checkpoint)
    return table.all(StructType.fromDDL(jobs.CATALOG)).select("capability_id", "action", "reference_count")
