"""Queries whose result is a table after a change, or what an audit finds."""

from pyspark.sql import functions as F

from cairn.operators import mutation as m
from cairn.plans.oracle_tables import DOCUMENT, with_tables
from cairn.plans.registry import query
from cairn.sources import lake


def _stored(spark, sf):
    """The part of the catalog that was judged of good quality, as the stored catalog."""
    good = lake.raw(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return lake.documents_catalog(spark, sf).join(good, "id", "left_semi")


_STORED = "stored AS (SELECT * FROM document WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1))"


@query("d1_insert_absent", with_tables(
    f"""{_STORED}, k AS (SELECT min(id) AS id, project_key, file_hash, document_type FROM document GROUP BY 2, 3, 4)
    SELECT id, file_hash FROM k WHERE (project_key, file_hash, document_type) NOT IN (SELECT (project_key, file_hash, document_type) FROM stored WHERE deleted_at IS NULL)""", DOCUMENT))
def insert_absent(spark, sf):
    return m.insert_absent(_stored(spark, sf), lake.documents_catalog(spark, sf)).select("id", "file_hash")


@query("d1_resolved_rows", with_tables(
    f"""{_STORED}, o AS (SELECT min(id) AS stored_id, project_key, file_hash, document_type FROM stored WHERE deleted_at IS NULL GROUP BY 2, 3, 4)
    SELECT id, stored_id FROM document LEFT JOIN o USING (project_key, file_hash, document_type)""", DOCUMENT))
def resolved_rows(spark, sf):
    return m.resolved_rows(_stored(spark, sf), lake.documents_catalog(spark, sf))


def _thresholds(spark, sf):
    c = lake.raw(spark, sf, "customer")
    stored = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("project_key"), F.lit(10).cast("long").alias("cyclomatic"),
                      F.lit(15).cast("long").alias("cognitive"), F.lit(10.0).alias("duplicate_ratio"), F.lit(5).cast("long").alias("minimum_lines"))
    o = lake.raw(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("cyclomatic"), F.count(F.lit(1)).alias("cognitive"),
        (F.max("o_totalprice") / 5000).alias("duplicate_ratio"), F.max(F.dayofmonth("o_orderdate")).cast("long").alias("minimum_lines"))
    return stored, o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("project_key"), "cyclomatic", "cognitive", "duplicate_ratio", "minimum_lines")


_NEW = """new AS (SELECT 'c' || o_custkey AS project_key, count(*) FILTER (o_orderstatus = 'O') AS cyclomatic, count(*) AS cognitive, max(o_totalprice) / 5000 AS duplicate_ratio,
    max(day(o_orderdate)) AS minimum_lines FROM orders GROUP BY 1), ok AS (SELECT * FROM new WHERE cyclomatic >= 1 AND cognitive >= 1 AND duplicate_ratio BETWEEN 0 AND 100 AND minimum_lines >= 1)"""


@query("d2_upsert_thresholds", f"""WITH {_NEW} SELECT project_key, cyclomatic, cognitive, duplicate_ratio, minimum_lines FROM ok
    UNION ALL SELECT 'c' || c_custkey, 10, 15, 10.0, 5 FROM customer WHERE 'c' || c_custkey NOT IN (SELECT project_key FROM ok)""")
def upsert_thresholds(spark, sf):
    return m.upsert_thresholds(*_thresholds(spark, sf))[0]


@query("d2_refused_thresholds", f"WITH {_NEW} SELECT project_key FROM new WHERE project_key NOT IN (SELECT project_key FROM ok)")
def refused_thresholds(spark, sf):
    return m.upsert_thresholds(*_thresholds(spark, sf))[1].select("project_key")


@query("d3_soft_delete", with_tables(
    """SELECT id, CASE WHEN hit THEN 'DELETED' ELSE index_status END AS index_status, CASE WHEN hit AND graph_source_key IS NOT NULL THEN 'DELETED' ELSE graph_index_status END AS graph_index_status,
    (CASE WHEN hit THEN TIMESTAMP '2025-01-01' ELSE deleted_at END)::VARCHAR AS deleted_at
    FROM (SELECT *, deleted_at IS NULL AND id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS hit FROM document)""", DOCUMENT))
def soft_delete(spark, sf):
    toxic = lake.raw(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    out = m.mark_deleted(lake.documents_catalog(spark, sf), toxic, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("id", "index_status", "graph_index_status", F.col("deleted_at").cast("string").alias("deleted_at"))


def transitions(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "view", "RUNNING").when(kind == "purchase", "PASSED").when(kind == "error", "ERROR").when(kind == "click", "FINDING").otherwise("NOTED")
    return lake.raw(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("item"), "ts", "event_id", status.alias("status"))


_TRANSITIONS = """ev AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS item, ts, event_id, CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'PASSED'
    WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'FINDING' ELSE 'NOTED' END AS status FROM events),
st AS (SELECT item, min((ts, event_id)) AS s FROM ev WHERE status = 'RUNNING' GROUP BY 1),
fin AS (SELECT item, arg_min(status, (ts, event_id)) AS outcome FROM ev JOIN st USING (item) WHERE status IN ('PASSED', 'ERROR', 'FINDING') AND (ts, event_id) > s GROUP BY 1),
state AS (SELECT item, coalesce(outcome, CASE WHEN s IS NOT NULL THEN 'RUNNING' END, 'QUEUED') AS status FROM (SELECT DISTINCT item FROM ev) LEFT JOIN st USING (item) LEFT JOIN fin USING (item))"""


@query("d4_guarded_transitions", f"WITH {_TRANSITIONS} SELECT item, status FROM state")
def guarded_transitions(spark, sf):
    return m.first_outcome(transitions(spark, sf), "item", ["ts", "event_id"], "RUNNING", ["PASSED", "ERROR", "FINDING"]).select("item", "status")


_JOB_EVENTS = """ev AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS job, (ts, event_id) AS tick, CASE WHEN event_type = 'view' THEN 'RUN' WHEN event_type = 'error' AND value > 20 THEN 'FAIL' ELSE 'FILE' END AS kind,
      CASE event_type WHEN 'click' THEN 'FINDING' WHEN 'error' THEN 'ERROR' ELSE 'PASSED' END AS outcome FROM events),
job AS (SELECT job, 1 + length(job) % 2 AS total_files FROM (SELECT DISTINCT job FROM ev)),
s AS (SELECT job, min(tick) AS start FROM ev WHERE kind = 'RUN' GROUP BY 1), f AS (SELECT job, min(tick) AS fail FROM ev WHERE kind = 'FAIL' GROUP BY 1),
counted AS (SELECT * FROM (SELECT ev.job, tick, outcome, row_number() OVER (PARTITION BY ev.job ORDER BY tick) AS n FROM ev JOIN s ON ev.job = s.job WHERE kind = 'FILE' AND tick > start)
    JOIN job USING (job) LEFT JOIN f USING (job) WHERE n <= total_files AND (fail IS NULL OR tick < fail)),
agg AS (SELECT job, count(*) AS processed, count(*) FILTER (outcome = 'PASSED') AS passed, count(*) FILTER (outcome = 'FINDING') AS findings, count(*) FILTER (outcome = 'ERROR') AS errors FROM counted GROUP BY 1)"""


@query("d4_job_states", f"""WITH {_JOB_EVENTS} SELECT job, CASE WHEN processed >= total_files THEN CASE WHEN errors > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END
    WHEN fail IS NOT NULL THEN 'FAILED' WHEN start IS NOT NULL THEN 'RUNNING' ELSE 'QUEUED' END AS status, coalesce(processed, 0) AS processed, coalesce(passed, 0) AS passed,
    coalesce(findings, 0) AS findings, coalesce(errors, 0) AS errors FROM job LEFT JOIN s USING (job) LEFT JOIN f USING (job) LEFT JOIN agg USING (job)""")
def job_states(spark, sf):
    """Events of a user and day as those of a job of one or two files."""
    kind = F.col("event_type")
    events = lake.raw(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("job"), F.struct("ts", "event_id").alias("at"),
        F.when(kind == "view", "RUN").when((kind == "error") & (F.col("value") > 20), "FAIL").otherwise("FILE").alias("kind"),
        F.when(kind == "click", "FINDING").when(kind == "error", "ERROR").otherwise("PASSED").alias("outcome"))
    jobs = events.select("job").distinct().withColumn("total_files", 1 + F.length("job") % 2)
    return m.job_states(jobs, events)


@query("d9_recover_interrupted", f"WITH {_TRANSITIONS} SELECT CASE status WHEN 'RUNNING' THEN 'QUEUED' ELSE status END AS status, count(*) AS n FROM state GROUP BY 1")
def recover_interrupted(spark, sf):
    state = m.first_outcome(transitions(spark, sf), "item", ["ts", "event_id"], "RUNNING", ["PASSED", "ERROR", "FINDING"])
    return m.recover_interrupted(state).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("d5_column_repair", with_tables(
    """SELECT id, CASE WHEN project_key = 'es' THEN 'default' ELSE project_key END AS project_key, vector_source_key, graph_source_key FROM document""", DOCUMENT))
def column_repair(spark, sf):
    damaged = lake.documents_catalog(spark, sf).withColumns({
        "project_key": F.when(F.col("project_key") == "es", " \t").otherwise(F.col("project_key")),
        "vector_source_key": F.lit("stale"), "graph_source_key": F.lit(None).cast("string")})
    return m.repair_documents(damaged).select("id", "project_key", "vector_source_key", "graph_source_key")


def _versions(spark, sf):
    s = F.col("o_orderstatus")
    return lake.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version_key"),
        F.when(s == "O", "ACTIVE").when(s == "P", "DRAFT").otherwise("ARCHIVED").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", None).otherwise(F.col("o_orderdate")).alias("activated_at"), "o_orderpriority")


@query("d6_activate_versions", """SELECT 'v' || o_orderkey AS version_key, CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_orderpriority = '2-HIGH' THEN 'ACTIVE' ELSE 'DRAFT' END ELSE 'ARCHIVED' END AS status FROM orders""")
def activate_versions(spark, sf):
    versions = _versions(spark, sf)
    return m.activate_versions(versions, versions.where("o_orderpriority = '2-HIGH'")).select("version_key", "status")


@query("w3_active_version", """SELECT 'v' || o_orderkey AS version_key FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey DESC LIMIT 1""")
def active_version(spark, sf):
    return m.active_version(_versions(spark, sf)).select("version_key")


@query("d10_integrity_audit", """SELECT 'one open order per customer' AS "check", o_custkey::VARCHAR AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1
    UNION ALL SELECT 'labelled document exists', l_partkey::VARCHAR, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM labels) GROUP BY l_partkey
    UNION ALL SELECT 'known role', role, count(*) FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY role""")
def integrity_audit(spark, sf):
    labels = lake.raw(spark, sf, "labels")
    return (
        m.more_than_one(lake.raw(spark, sf, "orders").where("o_orderstatus = 'O'"), "o_custkey", "one open order per customer")
        .unionByName(m.missing_parent(lake.raw(spark, sf, "lineitem"), labels, "l_partkey", "doc_id", "labelled document exists"))
        .unionByName(m.outside_domain(lake.raw(spark, sf, "conversations"), "role", ["user", "assistant"], "known role")))


@query("d12_index_outcomes", with_tables(
    """SELECT id, CASE WHEN hit THEN nv ELSE vector_index_status END AS vector_index_status, CASE WHEN hit AND ng IS NOT NULL THEN ng ELSE graph_index_status END AS graph_index_status,
    CASE WHEN NOT hit THEN index_status WHEN nv = 'FAILED' OR coalesce(ng, graph_index_status) = 'FAILED' THEN 'FAILED' ELSE 'INDEXED' END AS index_status
    FROM (SELECT d.*, deleted_at IS NULL AND l.doc_id IS NOT NULL AS hit, CASE WHEN quality = 1 THEN 'INDEXED' ELSE 'FAILED' END AS nv, CASE WHEN toxic = 1 THEN 'FAILED' END AS ng
          FROM document d LEFT JOIN labels l ON d.id = l.doc_id)""", DOCUMENT))
def index_outcomes(spark, sf):
    outcomes = lake.raw(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "INDEXED").otherwise("FAILED").alias("vector_index_status"),
        F.when(F.col("toxic") == 1, "FAILED").alias("graph_index_status"), F.lit(None).cast("string").alias("error_message"))
    return m.apply_index_outcomes(lake.documents_catalog(spark, sf), outcomes).select("id", "vector_index_status", "graph_index_status", "index_status")
