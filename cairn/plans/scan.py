"""Scan, execution and health queries over the event stream."""

from pyspark.sql import functions as F

from cairn.functions import files as ff
from cairn.operators import scan as s
from cairn.plans.oracle_tables import SCAN, with_tables
from cairn.plans.registry import query
from cairn.sources import lake, scan_json

_KEYS = ["scan_job_id", "document_id"]


def _responses(spark, sf):
    """Scanner replies: the findings of an event wrapped the way its type arrives."""
    e = lake.texts(spark, sf, "events")
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    body = F.concat(
        F.lit('{"status":"'), F.when(kind == "error", "FAILED").otherwise("COMPLETED"),
        F.lit('","findings":'),
        F.when(kind == "view", "[]").otherwise(F.concat(
            F.lit('[{"severity":"HIGH","ruleId":"r'), k, F.lit('","message":" ","startLine":'), k, F.lit('},{"severity":""}]'))),
        F.lit("}"))
    quoted = F.replace(body, F.lit('"'), F.lit('\\"'))
    response = (
        F.when(kind == "signup", F.concat(F.lit('{"content":[{"text":"'), quoted, F.lit('"}]}')))
        .when(kind == "click", F.concat(F.lit('{"result":{"data":'), body, F.lit("}}")))
        .when(kind == "purchase", F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body))
    return e.select("event_id", response.alias("response"))


@query("s5_scan_json_findings", """
    WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
    SELECT event_id, 'ERROR' AS status, '-' AS severity, '-' AS rule_id, 'Scan failed.' AS message, NULL::INTEGER AS start_line
      FROM e WHERE event_type = 'error'
    UNION ALL SELECT event_id, 'PASSED', '-', '-', 'No security findings', NULL FROM e WHERE event_type = 'view'
    UNION ALL SELECT event_id, 'FINDING', 'HIGH', 'r' || k, 'Security finding', k::INTEGER FROM e WHERE event_type NOT IN ('error', 'view')
    UNION ALL SELECT event_id, 'FINDING', 'WARNING', 'unknown', 'Security finding', NULL FROM e WHERE event_type NOT IN ('error', 'view')""")
def scan_json_findings(spark, sf):
    return scan_json.findings(_responses(spark, sf)).select(
        "event_id", "status", "severity", "rule_id", "message", "start_line")


@query("p10_finding_filter", with_tables(
    """SELECT document_id, severity, rule_id FROM scan_result WHERE severity = 'HIGH' AND status = 'FINDING'
    AND (file_name ILIKE '%rule-4%' OR rule_id ILIKE '%rule-4%' OR message ILIKE '%rule-4%')""", SCAN))
def finding_filter(spark, sf):
    return s.filter_findings(lake.scan_results(spark, sf), "HIGH", "FINDING", " Rule-4").select(
        "document_id", "severity", "rule_id")


@query("a13_scan_totals", with_tables(
    """SELECT project_id, count(*) AS total_files, count(*) FILTER (status <> 'ERROR') AS scanned_files,
    count(*) FILTER (status = 'PASSED') AS passed_files, count(*) FILTER (status = 'FINDING') AS finding_count,
    count(*) FILTER (status = 'ERROR') AS error_files FROM scan_result GROUP BY 1""", SCAN))
def scan_totals(spark, sf):
    return s.scan_totals(lake.scan_results(spark, sf), "project_id")


def _jobs(spark, sf):
    """A job was opened for every event of its user and day plus one file that is still missing on quiet days."""
    r = lake.scan_results(spark, sf)
    return r.groupBy("project_id", "scan_job_id").agg(
        F.max("created_at").alias("created_at"),
        (F.count(F.lit(1)) + F.when(F.count(F.lit(1)) < 2, 1).otherwise(0)).alias("total_files"))


_JOBS = """job AS (SELECT project_id, scan_job_id, max(created_at) AS created_at, count(*) AS n, count(*) + (count(*) < 2)::INTEGER AS total_files,
    count(*) FILTER (status = 'PASSED') AS passed_files, count(*) FILTER (status = 'FINDING') AS finding_count,
    count(*) FILTER (status = 'ERROR') AS error_files, arg_min(message, document_id) FILTER (status = 'ERROR') AS first_error
    FROM scan_result GROUP BY ALL)"""


@query("a14_job_progress", with_tables(
    f"""{_JOBS} SELECT scan_job_id, total_files::BIGINT AS total_files, n AS processed_files, passed_files, finding_count, error_files,
    least(100, n * 100 // total_files)::BIGINT AS progress FROM job""", SCAN))
def job_progress(spark, sf):
    outcomes = s.file_outcomes(lake.scan_results(spark, sf), _KEYS)
    return s.job_progress(outcomes, _jobs(spark, sf)).select(
        "scan_job_id", "total_files", "processed_files", "passed_files", "finding_count", "error_files", "progress")


@query("a15_job_final_status", with_tables(
    f"""{_JOBS} SELECT scan_job_id, CASE WHEN n < total_files THEN 'RUNNING' WHEN error_files > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS final_status,
    CASE WHEN n < total_files THEN 'Scanning' WHEN error_files > 0 THEN first_error ELSE 'All files scanned' END AS status_message FROM job""", SCAN))
def job_final_status(spark, sf):
    results = lake.scan_results(spark, sf)
    progress = s.job_progress(s.file_outcomes(results, _KEYS), _jobs(spark, sf))
    return s.job_status(progress, results).select("scan_job_id", "final_status", "status_message")


@query("j24_latest_scan_results", with_tables(
    f"""{_JOBS}, newest AS (SELECT project_id, arg_max(scan_job_id, created_at) AS scan_job_id FROM job GROUP BY 1)
    SELECT document_id, project_id, status FROM scan_result SEMI JOIN newest USING (project_id, scan_job_id)""", SCAN))
def latest_scan_results(spark, sf):
    return s.latest_job_results(lake.scan_results(spark, sf), _jobs(spark, sf)).select("document_id", "project_id", "status")


@query("w3_latest_job_per_project", with_tables(
    f"""{_JOBS} SELECT project_id, scan_job_id FROM job QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_job_id DESC) = 1""", SCAN))
def latest_job(spark, sf):
    return _jobs(spark, sf).groupBy("project_id").agg(
        F.max_by("scan_job_id", F.struct("created_at", "scan_job_id")).alias("scan_job_id"))


@query("s8_finding_export", with_tables(
    """SELECT document_id, file_name, file_type, status, severity, rule_id, message, NULL::INTEGER AS start_line,
    NULL::INTEGER AS start_column, NULL::INTEGER AS end_line, NULL::INTEGER AS end_column FROM scan_result""", SCAN))
def finding_export(spark, sf):
    return s.export_rows(lake.scan_results(spark, sf))


@query("t8_pending_work", """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS status
    FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def pending_work(spark, sf):
    o = lake.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("COMPLETED").alias("status"))
    return s.work_list(o, "QUEUED", "RUNNING").select("id", "status")


@query("a16_health_rollup", """
    WITH d AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'click' THEN 'DEGRADED' WHEN 'view' THEN 'UNKNOWN' ELSE 'UP' END AS status,
                      value > 10 AS critical, strftime(ts, '%Y-%m-%d') AS day FROM events),
    n AS (SELECT user_id, day, count(*) AS total, count(*) FILTER (status = 'UP') AS up, count(*) FILTER (status = 'DEGRADED') AS degraded,
                 count(*) FILTER (status = 'DOWN') AS down, count(*) FILTER (status = 'UNKNOWN') AS unknown,
                 bool_or(status = 'DOWN' AND critical) AS cd FROM d GROUP BY ALL)
    SELECT user_id, day, total, up, degraded, down, unknown, CASE WHEN cd THEN 'DOWN' WHEN down + degraded > 0 OR (unknown > 0 AND up > 0) THEN 'DEGRADED'
           WHEN unknown = total THEN 'UNKNOWN' ELSE 'UP' END AS overall FROM n""")
def health_rollup(spark, sf):
    return s.health_rollup(health_events(spark, sf), "user_id", "day")


def health_events(spark, sf):
    """Dependency checks: a user is a dependency, its event type the reported status."""
    kind = F.col("event_type")
    return lake.raw(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("value") > 10).alias("critical"),
        F.when(kind == "error", "DOWN").when(kind == "click", "DEGRADED").when(kind == "view", "UNKNOWN").otherwise("UP").alias("status"))


def steps(spark, sf):
    """Execution steps: line items of an order, the order being the execution."""
    li = lake.raw(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("execution_id"), F.col("l_linenumber").alias("step_id"),
        F.when(F.col("l_returnflag") == "N", "SUCCEEDED").when(F.col("l_returnflag") == "A", "FALLBACK_SUCCEEDED").otherwise("FAILED").alias("status"),
        F.when(F.col("l_linestatus") == "O", "TOOL_CALL").otherwise("PING").alias("kind"),
        F.concat(F.lit("tool"), F.col("l_suppkey").cast("string")).alias("target"),
        F.col("l_partkey").cast("string").alias("arguments"), F.col("l_tax").cast("string").alias("result"))


@query("a17_execution_rollup", """
    SELECT l_orderkey AS execution_id, CASE WHEN bool_or(l_returnflag NOT IN ('N', 'A')) THEN 'PARTIAL'
    WHEN bool_or(l_returnflag = 'A') THEN 'SUCCEEDED_WITH_FALLBACK' ELSE 'SUCCEEDED' END AS overall FROM lineitem GROUP BY 1""")
def execution_rollup(spark, sf):
    return s.execution_rollup(steps(spark, sf), "execution_id")


@query("p23_public_steps", """
    SELECT l_orderkey AS execution_id, l_linenumber AS step_id, CASE WHEN l_linestatus = 'O' THEN 'TOOL_CALL' ELSE 'PING' END AS kind,
    CASE WHEN l_linestatus = 'O' THEN 'tool' || l_suppkey ELSE 'PING' END AS target FROM lineitem""")
def public_steps(spark, sf):
    return s.public_steps(steps(spark, sf)).select("execution_id", "step_id", "kind", "target")


@query("p22_scan_admission", """
    SELECT doc_id, CASE WHEN strlen(text) > 1048576 THEN 'File exceeds the scan size limit.'
      WHEN lang = 'fr' THEN 'File is not valid UTF-8.' END AS error FROM documents""")
def scan_admission(spark, sf):
    """Admission of stored bytes; French files are stored with a stray byte in front."""
    raw_bytes = F.encode("text", "UTF-8")
    stored = F.when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("FF")), raw_bytes)).otherwise(raw_bytes)
    return lake.raw(spark, sf, "documents").select("doc_id", ff.admission_error(stored).alias("error"))
