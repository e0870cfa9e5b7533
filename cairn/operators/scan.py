"""Scan-finding analytics, scan jobs, execution and health rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import contains_ignoring_case, non_blank

# Column order of a findings export.
EXPORT_COLUMNS = ("document_id", "file_name", "file_type", "status", "severity", "rule_id", "message",
                  "start_line", "start_column", "end_line", "end_column")


def filter_findings(rows: DataFrame, severity: str = "ALL", status: str = "ALL", keyword: str = "") -> DataFrame:
    if severity != "ALL":
        rows = rows.where(F.col("severity") == severity)
    if status != "ALL":
        rows = rows.where(F.col("status") == status)
    word = keyword.strip()
    if word:
        rows = rows.where(contains_ignoring_case(F.col("file_name"), word) | contains_ignoring_case(F.col("rule_id"), word)
                          | contains_ignoring_case(F.col("message"), word))
    return rows


def file_outcomes(results: DataFrame, keys: list[str]) -> DataFrame:
    """One outcome per scanned file: an error row makes it ERROR, else findings or a pass."""
    errors = F.count_if(F.col("status") == "ERROR")
    findings = F.count_if(F.col("status") == "FINDING")
    return results.groupBy(*keys).agg(errors.alias("_errors"), findings.alias("findings")).select(
        *keys,
        F.when(F.col("_errors") > 0, "ERROR").when(F.col("findings") > 0, "FINDING").otherwise("PASSED").alias("outcome"),
        F.when(F.col("_errors") > 0, 0).otherwise(F.col("findings")).cast("long").alias("findings"),
    )


def scan_totals(results: DataFrame, key: str) -> DataFrame:
    files = file_outcomes(results, [key, "document_id"])
    return files.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("outcome") != "ERROR").alias("scanned_files"),
        F.count_if(F.col("outcome") == "PASSED").alias("passed_files"),
        F.sum("findings").alias("finding_count"),
        F.count_if(F.col("outcome") == "ERROR").alias("error_files"),
    )


def percent_done(processed: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(processed * 100 / total))).cast("long")


def job_progress(outcomes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counters of each job and its percentage; jobs without outcomes stay at zero."""
    done = outcomes.groupBy("scan_job_id").agg(
        F.count(F.lit(1)).alias("processed_files"),
        F.count_if(F.col("outcome") == "PASSED").alias("passed_files"),
        F.sum("findings").alias("finding_count"),
        F.count_if(F.col("outcome") == "ERROR").alias("error_files"),
    )
    names = ("processed_files", "passed_files", "finding_count", "error_files")
    joined = jobs.join(done, "scan_job_id", "left").withColumns(
        {n: F.coalesce(n, F.lit(0)).cast("long") for n in names})
    return joined.withColumn("progress", percent_done(F.col("processed_files"), F.col("total_files")))


def job_status(progress: DataFrame, results: DataFrame) -> DataFrame:
    """Final status of finished jobs; the message of a failed one is its first error."""
    first_error = results.where((F.col("status") == "ERROR") & non_blank(F.col("message")).isNotNull()).groupBy(
        "scan_job_id").agg(F.min_by("message", F.struct("document_id", "message")).alias("first_error"))
    finished = F.col("processed_files") >= F.col("total_files")
    status = F.when(~finished, "RUNNING").when(F.col("error_files") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
    return progress.join(first_error, "scan_job_id", "left").withColumn("final_status", status).withColumn(
        "status_message",
        F.when(F.col("final_status") == "COMPLETED_WITH_ERRORS", F.coalesce("first_error", F.lit("Some files failed")))
        .when(F.col("final_status") == "COMPLETED", "All files scanned").otherwise("Scanning"))


def latest_job_results(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Result rows of the newest job of each project."""
    newest = jobs.groupBy("project_id").agg(F.max_by("scan_job_id", F.struct("created_at", "scan_job_id")).alias("scan_job_id"))
    return results.join(newest, ["project_id", "scan_job_id"], "left_semi")


def export_rows(results: DataFrame) -> DataFrame:
    """Rows in the export's fixed order, missing text as empty; writing it is the caller's sink."""
    numbers = {"document_id", "start_line", "start_column", "end_line", "end_column"}
    present = [F.col(c) if c in results.columns else F.lit(None).cast("int").alias(c) for c in EXPORT_COLUMNS]
    out = results.select(*present)
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in EXPORT_COLUMNS if c not in numbers})


def write_export(results: DataFrame, path: str) -> None:
    """CSV export; an empty result is an error, found without counting the rows."""
    rows = export_rows(results)
    if rows.isEmpty():
        raise ValueError("There are no scan results to export.")
    rows.write.csv(path, header=True)


def health_rollup(dependencies: DataFrame, *keys: str) -> DataFrame:
    """Counts by status and the overall status."""
    def n(status):
        return F.count_if(F.col("status") == status)

    counted = dependencies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), n("UP").alias("up"), n("DEGRADED").alias("degraded"),
        n("DOWN").alias("down"), n("UNKNOWN").alias("unknown"),
        F.bool_or((F.col("status") == "DOWN") & F.col("critical")).alias("_critical_down"))
    c = F.col
    overall = (
        F.when(c("_critical_down"), "DOWN")
        .when((c("down") > 0) | (c("degraded") > 0) | ((c("unknown") > 0) & (c("up") > 0)), "DEGRADED")
        .when(c("unknown") == c("total"), "UNKNOWN").otherwise("UP"))
    return counted.withColumn("overall", overall).drop("_critical_down")


def execution_rollup(steps: DataFrame, key: str) -> DataFrame:
    failed = F.bool_or(~F.col("status").isin("SUCCEEDED", "FALLBACK_SUCCEEDED"))
    fallback = F.bool_or(F.col("status") == "FALLBACK_SUCCEEDED")
    return steps.groupBy(key).agg(
        F.when(failed, "PARTIAL").when(fallback, "SUCCEEDED_WITH_FALLBACK").otherwise("SUCCEEDED").alias("overall"))


def public_steps(steps: DataFrame) -> DataFrame:
    """What may be shown of a step: the target only of tool calls, neither arguments nor results."""
    hidden = {"arguments", "result", "target"}
    return steps.select(
        *[c for c in steps.columns if c not in hidden],
        F.when(F.col("kind") == "TOOL_CALL", F.col("target")).otherwise(F.col("kind")).alias("target"))


def work_list(items: DataFrame, *statuses: str) -> DataFrame:
    return items.where(F.col("status").isin(*statuses)).orderBy("created_at", "id")
