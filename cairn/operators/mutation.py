"""Table changes as rewrites: inserts, upserts, deletes, guarded transitions, repair and audits.

Each function returns the new rows or the new table; the caller writes it as a new version or
overwrites the partitions it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import files
from cairn.functions.text import non_blank
from cairn.operators.ordering import positions

CONTENT_KEY = ("project_key", "file_hash", "document_type")


def insert_absent(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...] = CONTENT_KEY) -> DataFrame:
    """Incoming rows that have no active stored row of the same key, one per key (the smallest id).

    Rows without a hash are never duplicates. Applying the result twice adds nothing.
    """
    keys = list(key)
    active = stored.where(F.col("deleted_at").isNull())
    # Reduced to keys and ids first: whole rows move only for the ids that are kept.
    first = incoming.where(F.col("file_hash").isNotNull()).groupBy(*keys).agg(F.min("id").alias("id"))
    fresh = first.join(active.select(*keys), keys, "left_anti").select("id")
    unhashed = incoming.where(F.col("file_hash").isNull()).select("id")
    return incoming.join(fresh.unionByName(unhashed), "id", "left_semi").select(*incoming.columns)


def resolved_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """For every incoming row the id of the stored row it ends up as."""
    keys = list(CONTENT_KEY)
    owners = stored.where(F.col("deleted_at").isNull()).groupBy(*keys).agg(F.min("id").alias("stored_id"))
    return incoming.select("id", *keys).join(owners, keys, "left").select("id", "stored_id")


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace stored ones of the same key."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def valid_thresholds() -> Column:
    return (
        (F.col("cyclomatic") >= 1) & (F.col("cognitive") >= 1) & F.col("duplicate_ratio").between(0, 100) & (F.col("minimum_lines") >= 1))


def upsert_thresholds(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New threshold table, and the incoming rows that were refused."""
    ok = F.coalesce(valid_thresholds(), F.lit(False))
    return upsert(stored, incoming.where(ok), "project_key"), incoming.where(~ok)


def mark_deleted(documents: DataFrame, deleted: DataFrame, at: Column) -> DataFrame:
    """Soft delete by id; the graph status changes only where the document was in the graph."""
    gone = deleted.select("id").distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull() & F.col("deleted_at").isNull()
    graph = F.when(hit & F.col("graph_source_key").isNotNull(), "DELETED").otherwise(F.col("graph_index_status"))
    changed = documents.join(gone, "id", "left").withColumns({
        "index_status": F.when(hit, "DELETED").otherwise(F.col("index_status")),
        "vector_index_status": F.when(hit, "DELETED").otherwise(F.col("vector_index_status")),
        "graph_index_status": graph, "deleted_at": F.when(hit, at).otherwise(F.col("deleted_at"))})
    return changed.select(*documents.columns)


def first_outcome(events: DataFrame, key: str, order: list[str], start: str, outcomes: list[str]) -> DataFrame:
    """State of each item after its guarded transitions: started once, then the first later outcome for good.

    Outcomes before the start and anything after the first outcome do nothing. Two aggregates that
    combine map-side; no item's events are sorted in one task.
    """
    at = F.struct(*order)
    started = events.where(F.col("status") == start).groupBy(key).agg(F.min(at).alias("_start"))
    later = events.where(F.col("status").isin(*outcomes)).join(started, key).where(at > F.col("_start"))
    ended = later.groupBy(key).agg(F.min_by("status", at).alias("_outcome"), F.min(order[0]).alias("completed_at"))
    known = events.select(key).distinct()
    joined = known.join(started, key, "left").join(ended, key, "left")
    status = F.coalesce(F.col("_outcome"), F.when(F.col("_start").isNotNull(), start), F.lit("QUEUED"))
    return joined.select(key, status.alias("status"), F.col(f"_start.{order[0]}").alias("started_at"), "completed_at")


def job_states(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """State of each job (job, total_files) after its events (job, at, kind, outcome), under the guards of a scan.

    RUN takes a queued job on; FILE counts while it runs; after each file the job is finished if all files have been
    counted, with errors if any had one; FAIL ends a queued or running job. What comes after the end does nothing, as
    do files before the start. ``at`` orders a job's events.
    """
    start = events.where("kind = 'RUN'").groupBy("job").agg(F.min("at").alias("start"))
    fail = events.where("kind = 'FAIL'").groupBy("job").agg(F.min("at").alias("fail"))
    files = events.where("kind = 'FILE'").join(start, "job").where(F.col("at") > F.col("start"))
    counted = positions(files.select("job", "at", "outcome"), ["job"], ["at"], "n").join(jobs, "job").where(F.col("n") <= F.col("total_files"))
    ended = counted.join(fail, "job", "left").where(F.col("fail").isNull() | (F.col("at") < F.col("fail"))).groupBy("job").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("outcome") == "PASSED").alias("passed"),
        F.count_if(F.col("outcome") == "FINDING").alias("findings"), F.count_if(F.col("outcome") == "ERROR").alias("errors"))
    every = jobs.join(start, "job", "left").join(fail, "job", "left").join(ended, "job", "left")
    done = F.coalesce("processed", F.lit(0)) >= F.col("total_files")
    status = (F.when(done & F.col("start").isNotNull() & (F.col("total_files") > 0), F.when(F.col("errors") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED"))
              .when(F.col("fail").isNotNull(), "FAILED").when(F.col("start").isNotNull(), "RUNNING").otherwise("QUEUED"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("processed", "passed", "findings", "errors")]
    return every.select("job", status.alias("status"), *counts)


def repair_documents(documents: DataFrame) -> DataFrame:
    """Blank project becomes the default; source keys follow from id and file type."""
    key = F.concat(F.lit("document:"), F.col("id").cast("string"))
    return documents.withColumns({
        "project_key": F.coalesce(non_blank(F.col("project_key")), F.lit("default")),
        "vector_source_key": key,
        "graph_source_key": F.when(files.is_graph_source(F.col("original_file_name")), key)})


def activate_versions(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Archive what is active, activate the chosen drafts."""
    keys = chosen.select("version_key").distinct().withColumn("_chosen", F.lit(True))
    status = F.when(F.col("status") == "ACTIVE", "ARCHIVED").when(
        (F.col("status") == "DRAFT") & F.col("_chosen").isNotNull(), "ACTIVE").otherwise(F.col("status"))
    return versions.join(keys, "version_key", "left").withColumn("status", status).select(*versions.columns)


def active_version(versions: DataFrame) -> DataFrame:
    """The newest active version; an unset activation time sorts first, as in the catalog's database."""
    return versions.where(F.col("status") == "ACTIVE").orderBy(F.desc_nulls_first("activated_at"), F.desc("id")).limit(1)


def recover_interrupted(items: DataFrame) -> DataFrame:
    running = F.col("status") == "RUNNING"
    return items.withColumns({
        "started_at": F.when(running, None).otherwise(F.col("started_at")),
        "status": F.when(running, "QUEUED").otherwise(F.col("status"))})


def more_than_one(df: DataFrame, key: str, check: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), "n")


def missing_parent(children: DataFrame, parents: DataFrame, child: str, parent: str, check: str) -> DataFrame:
    """Foreign key violations, counted per missing value before the join."""
    counts = children.where(F.col(child).isNotNull()).groupBy(child).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(parents.select(F.col(parent).alias(child)), child, "left_anti").select(
        F.lit(check).alias("check"), F.col(child).cast("string").alias("key"), "n")


def outside_domain(df: DataFrame, column: str, allowed: list[str], check: str) -> DataFrame:
    return df.where(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(check).alias("check"), F.col(column).cast("string").alias("key"), "n")


def apply_index_outcomes(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Index results onto active documents; vector and graph results are independent, null leaves the old value."""
    new = outcomes.select("id", *[F.col(c).alias(f"_{c}") for c in ("vector_index_status", "graph_index_status", "error_message")])
    hit = F.col("deleted_at").isNull()
    vector = F.when(hit, F.coalesce("_vector_index_status", "vector_index_status")).otherwise(F.col("vector_index_status"))
    graph = F.when(hit, F.coalesce("_graph_index_status", "graph_index_status")).otherwise(F.col("graph_index_status"))
    touched = hit & (F.col("_vector_index_status").isNotNull() | F.col("_graph_index_status").isNotNull())
    whole = F.when(~touched, F.col("index_status")).when((vector == "FAILED") | (graph == "FAILED"), "FAILED").otherwise("INDEXED")
    joined = documents.join(new, "id", "left")
    return joined.select(
        *[c for c in documents.columns if c not in ("vector_index_status", "graph_index_status", "index_status")],
        vector.alias("vector_index_status"), graph.alias("graph_index_status"), whole.alias("index_status"),
        F.when(touched, F.col("_error_message")).alias("error_message"))
