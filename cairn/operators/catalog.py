"""Document catalog: scans, filters, lookups, pages, project counts and source inventories."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import clamp, contains_ignoring_case, first_text

PAGE_SIZE_MAX = 100


def active(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("deleted_at").isNull())


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def where_given(df: DataFrame, **equal: object) -> DataFrame:
    """AND of the equalities whose value is given; None and '' mean no predicate."""
    given = [F.col(k) == v for k, v in equal.items() if v not in (None, "")]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def like_given(df: DataFrame, **needles: str | None) -> DataFrame:
    """AND of case-insensitive contains; ``%`` and ``_`` in a needle stay wildcards."""
    given = [F.col(k).ilike(f"%{v}%") for k, v in needles.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def in_days(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Half-open range of whole days: from the first day up to the end of the last."""
    if first:
        df = df.where(F.col(column) >= F.lit(first).cast("timestamp_ntz"))
    if last:
        # Plain literals on both ends, so the range reaches the Parquet scan.
        end = datetime.date.fromisoformat(last) + datetime.timedelta(days=1)
        df = df.where(F.col(column) < F.lit(end.isoformat()).cast("timestamp_ntz"))
    return df


def without_heavy(df: DataFrame, *heavy: str) -> DataFrame:
    """Same columns, the heavy ones nulled so that they are never read."""
    return df.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) if c in heavy else F.col(c) for c in df.columns])


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    size = clamp(size, 1, PAGE_SIZE_MAX)
    return ordered.offset(max(number, 0) * size).limit(size)


def page_envelope(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row describing a page of ``df``: total, pages, first, last and whether more follow."""
    size, number = clamp(size, 1, PAGE_SIZE_MAX), max(number, 0)
    total = F.col("total")
    pages = F.ceil(total / size).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(number).cast("long").alias("page"),
        F.lit(size).cast("long").alias("size"),
        pages.alias("total_pages"),
        F.lit(number == 0).alias("first"),
        (F.lit(number + 1) >= pages).alias("last"),
        ((F.lit(number) + 1) * size < total).alias("has_next"),
    )


def project_document_counts(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Every project with the number of its active documents; counts before the join, so it joins one row per project."""
    counts = active(documents).groupBy("project_key").agg(F.count(F.lit(1)).alias("document_count"))
    return projects.join(counts, "project_key", "left").withColumn(
        "document_count", F.coalesce("document_count", F.lit(0)).cast("long")
    )


def existing_projects(keys: DataFrame, projects: DataFrame) -> DataFrame:
    return keys.join(projects, "project_key", "left_semi")


def deletable_projects(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Projects but the default one that own no document at all, deleted ones included."""
    owners = documents.select("project_key").distinct()
    return projects.where(F.col("project_key") != "default").join(owners, "project_key", "left_anti")


def vector_inventory(chunks: DataFrame, *extra: str) -> DataFrame:
    """One row per source of the vector store with its chunk count."""
    firsts = [F.max(c).alias(c) for c in extra]
    return chunks.groupBy("source_key").agg(F.count(F.lit(1)).alias("chunk_count"), *firsts)


def graph_inventory(nodes: DataFrame) -> DataFrame:
    """One row per non-blank graph key with its node count and fallback names."""
    return (
        nodes.where(F.trim("graph_key") != "")
        .groupBy("graph_key")
        .agg(
            F.coalesce(F.max("source_key"), F.max("graph_key")).alias("source_key"),
            F.coalesce(F.max("project_id"), F.lit("")).alias("project_id"),
            F.coalesce(F.max("file_name"), F.max("name"), F.max("graph_key")).alias("file_name"),
            F.count(F.lit(1)).alias("node_count"),
        )
    )


def source_inventory(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """Vector and graph sources in one list, blank project and name filled from the graph side."""
    v = vector.select(
        "source_key", F.col("project_id").alias("v_project"), F.col("file_name").alias("v_file"),
        F.col("file_path").alias("v_path"), "chunk_count", F.lit(True).alias("v_has"),
    )
    g = graph.select(
        "source_key", "graph_key", F.col("project_id").alias("g_project"), F.col("file_name").alias("g_file"),
        "node_count", F.lit(True).alias("g_has"),
    )
    return v.join(g, "source_key", "full").select(
        "source_key",
        first_text(F.col("v_project"), F.col("g_project")).alias("project_id"),
        first_text(F.col("v_file"), F.col("g_file"), F.col("v_path"), F.col("source_key")).alias("file_name"),
        F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"),
        F.coalesce("node_count", F.lit(0)).cast("long").alias("node_count"),
        F.coalesce("v_has", F.lit(False)).alias("vector_tracked"),
        F.coalesce("g_has", F.lit(False)).alias("graph_tracked"),
        F.coalesce("graph_key", F.lit("")).alias("graph_key"),
    )


def cleanup_inventory(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Catalog rows and indexed sources side by side with the three tracked flags."""
    base_name = F.element_at(F.filter(F.split("file_name", "[\\\\/]"), lambda s: s != ""), -1)
    s = sources.select("source_key", base_name.alias("s_name"), "vector_tracked", "graph_tracked")
    d = active(documents).select(
        F.concat(F.lit("document:"), F.col("id").cast("string")).alias("source_key"),
        F.col("original_file_name").alias("d_name"), F.col("document_type").alias("d_type"), F.lit(True).alias("d_has"),
    )
    return s.join(d, "source_key", "full").select(
        F.col("source_key").alias("id"),
        F.coalesce("d_name", "s_name", "source_key").alias("original_file_name"),
        F.coalesce("d_type", F.lit("SOURCE_INDEX")).alias("document_type"),
        F.coalesce("d_has", F.lit(False)).alias("catalog_tracked"),
        F.coalesce("vector_tracked", F.lit(False)).alias("vector_tracked"),
        F.coalesce("graph_tracked", F.lit(False)).alias("graph_tracked"),
    )


def cleanup_filter(targets: DataFrame, keyword: str) -> DataFrame:
    word = keyword.strip()
    if not word:
        return targets
    return targets.where(
        contains_ignoring_case(F.col("original_file_name"), word)
        | contains_ignoring_case(F.col("document_type"), word)
        | contains_ignoring_case(F.col("id"), word)
    )


def merge_pages(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two pages by id: later descriptive columns win, tracked flags are OR-ed."""
    both = first.withColumn("_seq", F.lit(0)).unionByName(second.withColumn("_seq", F.lit(1)))
    return both.groupBy("id").agg(
        F.max_by("original_file_name", "_seq").alias("original_file_name"),
        F.max_by("document_type", "_seq").alias("document_type"),
        *[F.bool_or(c).alias(c) for c in ("catalog_tracked", "vector_tracked", "graph_tracked")],
    )


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """Active documents that repeat an earlier one of the same project, content and type.

    The first of each key comes from an aggregate with map-side combine instead of a rank, so one
    content stored millions of times needs no task that sorts all its copies.
    """
    keys = ["project_key", "file_hash", "document_type"]
    live = active(documents).where(F.col("file_hash").isNotNull())
    first = live.groupBy(*keys).agg(F.min_by("id", F.struct("created_at", "id")).alias("first_id"))
    return live.join(first, keys).where(F.col("id") != F.col("first_id"))


def dashboard(documents: DataFrame, projects: DataFrame, scans: DataFrame) -> DataFrame:
    """One row of totals for the landing page."""
    counted = project_document_counts(projects, documents).agg(
        F.count(F.lit(1)).alias("projects"),
        F.count_if(F.col("document_count") > 0).alias("indexed_projects"),
        F.sum("document_count").alias("documents"),
    )
    scanned = scans.agg(
        F.count_if(F.col("status") == "FINDING").alias("findings"),
        F.count_if(F.col("status") == "PASSED").alias("passed_files"),
        F.count_if(F.col("status") == "ERROR").alias("error_files"),
    )
    return counted.join(F.broadcast(scanned))  # one row on each side


def batch_failures(outcomes: DataFrame) -> DataFrame:
    """The failed items of a batch (id, file_name, error), each with its message."""
    return outcomes.where(F.col("error").isNotNull()).select("id", "file_name", F.col("error").alias("message"))


def batch_outcome(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNull()).alias("success_count"),
        F.count_if(F.col("error").isNotNull()).alias("failure_count"),
    )
