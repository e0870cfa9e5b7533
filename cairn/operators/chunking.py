"""Text chunks: fixed-size windows, method chunks, statement chunks, and replacing a source's chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.files import suffix

# Window and overlap of the plain chunker.
CHUNK_SIZE, CHUNK_OVERLAP = 1200, 150


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of overlapping windows that covers the whole text; empty for an empty text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0))
    starts = F.sequence(F.lit(0).cast("long"), last.cast("long"))
    cut_at = F.transform(starts, lambda i: F.substring(text, (i * step + 1).cast("int"), F.lit(size)))
    return F.when(F.length(text) > 0, cut_at).otherwise(F.array().cast("array<string>"))


def plain_chunks(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of every document that is not a Java source (those are chunked per method)."""
    other = documents.where(suffix(F.col("file_path")) != ".java")
    exploded = other.select(
        F.col("id").alias("document_id"), F.col("vector_source_key").alias("source_key"), F.col("project_key").alias("project_id"),
        "file_path", F.posexplode(windows(F.col("content"), size, overlap)).alias("index", "content"))
    return exploded.withColumn("chunk_id", F.concat("source_key", F.lit(":chunk:"), F.col("index").cast("string")))


def method_chunks(methods: DataFrame) -> DataFrame:
    """One chunk per method with a stable id, its entities and its metadata."""
    m = F.col
    symbol = F.when(F.trim("declaring_type") == "", m("signature")).otherwise(F.concat_ws(".", "declaring_type", "signature"))
    type_uid = F.when(F.trim("declaring_type") != "", F.concat_ws(":", F.lit("type"), "project_id", "declaring_type"))
    entities = F.filter(F.array(m("method_uid"), type_uid, F.concat_ws(":", F.lit("file"), "project_id", "file_path")), lambda x: x.isNotNull())
    metadata = F.create_map(
        F.lit("contentType"), F.lit("java-method"), F.lit("methodUid"), m("method_uid"), F.lit("declaringType"), m("declaring_type"),
        F.lit("signature"), m("signature"), F.lit("moduleName"), m("module_name"))
    return methods.select(
        F.concat("source_key", F.lit(":java-method:"), F.sha2("method_uid", 256)).alias("chunk_id"), "source_key",
        F.concat(F.lit("Java Method: "), symbol, F.lit("\n"), m("method_body")).alias("content"), "project_id", "file_path",
        entities.alias("entity_ids"), symbol.alias("symbol"), metadata.alias("metadata"))


def statement_chunks(statements: DataFrame) -> DataFrame:
    """One chunk per mapper statement: template, dynamic conditions, and variants when there are several."""
    m = F.col
    conditions = F.when(F.size("conditions") > 0, F.concat(F.lit("\nDynamic Conditions:\n- "), F.array_join("conditions", "\n- ")))
    variants = F.when(F.size("variants") > 1, F.concat(F.lit("\nSQL Variants:\n- "), F.array_join("variants", "\n- ")))
    content = F.concat(
        F.lit("MyBatis Mapper: "), m("namespace"), F.lit("\nStatement: "), m("statement_id"), F.lit("\nCommand: "), m("command"),
        F.lit("\nSQL Template:\n"), m("sql"), F.coalesce(conditions, F.lit("")), F.coalesce(variants, F.lit("")))
    entities = F.array(
        F.concat_ws(":", F.lit("statement"), "project_id", "namespace", "statement_id"),
        F.concat_ws(":", F.lit("type"), "project_id", "namespace"), F.concat_ws(":", F.lit("file"), "project_id", "file_path"))
    return statements.select(
        F.concat("source_key", F.lit(":statement:"), m("statement_id")).alias("chunk_id"), "source_key", content.alias("content"),
        "project_id", "file_path", entities.alias("entity_ids"), F.concat_ws(".", "namespace", "statement_id").alias("symbol"))


def replace_sources(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunks after an ingest: every source that arrives replaces all of its former chunks."""
    keys = incoming.select("source_key").distinct()
    return stored.join(keys, "source_key", "left_anti").unionByName(incoming)


def ingest_totals(base: DataFrame, statements: DataFrame, methods: DataFrame) -> DataFrame:
    """Numbers of chunks per source (source_key) by the way they were made, and in all."""
    kinds = {"base_chunks": base, "statement_chunks": statements, "method_chunks": methods}
    every = None
    for name, chunks in kinds.items():
        counted = chunks.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
        every = counted if every is None else every.unionByName(counted)
    totals = [F.sum(F.when(F.col("kind") == name, F.col("n")).otherwise(0)).alias(name) for name in kinds]
    return every.groupBy("source_key").agg(*totals, F.sum("n").alias("chunk_count"))


def ingest_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id", "content_type").agg(F.count(F.lit(1)).alias("chunk_count"))
