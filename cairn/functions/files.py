"""Column functions over file names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import non_blank

# File suffixes and name rules of the catalog.
VECTOR_SUFFIXES = (".java", ".kt", ".xml", ".sql", ".yml", ".yaml", ".md", ".js", ".jsx", ".ts", ".tsx")
GRAPH_SUFFIXES = (".java", ".xml", ".yml", ".yaml", ".md")
SCANNABLE_SUFFIXES = (".java",)
TEST_DIRECTORY_PATTERN = "(?i)(^|/)(test|tests|testcase|testcases)/"
TEST_NAME_PATTERN = "(^|/)(Test[^/]*|[^/]*Test|[^/]*Tests|[^/]*TestCase|IT[^/]*|[^/]*IT|[^/]*ITCase)\\.java$"
IGNORED_DIRECTORIES = (".git", ".gradle", ".idea", ".vscode", "build", "dist", "node_modules", "out", "target")
LISTING_DEPTH = 12
LISTING_LIMIT = 100
ARCHIVE_MAX_ENTRIES = 5000
ARCHIVE_MAX_ENTRY_BYTES = 10 * 1024 * 1024
ARCHIVE_MAX_TOTAL_BYTES = 200 * 1024 * 1024
SCAN_MAX_BYTES = 1024 * 1024


def suffix(name: Column) -> Column:
    """Last extension in lower case with its dot; empty when there is none."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(name, F.lit("")))), "(\\.[^.]*)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def symbol(name: Column) -> Column:
    """File name without its extension; a leading dot is not an extension."""
    return F.regexp_replace(name, "^(?s)(.+)\\.[^.]*$", "$1")


def is_temporary(name: Column) -> Column:
    return F.lower(F.trim(name)).rlike("\\.(tmp|part|crdownload)$")


def is_vector_source(name: Column) -> Column:
    return suffix(name).isin(*VECTOR_SUFFIXES) & ~is_temporary(name)


def is_graph_source(name: Column) -> Column:
    return suffix(name).isin(*GRAPH_SUFFIXES)


def is_scannable(name: Column) -> Column:
    return suffix(name).isin(*SCANNABLE_SUFFIXES)


def is_test_source(path: Column) -> Column:
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return (suffix(path) == ".java") & (p.rlike(TEST_DIRECTORY_PATTERN) | p.rlike(TEST_NAME_PATTERN))


def document_type(given: Column, name: Column) -> Column:
    """The given type when it is a known one, else by extension; an unknown given type is null (rejected)."""
    wanted = F.upper(non_blank(given))
    derived = F.when(suffix(name) == ".java", "STANDARD_SOURCE").otherwise("STANDARD_DOCUMENT")
    return F.when(wanted.isNull(), derived).when(wanted.isin("STANDARD_SOURCE", "STANDARD_DOCUMENT"), wanted)


def normalize_path(path: Column, default: str = "Source.java") -> Column:
    """Forward slashes, no blank or ``.`` segments, ``..`` removes its parent."""
    parts = F.split(F.replace(F.coalesce(non_blank(path), F.lit(default)), F.lit("\\"), F.lit("/")), "/+")
    kept = F.filter(parts, lambda s: (F.trim(s) != "") & (s != "."))
    folded = F.aggregate(
        kept, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    return F.when(F.size(folded) == 0, F.lit(default)).otherwise(F.array_join(folded, "/"))


def is_unsafe_entry(path: Column) -> Column:
    """Blank, absolute, drive-qualified, or climbing out of the archive root."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    # Depth after each segment; below zero means the path has left the root.
    walk = F.aggregate(
        F.filter(F.split(p, "/+"), lambda s: ~s.isin("", ".")),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, s: F.struct(
            (acc["depth"] + F.when(s == "..", -1).otherwise(1)).alias("depth"),
            F.least(acc["low"], acc["depth"] + F.when(s == "..", -1).otherwise(1)).alias("low"),
        ),
    )
    return (F.trim(p) == "") | p.startswith("/") | F.contains(p, F.lit(":")) | (walk["low"] < 0)


def archive_report(entries: DataFrame) -> DataFrame:
    """Bulk ingest per project: discovered, indexed, skipped and failed entries, and which limits were broken."""
    path, size = F.col("path"), F.col("size")
    unsafe = is_unsafe_entry(path)
    accepted = is_vector_source(path) & ~is_test_source(path) & ~unsafe
    too_big = accepted & (size > ARCHIVE_MAX_ENTRY_BYTES)
    counted = entries.groupBy("project_key").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(accepted & ~too_big).alias("indexed"),
        F.count_if(~accepted & ~unsafe).alias("skipped"),
        F.count_if(too_big | unsafe).alias("failed"),
        F.count_if(unsafe).alias("unsafe"),
        F.sum(F.when(accepted, size).otherwise(0)).cast("long").alias("total_bytes"),
    )
    rejected = (
        (F.col("discovered") > ARCHIVE_MAX_ENTRIES) | (F.col("total_bytes") > ARCHIVE_MAX_TOTAL_BYTES) | (F.col("failed") > 0)
    )
    return counted.withColumn("rejected", rejected)


def archive_failures(entries: DataFrame) -> DataFrame:
    """The entries of an archive that fail, each with its reason; a path that leaves the archive counts first."""
    path = F.col("path")
    unsafe = is_unsafe_entry(path)
    too_big = is_vector_source(path) & ~is_test_source(path) & (F.col("size") > ARCHIVE_MAX_ENTRY_BYTES)
    return entries.withColumn("reason", F.when(unsafe, "UNSAFE_PATH").when(too_big, "TOO_LARGE")).where("reason IS NOT NULL")


def admission_error(content: Column) -> Column:
    """Why a file is not scanned: too large or not UTF-8; null when it is admitted."""
    return (
        F.when(F.octet_length(content) > SCAN_MAX_BYTES, "File exceeds the scan size limit.")
        .when(~F.is_valid_utf8(content.cast("string")), "File is not valid UTF-8.")
    )


def listed_path(path: Column) -> Column:
    """Paths a project listing shows: no ignored directory, not deeper than the limit."""
    parts = F.split(path, "/")
    ignored = F.exists(parts, lambda s: s.isin(*IGNORED_DIRECTORIES))
    return ~ignored & (F.size(parts) <= LISTING_DEPTH)
