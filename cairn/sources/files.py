"""Source files on shared storage as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import files as ff


def relative_path(root: str) -> Column:
    """Path below ``root``, whatever scheme the file system puts in front."""
    plain = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    return F.regexp_replace(plain, f"^/*{root.strip('/')}/", "")


def read_source_files(spark: SparkSession, root: str, with_tests: bool = False) -> DataFrame:
    """Accepted source files below a folder: (path, size, content as text)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = relative_path(root)
    rows = found.select(path.alias("path"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))
    keep = ff.is_vector_source(F.col("path"))
    return rows.where(keep if with_tests else keep & ~ff.is_test_source(F.col("path")))
