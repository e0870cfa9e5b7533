"""What the operators of this package share: words, row keys, tables read by queries."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII white-space characters that end a word.
SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than the six white-space ones, as an array."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def n_words(text: Column) -> Column:
    """Number of words, without building the array of them: the runs are shrunk to one letter each."""
    return F.length(F.regexp_replace(F.regexp_replace(text, f"{NOT_SPACE}+", "w"), f"{SPACE}+", "")).cast("long")


def columns_of(df: DataFrame) -> list[Column]:
    """Every column of ``df``, safe for names with dots or spaces."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't use, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame, seed: str = "") -> Column:
    """60 bits that depend on the row's ``doc_id``, or on its text where there is no id: the same in every run."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text_of()))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), identity)), 1, 15), 16, 10).cast("long")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, which may not find it on their own path.

    The archive is made on the driver, from where Spark sends it to every executor.
    """
    context = spark.sparkContext
    if getattr(context, "_cairn_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="cairn-code-")) / "cairn_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((root / "cairn").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._cairn_shipped = True


def map_batches(df: DataFrame, work, schema) -> DataFrame:
    """``df.mapInArrow``, with this package within the workers' reach."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)
