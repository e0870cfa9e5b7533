"""A table made of one Parquet folder per micro-batch, and one of gathered rows now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


class BatchTable:
    """``path/batch=<id>``: writing a batch again replaces just that batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def gather(self, rows: DataFrame, batch_id: int) -> None:
        """Rows that stand for everything up to this batch; earlier folders aren't read again."""
        rows.write.mode("overwrite").parquet(f"{self.path}-gathered/batch={batch_id}")

    def _read(self, path: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", path).parquet(path)
        except Exception as missing:  # the folder does not exist yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def all(self, schema: StructType) -> DataFrame:
        """Every row with its batch number, or what was last gathered and the rows since; empty before the first batch."""
        full = StructType([*schema.fields]).add("batch", LongType())
        rows, gathered = self._read(self.path, full), self._read(f"{self.path}-gathered", full)
        last = gathered.agg(F.max("batch")).first()[0]  # from folder names
        if last is None:
            return rows
        return rows.where(F.col("batch") > last).unionByName(gathered.where(F.col("batch") == last))

    def before(self, batch_id: int, schema: StructType) -> DataFrame:
        return self.all(schema).where(F.col("batch") < batch_id).drop("batch")
