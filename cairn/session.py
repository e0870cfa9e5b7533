"""Session and materialisation helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cairn", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cairn.scan.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where nothing is configured, a local master gets a fresh temporary folder; on a cluster that would be another
    folder on each machine, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="cairn-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def spread(df: DataFrame, light: bool = False) -> DataFrame:
    """Deal a scan out evenly, for work that is heavy per row: to ``spark.cairn.scan.partitions`` tasks or four per core.

    A file is split only between its row groups, so a table of small rows may come in a single task however large the
    cluster is, and its work would stay on one core. Rows with ``light`` work are dealt out only where the setting says so.
    """
    wanted = df.sparkSession.conf.get("spark.cairn.scan.partitions", None)
    if light and not wanted:
        return df
    return df.repartition(int(wanted) if wanted else 4 * df.sparkSession.sparkContext.defaultParallelism)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative plans, survives lost executors and computes its input a single
    time; the columnar copy still prunes columns for later readers.
    """
    return _written(df, f"{shared_dir(df.sparkSession)}/cairn-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``cut`` for work that leaves its results elsewhere: what it wrote is removed when the block ends.

    Inside, each query's shuffle files go when it ends (Spark 4.1 or later); else they stay until the driver happens to
    collect its garbage.
    """
    folder, numbers = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}", count()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield lambda df: _written(df, f"{folder}/{next(numbers)}")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
