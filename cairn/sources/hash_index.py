"""A catalog of contents by hash that several watchers may add to at once.

    data/<folder>/bucket=…     rows, as a batch wrote them
    commits/bucket=…/<number>  the folder that this commit of the bucket takes rows from

A row's bucket is that of its content key, so a batch reads and changes the buckets of its own hashes only. A folder's
rows count once a commit names it. Commits of a bucket are numbered without gaps and a number can be taken once: of two
writers that read the same state one gets the next number, the other reads the bucket again and stores what is still
new. A batch that runs again finds what its first run committed.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.operators.mutation import CONTENT_KEY, insert_absent
from cairn.session import cut


class HashIndex:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 256):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _bucket(self):
        """Of the content key; rows without a hash are never the same content, so they go by their id."""
        key = F.coalesce("file_hash", F.concat(F.lit("id:"), F.col("id").cast("string")))
        return F.pmod(F.xxhash64(*[c for c in CONTENT_KEY if c != "file_hash"], key), F.lit(self.buckets)).cast("int")

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, buckets: list[int]) -> dict[int, list[str]]:
        """The folders that each bucket's commits name, one small file each."""
        found: dict[int, list[str]] = {b: [] for b in buckets}
        there = []
        for b in buckets:
            at, fs = self._hadoop(f"{self.path}/commits/bucket={b}")
            if fs.exists(at):
                there.append(at.toString())
        if there:
            lines = self.spark.read.text(there, wholetext=True, pathGlobFilter="[0-9]*").select("value", F.col("_metadata.file_path").alias("file"))
            for r in lines.collect():
                found[int(r["file"].split("/bucket=")[1].split("/")[0])].append(r["value"].strip())
        return found

    def _rows(self, folders: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, fs in folders.items() for f in fs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def all(self) -> DataFrame:
        return self._rows(self._folders(list(range(self.buckets))))

    def _take(self, bucket: int, number: int, folder: str) -> bool:
        """Make commit ``number`` of a bucket, complete with its content, unless another writer has made it."""
        place = f"{self.path}/commits/bucket={bucket}"
        draft, fs = self._hadoop(f"{place}/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(folder.encode()))
        out.close()
        final = self._hadoop(f"{place}/{number:010d}")[0]
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":  # a rename would replace what is there; a link fails
                paths = jvm.java.nio.file.Paths
                none = self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
                jvm.java.nio.file.Files.createLink(paths.get(final.toUri().getPath(), none), paths.get(draft.toUri().getPath(), none))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Py4JJavaError as other:
            if "FileAlreadyExists" not in str(other.java_exception):
                raise
            return False
        finally:
            fs.delete(draft, False)
        return True

    def add(self, rows: DataFrame) -> None:
        """Store the rows whose content isn't stored yet, each content once."""
        rows = cut(rows.select(*self.schema.names).withColumn("bucket", self._bucket()))
        todo = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # at most one number per bucket
        while todo:
            folders = self._folders(todo)
            stored = self._rows(folders)
            asked = rows.where(F.col("bucket").isin(todo))
            fresh = insert_absent(stored, asked).join(stored.select("id"), "id", "left_anti").select(*rows.columns)
            folder = uuid.uuid4().hex
            fresh.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            made = self.spark.read.schema("bucket int").parquet(f"{self.path}/data/{folder}").select("bucket").distinct()
            todo = [b for b in sorted(r[0] for r in made.collect()) if not self._take(b, len(folders[b]), folder)]
