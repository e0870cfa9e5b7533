"""Incremental versions of the pollers and watchers, on Structured Streaming.

State of a job, an execution or a dependency lives in Spark's state store and expires, as aggregates per span of time
(``keyed_log``: with a timer per key). Other state lives in tables made of one folder per micro-batch, where a batch that is run again overwrites its own
folder, and in the hash index of the inbox. So retries and restarts leave no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.functions.files import is_vector_source
from cairn.operators import quality
from cairn.operators.extract import living_references, reconcile
from cairn.session import cut
from cairn.sources.batches import BatchTable
from cairn.sources.hash_index import HashIndex
from cairn.streaming.keyed import Expiring, keyed, timers_supported


def drain(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything that is available now, then stop."""
    started = (
        stream.writeStream.foreachBatch(on_batch).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def inbox_files(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of accepted files dropped into a folder.

    A stream lists a file once, so a file must appear complete: writers use a temporary name (those
    are not taken) and rename when done, which the stream then sees as a new file.
    """
    files = spark.readStream.schema(BINARY_FILE).format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(is_vector_source(F.col("path")))


def ingest(arrivals: DataFrame, catalog: HashIndex, checkpoint: str) -> None:
    """Inbox into catalog: a content already stored, or repeated, is stored once, whichever watcher takes it."""
    drain(arrivals, lambda batch, _: catalog.add(batch), checkpoint)


def changelog(changes: DataFrame, table: BatchTable, checkpoint: str, *keys: str, every: int = 16) -> None:
    """Changed rows of keyed state, appended per batch; the newest batch of a key is its state.

    After ``every`` batches the newest rows are written together, and later reads begin there.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, batch_id)
        if keys and (batch_id + 1) % every == 0:
            table.gather(latest(table.all(batch.schema), *keys), batch_id)

    drain(changes, store, checkpoint, mode="update")


def latest(log: DataFrame, *keys: str) -> DataFrame:
    """Current state out of a changelog."""
    values = [c for c in log.columns if c not in (*keys, "batch")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def keyed_log(rows: DataFrame, key: str, processor: Expiring, table: BatchTable, checkpoint: str, delay: str) -> StructType:
    """Run a keyed state over what is available; the schema of its changelog."""
    with timers_supported(rows.sparkSession):
        changes = keyed(rows, key, processor, delay)
        changelog(changes, table, checkpoint, key)
    return changes.schema


def in_spans(rows: DataFrame, key: str, span: str, delay: str) -> GroupedData:
    """Rows with a timestamp ``ts`` by key and span of time: a span's state goes when the watermark has passed it."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(key, F.window("ts", span).alias("span"))


def progress_counters(outcomes: DataFrame, span: str, delay: str) -> DataFrame:
    """Counters per job and span of a stream of file outcomes (one event per file); spans add up."""
    def n(status):
        return F.count_if(F.col("status") == status)

    return in_spans(outcomes, "scan_job_id", span, delay).agg(
        F.count(F.lit(1)).alias("processed_files"), n("PASSED").alias("passed_files"), n("FINDING").alias("finding_count"), n("ERROR").alias("error_files"))


def progress(log: DataFrame) -> DataFrame:
    """Counters per job out of their changelog."""
    counts = ("processed_files", "passed_files", "finding_count", "error_files")
    return latest(log, "scan_job_id", "span").groupBy("scan_job_id").agg(*[F.sum(c).alias(c) for c in counts])


def last_checks(checks: DataFrame, span: str, delay: str) -> DataFrame:
    """Newest check per dependency and span."""
    at = F.struct("ts", "event_id")
    return in_spans(checks, "id", span, delay).agg(F.max_by(F.struct("status", "critical"), at).alias("check"), F.max(at).alias("at"))


def last_known(log: DataFrame) -> DataFrame:
    """Newest check per dependency out of the changelog."""
    newest = latest(log, "id", "span").groupBy("id").agg(F.max_by("check", "at").alias("check"))
    return newest.select("id", "check.status", "check.critical")


def execution_spans(events: DataFrame, span: str, delay: str) -> DataFrame:
    """Start and outcomes per execution and span of a stream of events (execution_id, event_id, status).

    All outcomes of an execution stay: while an earlier start may still arrive, any of them can be the first one after it.
    """
    at, started = F.struct(F.unix_micros("ts").alias("us"), "event_id"), F.col("status") == "STARTED"
    outcome = F.struct(F.unix_micros("ts").alias("us"), "event_id", "status")
    return in_spans(events, "execution_id", span, delay).agg(
        F.min(F.when(started, at)).alias("start"), F.collect_set(F.when(~started, outcome)).alias("outcomes"))


def executions(log: DataFrame) -> DataFrame:
    """Executions out of their changelog: the first STARTED, and for good the first outcome after it."""
    whole = latest(log, "execution_id", "span").groupBy("execution_id").agg(
        F.min("start").alias("start"), F.flatten(F.collect_list("outcomes")).alias("outcomes"))
    after = F.array_min(F.filter("outcomes", lambda o: F.struct(o["us"], o["event_id"]) > F.col("start")))
    return whole.where(F.col("start").isNotNull()).withColumn("_o", after).select(
        "execution_id", F.coalesce("_o.status", F.lit("STARTED")).alias("status"), F.col("start.us").alias("started_us"), F.col("_o.us").alias("completed_us"))


def execution_log(events: DataFrame, table: BatchTable, checkpoint: str, span: str, delay: str) -> StructType:
    """Run the executions over what is available; the schema of their changelog. They may be too many for the memory."""
    spans = execution_spans(events, span, delay)
    with timers_supported(events.sparkSession):
        changelog(spans, table, checkpoint, "execution_id", "span")
    return spans.schema


def snapshots(summaries: DataFrame, table: BatchTable, checkpoint: str) -> None:
    """Quality summaries as they are evaluated; every change is stored, the last good ones stay."""
    def store(batch: DataFrame, batch_id: int) -> None:
        table.write(quality.changes(batch, table.before(batch_id, batch.schema)), batch_id)

    drain(summaries, store, checkpoint)


CATALOG = "listing_id long, capability_id string, tool string, action string, reference_count long"


OPEN = "listing_id long, first_batch long, n long, n_tools long, named long"


def catalog_sync(listings: DataFrame, current: DataFrame, references: DataFrame, log: BatchTable, table: BatchTable, checkpoint: str) -> None:
    """Tool listings (listing_id, n_tools, tool) as they arrive, each reconciled with the catalog the one before it left.

    The rows of a listing may come in several batches: they are logged, and a listing counts once all ``n_tools`` of
    them are there. Each batch leaves a small table of the listings still open, with the batch they began in, so the
    next one reads the log from the oldest of these on. A listing without a named tool is refused and leaves the catalog
    as it was; one older than the last that counted is skipped. The catalog's history has one reconciliation per listing.
    """
    spark = current.sparkSession
    schema, unfinished = StructType.fromDDL(CATALOG), BatchTable(spark, f"{log.path}-open")

    def store(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id)
        last = table.before(batch_id, schema).agg(F.max("listing_id")).first()[0]
        newer = F.lit(True) if last is None else F.col("listing_id") > last
        new = batch.groupBy("listing_id").agg(
            F.lit(batch_id).cast("long").alias("first_batch"), F.count(F.lit(1)).alias("n"), F.max("n_tools").alias("n_tools"),
            F.count_if(F.trim("tool") != "").alias("named"))
        before = unfinished.all(StructType.fromDDL(OPEN)).where(F.col("batch") == batch_id - 1).drop("batch")
        sizes = cut(before.unionByName(new).where(newer).groupBy("listing_id").agg(
            F.min("first_batch").alias("first_batch"), F.sum("n").alias("n"), F.max("n_tools").alias("n_tools"), F.sum("named").alias("named")))
        whole = [(r["listing_id"], r["first_batch"]) for r in sizes.where("n >= n_tools AND named > 0").orderBy("listing_id").collect()]  # a few
        unfinished.write(sizes.where("n < n_tools"), batch_id)
        if not whole:
            return
        rows = log.all(batch.schema).where(F.col("batch").between(min(first for _, first in whole), batch_id)).drop("batch")
        history = table.before(batch_id, schema)
        catalog = current if last is None else history.where((F.col("listing_id") == last) & (F.col("action") != "removed"))
        made = []
        for listing, _ in whole:
            result = reconcile(catalog.select("capability_id", "tool"), rows.where(F.col("listing_id") == listing))
            kept = living_references(references, result).groupBy("capability_id").agg(F.count(F.lit(1)).alias("reference_count"))
            counted = result.join(kept, "capability_id", "left").withColumn("reference_count", F.coalesce("reference_count", F.lit(0)).cast("long"))
            made.append(cut(counted.withColumn("listing_id", F.lit(listing).cast("long")).select(*schema.names)))
            catalog = made[-1].where(F.col("action") != "removed")
        table.write(reduce(DataFrame.unionByName, made), batch_id)

    drain(listings, store, checkpoint)
