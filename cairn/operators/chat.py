"""Chat: conversation lists, recent messages, history text, projects of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions.text import title


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their last message and message count.

    One aggregate over the messages replaces the two correlated subqueries; it combines map-side,
    so a conversation with very many messages still arrives as one row per task.
    """
    stats = messages.groupBy("conversation_id").agg(
        F.max_by("message", F.struct("created_at", "id")).alias("last_message"),
        F.count(F.lit(1)).alias("message_count"),
    )
    return (
        conversations.join(stats.withColumnRenamed("conversation_id", "id"), "id", "left")
        .withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("long"))
    )


def project_list(projects: DataFrame, conversations: DataFrame) -> DataFrame:
    counts = conversations.groupBy("project_id").agg(F.count(F.lit(1)).alias("conversation_count"))
    return projects.join(counts.withColumnRenamed("project_id", "id"), "id", "left").withColumn(
        "conversation_count", F.coalesce("conversation_count", F.lit(0)).cast("long")
    )


def recent_messages(messages: DataFrame, limit: int) -> DataFrame:
    """Last ``limit`` messages of each conversation with their position in reading order."""
    newest = W.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= limit)
    size = F.count(F.lit(1)).over(W.partitionBy("conversation_id"))  # at most ``limit`` rows per key here
    return kept.withColumn("position", size - F.col("_back") + 1).drop("_back")


def history_text(messages: DataFrame, limit: int) -> DataFrame:
    """``role: message`` lines of the last messages, oldest first; bounded by ``limit`` per conversation."""
    recent = recent_messages(messages, limit)
    lines = F.sort_array(F.collect_list(F.struct("position", F.concat_ws(": ", "role", "message").alias("line"))))
    return recent.groupBy("conversation_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history")
    )


def titles(conversations: DataFrame, column: str) -> DataFrame:
    return conversations.withColumn("title", title(F.col(column)))


def grouped_by_project(projects: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation under its project, an empty row for a project without any, the rest ungrouped."""
    known = projects.select(F.col("id").alias("project_id"), F.col("name").alias("group_name"))
    # An unset project is ungrouped; a project id nobody knows is shown nowhere.
    inside = known.join(conversations.select(F.col("id").alias("conversation_id"), "project_id"), "project_id", "left")
    outside = conversations.where(F.col("project_id").isNull()).select(
        F.lit(None).cast("long").alias("project_id"), F.lit("ungrouped").alias("group_name"), F.col("id").alias("conversation_id")
    )
    return inside.select("project_id", "group_name", "conversation_id").unionByName(outside)


def attachments(messages: DataFrame) -> DataFrame:
    """Messages whose attachment can be fetched."""
    return messages.where(
        (F.col("role") == "user") & F.col("attachment_name").isNotNull() & (F.length("attachment_content") > 0)
    )


def touched(conversations: DataFrame, appended: DataFrame) -> DataFrame:
    """Conversations after an append: updated_at moves to the newest appended message."""
    newest = appended.groupBy("conversation_id").agg(F.max("created_at").alias("_touched"))
    return (
        conversations.join(newest.withColumnRenamed("conversation_id", "id"), "id", "left")
        .withColumn("updated_at", F.greatest("updated_at", "_touched")).drop("_touched")
    )


def without_project(projects: DataFrame, conversations: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete projects: their conversations stay, ungrouped."""
    gone = deleted.select("id").distinct()
    kept = projects.join(gone, "id", "left_anti")
    flagged = conversations.join(gone.select(F.col("id").alias("project_id"), F.lit(True).alias("_gone")), "project_id", "left")
    cleared = flagged.withColumn("project_id", F.when(F.col("_gone"), None).otherwise(F.col("project_id"))).drop("_gone")
    return kept, cleared.select(*conversations.columns)
