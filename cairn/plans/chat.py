"""Chat queries over the conversation turns."""

from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import chat as c
from cairn.plans.oracle_tables import CHAT, with_tables
from cairn.plans.registry import query
from cairn.sources import lake


@query("j2_conversation_list", with_tables(
    """SELECT c.id, c.updated_at::VARCHAR AS updated_at,
    (SELECT r.message FROM chat_message r WHERE r.conversation_id = c.id ORDER BY r.created_at DESC, r.id DESC LIMIT 1) AS last_message,
    (SELECT count(*) FROM chat_message n WHERE n.conversation_id = c.id) AS message_count FROM chat_conversation c""", CHAT))
def conversation_list(spark, sf):
    out = c.conversation_list(lake.chat_conversations(spark, sf), lake.chat_messages(spark, sf))
    return out.select("id", F.col("updated_at").cast("string").alias("updated_at"), "last_message", "message_count").orderBy(
        F.desc("updated_at"), F.desc("id"))


@query("j3_chat_projects", with_tables(
    """SELECT p.id, p.name, (SELECT count(*) FROM chat_conversation c WHERE c.project_id = p.id) AS conversation_count
    FROM chat_project p""", CHAT))
def chat_projects(spark, sf):
    return c.project_list(lake.chat_projects(spark, sf), lake.chat_conversations(spark, sf)).orderBy("name", "id")


@query("j27_conversations_by_project", with_tables(
    """SELECT p.id AS project_id, p.name AS group_name, c.id AS conversation_id FROM chat_project p
    LEFT JOIN chat_conversation c ON c.project_id = p.id
    UNION ALL SELECT NULL, 'ungrouped', id FROM chat_conversation WHERE project_id IS NULL""", CHAT))
def conversations_by_project(spark, sf):
    return c.grouped_by_project(lake.chat_projects(spark, sf), lake.chat_conversations(spark, sf))


@query("w2_recent_messages", with_tables(
    """SELECT conversation_id, id, role, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS position
    FROM (SELECT * FROM chat_message QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) <= 3)""",
    CHAT))
def recent_messages(spark, sf):
    return c.recent_messages(lake.chat_messages(spark, sf), 3).select("conversation_id", "id", "role", "position")


@query("f23_history_text", with_tables(
    """SELECT conversation_id, string_agg(role || ': ' || message, chr(10) ORDER BY created_at, id) AS history
    FROM (SELECT * FROM chat_message QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) <= 4)
    GROUP BY 1""", CHAT))
def history_text(spark, sf):
    return c.history_text(lake.chat_messages(spark, sf), 4)


@query("f6_conversation_title", with_tables(
    """SELECT id, CASE WHEN trim(opening) = '' THEN 'New conversation' WHEN length(trim(opening)) <= 80 THEN trim(opening)
    ELSE substr(trim(opening), 1, 80) || '...' END AS title FROM chat_conversation""", CHAT))
def conversation_title(spark, sf):
    return c.titles(lake.chat_conversations(spark, sf), "opening").select("id", "title")


@query("f8_compact_summary", with_tables(
    """SELECT conversation_id, id, CASE WHEN length(flat) > 96 THEN substr(flat, 1, 96) || '...' ELSE flat END AS short,
    CASE WHEN length(flat) > 160 THEN substr(flat, 1, 160) || '...' ELSE flat END AS long
    FROM (SELECT *, trim(regexp_replace(message, '\\s+', ' ', 'g')) AS flat FROM chat_message)""", CHAT))
def compact_summary(spark, sf):
    m = F.col("message")
    return lake.chat_messages(spark, sf).select(
        "conversation_id", "id", tx.compact(m, 96).alias("short"), tx.compact(m, 160).alias("long"))


@query("p21_attachment_fetch", with_tables(
    """SELECT conversation_id, id, strlen(message) AS bytes FROM chat_message WHERE role = 'user' AND strlen(message) > 0""", CHAT))
def attachment_fetch(spark, sf):
    m = lake.chat_messages(spark, sf).withColumns(
        {"attachment_name": F.concat(F.lit("turn"), F.col("id").cast("string")), "attachment_content": F.encode("message", "UTF-8")})
    return c.attachments(m).select("conversation_id", "id", F.length("attachment_content").cast("long").alias("bytes"))


@query("d7_delete_chat_project", with_tables(
    """SELECT id, CASE WHEN project_id IN (SELECT r_regionkey FROM region WHERE r_name < 'ASIA') THEN NULL ELSE project_id END AS project_id
    FROM chat_conversation""", CHAT))
def delete_chat_project(spark, sf):
    projects = lake.chat_projects(spark, sf)
    _, conversations = c.without_project(
        projects, lake.chat_conversations(spark, sf), projects.where("name < 'ASIA'"))
    return conversations.select("id", "project_id")


@query("d11_append_and_touch", with_tables(
    """SELECT id, max(t)::VARCHAR AS updated_at FROM (SELECT id, updated_at AS t FROM chat_conversation
    UNION ALL SELECT conversation_id, created_at + INTERVAL 1 DAY FROM chat_message WHERE role = 'system') GROUP BY id""", CHAT))
def append_and_touch(spark, sf):
    appended = lake.chat_messages(spark, sf).where("role = 'system'").withColumn(
        "created_at", F.timestamp_add("DAY", F.lit(1), F.col("created_at")))
    return c.touched(lake.chat_conversations(spark, sf), appended).select(
        "id", F.col("updated_at").cast("string").alias("updated_at"))
