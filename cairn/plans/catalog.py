"""Catalog queries: scans, filters, pages, lookups, joins with projects, inventories."""

from pyspark.sql import functions as F

from cairn.functions import files as ff
from cairn.functions import text as tx
from cairn.operators import catalog as c
from cairn.operators import ordering
from cairn.plans.oracle_tables import DOCUMENT, PROJECT, SCAN, with_tables
from cairn.plans.registry import query
from cairn.sources import lake

LISTED = ("id", "project_key", "original_file_name", "document_type", "index_status", "created_at")
_LIST = "id, project_key, original_file_name, document_type, index_status, created_at::VARCHAR AS created_at"


def _listed(df):
    return df.select(*[F.col(x).cast("string").alias(x) if x == "created_at" else x for x in LISTED])


@query("s1_active_catalog", with_tables(f"SELECT {_LIST} FROM document WHERE deleted_at IS NULL", DOCUMENT))
def active_catalog(spark, sf):
    return _listed(c.newest_first(c.active(lake.documents_catalog(spark, sf))))


@query("p1_deleted_filter", with_tables(
    "SELECT project_key, count(*) AS active_count FROM document WHERE deleted_at IS NULL GROUP BY 1", DOCUMENT))
def deleted_filter(spark, sf):
    return c.active(lake.documents_catalog(spark, sf)).groupBy("project_key").agg(F.count(F.lit(1)).alias("active_count"))


@query("p2_optional_filter", with_tables(
    f"SELECT {_LIST} FROM document WHERE deleted_at IS NULL AND project_key = 'en' AND index_status = 'PENDING'", DOCUMENT))
def optional_filter(spark, sf):
    docs = c.active(lake.documents_catalog(spark, sf))
    return _listed(c.where_given(docs, project_key="en", index_status="PENDING", document_type=""))


def history(spark, sf):
    """Generation history: a turn is a generation, its role the target type."""
    m = lake.chat_messages(spark, sf)
    return m.select(
        (F.col("conversation_id") * 1000000 + F.col("id")).alias("id"), F.col("role").alias("target_type"),
        F.concat(F.lit('["mapper", "'), F.col("role"), F.lit('"]')).alias("target_types"),
        F.col("message").alias("prompt"), F.col("message").alias("generated_code"), "created_at")


_HISTORY = """message AS (SELECT conv_id * 1000000 + turn AS id, role AS target_type, '["mapper", "' || role || '"]' AS target_types,
    text AS prompt, text AS generated_code,
    TIMESTAMP '2024-01-01' + to_minutes((conv_id * 60 + turn)::INTEGER) AS created_at FROM conversations)"""


@query("p3_history_search", with_tables(
    """SELECT id, prompt FROM message WHERE target_type ILIKE '%ASSIST%' AND target_types ILIKE '%mapper%'
    AND generated_code ILIKE '%THE%on%'""", _HISTORY))
def history_search(spark, sf):
    return c.like_given(history(spark, sf), target_type="ASSIST", target_types="mapper", generated_code="THE%on",
                        prompt=None).select("id", "prompt")


@query("p4_day_range", """SELECT event_id, user_id, event_type FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'""")
def day_range(spark, sf):
    return c.in_days(lake.raw(spark, sf, "events"), "ts", "2024-01-05", "2024-01-07").select(
        "event_id", "user_id", "event_type")


@query("p5_summary_projection", with_tables(
    "SELECT id, target_type, prompt, NULL::VARCHAR AS generated_code FROM message", _HISTORY))
def summary_projection(spark, sf):
    return c.without_heavy(history(spark, sf), "generated_code").select("id", "target_type", "prompt", "generated_code")


@query("s7_history_json_lists", with_tables(
    """SELECT id, 'mapper,' || target_type AS targets, 2::BIGINT AS target_count FROM message""", _HISTORY))
def history_json(spark, sf):
    types = tx.json_list(F.col("target_types"))
    return history(spark, sf).select(
        "id", F.array_join(types, ",").alias("targets"), F.size(types).cast("long").alias("target_count"))


@query("p11_cleanup_filter", with_tables(
    """SELECT 'document:' || id AS id, original_file_name, document_type FROM document
    WHERE deleted_at IS NULL AND (original_file_name ILIKE '%.md%' OR document_type ILIKE '%.md%' OR id::VARCHAR ILIKE '%.md%')""",
    DOCUMENT))
def cleanup_filter(spark, sf):
    docs = c.active(lake.documents_catalog(spark, sf)).select(
        F.col("vector_source_key").alias("id"), "original_file_name", "document_type")
    return c.cleanup_filter(docs, " .MD ")


@query("p12_first_by_content", with_tables(
    """SELECT min(id) AS id, file_hash, document_type FROM document WHERE deleted_at IS NULL GROUP BY file_hash, document_type""",
    DOCUMENT))
def first_by_content(spark, sf):
    """The by-hash lookup asked for every (hash, type) at once: lowest id wins."""
    return c.active(lake.documents_catalog(spark, sf)).groupBy("file_hash", "document_type").agg(F.min("id").alias("id"))


@query("p12_by_graph_source", with_tables(
    """SELECT graph_source_key, max(id) AS id, arg_max(original_file_name, id) AS original_file_name FROM document
    WHERE deleted_at IS NULL AND graph_source_key IS NOT NULL GROUP BY 1""", DOCUMENT))
def by_graph_source(spark, sf):
    """The by-source lookup asked for every source key at once: highest id wins."""
    docs = c.active(lake.documents_catalog(spark, sf)).where(F.col("graph_source_key").isNotNull())
    return docs.groupBy("graph_source_key").agg(
        F.max("id").alias("id"), F.max_by("original_file_name", "id").alias("original_file_name"))


@query("p13_test_sources", with_tables(
    """SELECT id, file_path, suffixless LIKE '%' AND original_file_name LIKE '%.java' AND file_path LIKE '%/test/%' AS test_source
    FROM (SELECT *, '' AS suffixless FROM document)""", DOCUMENT))
def test_sources(spark, sf):
    return lake.documents_catalog(spark, sf).select(
        "id", "file_path", ff.is_test_source(F.col("file_path")).alias("test_source"))


@query("p14_document_type", with_tables("SELECT id, document_type FROM document", DOCUMENT))
def document_type(spark, sf):
    return lake.documents_catalog(spark, sf).select(
        "id", ff.document_type(F.lit(None).cast("string"), F.col("original_file_name")).alias("document_type"))


@query("p18_file_predicates", with_tables(
    """SELECT id, regexp_matches(original_file_name, '\\.(java|xml|yml|md)$') AS graph_source,
    regexp_matches(original_file_name, '\\.(java|kt|xml|sql|yml|md)$') AS vector_source,
    original_file_name LIKE '%.java' AS scannable, original_file_name LIKE '%.tmp' AS temporary FROM document""", DOCUMENT))
def file_predicates(spark, sf):
    n = F.col("original_file_name")
    return lake.documents_catalog(spark, sf).select(
        "id", ff.is_graph_source(n).alias("graph_source"), ff.is_vector_source(n).alias("vector_source"),
        ff.is_scannable(n).alias("scannable"), ff.is_temporary(n).alias("temporary"))


@query("p24_find_by_base_name", with_tables(
    """SELECT id, file_path FROM document d SEMI JOIN (SELECT o_orderkey FROM orders) ON original_file_name = 'Doc' || o_orderkey || '.java'""",
    DOCUMENT))
def find_by_base_name(spark, sf):
    """Source files by exact base name, for a whole table of requested names."""
    wanted = lake.raw(spark, sf, "orders").select(
        F.concat(F.lit("Doc"), F.col("o_orderkey").cast("string"), F.lit(".java")).alias("base_name"))
    docs = lake.documents_catalog(spark, sf).withColumn("base_name", ff.base_name(F.col("file_path")))
    return docs.join(wanted, "base_name", "left_semi").select("id", "file_path")


@query("j1_project_document_counts", with_tables(
    """SELECT p.project_key, p.name, count(d.id) FILTER (d.deleted_at IS NULL) AS document_count
    FROM project p LEFT JOIN document d USING (project_key) GROUP BY 1, 2""", DOCUMENT, PROJECT))
def project_counts(spark, sf):
    return c.project_document_counts(lake.projects(spark, sf), lake.documents_catalog(spark, sf))


@query("j4_project_exists", with_tables(
    """SELECT label, vec_id FROM embeddings WHERE list_extract(['en', 'fr', 'default', 'xx', 'de', 'es', 'unused', 'yy', 'zz', ''], label + 1)
    IN (SELECT project_key FROM project)""", PROJECT))
def project_exists(spark, sf):
    """Rows whose project is known; the others are requests for projects that do not exist."""
    names = F.array(*[F.lit(x) for x in ("en", "fr", "default", "xx", "de", "es", "unused", "yy", "zz", "")])
    asked = lake.raw(spark, sf, "embeddings").select(
        F.element_at(names, F.col("label") + 1).alias("project_key"), "label", "vec_id")
    return c.existing_projects(asked, lake.projects(spark, sf)).select("label", "vec_id")


@query("j5_deletable_projects", with_tables(
    """SELECT project_key, name FROM project p WHERE project_key <> 'default'
    AND NOT EXISTS (SELECT 1 FROM document d WHERE d.project_key = p.project_key)""", DOCUMENT, PROJECT))
def deletable_projects(spark, sf):
    return c.deletable_projects(lake.projects(spark, sf), lake.documents_catalog(spark, sf))


def _vector_sources(spark, sf):
    """Chunks of every active text, counted per source; chunk starts every 1050 characters."""
    d = c.active(lake.documents_catalog(spark, sf)).where(ff.is_vector_source(F.col("original_file_name")))
    chunks = d.select(
        F.col("vector_source_key").alias("source_key"), F.col("project_key").alias("project_id"),
        F.lit("").alias("file_name"), "file_path",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("file_size") - 1) / 1050), F.lit(1).cast("long"))).alias("n"))
    return c.vector_inventory(chunks, "project_id", "file_name", "file_path")


_VECTOR = """vec AS (SELECT vector_source_key AS source_key, project_key AS project_id, file_path,
    ((file_size - 1) // 1050 + 1)::BIGINT AS chunk_count FROM document
    WHERE deleted_at IS NULL AND regexp_matches(original_file_name, '\\.(java|kt|xml|sql|yml|md)$'))"""


@query("s6_vector_sources", with_tables(f"{_VECTOR} SELECT * FROM vec", DOCUMENT))
def vector_sources(spark, sf):
    return _vector_sources(spark, sf).select("source_key", "project_id", "file_path", "chunk_count")


def _graph_sources(spark, sf):
    """Graph nodes of documents (one per line of text), grouped by the key they were indexed under."""
    d = lake.documents_catalog(spark, sf).where(F.col("graph_source_key").isNotNull())
    nodes = d.select(
        F.concat(F.lit("rag-source:"), "graph_source_key").alias("graph_key"), F.col("graph_source_key").alias("source_key"),
        F.lit("").alias("project_id"), F.col("original_file_name").alias("file_name"), F.col("original_file_name").alias("name"),
        F.explode(F.split("content", "\n")).alias("line"))
    return c.graph_inventory(nodes)


_GRAPH_SOURCES = """gra AS (SELECT 'rag-source:' || graph_source_key AS graph_key, graph_source_key AS source_key,
    original_file_name AS file_name, (length(content) - length(replace(content, chr(10), '')) + 1)::BIGINT AS node_count
    FROM document WHERE graph_source_key IS NOT NULL)"""


@query("a7_graph_sources", with_tables(f"{_GRAPH_SOURCES} SELECT * FROM gra", DOCUMENT))
def graph_sources(spark, sf):
    return _graph_sources(spark, sf).select("graph_key", "source_key", "file_name", "node_count")


_INVENTORY = f"""{_VECTOR}, {_GRAPH_SOURCES}, inv AS (
    SELECT source_key, coalesce(v.project_id, '') AS project_id, coalesce(g.file_name, v.file_path) AS file_name,
           coalesce(chunk_count, 0) AS chunk_count, coalesce(node_count, 0) AS node_count,
           v.source_key IS NOT NULL AS vector_tracked, g.source_key IS NOT NULL AS graph_tracked,
           coalesce(g.graph_key, '') AS graph_key
    FROM vec v FULL JOIN gra g USING (source_key))"""


@query("j6_source_inventory", with_tables(f"{_INVENTORY} SELECT * FROM inv", DOCUMENT))
def source_inventory(spark, sf):
    return c.source_inventory(_vector_sources(spark, sf), _graph_sources(spark, sf))


_CLEANUP = f"""{_INVENTORY}, cleanup AS (
    SELECT coalesce(d.vector_source_key, i.source_key) AS id, coalesce(d.original_file_name, regexp_extract(i.file_name, '[^/]+$')) AS original_file_name,
           coalesce(d.document_type, 'SOURCE_INDEX') AS document_type, d.id IS NOT NULL AS catalog_tracked,
           coalesce(vector_tracked, false) AS vector_tracked, coalesce(graph_tracked, false) AS graph_tracked
    FROM inv i FULL JOIN (SELECT * FROM document WHERE deleted_at IS NULL) d ON i.source_key = d.vector_source_key)"""


@query("j26_cleanup_inventory", with_tables(f"{_CLEANUP} SELECT * FROM cleanup", DOCUMENT))
def cleanup_inventory(spark, sf):
    sources = c.source_inventory(_vector_sources(spark, sf), _graph_sources(spark, sf))
    return c.cleanup_inventory(sources, lake.documents_catalog(spark, sf))


@query("u5_page_merge", with_tables(
    f"""{_CLEANUP} SELECT id, any_value(original_file_name) AS original_file_name, any_value(document_type) AS document_type,
    bool_or(catalog_tracked) AS catalog_tracked, bool_or(vector_tracked) AS vector_tracked, bool_or(graph_tracked) AS graph_tracked
    FROM (SELECT * FROM cleanup WHERE document_type <> 'STANDARD_SOURCE'
          UNION ALL SELECT id, upper(original_file_name), document_type, NOT catalog_tracked, false, graph_tracked FROM cleanup WHERE document_type = 'STANDARD_SOURCE'
          UNION ALL SELECT id, upper(original_file_name), document_type, catalog_tracked, vector_tracked, false FROM cleanup WHERE document_type = 'STANDARD_SOURCE')
    GROUP BY id""", DOCUMENT))
def page_merge(spark, sf):
    targets = c.cleanup_inventory(
        c.source_inventory(_vector_sources(spark, sf), _graph_sources(spark, sf)), lake.documents_catalog(spark, sf))
    first = targets.withColumns({"catalog_tracked": F.when(F.col("document_type") == "STANDARD_SOURCE", ~F.col("catalog_tracked")).otherwise(F.col("catalog_tracked")),
                                 "vector_tracked": F.when(F.col("document_type") == "STANDARD_SOURCE", False).otherwise(F.col("vector_tracked"))})
    second = targets.where("document_type = 'STANDARD_SOURCE'").withColumns(
        {"original_file_name": F.upper("original_file_name"), "graph_tracked": F.lit(False)})
    return c.merge_pages(first, second)


@query("a1_page_envelope", with_tables(
    """SELECT count(*) AS total, 1::BIGINT AS page, 100::BIGINT AS size, ceil(count(*) / 100)::BIGINT AS total_pages, false AS first,
    2 >= ceil(count(*) / 100) AS last, 200 < count(*) AS has_next FROM document WHERE deleted_at IS NULL AND index_status = 'INDEXED'""", DOCUMENT))
def page_envelope(spark, sf):
    return c.page_envelope(c.where_given(c.active(lake.documents_catalog(spark, sf)), index_status="INDEXED"), 1, 250)


@query("t1_catalog_page", with_tables(
    f"SELECT {_LIST} FROM document WHERE deleted_at IS NULL ORDER BY document.created_at DESC, id DESC LIMIT 30 OFFSET 60", DOCUMENT))
def catalog_page(spark, sf):
    return _listed(c.page(c.newest_first(c.active(lake.documents_catalog(spark, sf))), 2, 30))


@query("w1_duplicate_documents", with_tables(
    """SELECT id, file_hash FROM document WHERE deleted_at IS NULL
    QUALIFY row_number() OVER (PARTITION BY project_key, file_hash, document_type ORDER BY created_at, id) > 1""", DOCUMENT))
def duplicate_documents(spark, sf):
    return c.duplicate_documents(lake.documents_catalog(spark, sf)).select("id", "file_hash")


@query("a18_dashboard", with_tables(
    """SELECT (SELECT count(*) FROM project) AS projects,
    (SELECT count(DISTINCT project_key) FROM document SEMI JOIN project USING (project_key) WHERE deleted_at IS NULL) AS indexed_projects,
    (SELECT count(*) FROM document WHERE deleted_at IS NULL) AS documents,
    (SELECT count(*) FROM scan_result WHERE status = 'FINDING') AS findings,
    (SELECT count(*) FROM scan_result WHERE status = 'PASSED') AS passed_files,
    (SELECT count(*) FROM scan_result WHERE status = 'ERROR') AS error_files""", DOCUMENT, PROJECT, SCAN))
def dashboard(spark, sf):
    return c.dashboard(lake.documents_catalog(spark, sf), lake.projects(spark, sf), lake.scan_results(spark, sf)).select(
        "projects", "indexed_projects", F.col("documents").cast("long").alias("documents"), "findings", "passed_files", "error_files")


@query("a18_recent_projects", with_tables(
    """SELECT project_key, max(created_at)::VARCHAR AS updated_at FROM document WHERE deleted_at IS NULL
    GROUP BY 1 ORDER BY max(created_at) DESC, 1 LIMIT 5""", DOCUMENT))
def recent_projects(spark, sf):
    return (c.active(lake.documents_catalog(spark, sf)).groupBy("project_key").agg(F.max("created_at").alias("updated_at"))
            .orderBy(F.desc("updated_at"), "project_key").limit(5)
            .select("project_key", F.col("updated_at").cast("string").alias("updated_at")))


@query("a25_batch_outcome", with_tables(
    """SELECT count(*) AS total, count(*) FILTER (index_status <> 'FAILED') AS success_count,
    count(*) FILTER (index_status = 'FAILED') AS failure_count FROM document
    WHERE deleted_at IS NULL AND original_file_name LIKE '%.java' AND file_path NOT LIKE '%/src/test/%'""", DOCUMENT))
def batch_outcome(spark, sf):
    """Reindexing every non-test Java document: how many went through."""
    d = c.active(lake.documents_catalog(spark, sf)).where(
        F.lower("file_path").endswith(".java") & ~F.contains(F.lower("file_path"), F.lit("/src/test/")))
    return c.batch_outcome(d.select(F.when(F.col("index_status") == "FAILED", "failed").alias("error")))


@query("a25_failures", with_tables(
    """SELECT id, original_file_name AS file_name, 'size ' || file_size AS message FROM document
    WHERE deleted_at IS NULL AND original_file_name LIKE '%.java' AND file_path NOT LIKE '%/src/test/%' AND index_status = 'FAILED'""", DOCUMENT))
def batch_failures(spark, sf):
    """The documents that failed, with the reason."""
    d = c.active(lake.documents_catalog(spark, sf)).where(
        F.lower("file_path").endswith(".java") & ~F.contains(F.lower("file_path"), F.lit("/src/test/")))
    error = F.when(F.col("index_status") == "FAILED", F.concat(F.lit("size "), F.col("file_size").cast("string")))
    return c.batch_failures(d.select("id", F.col("original_file_name").alias("file_name"), error.alias("error")))


@query("s2_source_files", with_tables(
    """SELECT id, file_path FROM document WHERE regexp_matches(original_file_name, '\\.(java|kt|xml|sql|yml|md)$')
    AND NOT (original_file_name LIKE '%.java' AND file_path LIKE '%/test/%')""", DOCUMENT))
def source_files(spark, sf):
    p = F.col("file_path")
    return lake.documents_catalog(spark, sf).where(ff.is_vector_source(p) & ~ff.is_test_source(p)).select("id", "file_path")


_ARCHIVE = """entry AS (SELECT id, project_key, file_path, file_size,
    regexp_matches(original_file_name, '\\.(java|kt|xml|sql|yml|md)$') AND NOT (original_file_name LIKE '%.java' AND file_path LIKE '%/test/%') AS accepted
    FROM document)"""


@query("s3_archive_report", with_tables(
    f"""{_ARCHIVE}, judged AS (SELECT *, file_size % 97 = 0 AS unsafe, NOT file_size % 97 = 0 AND accepted AND file_size * 1000 > 10485760 AS too_big FROM entry)
    SELECT project_key, count(*) AS discovered, count(*) FILTER (accepted AND NOT unsafe AND NOT too_big) AS indexed, count(*) FILTER (NOT accepted AND NOT unsafe) AS skipped,
    count(*) FILTER (unsafe OR too_big) AS failed, count(*) FILTER (unsafe) AS unsafe, sum(CASE WHEN accepted AND NOT unsafe THEN file_size * 1000 ELSE 0 END)::BIGINT AS total_bytes,
    count(*) > 5000 OR sum(CASE WHEN accepted AND NOT unsafe THEN file_size * 1000 ELSE 0 END) > 209715200 OR count(*) FILTER (unsafe OR too_big) > 0 AS rejected FROM judged GROUP BY project_key""", DOCUMENT))
def archive_report(spark, sf):
    return ff.archive_report(_archive_entries(spark, sf)).select(
        "project_key", "discovered", "indexed", "skipped", "failed", "unsafe", "total_bytes", "rejected")


def _archive_entries(spark, sf):
    """Files a thousand times as large as their documents; some paths lead out of the archive."""
    path = F.when(F.col("file_size") % 97 == 0, F.concat(F.lit("a/../../"), "file_path")).otherwise(F.col("file_path"))
    return lake.documents_catalog(spark, sf).select("id", "project_key", path.alias("path"), (F.col("file_size") * 1000).alias("size"))


@query("s3_archive_failures", with_tables(
    f"""{_ARCHIVE} SELECT id, project_key, CASE WHEN file_size % 97 = 0 THEN 'UNSAFE_PATH' ELSE 'TOO_LARGE' END AS reason FROM entry
    WHERE file_size % 97 = 0 OR (accepted AND file_size * 1000 > 10485760)""", DOCUMENT))
def archive_failures(spark, sf):
    """The entries an ingest refuses, with the reason."""
    return ff.archive_failures(_archive_entries(spark, sf)).select("id", "project_key", "reason")


@query("w9_running_quota", with_tables(
    f"""{_ARCHIVE} SELECT id, project_key, (sum(file_size) OVER w)::BIGINT AS bytes_so_far, (sum(file_size) OVER w) > 209715 AS over_quota
    FROM entry WINDOW w AS (PARTITION BY project_key ORDER BY id ROWS UNBOUNDED PRECEDING)""", DOCUMENT))
def running_quota(spark, sf):
    """Bytes taken so far in ingest order of each project; one language holds most of the corpus."""
    d = lake.documents_catalog(spark, sf).select("id", "project_key", "file_size")
    out = ordering.running_total(d, ["project_key"], ["id"], "file_size", "bytes_so_far")
    return out.select("id", "project_key", "bytes_so_far", (F.col("bytes_so_far") > 209715).alias("over_quota"))
