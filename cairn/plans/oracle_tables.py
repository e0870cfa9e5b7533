"""The engine tables once more, as DuckDB common table expressions for the oracle queries."""

DOCUMENT = """document AS (
  SELECT doc_id AS id, lang AS project_key, 'Doc' || doc_id || suffix AS original_file_name,
         CASE WHEN right(source, 1) = '7' THEN 'app/src/test/java/' ELSE 'app/src/main/java/' END
           || lang || '/' || source || '/Doc' || doc_id || suffix AS file_path,
         n_chars AS file_size,
         CASE WHEN suffix = '.java' THEN 'STANDARD_SOURCE' ELSE 'STANDARD_DOCUMENT' END AS document_type,
         sha256(text) AS file_hash, 'document:' || doc_id AS vector_source_key,
         CASE WHEN suffix IN ('.java', '.xml', '.yml', '.md') THEN 'document:' || doc_id END AS graph_source_key,
         status AS index_status, status AS vector_index_status,
         CASE WHEN suffix IN ('.java', '.xml', '.yml', '.md') THEN status ELSE 'SKIPPED' END AS graph_index_status,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id::INTEGER) AS created_at,
         CASE WHEN source = 'src18' THEN TIMESTAMP '2024-01-02' + to_minutes(doc_id::INTEGER) END AS deleted_at,
         text AS content
  FROM (SELECT *, CASE right(source, 1) WHEN '0' THEN '.java' WHEN '1' THEN '.xml' WHEN '2' THEN '.md'
                    WHEN '3' THEN '.yml' WHEN '4' THEN '.kt' WHEN '5' THEN '.java' WHEN '6' THEN '.sql'
                    WHEN '7' THEN '.java' WHEN '8' THEN '.tmp' WHEN '9' THEN '.txt' ELSE '' END AS suffix,
               CASE WHEN n_chars < 100 THEN 'FAILED' WHEN n_chars < 400 THEN 'PENDING'
                    WHEN n_chars < 800 THEN 'INDEXING' ELSE 'INDEXED' END AS status
        FROM documents))"""

PROJECT = """project AS (
  SELECT project_key, 'Project ' || project_key AS name
  FROM (SELECT DISTINCT lang AS project_key FROM documents UNION ALL SELECT 'default' UNION ALL SELECT 'unused'))"""

METHODS = """methods AS (
  SELECT lang AS project_key, 'method:' || lang || ':' || doc_id AS method_uid, source AS file_path,
         doc_id AS start_line, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count,
         sha256(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g')) AS method_hash,
         sha256(regexp_replace(lower(text), '[0-9]+', '#', 'g')) AS structural_hash,
         length(text) - length(replace(text, ',', '')) + 1 AS cyclomatic,
         length(text) - length(replace(text, ',', '')) + 2 * (length(text) - length(replace(text, '.', ''))) AS cognitive
  FROM documents)"""

CHAT = """chat_message AS (
  SELECT conv_id AS conversation_id, turn AS id, role, text AS message,
         TIMESTAMP '2024-01-01' + to_minutes((conv_id * 60 + turn)::INTEGER) AS created_at
  FROM conversations),
chat_conversation AS (
  SELECT id, opening, updated_at,
         CASE WHEN letter BETWEEN 'a' AND 'e' THEN 0 WHEN letter BETWEEN 'f' AND 'j' THEN 1
              WHEN letter BETWEEN 'k' AND 'o' THEN 2 WHEN letter BETWEEN 'p' AND 't' THEN 3 END::BIGINT AS project_id
  FROM (SELECT conversation_id AS id, arg_min(message, id) AS opening, max(created_at) AS updated_at,
               lower(substr(arg_min(message, id), 1, 1)) AS letter
        FROM chat_message GROUP BY conversation_id)),
chat_project AS (SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region)"""

SCAN = """scan_result AS (
  SELECT user_id AS project_id, user_id || '-' || strftime(ts, '%Y%m%d') AS scan_job_id, event_id AS document_id,
         'File' || event_id || '.java' AS file_name, 'JAVA' AS file_type,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'PASSED' ELSE 'FINDING' END AS status,
         CASE WHEN event_type IN ('error', 'view') THEN '-' WHEN event_type = 'purchase' THEN 'HIGH'
              WHEN event_type = 'click' THEN 'LOW' ELSE 'WARNING' END AS severity,
         CASE WHEN event_type IN ('error', 'view') THEN '-'
              ELSE 'rule-' || json_extract_string(props, '$.k') END AS rule_id,
         'value ' || value AS message, ts AS created_at
  FROM events)"""

GRAPH = """place AS (
  SELECT n_nationkey, n_name, 'com.' || lower(r_name) || '.' || lower(n_name) AS package_name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
node AS (
  SELECT uid, label, name, layer, package_name, external, graph_key,
         CASE WHEN external THEN 'vendor' ELSE 'commerce' END AS project_id
  FROM (
    SELECT 'package:' || n_nationkey AS uid, 'Package' AS label, package_name AS name, NULL::VARCHAR AS layer,
           package_name, false AS external, 'nation:' || n_nationkey AS graph_key FROM place
    UNION ALL SELECT 'type:base:' || n_nationkey, 'JavaType', 'Base' || n_name || 'Service', 'Service', package_name,
           false, 'nation:' || n_nationkey FROM place
    UNION ALL SELECT 'type:c:' || c_custkey, 'JavaType', c_name,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Controller' WHEN 'BUILDING' THEN 'Service'
             WHEN 'FURNITURE' THEN 'ServiceImpl' WHEN 'HOUSEHOLD' THEN 'DTO' ELSE 'Domain' END,
           package_name, false, 'nation:' || n_nationkey FROM customer JOIN place ON c_nationkey = n_nationkey
    UNION ALL SELECT 'type:s:' || s_suppkey, 'JavaType', s_name,
           CASE WHEN s_acctbal >= 5000 THEN 'Repository' ELSE 'Mapper' END, package_name, s_acctbal < 0,
           'nation:' || n_nationkey FROM supplier JOIN place ON s_nationkey = n_nationkey
    UNION ALL SELECT 'method:s:' || s_suppkey, 'Method', 'supply' || s_suppkey, NULL, NULL, false,
           'nation:' || s_nationkey FROM supplier
    UNION ALL SELECT 'statement:s:' || s_suppkey, 'SqlStatement', 'statement' || s_suppkey, NULL, NULL, false,
           'nation:' || s_nationkey FROM supplier WHERE s_acctbal < 5000
    UNION ALL SELECT 'method:o:' || o_orderkey, 'Method', 'order' || o_orderkey, NULL, NULL, false,
           'year:' || year(o_orderdate) FROM orders
    UNION ALL SELECT 'table:p:' || p_partkey, 'DatabaseTable', p_name, NULL, NULL, false, 'brand:' || p_brand FROM part)),
edge AS (
  SELECT 'package:' || c_nationkey AS src, 'type:c:' || c_custkey AS dst, 'CONTAINS' AS type,
         'nation:' || c_nationkey AS graph_key FROM customer
  UNION ALL SELECT 'package:' || s_nationkey, 'type:s:' || s_suppkey, 'CONTAINS', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'type:c:' || c_custkey, 'type:base:' || c_nationkey, 'EXTENDS', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'type:base:' || s_nationkey, 'type:s:' || s_suppkey, 'INJECTS', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'type:c:' || o_custkey, 'method:o:' || o_orderkey, 'HAS_METHOD', 'year:' || year(o_orderdate) FROM orders
  UNION ALL SELECT 'type:s:' || s_suppkey, 'method:s:' || s_suppkey, 'HAS_METHOD', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'type:s:' || s_suppkey, 'statement:s:' || s_suppkey, 'HAS_STATEMENT', 'nation:' || s_nationkey
    FROM supplier WHERE s_acctbal < 5000
  UNION ALL SELECT 'method:o:' || l_orderkey, 'method:s:' || l_suppkey, 'CALLS', 'ship:' || year(l_shipdate) FROM lineitem
  UNION ALL SELECT 'method:o:' || l_orderkey, 'table:p:' || l_partkey, 'WRITES_TO', 'ship:' || year(l_shipdate)
    FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT 'statement:s:' || l_suppkey, 'table:p:' || l_partkey, 'READS_FROM', 'ship:' || year(l_shipdate)
    FROM lineitem WHERE l_returnflag = 'R')"""


def with_tables(body: str, *tables: str, recursive: bool = False) -> str:
    """Put the named table expressions in front of ``body`` (a SELECT, or more CTEs then a SELECT)."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    joiner = ", " if not body.upper().startswith(("SELECT", "(SELECT")) else " "
    return head + ", ".join(tables) + joiner + body
