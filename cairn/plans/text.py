"""Text function queries over documents, pages, benchmark items and conversations."""

from pyspark.sql import functions as F

from cairn.functions import agent, files, ids
from cairn.functions import text as tx
from cairn.operators import catalog as cat
from cairn.operators import ordering
from cairn.plans.registry import query
from cairn.session import cut
from cairn.sources import lake


def _s(column):
    return F.col(column).cast("string")


@query("f1_normalized_path", "SELECT doc_id, 'app/' || source || '/Doc' || doc_id || '.java' AS path, 'Source.java' AS fallback FROM documents")
def normalized_path(spark, sf):
    messy = F.concat(F.lit("\\app\\x/..//./"), "source", F.lit("\\Doc"), _s("doc_id"), F.lit(".java"))
    return lake.raw(spark, sf, "documents").select("doc_id", files.normalize_path(messy).alias("path"), files.normalize_path(F.lit("../.")).alias("fallback"))


@query("f2_uids", """SELECT c_custkey, 'type:p:com.C' || c_custkey AS type_uid, 'table:default:public:t' || c_custkey AS table_uid, 'column:p:app:t' || c_custkey || ':id' AS column_uid,
    CASE WHEN c_acctbal < 0 THEN 'rule:given' ELSE 'rule:p:r' || c_nationkey END AS rule_uid, 'file:p:a/C' || c_custkey AS file_uid FROM customer""")
def uids(spark, sf):
    key, p = _s("c_custkey"), F.lit(" p ")
    rule = F.when(F.col("c_acctbal") < 0, "rule:given").otherwise(F.concat(F.lit(" r"), _s("c_nationkey")))
    return lake.raw(spark, sf, "customer").select(
        "c_custkey", ids.uid("type", p, F.concat(F.lit(" com.C"), key)).alias("type_uid"),
        ids.table_uid(F.lit(" "), F.lit(""), F.concat(F.lit("t"), key)).alias("table_uid"),
        ids.column_uid(p, F.lit("app"), F.concat(F.lit("t"), key), F.lit("id")).alias("column_uid"),
        ids.rule_uid(p, rule).alias("rule_uid"), ids.file_uid(p, F.concat(F.lit("./a//C"), key)).alias("file_uid"))


@query("f4_content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(spark, sf):
    return lake.raw(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


@query("f5_first_text", """SELECT doc_id, CASE WHEN l.quality = 1 THEN d.source WHEN l.quality = 0 THEN d.lang ELSE '' END AS value
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def first_text(spark, sf):
    d = lake.raw(spark, sf, "documents").join(lake.raw(spark, sf, "labels"), "doc_id", "left")
    a = F.when(F.col("quality") == 1, F.concat(F.lit("\t "), "source", F.lit("\n"))).otherwise(" \n")
    b = F.when(F.col("quality") == 0, F.col("lang"))
    return d.select("doc_id", tx.first_text(F.lit(None).cast("string"), a, b).alias("value"))


@query("f7_abbreviated", """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 297) || '...' END AS inside, substr(text, 1, 160) AS plain,
    CASE WHEN length(text) <= 6000 THEN text ELSE substr(text, 1, 6000) || chr(10) || '... truncated ...' END AS marked FROM documents""")
def abbreviated(spark, sf):
    t = F.col("text")
    return lake.raw(spark, sf, "documents").select(
        "doc_id", tx.abbreviate(t, 300, "...", inside=True).alias("inside"), tx.abbreviate(t, 160).alias("plain"),
        tx.abbreviate(t, 6000, "\n... truncated ...").alias("marked"))


@query("f10_endpoint_paths", """SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (
    SELECT page_id, regexp_replace(regexp_replace('/api/' || regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '/+', '/', 'g'), '(.)/$', '\\1') AS p FROM pages)""")
def endpoint_paths(spark, sf):
    from cairn.functions.code import endpoint_path

    return lake.raw(spark, sf, "pages").select("page_id", endpoint_path(F.lit("api//"), F.regexp_extract("url", "^https?://[^/]*([^?#]*)", 1)).alias("path"))


QUERY_TEXT = 'the of "of the" THE and "and th" tion'
_TERMS = ["and th", "of the", "tion", "and", "THE", "of"]


@query("f14_search_terms", """SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_transform(ts, lambda x: lower(x))),
      lambda l: (-length(l), list_filter(ts, lambda y: lower(y) = l)[-1]))), lambda s: s[2]), '|') AS terms
    FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '("[^"]+"|[^ \\t\\n\\x0B\\f\\r]+)', 1), lambda t: CASE WHEN length(t) > 1 AND t LIKE '"%"' THEN trim(substr(t, 2, length(t) - 2)) ELSE t END), lambda t: t <> '') AS ts FROM benchmark)""")
def search_terms(spark, sf):
    """Every benchmark item read as a search: terms, last spelling kept, longest first."""
    return lake.raw(spark, sf, "benchmark").select("item_id", F.array_join(tx.search_terms(F.col("text")), "|").alias("terms"))


_PATTERN_SQL = "(?i)(and th|of the|tion|and|THE|of)"


def _matches(spark, sf):
    """Lines of every document with the number of hits of one search."""
    pattern = F.lit(tx.pattern_of(spark, QUERY_TEXT))
    lines = lake.texts(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("line", "t"))
    return lines.withColumn("hits", F.size(F.regexp_extract_all("t", pattern, F.lit(1))).cast("long"))


_LINES = f"""line AS (SELECT doc_id, i - 1 AS line, len(regexp_extract_all(t, '{_PATTERN_SQL}', 1)) AS hits FROM (
    SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents)))"""


@query("a23_match_counts", f"WITH {_LINES} SELECT doc_id, count(*) FILTER (hits > 0) AS matched_lines, sum(hits)::BIGINT AS matches FROM line GROUP BY 1")
def match_counts(spark, sf):
    return _matches(spark, sf).groupBy("doc_id").agg(F.count_if(F.col("hits") > 0).alias("matched_lines"), F.sum("hits").alias("matches"))


@query("w10_match_numbers", f"WITH {_LINES} SELECT doc_id, line, hits, (sum(hits) OVER (ORDER BY doc_id, line ROWS UNBOUNDED PRECEDING))::BIGINT AS last_number FROM line QUALIFY hits > 0")
def match_numbers(spark, sf):
    """Numbers of the matches in reading order over the whole corpus: the last one on each line."""
    # Counted once: the range partitioning below reads its input twice.
    lines = cut(_matches(spark, sf).where("hits > 0").select("doc_id", "line", "hits"))
    return ordering.running_total(lines, [], ["doc_id", "line"], "hits", "last_number").select("doc_id", "line", "hits", "last_number")


@query("w8_section_of_line", """WITH l AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents))
    SELECT doc_id, i - 1 AS line, coalesce(last_value(CASE WHEN length(t) < 40 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'General') AS section FROM l""")
def section_of_line(spark, sf):
    """Short lines head the lines that follow; a document's lines all come from its own row."""
    lines = F.split("text", "\\r?\\n")
    folded = F.aggregate(
        lines, F.struct(F.lit("General").alias("head"), F.array().cast("array<string>").alias("out")),
        lambda a, t: F.struct(F.when(F.length(t) < 40, t).otherwise(a["head"]).alias("head"),
                              F.array_append(a["out"], F.when(F.length(t) < 40, t).otherwise(a["head"])).alias("out")),
        lambda a: a["out"])
    return lake.raw(spark, sf, "documents").select("doc_id", F.posexplode(folded).alias("line", "section"))


@query("f15_intents", """WITH m AS (SELECT doc_id, lower(CASE lang WHEN 'de' THEN 'Rules List ' WHEN 'fr' THEN 'C:' || chr(92) || 'x analyze project ' ELSE '' END || text) AS t FROM documents)
    SELECT doc_id, CASE WHEN contains(t, 'rules list') OR contains(t, 'rule list') THEN 'RULE_LIST'
      WHEN regexp_matches(t, 'database tables|database table list|table list|tables list') THEN 'TABLE_LIST'
      WHEN regexp_matches(t, 'java|source|controller|repository|mapper|dto|class|method|package|annotation|call graph|dependency|impact analysis|serviceimpl') THEN 'SOURCE_SEARCH'
      WHEN t LIKE 'c:%' AND contains(t, 'analyze project') THEN 'PROJECT_STRUCTURE_ANALYSIS' WHEN regexp_matches(t, 'server://info|resource read|read resource') THEN 'RESOURCE_READ'
      WHEN contains(t, 'resource') THEN 'RESOURCE_LIST' WHEN contains(t, 'prompt') THEN 'PROMPT_LIST' WHEN contains(t, 'server info') THEN 'SERVER_INFO_TOOL'
      WHEN contains(t, 'tool') THEN 'TOOL_LIST' WHEN regexp_matches(t, 'ping|status|health') THEN 'PING' ELSE 'SERVER_INFO' END AS intent FROM m""")
def intents(spark, sf):
    lead = F.when(F.col("lang") == "de", "Rules List ").when(F.col("lang") == "fr", "C:\\x analyze project ").otherwise("")
    return lake.raw(spark, sf, "documents").select("doc_id", agent.intent(F.concat(lead, "text")).alias("intent"))


@query("f16_arguments", """SELECT o_orderkey, 'app.t' || o_custkey AS table_name, 'C:' || chr(92) || 'src' || chr(92) || 'F' || o_orderkey || '.java' AS path, 'F' || o_orderkey || '.java' AS file_name,
    'hello ' || o_custkey AS quoted, 'orders' || o_custkey AS table_by_word, 'select ' || o_custkey AS code FROM orders""")
def arguments(spark, sf):
    key, cust = _s("o_orderkey"), _s("o_custkey")
    m1 = F.concat(F.lit("run it, Table_Name = 'app.t"), cust, F.lit("' on C:\\src\\F"), key, F.lit(".java, please"))
    m2 = F.concat(F.lit('show "hello '), cust, F.lit('" all table orders'), cust, F.lit(" table ```sql\nselect "), cust, F.lit("\n```"))
    return lake.raw(spark, sf, "orders").select(
        "o_orderkey", agent.table_argument(m1).alias("table_name"), agent.path_argument(m1, "path", "scan_path").alias("path"), agent.file_argument(m1).alias("file_name"),
        agent.quoted_text(m2).alias("quoted"), agent.table_argument(m2).alias("table_by_word"), agent.fenced_code(m2).alias("code"))


@query("t7_best_java_reference", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'com.acme.Order' || o_orderkey WHEN 'F' THEN 'UserService' ELSE 'Zeta' END AS reference FROM orders""")
def best_java_reference(spark, sf):
    key, status = _s("o_orderkey"), F.col("o_orderstatus")
    text = (F.when(status == "O", F.concat(F.lit("where is com.acme.Order"), key, F.lit(".java used by UserService")))
            .when(status == "F", "java class Alpha or UserService of the service").otherwise("the Alpha and Zeta in code"))
    return lake.raw(spark, sf, "orders").select("o_orderkey", agent.java_reference(text).alias("reference"))


@query("f18_json_lists", """SELECT conv_id, turn, '["' || role || '","x"]' AS written, role AS first_item, 2::BIGINT AS items, 0::BIGINT AS bad_items FROM conversations""")
def json_lists(spark, sf):
    written = F.to_json(F.array("role", F.lit("x")))
    read = tx.json_list(written)
    return lake.raw(spark, sf, "conversations").select(
        "conv_id", "turn", written.alias("written"), F.get(read, 0).alias("first_item"), F.size(read).cast("long").alias("items"),
        F.size(tx.json_list(F.concat(F.lit("{"), "text"))).cast("long").alias("bad_items"))


@query("f20_placeholders", "SELECT c_custkey, 'v:' || c_custkey AS value, 'p''q' || c_nationkey AS quoted, '${A}' AS bare FROM customer")
def placeholders(spark, sf):
    return lake.raw(spark, sf, "customer").select(
        "c_custkey", tx.placeholder_default(F.concat(F.lit(" '${KEY:v:"), _s("c_custkey"), F.lit("}'"))).alias("value"),
        tx.unquote(F.concat(F.lit("\"p'q"), _s("c_nationkey"), F.lit('"'))).alias("quoted"), tx.placeholder_default(F.lit("${A}")).alias("bare"))


@query("p9_redacted_config", """SELECT c_custkey, '[REDACTED]' AS secret, CASE WHEN c_acctbal < 0 THEN '[REDACTED]' ELSE c_name END AS maybe FROM customer""")
def redacted_config(spark, sf):
    key = F.when(F.col("c_acctbal") < 0, "a.Api-Key.x").otherwise("a.name")
    return lake.raw(spark, sf, "customer").select(
        "c_custkey", tx.redact_config(F.lit("db.PASSWORD"), F.col("c_name")).alias("secret"),
        tx.redact_config(key, F.concat(F.lit("'"), "c_name", F.lit("'"))).alias("maybe"))


@query("f21_project_validation", """SELECT doc_id, length(source || lang) BETWEEN 2 AND 64 AND n_chars BETWEEN 1 AND 120 AS short_name, n_chars <= 500 AS short_description, false AS bad_key FROM documents""")
def project_validation(spark, sf):
    key, ok = F.concat("source", F.lit("_"), "lang"), F.lit("ok")
    body = F.rpad(F.lit("x"), F.col("n_chars").cast("int"), F.lit("x"))
    return lake.raw(spark, sf, "documents").select(
        "doc_id", tx.valid_project(key, body, ok).alias("short_name"), tx.valid_project(key, ok, body).alias("short_description"),
        tx.valid_project(F.concat(F.lit("-"), key), ok, ok).alias("bad_key"))


@query("f22_day_boundaries", """SELECT event_id, date_trunc('day', ts)::TIMESTAMP::VARCHAR AS day_start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP::VARCHAR AS next_day FROM events""")
def day_boundaries(spark, sf):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return lake.raw(spark, sf, "events").select(
        "event_id", day.cast("string").alias("day_start"), F.timestamp_add("DAY", F.lit(1), day).cast("string").alias("next_day"))


@query("f24_clamped_page", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 100")
def clamped_page(spark, sf):
    """A page request beyond the limits is clamped: negative page, oversized page size."""
    return cat.page(lake.raw(spark, sf, "pages").orderBy("page_id"), -3, 5000).select("page_id", "url")


@query("t2_page_past_end", "SELECT page_id, url FROM pages WHERE false")
def page_past_end(spark, sf):
    return cat.page(lake.raw(spark, sf, "pages").orderBy("page_id"), 1_000_000, 100).select("page_id", "url")


@query("t2_page_summary", """SELECT count(*) AS total, 0::BIGINT AS page, 30::BIGINT AS size, ceil(count(*) / 30)::BIGINT AS total_pages, true AS first, 1 >= ceil(count(*) / 30) AS last, 30 < count(*) AS has_next FROM pages""")
def page_summary(spark, sf):
    return cat.page_envelope(lake.raw(spark, sf, "pages"), 0, 30)


@query("f8_page_links", """SELECT page_id, link, count(*) AS uses FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def page_links(spark, sf):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")
    return lake.raw(spark, sf, "pages").select("page_id", links).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("uses"))
