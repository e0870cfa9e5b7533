"""Graph queries over the code base laid on the sales tables."""

import uuid

from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import graph as g
from cairn.operators import source_routes as sr
from cairn.operators import traversal as tr
from cairn.plans.oracle_tables import DOCUMENT, GRAPH, with_tables
from cairn.plans.registry import query
from cairn.session import cut, shared_dir
from cairn.sources import lake
from cairn.sources.graph_store import GraphStore

_DIRECT = "('IMPORTS', 'INJECTS', 'IMPLEMENTS', 'EXTENDS', 'USES', 'USES_DTO', 'MAPS_TO')"
_TYPES = f"""own AS (SELECT dst AS member, src AS owner FROM edge WHERE type = 'HAS_METHOD'),
sown AS (SELECT dst AS member, src AS owner FROM edge WHERE type = 'HAS_STATEMENT'),
itype AS (SELECT * FROM node WHERE label = 'JavaType' AND NOT external),
lifted AS (SELECT DISTINCT a.owner AS src, b.owner AS dst FROM edge e JOIN own a ON e.src = a.member JOIN own b ON e.dst = b.member
           WHERE e.type = 'CALLS'),
tedge AS (SELECT src, dst, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM (
            SELECT src, dst, type FROM edge WHERE type IN {_DIRECT} UNION ALL SELECT src, dst, 'CALLS' FROM lifted)
          WHERE src <> dst AND src IN (SELECT uid FROM itype) AND dst IN (SELECT uid FROM itype) GROUP BY src, dst),
dedge AS (SELECT coalesce(o.owner, s.owner, e.src) AS src, e.dst, string_agg(DISTINCT e.type, ',' ORDER BY e.type) AS types
          FROM edge e LEFT JOIN own o ON e.src = o.member LEFT JOIN sown s ON e.src = s.member
          WHERE e.type IN ('READS_FROM', 'WRITES_TO', 'MAPS_TO') AND e.dst IN (SELECT uid FROM node WHERE label = 'DatabaseTable')
          GROUP BY 1, 2 HAVING coalesce(any_value(o.owner), any_value(s.owner), any_value(e.src)) IN (SELECT uid FROM itype))"""

def _labels():
    return F.filter(F.array(F.col("label"), g.classification(F.col("label"), F.col("layer"))), lambda x: x.isNotNull())
_LABELS_SQL = """tagged AS (SELECT *, list_filter([label, CASE WHEN label = 'JavaType' THEN CASE WHEN layer = 'ServiceImpl' THEN 'Service'
    WHEN layer IN ('Service', 'Repository', 'DTO', 'Domain', 'Mapper') THEN layer END END], lambda x: x IS NOT NULL) AS labels FROM node)"""


def _graph(spark, sf):
    return lake.graph_nodes(spark, sf), lake.graph_edges(spark, sf)


def _flat(df):
    return df.withColumn("types", F.array_join("types", ","))


@query("j7_lifted_calls", with_tables(f"{_TYPES} SELECT * FROM lifted", GRAPH))
def lifted_calls(spark, sf):
    return g.lifted_calls(lake.graph_edges(spark, sf))


@query("a11_type_edges", with_tables(f"{_TYPES} SELECT * FROM tedge", GRAPH))
def type_edges(spark, sf):
    return _flat(g.type_edges(*_graph(spark, sf)))


@query("j8_table_edges", with_tables(f"{_TYPES} SELECT * FROM dedge", GRAPH))
def table_edges(spark, sf):
    return _flat(g.table_edges(*_graph(spark, sf)))


@query("g2_class_impact", with_tables(
    f"""{_TYPES} SELECT src AS selected, 'outgoing' AS side, dst AS other, types FROM tedge
    UNION ALL SELECT dst, 'incoming', src, types FROM tedge""", GRAPH))
def class_impact(spark, sf):
    return _flat(g.impact(g.type_edges(*_graph(spark, sf))))


_MATRIX = f"""{_TYPES}, matrix AS (SELECT a.package_name AS src_package, b.package_name AS dst_package, count(*) AS edge_count,
    array_to_string(list_sort(list_distinct(flatten(list(string_split(types, ','))))), ',') AS types
    FROM tedge JOIN itype a ON src = a.uid JOIN itype b ON dst = b.uid WHERE a.package_name <> b.package_name GROUP BY 1, 2)"""


@query("a10_package_matrix", with_tables(f"{_MATRIX} SELECT * FROM matrix", GRAPH))
def package_matrix(spark, sf):
    return _flat(g.package_matrix(*_graph(spark, sf)))


_DEPENDENCIES = ("('IMPORTS', 'EXTENDS', 'IMPLEMENTS', 'INJECTS', 'USES', 'USES_DTO', 'CALLS', 'READS_FROM', 'WRITES_TO', 'MAPS_TO', "
                 "'EXECUTES', 'HAS_STATEMENT', 'HAS_MAPPER_XML')")


@query("j10_type_dependencies", with_tables(
    f"""SELECT DISTINCT e.src AS selected, e.type, e.dst AS other, b.name AS other_name FROM edge e JOIN node a ON e.src = a.uid JOIN node b ON e.dst = b.uid
    WHERE a.label = 'JavaType' AND b.label = 'JavaType' AND e.type IN {_DEPENDENCIES}""", GRAPH))
def type_dependencies(spark, sf):
    return g.dependencies(*_graph(spark, sf))


@query("j11_type_impacts", with_tables(
    f"""SELECT DISTINCT e.dst AS selected, e.type, e.src AS other, a.name AS other_name FROM edge e JOIN node a ON e.src = a.uid JOIN node b ON e.dst = b.uid
    WHERE a.label = 'JavaType' AND b.label = 'JavaType' AND e.type IN {_DEPENDENCIES}""", GRAPH))
def type_impacts(spark, sf):
    return g.dependencies(*_graph(spark, sf), reverse=True)


@query("j12_node_source", with_tables(
    """SELECT n.uid, n.label, coalesce(n.package_name, o.package_name, '') AS package_name, n.graph_key AS source_key,
    coalesce(f.name, pf.name, n.name || '.java') AS source_file, coalesce(o.name, n.name) AS type_name
    FROM node n LEFT JOIN (SELECT dst, src FROM edge WHERE type = 'CONTAINS') fe ON n.uid = fe.dst LEFT JOIN node f ON f.uid = fe.src
    LEFT JOIN (SELECT dst, src FROM edge WHERE type = 'HAS_METHOD') oe ON n.uid = oe.dst LEFT JOIN node o ON o.uid = oe.src
    LEFT JOIN (SELECT dst, src FROM edge WHERE type = 'CONTAINS') pe ON o.uid = pe.dst LEFT JOIN node pf ON pf.uid = pe.src""", GRAPH))
def node_source(spark, sf):
    return g.node_source(*_graph(spark, sf), declares="CONTAINS")


_ROUTES = """part_of AS (SELECT dst AS uid, min(src) AS file FROM edge WHERE type = 'CONTAINS' GROUP BY 1),
has AS (SELECT dst AS uid, min(src) AS owner FROM edge WHERE type = 'HAS_METHOD' GROUP BY 1),
told AS (SELECT n.*, f.name AS f_name, o.name AS o_name, o.package_name AS o_package, o.uid AS o_uid, tf.name AS tf_name,
    CASE WHEN n.uid LIKE 'method:s:%' THEN substr(n.uid, 10)::BIGINT END AS history_id
    FROM node n LEFT JOIN part_of p ON n.uid = p.uid LEFT JOIN node f ON f.uid = p.file LEFT JOIN has h ON n.uid = h.uid LEFT JOIN node o ON o.uid = h.owner
    LEFT JOIN part_of tp ON tp.uid = o.uid LEFT JOIN node tf ON tf.uid = tp.file),
named AS (SELECT *, CASE WHEN label = 'JavaType' THEN package_name || '.' || name WHEN o_name IS NOT NULL THEN o_package || '.' || o_name ELSE '' END AS fqn,
    CASE WHEN label = 'JavaType' THEN name WHEN o_name IS NOT NULL THEN o_name ELSE name END AS simple_name,
    CASE WHEN uid LIKE 'type:c:%' THEN 'document:' || substr(uid, 8) WHEN o_uid LIKE 'type:c:%' THEN 'document:' || substr(o_uid, 8) ELSE '' END AS source_key FROM told),
cat AS (SELECT graph_source_key, arg_min(original_file_name, id) AS file, arg_min(file_path, id) AS path, arg_min(CASE WHEN index_status <> 'FAILED' THEN content END, id) AS body
    FROM document WHERE deleted_at IS NULL AND graph_source_key IS NOT NULL GROUP BY 1),
made AS (SELECT conv_id, arg_min(text, turn) AS body FROM conversations WHERE turn % 2 = 1 GROUP BY 1),
joined AS (SELECT n.*, c.file, coalesce(c.path, '') AS file_path, CASE WHEN trim(c.body) <> '' THEN c.body END AS c_body,
    CASE WHEN trim(m.body) <> '' THEN m.body END AS m_body,
    CASE WHEN label = 'Package' THEN 'package ' || name WHEN f_name IS NOT NULL THEN 'package ' || f_name WHEN tf_name IS NOT NULL THEN 'package ' || tf_name END AS own
    FROM named n LEFT JOIN cat c ON n.source_key = c.graph_source_key LEFT JOIN made m ON n.history_id = m.conv_id)"""


@query("j12_source_routes", with_tables(
    f"""{_ROUTES} SELECT uid, label, name, fqn, simple_name,
    coalesce(file, CASE WHEN label = 'Package' THEN name || '.txt' ELSE coalesce(f_name, tf_name) || '.txt' END, simple_name || '.java') AS file_name,
    CASE WHEN label = 'Package' OR f_name IS NOT NULL THEN 'package' WHEN tf_name IS NOT NULL THEN 'package' ELSE '' END AS source_kind,
    source_key, file_path, length(coalesce(c_body, m_body, own, '')) AS content_chars,
    CASE WHEN coalesce(c_body, m_body, own, '') <> '' THEN '' WHEN file_path <> '' THEN 'file' WHEN source_key <> '' THEN 'catalog row' ELSE 'source' END AS missing FROM joined""",
    GRAPH, DOCUMENT))
def source_routes(spark, sf):
    """Packages stand for source files, customer types come from a document, methods of suppliers from a generation."""
    nodes, edges = _graph(spark, sf)
    of_type = F.col("label") == "JavaType"
    is_package = F.col("label") == "Package"
    own = {
        "fqn": F.when(of_type, F.concat_ws(".", "package_name", "name")), "simpleName": F.when(of_type, F.col("name")),
        "source": F.when(F.col("uid").startswith("type:c:"), F.concat(F.lit("document:"), F.substr("uid", F.lit(8)))),
        "historyId": F.when(F.col("uid").startswith("method:s:"), F.substr("uid", F.lit(10))),
        "fileName": F.when(is_package, F.concat("name", F.lit(".txt"))), "sourceKind": F.when(is_package, F.lit("package")),
        "sourceContent": F.when(is_package, F.concat(F.lit("package "), "name"))}
    props = F.map_from_arrays(F.array(*[F.lit(k) for k in own]), F.array(*own.values()))
    docs = lake.documents_catalog(spark, sf).where("deleted_at IS NULL").select(
        "id", "graph_source_key", "original_file_name", "file_path", F.when(F.col("index_status") != "FAILED", F.col("content")).alias("content"))
    turns = lake.raw(spark, sf, "conversations").where("turn % 2 = 1")
    supplier = F.concat(F.lit("Supplier#"), F.lpad(F.col("conv_id").cast("string"), 9, "0"))
    blocks = turns.select(F.col("conv_id").cast("long").alias("history_id"), F.col("turn").alias("place"), F.lit(None).cast("string").alias("fqn"),
                          supplier.alias("simple_name"), F.col("text").alias("content"))
    found = sr.node_sources(nodes.withColumn("props", props), edges, docs, blocks, declares="CONTAINS", file_label="Package")
    return found.select(*[c for c in found.columns if c not in ("content", "missing")], F.length("content").cast("long").alias("content_chars"), "missing")


@query("a5_label_counts", with_tables(
    f"{_LABELS_SQL} SELECT label, count(*) AS node_count FROM (SELECT unnest(labels) AS label FROM tagged) GROUP BY 1", GRAPH))
def label_counts(spark, sf):
    return g.label_counts(lake.graph_nodes(spark, sf), _labels())


_LABEL_GRAPH = f"""{_LABELS_SQL}, lg AS (SELECT source_label, type, target_label, count(*) AS edge_count FROM (
    SELECT s.label1 AS source_label, e.type, unnest(t.labels) AS target_label FROM edge e
    JOIN (SELECT uid, unnest(labels) AS label1 FROM tagged) s ON e.src = s.uid JOIN tagged t ON e.dst = t.uid) GROUP BY ALL)"""


@query("a6_label_graph", with_tables(f"{_LABEL_GRAPH} SELECT * FROM lg", GRAPH))
def label_graph(spark, sf):
    return g.label_graph(*_graph(spark, sf), _labels())


@query("t5_label_graph_truncated", with_tables(
    f"""{_LABEL_GRAPH} SELECT *, (SELECT count(*) FROM lg) > 10 AS truncated FROM lg ORDER BY edge_count DESC, lower(source_label), source_label,
    lower(type), type, lower(target_label), target_label LIMIT 10""", GRAPH))
def label_graph_truncated(spark, sf):
    order = [F.desc("edge_count"), F.lower("source_label"), F.col("source_label"), F.lower("type"), F.col("type"),
             F.lower("target_label"), F.col("target_label")]
    return g.limited_with_flag(g.label_graph(*_graph(spark, sf), _labels()), order, 10)


@query("a24_pair_fan_out", with_tables(
    f"""{_LABEL_GRAPH} SELECT source_label, target_label, type, edge_count, count(*) OVER (PARTITION BY source_label, target_label) AS pair_count,
    source_label <> target_label AND (target_label, source_label) IN (SELECT (source_label, target_label) FROM lg) AS has_reverse FROM lg""", GRAPH))
def pair_fan_out(spark, sf):
    return g.pair_fan_out(g.label_graph(*_graph(spark, sf), _labels())).drop("pair_position")


@query("w11_parallel_edge_position", """
    SELECT l_orderkey AS src, l_suppkey AS dst, l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS position
    FROM lineitem""")
def parallel_edge_position(spark, sf):
    """Position of each call among the parallel ones of its pair, whatever the size of the pair."""
    from cairn.operators.ordering import positions

    li = lake.raw(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_partkey")
    return positions(li, ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"], "position").select(
        F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("line"), "position")


_PROPS = ["uid", "name", "layer", "package_name", "graph_key", "project_id"]


@query("a9_node_degrees", with_tables(
    """d AS (SELECT uid, count(*) AS degree FROM (SELECT src AS uid FROM edge UNION ALL SELECT dst FROM edge WHERE src <> dst) GROUP BY 1)
    SELECT node.uid, coalesce(degree, 0) AS degree, 4 + (layer IS NOT NULL)::BIGINT + (package_name IS NOT NULL)::BIGINT AS property_count
    FROM node LEFT JOIN d USING (uid)""", GRAPH))
def node_degrees(spark, sf):
    return g.degrees(*_graph(spark, sf)).select("uid", "degree", g.property_count(*_PROPS).alias("property_count"))


@query("t6_node_detail_edges", with_tables(
    """d AS (SELECT uid FROM (SELECT src AS uid FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1 ORDER BY count(*) DESC, uid LIMIT 1),
    around AS (SELECT 'OUTGOING' AS direction, type, dst AS other, graph_key FROM edge WHERE src IN (SELECT uid FROM d)
               UNION ALL SELECT 'INCOMING', type, src, graph_key FROM edge WHERE dst IN (SELECT uid FROM d))
    SELECT direction, type, other, name AS other_name FROM around a JOIN node ON other = uid
    ORDER BY type, lower(name), other, direction, a.graph_key LIMIT 500""", GRAPH))
def node_detail_edges(spark, sf):
    """Edges shown for the best connected node of the graph."""
    nodes, edges = _graph(spark, sf)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("uid")).groupBy("uid").count()
    best = ends.orderBy(F.desc("count"), "uid").limit(1).select("uid")
    return g.detail_edges(edges, nodes, best).select("direction", "type", "other", "other_name")


@query("p6_keyword_search", with_tables(
    f"""{_LABELS_SQL} SELECT uid FROM tagged WHERE list_contains(labels, 'JavaType') AND (
    len(list_filter(labels, lambda x: lower(x) LIKE '%asia%')) > 0 OR lower(concat_ws('|', uid, name, layer, package_name, graph_key, project_id)) LIKE '%asia%')""", GRAPH))
def keyword_search(spark, sf):
    return lake.graph_nodes(spark, sf).where(g.keyword_match(_labels(), _PROPS, "JavaType", "ASIA")).select("uid")


@query("p7_display_name", with_tables("SELECT uid, coalesce(nullif(trim(name), ''), uid) AS display_name FROM node", GRAPH))
def display_name(spark, sf):
    nodes = lake.graph_nodes(spark, sf)
    return nodes.select("uid", g.display_name(nodes).alias("display_name"))


@query("p8_masked_properties", with_tables(
    """SELECT uid, '******' AS api_key, name, '******' AS access_token FROM node""", GRAPH))
def masked_properties(spark, sf):
    props = F.create_map(F.lit("api_KEY"), "graph_key", F.lit("name"), "name", F.lit("accessToken"), "uid")
    masked = tx.mask_properties(props)
    return lake.graph_nodes(spark, sf).select("uid", masked["api_KEY"].alias("api_key"), masked["name"].alias("name"),
                                              masked["accessToken"].alias("access_token"))


@query("p16_architecture_role", with_tables(
    """SELECT uid, CASE WHEN layer = 'Controller' THEN 'Controller' WHEN layer IN ('Service', 'ServiceImpl') THEN 'Service'
    WHEN layer IN ('Repository', 'Mapper') THEN layer WHEN layer IN ('DTO', 'Domain') THEN 'DataModel'
    WHEN label IN ('DatabaseTable', 'ApiEndpoint', 'SqlStatement') THEN label ELSE 'Common' END AS role FROM node""", GRAPH))
def architecture_role(spark, sf):
    return lake.graph_nodes(spark, sf).select("uid", g.role(F.col("label"), F.col("layer")).alias("role"))


@query("p19_node_package", with_tables(
    "SELECT uid, coalesce(package_name, CASE WHEN name LIKE '%.%' THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) END, '(default package)') AS package FROM node", GRAPH))
def node_package(spark, sf):
    return lake.graph_nodes(spark, sf).select("uid", g.package_of(F.col("package_name"), F.col("name")).alias("package"))


@query("p20_project_nodes", with_tables("SELECT uid, label FROM node WHERE project_id = 'vendor'", GRAPH))
def project_nodes(spark, sf):
    return lake.graph_nodes(spark, sf).where(F.col("project_id") == "vendor").select("uid", "label")


@query("a8_java_file_count", with_tables("SELECT count(DISTINCT file_path) AS file_count FROM document WHERE file_path LIKE '%.java'", DOCUMENT))
def java_file_count(spark, sf):
    """Distinct Java files among the source file nodes of the catalog."""
    files = lake.documents_catalog(spark, sf).select(F.lit("SourceFile").alias("label"), F.col("file_path").alias("uid"))
    return g.java_file_count(files)


_OBSERVED = """obs AS (SELECT 'part:' || l_partkey AS uid, (l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus) AS seq, 'L' || l_linenumber AS label, 'order' || l_orderkey AS name,
    l_linestatus = 'O' AS external, l_returnflag AS flag, CASE WHEN l_linestatus = 'O' THEN l_suppkey::VARCHAR END AS supplier
    FROM lineitem)"""


@query("a12_merged_nodes", with_tables(
    """SELECT uid, arg_min(label, seq) AS label, arg_max(name, seq) AS name, arg_max(external, seq) AS external,
    arg_max(flag, seq) AS flag, arg_max(supplier, seq) FILTER (supplier IS NOT NULL) AS supplier FROM obs GROUP BY uid""", _OBSERVED))
def merged_nodes(spark, sf):
    """A part is observed by each of its line items. Its observations come together while they are six narrow columns, so
    a task merges them before it sends strings and maps, and sorts a partition rather than its share of the file."""
    seen = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus"]
    li = lake.raw(spark, sf, "lineitem").select(*seen).hint("rebalance", F.col("l_partkey"))
    props = F.map_filter(F.create_map(F.lit("flag"), "l_returnflag", F.lit("supplier"),
                                      F.when(F.col("l_linestatus") == "O", F.col("l_suppkey").cast("string"))), lambda k, v: v.isNotNull())
    obs = li.select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("uid"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus").alias("seq"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("label"), F.concat(F.lit("order"), F.col("l_orderkey").cast("string")).alias("name"),
        (F.col("l_linestatus") == "O").alias("external"), props.alias("props"))
    return g.merge_nodes(obs).select("uid", "label", "name", "external", F.col("props")["flag"].alias("flag"), F.col("props")["supplier"].alias("supplier"))


def _store(spark, nodes, edges):
    """A new store with this graph; a node's columns are its properties."""
    store = GraphStore(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", 16)
    store.write(_observed(nodes), edges.withColumn("props", F.lit(None).cast("map<string,string>")))
    return store


def _observed(nodes, **more):
    named = {"graphKey": F.col("graph_key"), "name": F.col("name"), "layer": F.col("layer"), "packageName": F.col("package_name"), **more}
    return nodes.select("uid", F.lit(0).alias("seq"), "label", F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]).alias("props"))


@query("s9_graph_write", with_tables(
    "SELECT DISTINCT src, dst, type, graph_key FROM edge WHERE src IN (SELECT uid FROM itype) AND dst IN (SELECT uid FROM itype)",
    GRAPH, "itype AS (SELECT * FROM node WHERE NOT external)"))
def graph_write(spark, sf):
    """What a write stores: merged edges whose two ends were stored; external nodes were not sent."""
    nodes, edges = _graph(spark, sf)
    return _store(spark, nodes.where(~F.col("external")), edges).edges().select("src", "dst", "type", "graph_key")


@query("s9_stored_nodes", with_tables(
    """SELECT uid, label, CASE WHEN label = 'Method' THEN 'again' ELSE graph_key END AS graph_key, name, CASE WHEN label = 'Method' THEN 'Late' ELSE layer END AS layer,
    package_name, CASE WHEN label = 'Method' THEN 'x' ELSE NULL END AS note, false AS with_content FROM node""", GRAPH))
def stored_nodes(spark, sf):
    """Methods are written a second time under another key: new values go over the stored ones, source texts stay out."""
    nodes, edges = _graph(spark, sf)
    content = F.concat(F.lit("class "), "name")
    store = GraphStore(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", 16)
    store.write(_observed(nodes, content=content, sourceContent=content), edges.limit(0).withColumn("props", F.lit(None).cast("map<string,string>")))
    late = nodes.where(F.col("label") == "Method").withColumns({"graph_key": F.lit("again"), "layer": F.lit("Late"), "name": F.lit(None).cast("string")})
    store.write(_observed(late, note=F.lit("x"), content=content), edges.limit(0).withColumn("props", F.lit(None).cast("map<string,string>")))
    props = F.col("props")
    return store.nodes().select(
        "uid", "label", "graph_key", props["name"].alias("name"), props["layer"].alias("layer"), props["packageName"].alias("package_name"), props["note"].alias("note"),
        (F.map_contains_key(props, "content") | F.map_contains_key(props, "sourceContent")).alias("with_content"))


_OVERVIEW = """ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY name, uid) AS rn FROM {scope}),
placed AS (SELECT *, CASE WHEN rn <= {quota} THEN 0 ELSE 1 END AS phase FROM ranked),
shown AS (SELECT * FROM placed ORDER BY phase, label, name, uid LIMIT {limit})"""


@query("w4_overview", with_tables(
    f"{_OVERVIEW.format(scope='node', quota=29, limit=600)} SELECT uid, label, name, phase FROM shown", GRAPH))
def overview(spark, sf):
    return g.overview(lake.graph_nodes(spark, sf), 600).select("uid", "label", "name", "phase")


_MATCHED = """matched AS (SELECT * FROM node WHERE contains(lower(concat_ws(chr(10), name, label, CASE WHEN label = 'JavaType' THEN name || '.java' END,
    CASE WHEN label = 'JavaType' THEN package_name || '.' || name END, graph_key, layer)), 'nation_')),
keys AS (SELECT DISTINCT graph_key FROM matched ORDER BY 1 LIMIT 20),
scope AS (SELECT * FROM node WHERE graph_key IN (SELECT graph_key FROM keys) OR uid IN (SELECT uid FROM matched))"""


@query("w5_matched_overview", with_tables(
    f"{_MATCHED}, {_OVERVIEW.format(scope='scope', quota=3, limit=60)} SELECT uid, label, name, phase FROM shown", GRAPH))
def matched_overview(spark, sf):
    is_type = F.col("label") == "JavaType"
    nodes = lake.graph_nodes(spark, sf).withColumns({
        "fileName": F.when(is_type, F.concat("name", F.lit(".java"))), "fqn": F.when(is_type, F.concat_ws(".", "package_name", "name")),
        "source": F.col("graph_key"), "sourceKind": F.col("layer")})
    return g.overview(g.matched_scope(nodes, " Nation_ "), 60).select("uid", "label", "name", "phase")


@query("u4_not_yet_selected", with_tables(
    f"{_OVERVIEW.format(scope='node', quota=29, limit=600)} SELECT label, count(*) AS left_over FROM node WHERE uid NOT IN (SELECT uid FROM shown) GROUP BY 1", GRAPH))
def not_yet_selected(spark, sf):
    nodes = lake.graph_nodes(spark, sf)
    return nodes.join(g.overview(nodes, 600).select("uid"), "uid", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("left_over"))


@query("j9_induced_edges", with_tables(
    f"""{_OVERVIEW.format(scope='node', quota=29, limit=600)} SELECT type, src, dst, graph_key FROM edge
    WHERE src IN (SELECT uid FROM shown) AND dst IN (SELECT uid FROM shown) ORDER BY type, src, dst, graph_key LIMIT (SELECT greatest(200, least(5000, 6 * count(*))) FROM shown)""", GRAPH))
def induced_edges(spark, sf):
    nodes, edges = _graph(spark, sf)
    return g.induced_edges(edges, g.overview(nodes, 600))


@query("a19_package_tree", with_tables(
    f"""{_TYPES} SELECT path, count(*) AS type_count FROM (SELECT unnest([string_split(package_name, '.')[1],
    array_to_string(string_split(package_name, '.')[1:2], '.'), package_name]) AS path FROM itype) GROUP BY 1""", GRAPH))
def package_tree(spark, sf):
    return g.package_tree(g.internal_types(lake.graph_nodes(spark, sf)))


@query("a20_common_package_prefix", """
    SELECT CASE WHEN len(shared) >= 2 THEN array_to_string(shared, '.') ELSE '' END AS root FROM (
      SELECT list(part ORDER BY pos) AS shared FROM (
        SELECT pos, min(part) AS part, bool_and(same) OVER (ORDER BY pos) AS ok FROM (
          SELECT pos, min(part) AS part, count(DISTINCT part) = 1 AND count(*) = (SELECT count(*) FROM documents) AS same
          FROM (SELECT unnest(string_split('com.acme.' || lang || '.' || source, '.')) AS part, unnest([1, 2, 3, 4]) AS pos FROM documents) GROUP BY pos)
        GROUP BY pos, same) WHERE ok)""")
def common_package_prefix(spark, sf):
    packages = lake.raw(spark, sf, "documents").select(F.concat_ws(".", F.lit("com.acme"), "lang", "source").alias("package_name"))
    return g.common_prefix(packages)


@query("a20_package_entries", """
    WITH p AS (SELECT DISTINCT 'com.acme.' || lang || '.' || source AS package FROM documents UNION SELECT 'com.acme'),
    r AS (SELECT CASE WHEN count(DISTINCT lang) > 1 OR true THEN 'com.acme' END AS root FROM documents)
    SELECT package, CASE WHEN package = root THEN '(root)' ELSE substr(package, length(root) + 2) END AS relative_name,
      CASE WHEN package = root THEN 0 ELSE 1 END::BIGINT AS depth FROM p, r""")
def package_entries(spark, sf):
    """Names relative to the common prefix, which is a package itself here."""
    d = lake.raw(spark, sf, "documents")
    names = F.explode(F.array(F.concat_ws(".", F.lit("com.acme"), "lang", "source"), F.lit("com.acme")))
    return g.package_entries(d.select(names.alias("package_name")))


@query("g7_package_hierarchy", """
    WITH page AS (SELECT DISTINCT 'web' || replace(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '/', '.') AS package FROM pages),
    pkg AS (SELECT package FROM page UNION SELECT DISTINCT regexp_extract(package, '^(web\\.[^.]+)\\.', 1) FROM page WHERE package LIKE 'web.%.%')
    SELECT a.package, (SELECT b.package FROM pkg b WHERE starts_with(a.package, b.package || '.') ORDER BY length(b.package) DESC LIMIT 1) AS parent FROM pkg a""")
def package_hierarchy(spark, sf):
    """Address paths as packages, the language folders among them."""
    page = lake.raw(spark, sf, "pages").select(
        F.concat(F.lit("web"), F.replace(F.regexp_extract("url", "^https?://[^/]*([^?#]*)", 1), F.lit("/"), F.lit("."))).alias("package_name"))
    folders = page.where(F.col("package_name").like("web.%.%")).select(F.regexp_extract("package_name", "^(web\\.[^.]+)\\.", 1).alias("package_name"))
    return g.nearest_parent(page.unionByName(folders))


@query("g9_package_containers", with_tables(
    f"""{_TYPES} SELECT 'package:' || package_name AS source, uid AS target, 'CONTAINS' AS type, 'contains' AS link_kind FROM itype
    UNION ALL SELECT src, dst, replace(types, ',', ', '), 'dependency' FROM tedge""", GRAPH))
def package_containers(spark, sf):
    return g.container_links(*_graph(spark, sf))


@query("g9_package_nodes", with_tables(
    f"{_TYPES} SELECT 'package:' || package_name AS id, 'Package' AS label, package_name AS name, count(*) AS type_count FROM itype GROUP BY package_name", GRAPH))
def package_nodes(spark, sf):
    return g.package_nodes(lake.graph_nodes(spark, sf))


@query("g9_package_members", with_tables(
    f"{_TYPES} SELECT 'package:' || package_name AS package, uid, row_number() OVER (PARTITION BY package_name ORDER BY name, uid) AS position FROM itype", GRAPH))
def package_members(spark, sf):
    return g.package_members(lake.graph_nodes(spark, sf))


_OF_HISTORY = "gen AS (SELECT *, TRY_CAST(regexp_extract(graph_key, '([0-9]+)$', 1) AS BIGINT) AS history_id FROM node)"


def _generated_nodes(spark, sf):
    """Nodes of a generation: the number at the end of their graph key."""
    return lake.graph_nodes(spark, sf).withColumn("history_id", F.regexp_extract("graph_key", "([0-9]+)$", 1).try_cast("long"))


@query("g10_history_nodes", with_tables("SELECT uid, label, name FROM gen WHERE history_id = 12", GRAPH, _OF_HISTORY))
def history_nodes(spark, sf):
    return g.history_graph(_generated_nodes(spark, sf), lake.graph_edges(spark, sf), 12)[0].select("uid", "label", "name")


@query("g10_history_edges", with_tables(
    "SELECT src, dst, type, graph_key FROM edge WHERE src IN (SELECT uid FROM gen WHERE history_id = 12) AND dst IN (SELECT uid FROM gen WHERE history_id = 12)", GRAPH, _OF_HISTORY))
def history_edges(spark, sf):
    return g.history_graph(_generated_nodes(spark, sf), lake.graph_edges(spark, sf), 12)[1]


@query("g10_generation_graph", with_tables(
    """SELECT a.graph_key AS generation, e.type, count(*) AS edge_count FROM edge e JOIN node a ON e.src = a.uid JOIN node b ON e.dst = b.uid
    WHERE a.graph_key = b.graph_key GROUP BY ALL""", GRAPH))
def generation_graph(spark, sf):
    return g.same_generation(*_graph(spark, sf)).groupBy("generation", "type").agg(F.count(F.lit(1)).alias("edge_count"))


@query("g8_package_scope", with_tables(
    f"""{_TYPES}, sel AS (SELECT uid FROM itype WHERE package_name = 'com.europe.nation_3'),
    tl AS (SELECT DISTINCT src, dst, type FROM (SELECT src, dst, type FROM edge WHERE type IN {_DIRECT} UNION ALL SELECT src, dst, 'CALLS' FROM lifted)
           WHERE src <> dst AND src IN (SELECT uid FROM itype) AND dst IN (SELECT uid FROM itype)
             AND (src IN (SELECT uid FROM sel) OR dst IN (SELECT uid FROM sel))),
    st AS (SELECT DISTINCT src, dst, type FROM edge WHERE type = 'HAS_STATEMENT' AND src IN (SELECT uid FROM sel)),
    ac AS (SELECT DISTINCT o.owner AS src, e.dst, e.type FROM edge e JOIN own o ON e.src = o.member WHERE e.type IN ('READS_FROM', 'WRITES_TO') AND o.owner IN (SELECT uid FROM sel)),
    tt AS (SELECT DISTINCT src, dst, type FROM edge WHERE (src IN (SELECT uid FROM sel) OR src IN (SELECT dst FROM st)) AND dst IN (SELECT uid FROM node WHERE label = 'DatabaseTable'))
    SELECT * FROM tl UNION SELECT * FROM st UNION SELECT * FROM ac UNION SELECT * FROM tt""", GRAPH))
def package_scope(spark, sf):
    nodes, edges = _graph(spark, sf)
    return g.package_scope(nodes, edges, "com.europe.nation_3")


@query("c13_controller_rule", with_tables(
    f"""{_TYPES} SELECT uid, 'controller-must-not-call-repository' AS rule_id, CASE WHEN uid IN (SELECT src FROM lifted JOIN node r ON dst = r.uid WHERE r.layer = 'Repository')
    THEN 'VIOLATES' ELSE 'CONFORMS_TO' END AS type FROM itype WHERE layer = 'Controller'""", GRAPH))
def controller_rule(spark, sf):
    return g.controller_rule(*_graph(spark, sf))


@query("c14_service_rule", with_tables(
    f"""{_TYPES} SELECT uid, 'service-impl-must-implement-service' AS rule_id, CASE WHEN uid IN (SELECT src FROM edge JOIN node t ON dst = t.uid
    WHERE edge.type = 'EXTENDS' AND lower(t.name) LIKE '%service' AND t.package_name LIKE 'com.a%') THEN 'CONFORMS_TO' ELSE 'VIOLATES' END AS type FROM itype WHERE layer = 'ServiceImpl'""", GRAPH))
def service_rule(spark, sf):
    """Base types outside the regions starting with A lose their service name, so some types violate."""
    nodes, edges = _graph(spark, sf)
    renamed = nodes.withColumn("name", F.when(F.col("name").endswith("Service") & ~F.col("package_name").like("com.a%"), "Base").otherwise(F.col("name")))
    return g.service_rule(renamed, edges, implements="EXTENDS")


@query("j20_rule_evaluation", with_tables(
    f"""{_TYPES} SELECT uid AS src, unnest(['rule:p:naming', 'rule:x', 'rule:p:layering']) AS dst, unnest(['CONFORMS_TO', 'CONFORMS_TO', 'VIOLATES']) AS type FROM itype""", GRAPH))
def rule_evaluation(spark, sf):
    return g.rule_evaluations(lake.graph_nodes(spark, sf), ["naming", "rule:x", " "], [" layering"], "p")


_GONE = "gone AS (SELECT DISTINCT 'ship:' || year(l_shipdate) AS graph_key FROM lineitem WHERE year(l_shipdate) < 1999 UNION SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey < 2)"


@query("d8_graph_delete", with_tables(
    f"""{_GONE}, e1 AS (SELECT * FROM edge WHERE graph_key NOT IN (SELECT graph_key FROM gone)),
    n1 AS (SELECT * FROM node n WHERE label NOT IN ('JavaType', 'Method', 'DatabaseTable', 'SqlStatement') OR uid IN (SELECT src FROM e1 UNION SELECT dst FROM e1)),
    n2 AS (SELECT * FROM n1 WHERE label <> 'Package' OR uid IN (SELECT src FROM e1 WHERE type = 'CONTAINS' AND dst IN (SELECT uid FROM n1 WHERE label = 'JavaType')))
    SELECT uid, label FROM n2""", GRAPH))
def graph_delete(spark, sf):
    kept, _ = g.delete_graph(*_graph(spark, sf), _gone_keys(spark, sf), containment=(("Package", "JavaType"),))
    return kept.select("uid", "label")


def _gone_keys(spark, sf):
    ships = lake.raw(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y")).where("y < 1999").distinct().select(
        F.concat(F.lit("ship:"), F.col("y").cast("string")).alias("graph_key"))
    nations = lake.raw(spark, sf, "nation").where("n_regionkey < 2").select(
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("graph_key"))
    return ships.unionByName(nations)


_LEFT = f"""{_GONE}, e1 AS (SELECT DISTINCT src, dst, type, graph_key FROM edge WHERE graph_key NOT IN (SELECT graph_key FROM gone)
      AND src IN (SELECT uid FROM node) AND dst IN (SELECT uid FROM node)),
    n1 AS (SELECT * FROM node n WHERE label NOT IN ('JavaType', 'Method', 'DatabaseTable', 'SqlStatement') OR uid IN (SELECT src FROM e1 UNION SELECT dst FROM e1)),
    n2 AS (SELECT * FROM n1 WHERE label <> 'Package' OR uid IN (SELECT src FROM e1 WHERE type = 'CONTAINS' AND dst IN (SELECT uid FROM n1 WHERE label = 'JavaType')))"""


@query("d8_stored_delete", with_tables(
    f"""{_LEFT} SELECT 'node' AS kind, label AS name, count(*) AS n FROM n2 GROUP BY 2
    UNION ALL SELECT 'edge', type, count(*) FROM e1 WHERE src NOT IN (SELECT uid FROM n1 WHERE uid NOT IN (SELECT uid FROM n2))
      AND dst NOT IN (SELECT uid FROM n1 WHERE uid NOT IN (SELECT uid FROM n2)) GROUP BY 2""", GRAPH))
def stored_delete(spark, sf):
    """The same deletion from a stored graph: buckets of the keys are rewritten, orphans looked for among touched nodes."""
    store = _store(spark, *_graph(spark, sf))
    store.delete(_gone_keys(spark, sf), containment=(("Package", "JavaType"),))
    nodes = store.nodes().groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(store.edges().groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")))


@query("g6_orphan_cascade", with_tables(
    f"""{_LEFT.replace("AND src IN (SELECT uid FROM node) AND dst IN (SELECT uid FROM node)", "").replace("SELECT DISTINCT src, dst, type, graph_key", "SELECT *")}
    SELECT type, graph_key, count(*) AS edge_count FROM e1 WHERE src NOT IN (SELECT uid FROM n1 WHERE uid NOT IN (SELECT uid FROM n2))
    AND dst NOT IN (SELECT uid FROM n1 WHERE uid NOT IN (SELECT uid FROM n2)) GROUP BY ALL""", GRAPH))
def orphan_cascade(spark, sf):
    _, left = g.delete_graph(*_graph(spark, sf), _gone_keys(spark, sf), containment=(("Package", "JavaType"),))
    return left.groupBy("type", "graph_key").agg(F.count(F.lit(1)).alias("edge_count"))


_MANY = """und AS (SELECT DISTINCT src AS near, dst AS uid FROM edge WHERE type NOT IN ('CONTAINS', 'GENERATED', 'INGESTED')
        UNION SELECT DISTINCT dst, src FROM edge WHERE type NOT IN ('CONTAINS', 'GENERATED', 'INGESTED')),
ok AS (SELECT uid FROM node WHERE project_id = 'commerce'),
h0 AS (SELECT uid AS request, uid, 0 AS depth FROM node WHERE uid LIKE 'type:s:%' AND project_id = 'commerce'),
h1 AS (SELECT DISTINCT h.request, u.uid, 1 AS depth FROM h0 h JOIN und u ON u.near = h.uid SEMI JOIN ok ON u.uid = ok.uid WHERE u.uid <> h.request),
h2 AS (SELECT DISTINCT h.request, u.uid, 2 AS depth FROM h1 h JOIN und u ON u.near = h.uid SEMI JOIN ok ON u.uid = ok.uid
       ANTI JOIN h1 x ON x.request = h.request AND x.uid = u.uid WHERE u.uid <> h.request),
around AS (SELECT * FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) QUALIFY row_number() OVER (PARTITION BY request ORDER BY depth, uid) <= 50)"""


def _all_around(spark, sf):
    nodes, edges = _graph(spark, sf)
    asked = nodes.where(F.col("uid").startswith("type:s:")).select(F.col("uid").alias("request"), "uid")
    return tr.neighbourhoods(nodes, edges, asked, 2, "commerce", max_nodes=50), edges


@query("g1_many_neighbourhoods", with_tables(f"{_MANY} SELECT request, uid, depth FROM around", GRAPH))
def many_neighbourhoods(spark, sf):
    """The surroundings of every supplier type, each with its own limit, in one loop."""
    return _all_around(spark, sf)[0]


@query("g1_many_neighbourhood_edges", with_tables(
    f"""{_MANY} SELECT a.request, e.type, e.src, e.dst, e.graph_key FROM edge e JOIN around a ON e.src = a.uid SEMI JOIN around b ON b.request = a.request AND b.uid = e.dst
    QUALIFY row_number() OVER (PARTITION BY a.request ORDER BY e.type, e.src, e.dst, e.graph_key) <= 60""", GRAPH))
def many_neighbourhood_edges(spark, sf):
    visited, edges = _all_around(spark, sf)
    return tr.neighbourhoods_edges(edges, visited, 60)


_WALK = """seed AS (SELECT uid FROM node WHERE label = 'JavaType' AND name LIKE 'Base%' ORDER BY uid LIMIT 100),
und AS (SELECT DISTINCT src AS near, dst AS uid FROM edge WHERE type NOT IN ('CONTAINS', 'GENERATED', 'INGESTED')
        UNION SELECT DISTINCT dst, src FROM edge WHERE type NOT IN ('CONTAINS', 'GENERATED', 'INGESTED')),
ok AS (SELECT uid FROM node WHERE project_id = 'commerce'),
h0 AS (SELECT uid, 0 AS depth FROM seed SEMI JOIN ok USING (uid)),
h1 AS (SELECT DISTINCT u.uid, 1 AS depth FROM und u SEMI JOIN h0 ON u.near = h0.uid SEMI JOIN ok ON u.uid = ok.uid ANTI JOIN h0 ON u.uid = h0.uid),
h2 AS (SELECT DISTINCT u.uid, 2 AS depth FROM und u SEMI JOIN h1 ON u.near = h1.uid SEMI JOIN ok ON u.uid = ok.uid ANTI JOIN h0 ON u.uid = h0.uid ANTI JOIN h1 ON u.uid = h1.uid)"""


@query("g1_neighbourhood", with_tables(
    f"{_WALK} SELECT uid, depth FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) ORDER BY depth, uid LIMIT 600", GRAPH))
def neighbourhood(spark, sf):
    nodes, edges = _graph(spark, sf)
    seeds = nodes.where((F.col("label") == "JavaType") & F.col("name").like("Base%")).select("uid")
    return tr.neighbourhood(nodes, edges, seeds, depth=2, project="commerce")


@query("g1_neighbourhood_edges", with_tables(
    f"""{_WALK}, near AS (SELECT uid FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) ORDER BY depth, uid LIMIT 600)
    SELECT type, src, dst, graph_key FROM edge WHERE src IN (SELECT uid FROM near) AND dst IN (SELECT uid FROM near)
    ORDER BY type, src, dst, graph_key LIMIT 5000""", GRAPH))
def neighbourhood_edges(spark, sf):
    nodes, edges = _graph(spark, sf)
    return tr.neighbourhood_edges(edges, neighbourhood(spark, sf))


_FLOW = f"""{_TYPES}, staged AS (SELECT uid, label, external, layer, CASE WHEN label = 'DatabaseTable' THEN 3 WHEN layer IN ('Repository', 'Mapper') THEN 2
    WHEN layer IN ('Service', 'ServiceImpl') THEN 1 WHEN layer = 'Controller' THEN 0 END AS stage FROM node),
flow AS (SELECT e.src, e.dst, replace(types, ',', ', ') AS types FROM (FROM tedge UNION ALL FROM dedge) e JOIN staged a ON e.src = a.uid JOIN staged b ON e.dst = b.uid
         WHERE a.stage <= b.stage AND e.src <> e.dst),
reach AS (SELECT uid FROM staged WHERE stage = 0 AND NOT external UNION SELECT flow.dst FROM reach JOIN flow ON flow.src = reach.uid)"""


@query("g3_layer_flow_nodes", with_tables(f"{_FLOW} SELECT uid, stage FROM staged SEMI JOIN reach USING (uid)", GRAPH, recursive=True))
def layer_flow_nodes(spark, sf):
    kept, _ = tr.layer_flow(*_graph(spark, sf))
    return kept.select("uid", "stage")


@query("a21_layer_counts", with_tables(
    f"{_FLOW} SELECT stage, count(*) AS node_count FROM staged SEMI JOIN reach USING (uid) GROUP BY 1", GRAPH, recursive=True))
def layer_counts(spark, sf):
    """Nodes that the flow keeps, by stage."""
    kept, _ = tr.layer_flow(*_graph(spark, sf))
    return kept.groupBy("stage").agg(F.count(F.lit(1)).alias("node_count"))


@query("g3_layer_flow_edges", with_tables(
    f"{_FLOW} SELECT * FROM flow WHERE src IN (SELECT uid FROM reach) AND dst IN (SELECT uid FROM reach)", GRAPH, recursive=True))
def layer_flow_edges(spark, sf):
    return tr.layer_flow(*_graph(spark, sf))[1]


def _package_pairs(spark, sf):
    """Package dependencies with enough calls behind them (customer's nation to supplier's nation)."""
    li = lake.raw(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = lake.raw(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = lake.raw(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = lake.raw(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    by_customer = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    pairs = (by_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
             .groupBy("src", "dst").agg(F.sum("n").alias("n")))
    bound = li.agg(F.count(F.lit(1)) / 400).scalar()
    kept = pairs.where((F.col("src") != F.col("dst")) & (F.col("n") >= bound))
    name = lake.raw(spark, sf, "nation").select("n_nationkey", "n_name")
    named = kept.join(name.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("src_name")), "src").join(
        name.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("dst_name")), "dst")
    return cut(named.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")))


_PAIRS = """pair AS (SELECT a.n_name AS src, b.n_name AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
    WHERE a.n_name <> b.n_name GROUP BY 1, 2 HAVING count(*) >= (SELECT count(*) / 400 FROM lineitem)),
reach AS (SELECT src, dst FROM pair UNION SELECT reach.src, pair.dst FROM reach JOIN pair ON reach.dst = pair.src),
grp AS (SELECT a.src AS member, min(a.dst) AS component, count(*) AS size FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1 HAVING count(*) > 1)"""


@query("g4_package_cycles", with_tables("SELECT component, member, size FROM grp", _PAIRS, recursive=True))
def package_cycles(spark, sf):
    return tr.strongly_connected(_package_pairs(spark, sf))


@query("g5_cycle_paths", with_tables(
    """inside AS (SELECT p.src, p.dst, a.component FROM pair p JOIN grp a ON p.src = a.member JOIN grp b ON p.dst = b.member AND a.component = b.component),
    walk AS (SELECT component, component AS node, [component] AS path FROM (SELECT DISTINCT component FROM grp)
             UNION ALL SELECT w.component, i.dst, list_append(w.path, i.dst) FROM walk w JOIN inside i ON w.component = i.component AND w.node = i.src
             WHERE (len(w.path) = 1 OR w.node <> w.component) AND len(w.path) < 5 AND (i.dst = w.component OR NOT list_contains(w.path, i.dst)))
    SELECT component, array_to_string(path, ' > ') AS path FROM walk WHERE len(path) > 1 AND node = component
    QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(path), path) = 1""", _PAIRS, recursive=True))
def cycle_paths(spark, sf):
    pairs = _package_pairs(spark, sf)
    members = cut(tr.strongly_connected(pairs))
    return tr.cycle_paths(pairs, members).select("component", F.array_join("path", " > ").alias("path"))
