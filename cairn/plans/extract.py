"""Extraction queries over code, SQL, XML, YAML and Markdown texts written from the tables."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions import code, files, ids, sqltext
from cairn.functions import text as tx
from cairn.operators import chunking as ch
from cairn.operators import extract as x
from cairn.plans.registry import query
from cairn.sources import lake


def _s(column):
    return F.col(column).cast("string")


# --- method bodies -------------------------------------------------------------------------------------

def bodies(spark, sf):
    """One method body per order; its status decides the shape, its key and priority the literals."""
    o = lake.texts(spark, sf, "orders")
    long_body = F.concat(
        F.lit("{ // if while && \n if (total > 10 && open) { for (Item item : items) { while (item.next()) { save(item); } } } return total + "),
        _s("o_orderkey"), F.lit("; }"))
    short_body = F.concat(F.lit('{ String name = "a  && '), F.col("o_orderpriority"), F.lit('"; return name; }'))
    switch_body = F.concat(
        F.lit("{ switch (kind) { case "), _s("o_custkey"), F.lit(': if (ready || late) { run(); } break; default: throw new Failure("no"); } }'))
    status = F.col("o_orderstatus")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                    F.when(status == "O", long_body).when(status == "F", short_body).otherwise(switch_body).alias("body"))


@query("c1_normal_form_hash", """
    SELECT o_orderkey, sha256(CASE o_orderstatus WHEN 'O' THEN '{if(total>10&&open){for(Itemitem:items){while(item.next()){save(item);}}}returntotal+' || o_orderkey || ';}'
      WHEN 'F' THEN '{Stringname="a  && ' || o_orderpriority || '";returnname;}'
      ELSE '{switch(kind){case' || o_custkey || ':if(ready||late){run();}break;default:thrownewFailure("no");}}' END) AS method_hash FROM orders""")
def normal_form_hash(spark, sf):
    return bodies(spark, sf).select("o_orderkey", code.method_hash(F.col("body")).alias("method_hash"))


@query("c1_compact_documents", """
    SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all(text, '("[^"]*(?:"|\\z)|''[^'']*(?:''|\\z)|[^"'']+)', 1),
      lambda p: CASE WHEN p LIKE '"%' OR p LIKE '''%' THEN p ELSE regexp_replace(p, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') END), '')) AS hash
    FROM (SELECT doc_id, replace(text, chr(92), '/') AS text FROM documents)""")
def compact_documents(spark, sf):
    """The same normal form over whole documents, quotes and all."""
    text = F.replace("text", F.lit("\\"), F.lit("/"))
    return lake.raw(spark, sf, "documents").select("doc_id", F.sha2(code.compact(text), 256).alias("hash"))


@query("c2_structural_hash", """
    SELECT sha256(CASE o_orderstatus WHEN 'O' THEN '{if($variable>$literal&&open){for(Item$variable:$variable){while($variable.next()){save($variable);}}}return$variable+$literal;}'
      WHEN 'F' THEN '{String$variable=$literal;return$variable;}'
      ELSE '{switch(kind){case$literal:if(ready||late){run();}break;default:thrownewFailure($literal);}}' END) AS structural_hash, count(*) AS methods FROM orders GROUP BY 1""")
def structural_hash(spark, sf):
    hashed = code.structural_hash(F.col("body"), F.array(F.lit("total"), F.lit("items")))
    return bodies(spark, sf).select(hashed.alias("structural_hash")).groupBy("structural_hash").agg(F.count(F.lit(1)).alias("methods"))


@query("c3_counters", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS logical, CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS returns,
    CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS throws, CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS calls,
    CASE o_orderstatus WHEN 'O' THEN 2 ELSE 1 END AS lines FROM orders""")
def counters(spark, sf):
    return bodies(spark, sf).select("o_orderkey", code.counters(F.col("body")).alias("c")).select("o_orderkey", "c.*")


@query("c4_complexity", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 3 END AS branches, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 5 END AS cyclomatic,
    CASE o_orderstatus WHEN 'O' THEN 7 WHEN 'P' THEN 8 ELSE 0 END AS cognitive, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 3 END AS nesting FROM orders""")
def complexity(spark, sf):
    return bodies(spark, sf).select("o_orderkey", code.complexity(F.col("body")).alias("c")).select("o_orderkey", "c.*")


# --- types, names and calls ----------------------------------------------------------------------------

_SUFFIX = {"AUTOMOBILE": "Controller", "BUILDING": "Service", "FURNITURE": "ServiceImpl", "HOUSEHOLD": "Request"}
_TYPE_SQL = """t AS (SELECT c_custkey, 'C' || c_custkey || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Controller' WHEN 'BUILDING' THEN 'Service'
    WHEN 'FURNITURE' THEN 'ServiceImpl' WHEN 'HOUSEHOLD' THEN 'Request' ELSE '' END AS simple_name, 'com.acme.' || lower(c_mktsegment) AS package_name,
    c_acctbal FROM customer)"""


def _types(spark, sf):
    c = lake.raw(spark, sf, "customer")
    suffix = F.lit("")
    for segment, name in _SUFFIX.items():
        suffix = F.when(F.col("c_mktsegment") == segment, name).otherwise(suffix)
    named = c.select("c_custkey", "c_acctbal", F.concat(F.lit("C"), _s("c_custkey"), suffix).alias("simple_name"),
                     F.concat(F.lit("com.acme."), F.lower("c_mktsegment")).alias("package_name"))
    return named.withColumns({
        "project_id": F.lit("p"), "module_name": F.lit("main"),
        "type_uid": F.concat(F.lit("type:p:"), "package_name", F.lit("."), "simple_name"),
        "file_path": F.concat(F.lit("src/./main//x/../"), "simple_name", F.lit(".java"))})


@query("p15_layer", f"""WITH {_TYPE_SQL} SELECT c_custkey, CASE WHEN simple_name LIKE '%Controller' THEN 'Controller' WHEN simple_name LIKE '%ServiceImpl' THEN 'ServiceImpl'
    WHEN simple_name LIKE '%Service' THEN 'Service' WHEN c_acctbal < 0 THEN 'Repository' WHEN simple_name LIKE '%Request' THEN 'DTO' ELSE 'Domain' END AS layer FROM t""")
def layer(spark, sf):
    tags = F.when(F.col("c_acctbal") < 0, F.array(F.lit("REPOSITORY"), F.lit("x")))
    return _types(spark, sf).select("c_custkey", code.layer(F.col("simple_name"), tags).alias("layer"))


@query("c5_structure_edges", f"""WITH {_TYPE_SQL}, e AS (
    SELECT 'project:p' AS src, 'module:p:main' AS dst, 'CONTAINS' AS type FROM t UNION SELECT 'module:p:main', 'package:p:' || package_name, 'CONTAINS' FROM t
    UNION SELECT 'package:p:' || package_name, 'file:p:src/main/' || simple_name || '.java', 'CONTAINS' FROM t
    UNION SELECT 'file:p:src/main/' || simple_name || '.java', 'type:p:' || package_name || '.' || simple_name, 'DECLARES' FROM t) SELECT * FROM e""")
def structure_edges(spark, sf):
    return x.structure_edges(_types(spark, sf))


@query("c5_evidence_edges", f"""WITH {_TYPE_SQL} SELECT 'doc:' || c_custkey || ':chunk:' || i AS src, 'type:p:' || package_name || '.' || simple_name AS dst, kind AS type
    FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest(['DESCRIBES', 'EVIDENCE_FOR']) AS kind) WHERE c_acctbal >= 0""")
def evidence_edges(spark, sf):
    """Chunks that a type was read from; types of negative balance have none."""
    chunk = F.concat(F.lit("doc:"), _s("c_custkey"), F.lit(":chunk:"))
    chunks = F.when(F.col("c_acctbal") >= 0, F.array(F.concat(chunk, F.lit("0")), F.concat(chunk, F.lit("1")), F.lit(" "), F.concat(chunk, F.lit("0"))))
    return x.evidence_edges(_types(spark, sf).select(F.col("type_uid").alias("uid"), chunks.alias("evidence_chunk_ids")))


@query("c5_member_edges", """SELECT DISTINCT 'T' || l_orderkey AS src, 'm' || l_partkey AS dst, 'HAS_METHOD' AS type FROM lineitem
    UNION SELECT 'T' || l_orderkey, 'f' || l_suppkey, 'HAS_FIELD' FROM lineitem""")
def member_edges(spark, sf):
    li = lake.raw(spark, sf, "lineitem")
    owner = F.concat(F.lit("T"), _s("l_orderkey")).alias("type_uid")
    return x.member_edges(li.select(owner, F.concat(F.lit("m"), _s("l_partkey")).alias("method_uid")),
                          li.select(owner, F.concat(F.lit("f"), _s("l_suppkey")).alias("field_uid")))


def _references(spark, sf):
    li = lake.raw(spark, sf, "lineitem")
    name = (F.when(F.col("l_returnflag") == "A", F.concat(F.lit("S"), _s("l_suppkey"), F.lit("Dto")))
            .when(F.col("l_returnflag") == "R", "java.util.List").when(F.col("l_linestatus") == "O", "String")
            .otherwise(F.concat(F.lit("P"), _s("l_partkey"))))
    return li.select(
        F.concat(F.lit("T"), _s("l_orderkey"), F.lit(".java")).alias("file_path"), F.lit("p").alias("project_id"),
        F.concat(F.lit("type:p:com.acme.T"), _s("l_orderkey")).alias("type_uid"), F.lit("com.acme").alias("package_name"),
        name.alias("ref_name"), F.when(F.col("l_linenumber") <= 4, "USES").otherwise("INJECTS").alias("kind"))


def _imports(spark, sf):
    li = lake.raw(spark, sf, "lineitem")
    simple = F.concat(F.when(F.col("l_linestatus") == "O", "S").otherwise("Other"), _s("l_suppkey"), F.lit("Dto"))
    return li.select(F.concat(F.lit("T"), _s("l_orderkey"), F.lit(".java")).alias("file_path"), simple.alias("simple_name"),
                     F.concat(F.lit("org.dto."), simple).alias("fqn"))


_REF_SQL = """imp AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'),
ref AS (SELECT l.l_orderkey, CASE WHEN l_linenumber <= 4 THEN 'USES' ELSE 'INJECTS' END AS kind, l_returnflag, l_linestatus,
  CASE WHEN l_returnflag = 'A' AND i.l_suppkey IS NOT NULL THEN 'org.dto.S' || l.l_suppkey || 'Dto' WHEN l_returnflag = 'A' THEN 'com.acme.S' || l.l_suppkey || 'Dto'
       WHEN l_returnflag = 'R' THEN 'java.util.List' WHEN l_linestatus = 'O' THEN 'com.acme.String' ELSE 'com.acme.P' || l_partkey END AS fqn
  FROM lineitem l LEFT JOIN imp i ON l.l_orderkey = i.l_orderkey AND l.l_suppkey = i.l_suppkey)"""


@query("j16_name_resolution", f"WITH {_REF_SQL} SELECT 'T' || l_orderkey || '.java' AS file_path, fqn, count(*) AS uses FROM ref GROUP BY ALL")
def name_resolution(spark, sf):
    return x.resolve_names(_references(spark, sf), _imports(spark, sf)).groupBy("file_path", "fqn").agg(F.count(F.lit(1)).alias("uses"))


@query("p17_skip_types", f"WITH {_REF_SQL} SELECT fqn LIKE 'java.%' AS skipped, fqn LIKE '%.String' AS common, count(*) AS n FROM ref GROUP BY ALL")
def skip_types(spark, sf):
    r = x.resolve_names(_references(spark, sf), _imports(spark, sf))
    return r.groupBy(code.skipped_fqn(F.col("fqn")).alias("skipped"), F.col("ref_name").isin(*code.COMMON_TYPES).alias("common")).agg(F.count(F.lit(1)).alias("n"))


@query("c6_type_relationships", f"""WITH {_REF_SQL}, e AS (SELECT DISTINCT 'type:p:com.acme.T' || l_orderkey AS src, 'type:p:' || fqn AS dst, kind AS type FROM ref
      WHERE fqn NOT LIKE 'java.%' AND fqn NOT LIKE '%.String')
    SELECT * FROM e UNION ALL SELECT src, dst, 'USES_DTO' FROM e WHERE type = 'USES' AND dst LIKE '%Dto'""")
def type_relationships(spark, sf):
    return x.type_relationships(_references(spark, sf), _imports(spark, sf))


def _declared(spark, sf):
    li = lake.raw(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("T"), _s("l_orderkey")).alias("type_uid"), F.concat(F.lit("m"), F.col("l_returnflag")).alias("name"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("arity"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ordinal"),
        F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), _s("l_suppkey")).alias("method_uid"))


@query("j14_local_calls", """WITH m AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS uid FROM lineitem),
    f AS (SELECT *, first_value(uid) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS target FROM m)
    SELECT DISTINCT uid AS src, target AS dst, 'CALLS' AS type FROM f WHERE uid <> target""")
def local_calls(spark, sf):
    m = _declared(spark, sf)
    return x.local_calls(m.select("type_uid", "name", "arity", "method_uid"), m)


@query("j15_scoped_calls", """WITH f AS (SELECT l_orderkey, l_linenumber, 'com.acme.S' || min(l_suppkey) || 'Repository' AS fqn FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
    SELECT DISTINCT 'm' || l_orderkey AS src, 'method:p:' || fqn || ':call' || l_linenumber || '(Long,String,P' || l_partkey || ',?)' AS dst, fqn AS target_fqn
    FROM lineitem JOIN f USING (l_orderkey, l_linenumber)""")
def scoped_calls(spark, sf):
    li = lake.raw(spark, sf, "lineitem")
    owner = F.concat(F.lit("T"), _s("l_orderkey")).alias("type_uid")
    fields = li.where("l_linestatus = 'O'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s")).select(
        owner, F.concat(F.lit("f"), _s("l_linenumber")).alias("name"), F.concat(F.lit("com.acme.S"), _s("s"), F.lit("Repository")).alias("fqn"))

    def arg(kind, text):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    calls = li.select(
        owner, F.concat(F.lit("m"), _s("l_orderkey")).alias("method_uid"), F.lit("p").alias("project_id"),
        F.concat(F.lit("this.f"), _s("l_linenumber")).alias("scope"), F.concat(F.lit("call"), _s("l_linenumber")).alias("name"),
        F.array(arg("name", F.lit("p")), arg("string", F.lit("x")), arg("new", F.concat(F.lit("com.x.P"), _s("l_partkey"))), arg("name", F.lit("q"))).alias("args"),
        F.create_map(F.lit("p"), F.lit("Long")).alias("parameters"))
    return x.scoped_calls(calls, fields).select("src", "dst", "target_fqn")


@query("j17_signature_mappings", """SELECT DISTINCT 'type:p:com.acme.' || d AS src, 'type:p:com.acme.' || m AS dst, 'MAPS_TO' AS type
    FROM (SELECT o_orderkey, unnest(['C' || o_custkey || 'Dto', 'C' || o_custkey || 'Request']) AS d FROM orders WHERE o_orderstatus <> 'F') JOIN
         (SELECT o_orderkey, unnest(['Order' || o_orderkey, 'Clerk']) AS m FROM orders WHERE o_orderstatus <> 'F') USING (o_orderkey)""")
def signature_mappings(spark, sf):
    def fqn(*parts):
        return F.concat(F.lit("com.acme."), *parts)

    cust = _s("o_custkey")
    domains = F.when(F.col("o_orderstatus") == "F", F.array(fqn(F.lit("X"), F.lit("Service")))).otherwise(
        F.array(fqn(F.lit("Order"), _s("o_orderkey")), fqn(F.lit("Clerk")), fqn(F.lit("Clerk"))))
    rows = lake.raw(spark, sf, "orders").select(
        F.lit("p").alias("project_id"),
        F.concat(F.array(fqn(F.lit("C"), cust, F.lit("Dto")), fqn(F.lit("C"), cust, F.lit("Request"))), domains).alias("type_fqns"))
    return x.signature_mappings(rows)


@query("c7_endpoints", """SELECT 'endpoint:p:' || v || ':/orders/{id}/' || o_custkey AS src, 'm' || o_orderkey AS dst, v AS http_method, '/orders/{id}/' || o_custkey AS path
    FROM (SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 'GET' WHEN '2' THEN 'POST' WHEN '3' THEN 'PUT' WHEN '4' THEN 'REQUEST' END AS v FROM orders) WHERE v IS NOT NULL""")
def endpoints(spark, sf):
    digit = F.substring("o_orderpriority", 1, 1)
    name = (F.when(digit == "1", "GetMapping").when(digit == "2", "PostMapping").when(digit.isin("3", "4"), "RequestMapping").otherwise("Autowired"))
    text = F.concat(F.lit('@X("/{id}/'), _s("o_custkey"), F.lit('/"'), F.when(digit == "3", ", method = RequestMethod.PUT").otherwise(""), F.lit(")"))
    methods = lake.raw(spark, sf, "orders").select(
        F.lit("p").alias("project_id"), F.concat(F.lit("m"), _s("o_orderkey")).alias("method_uid"), name.alias("annotation_name"),
        text.alias("annotation_text"), F.lit('@RequestMapping("/orders/")').alias("class_annotation"))
    return x.endpoints(methods).select("src", "dst", "http_method", "path")


@query("f9_names", """SELECT id, simple, ext, symbol FROM (SELECT doc_id AS id, 'Doc' || doc_id AS simple, '.java' AS ext, 'Doc' || doc_id AS symbol FROM documents)""")
def names(spark, sf):
    d = lake.raw(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("com.acme.Doc"), _s("doc_id")).alias("fqn"),
                                               F.concat(F.lit("Doc"), _s("doc_id"), F.lit(".JAVA")).alias("file"))
    return d.select("id", code.simple_name(F.col("fqn")).alias("simple"), files.suffix(F.col("file")).alias("ext"), files.symbol(F.col("file")).alias("symbol"))


@query("f11_method_signature", "SELECT l_orderkey, l_linenumber, l_partkey, 'm' || l_linenumber || '(List<P' || l_partkey || '>,int,String...)' AS signature FROM lineitem")
def method_signature(spark, sf):
    types = F.array(F.concat(F.lit("List< P"), _s("l_partkey"), F.lit(" >")), F.lit("int"), F.lit("String..."))
    return lake.raw(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", code.signature(F.concat(F.lit("m"), _s("l_linenumber")), types).alias("signature"))


# --- SQL, XML, YAML, Markdown --------------------------------------------------------------------------

def _statements(spark, sf):
    o = lake.texts(spark, sf, "orders")
    table = F.concat(F.lit("app.orders_"), F.substring("o_orderpriority", 1, 1))
    select = F.concat(F.lit("SELECT o.id, o.total AS amount\n FROM "), table, F.lit(" o JOIN customer_"), _s("o_custkey"), F.lit(" c ON c.id = o.cust WHERE (o.id = #{id})"))
    insert = F.concat(F.lit("insert into "), table, F.lit("(id, total, `state`) values (#{id}, #{total}, 1)"))
    update = F.concat(F.lit("UPDATE "), table, F.lit(" SET total = #{total}, state_"), _s("o_custkey"), F.lit(" = 'x' WHERE id = #{id}"))
    status = F.col("o_orderstatus")
    return o.select(
        "o_orderkey", F.lit("p").alias("project_id"), F.concat(F.lit("statement:"), _s("o_orderkey")).alias("statement_uid"),
        F.concat(F.lit("mapper:"), _s("o_custkey")).alias("mapper_uid"),
        F.when(status == "O", "READ").otherwise("WRITE").alias("operation"),
        F.when(status == "O", select).when(status == "F", insert).otherwise(update).alias("sql"))


_TABLE = "'table:p:app:orders_' || left(o_orderpriority, 1)"


@query("c8_table_lineage", f"""SELECT 'statement:' || o_orderkey AS src, {_TABLE} AS dst, CASE o_orderstatus WHEN 'O' THEN 'READS_FROM' ELSE 'WRITES_TO' END AS type FROM orders
    UNION ALL SELECT 'statement:' || o_orderkey, 'table:p:public:customer_' || o_custkey, 'READS_FROM' FROM orders WHERE o_orderstatus = 'O'
    UNION SELECT 'mapper:' || o_custkey, {_TABLE}, 'MAPS_TO' FROM orders
    UNION SELECT 'mapper:' || o_custkey, 'table:p:public:customer_' || o_custkey, 'MAPS_TO' FROM orders WHERE o_orderstatus = 'O'""")
def table_lineage(spark, sf):
    """Statements of a customer's orders are one mapper's."""
    return x.table_lineage(_statements(spark, sf))


@query("c9_column_lineage", """WITH st AS (SELECT *, 'app:orders_' || left(o_orderpriority, 1) AS tbl FROM orders),
    tc AS (SELECT o_orderkey, tbl, unnest(CASE o_orderstatus WHEN 'O' THEN ['id', 'total'] WHEN 'F' THEN ['id', 'total', 'state'] ELSE ['total', 'state_' || o_custkey] END) AS col FROM st
           UNION ALL SELECT o_orderkey, 'public:customer_' || o_custkey, unnest(['id', 'total']) FROM st WHERE o_orderstatus = 'O')
    SELECT DISTINCT 'table:p:' || tbl AS src, 'column:p:' || tbl || ':' || col AS dst, 'HAS_COLUMN' AS type FROM tc
    UNION SELECT 'statement:' || o_orderkey, 'column:p:' || tbl || ':' || col, 'REFERENCES_COLUMN' FROM tc""")
def column_lineage(spark, sf):
    return x.column_lineage(_statements(spark, sf))


@query("f19_normalized_sql", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'SELECT o.id, o.total AS amount FROM app.orders_' || left(o_orderpriority, 1) || ' o JOIN customer_' || o_custkey || ' c ON c.id = o.cust WHERE (o.id = #{id})'
    WHEN 'F' THEN 'insert into app.orders_' || left(o_orderpriority, 1) || '(id, total, `state`) values (#{id}, #{total}, 1)'
    ELSE 'UPDATE app.orders_' || left(o_orderpriority, 1) || ' SET total = #{total}, state_' || o_custkey || ' = ''x'' WHERE id = #{id}' END AS sql FROM orders""")
def normalized_sql(spark, sf):
    padded = F.concat(F.lit("\t "), F.col("sql"), F.lit(" \n"))
    return _statements(spark, sf).select("o_orderkey", sqltext.normalize(padded).alias("sql"))


@query("c8_mapper_identifiers", """SELECT 'statement:' || o_orderkey AS statement_uid, CASE o_orderstatus WHEN 'O' THEN 'app.orders_' || left(o_orderpriority, 1) || ',customer_' || o_custkey
    ELSE 'app.orders_' || left(o_orderpriority, 1) END AS tables,
    CASE o_orderstatus WHEN 'O' THEN 'o,id,total,amount,c,cust' WHEN 'F' THEN 'id,total,state' ELSE 'total,state_' || o_custkey || ',x,id' END AS columns FROM orders""")
def mapper_identifiers(spark, sf):
    tables = sqltext.mapper_tables(F.col("sql"))
    return _statements(spark, sf).select(
        "statement_uid", F.array_join(tables, ",").alias("tables"), F.array_join(sqltext.mapper_columns(F.col("sql"), tables), ",").alias("columns"))


def _mapper_files(spark, sf):
    key, cust = _s("o_orderkey"), _s("o_custkey")
    xml = F.concat(
        F.lit('<?xml version="1.0"?>\n<!DOCTYPE mapper PUBLIC "a" "b">\n<mapper namespace="com.acme.O'), key, F.lit('Mapper">\n<select id="find'), key,
        F.lit('" resultType="R">\nSELECT id FROM app.orders <where><if test="cust != null">AND cust &lt; '), cust,
        F.lit('</if></where>\n</select>\n<!-- <update id="no">x</update> -->\n<update id="touch">UPDATE app.orders SET total = 1</update>\n'),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), F.concat(
            F.lit('<sql id="cols">${a}.id, <include refid="more"><property name="b" value="note"/></include></sql><sql id="more">${a}.${b}_'), cust,
            F.lit('<include refid="cols"/></sql>\n<select id="open">SELECT <include refid="com.acme.O'), key,
            F.lit('Mapper.cols"><property value="o" name="a"/></include> FROM app.orders o <include refid="gone"/><if test="x">WHERE o.id = 1</if></select>\n'))).otherwise(""),
        F.lit('</mapper>'))
    return lake.texts(spark, sf, "orders").select("o_orderkey", F.lit("p").alias("project_id"), F.concat(F.lit("doc:"), key).alias("source_key"),
                                               F.concat(F.lit("m/O"), key, F.lit(".xml")).alias("file_path"), xml.alias("content"))


@query("c10_mapper_statements", """SELECT 'com.acme.O' || o_orderkey || 'Mapper' AS namespace, 'find' || o_orderkey AS statement_id, 'SELECT' AS command, 'READ' AS operation,
    'SELECT id FROM app.orders AND cust < ' || o_custkey AS sql, 'cust != null' AS conditions FROM orders
    UNION ALL SELECT 'com.acme.O' || o_orderkey || 'Mapper', 'touch', 'UPDATE', 'WRITE', 'UPDATE app.orders SET total = 1', '' FROM orders
    UNION ALL SELECT 'com.acme.O' || o_orderkey || 'Mapper', 'open', 'SELECT', 'READ', 'SELECT o.id, o.note_' || o_custkey
      || ' /* CYCLIC INCLUDE cols */ FROM app.orders o /* UNRESOLVED INCLUDE gone */ WHERE o.id = 1', 'cyclic-include:cols;unresolved-include:gone;x' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""")
def mapper_statements(spark, sf):
    return x.mapper_statements(_mapper_files(spark, sf)).select(
        "namespace", "statement_id", "command", "operation", "sql", F.array_join("conditions", ";").alias("conditions"))


@query("c16_statement_chunks", """SELECT 'doc:' || o_orderkey || ':statement:find' || o_orderkey AS chunk_id, 'com.acme.O' || o_orderkey || 'Mapper.find' || o_orderkey AS symbol,
    'MyBatis Mapper: com.acme.O' || o_orderkey || 'Mapper' || chr(10) || 'Statement: find' || o_orderkey || chr(10) || 'Command: SELECT' || chr(10) || 'SQL Template:' || chr(10)
    || 'SELECT id FROM app.orders AND cust < ' || o_custkey || chr(10) || 'Dynamic Conditions:' || chr(10) || '- cust != null' AS content FROM orders
    UNION ALL SELECT 'doc:' || o_orderkey || ':statement:touch', 'com.acme.O' || o_orderkey || 'Mapper.touch', 'MyBatis Mapper: com.acme.O' || o_orderkey || 'Mapper' || chr(10)
    || 'Statement: touch' || chr(10) || 'Command: UPDATE' || chr(10) || 'SQL Template:' || chr(10) || 'UPDATE app.orders SET total = 1' FROM orders
    UNION ALL SELECT 'doc:' || o_orderkey || ':statement:open', 'com.acme.O' || o_orderkey || 'Mapper.open', 'MyBatis Mapper: com.acme.O' || o_orderkey || 'Mapper' || chr(10)
    || 'Statement: open' || chr(10) || 'Command: SELECT' || chr(10) || 'SQL Template:' || chr(10) || 'SELECT o.id, o.note_' || o_custkey || ' /* CYCLIC INCLUDE cols */ FROM app.orders o /* UNRESOLVED INCLUDE gone */ WHERE o.id = 1'
    || chr(10) || 'Dynamic Conditions:' || chr(10) || '- cyclic-include:cols' || chr(10) || '- unresolved-include:gone' || chr(10) || '- x' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""")
def statement_chunks(spark, sf):
    return statement_chunk_rows(spark, sf).select("chunk_id", "symbol", "content")


def statement_chunk_rows(spark, sf):
    return ch.statement_chunks(x.mapper_statements(_mapper_files(spark, sf)).withColumn("variants", F.array("sql")))


@query("c15_method_chunks", """SELECT 'doc:' || o_custkey || ':java-method:' || sha256(u) AS chunk_id, 'com.acme.C' || o_custkey || '.order' || o_orderkey || '()' AS symbol,
    u || '|type:p:com.acme.C' || o_custkey || '|file:p:src/C' || o_custkey || '.java' AS entities, 'Java Method: com.acme.C' || o_custkey || '.order' || o_orderkey || '()' || chr(10) || '{ return ' || o_orderkey || '; }' AS content
    FROM (SELECT *, 'method:p:com.acme.C' || o_custkey || ':order' || o_orderkey || '()' AS u FROM orders)""")
def method_chunks(spark, sf):
    return method_chunk_rows(spark, sf).select("chunk_id", "symbol", F.array_join("entity_ids", "|").alias("entities"), "content")


def method_chunk_rows(spark, sf):
    key, cust = _s("o_orderkey"), _s("o_custkey")
    m = lake.raw(spark, sf, "orders").select(
        F.concat(F.lit("doc:"), cust).alias("source_key"), F.lit("p").alias("project_id"), F.concat(F.lit("src/C"), cust, F.lit(".java")).alias("file_path"),
        F.concat(F.lit("com.acme.C"), cust).alias("declaring_type"), F.concat(F.lit("order"), key, F.lit("()")).alias("signature"),
        F.lit("main").alias("module_name"), F.concat(F.lit("{ return "), key, F.lit("; }")).alias("method_body"))
    m = m.withColumn("method_uid", ids.uid("method", F.col("project_id"), F.col("declaring_type"), F.col("signature")))
    return ch.method_chunks(m)


def _yaml(spark, sf):
    c = lake.texts(spark, sf, "customer")
    text = F.concat(
        F.lit("# head\nspring:\n  profiles:\n    active: [local, '"), F.lower("c_mktsegment"), F.lit("']\n  datasource:\n    password: \"p"), _s("c_custkey"),
        F.lit("\"\nai:\n  provider: ${P:Acme"), _s("c_nationkey"), F.lit("}\nbeans:\n  pay"), _s("c_custkey"), F.lit(":\n    url: 'http://x' # note\n- skip: 1\nname: "), F.col("c_name"))
    return c.select("c_custkey", text.alias("content"))


@query("c11_yaml_properties", """SELECT c_custkey, unnest(['spring.profiles.active', 'spring.datasource.password', 'ai.provider', 'beans.pay' || c_custkey || '.url', 'name']) AS key,
    unnest(['[local, ''' || lower(c_mktsegment) || ''']', '[REDACTED]', '${P:Acme' || c_nationkey || '}', 'http://x', c_name]) AS value FROM customer""")
def yaml_properties(spark, sf):
    p = x.yaml_properties(_yaml(spark, sf))
    return p.select("c_custkey", "key", tx.redact_config(F.col("key"), F.col("value")).alias("value"))


@query("c11_yaml_entities", """SELECT c_custkey, unnest(['Profile', 'Profile', 'Provider', 'Bean']) AS kind, unnest(['local', lower(c_mktsegment), 'Acme' || c_nationkey, 'pay' || c_custkey]) AS name FROM customer""")
def yaml_entities(spark, sf):
    return x.yaml_entities(x.yaml_properties(_yaml(spark, sf)))


def _uuid_sql(value):
    return (f"(substr(md5({value}), 1, 8) || '-' || substr(md5({value}), 9, 4) || '-3' || substr(md5({value}), 14, 3) || '-' || "
            f"substr('89ab89ab89ab89ab', ('0x' || substr(md5({value}), 17, 1))::INTEGER + 1, 1) || substr(md5({value}), 18, 3) || '-' || substr(md5({value}), 21, 12))")


@query("c12_standard_rules", f"""
    WITH line AS (SELECT doc_id, source, regexp_replace(l, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS l, i FROM (
      SELECT doc_id, source, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
        SELECT doc_id, source, string_split_regex('- ' || replace(text, chr(10), chr(10) || '- '), '\\r\\n|[\\n\\x0B\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM documents))),
    bullet AS (SELECT doc_id, i, 'Architecture ' || source AS section, regexp_replace(regexp_replace(l, '^([-*]|[0-9]+[.)])[ \\t\\n\\x0B\\f\\r]+', ''), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS st
               FROM line WHERE regexp_matches(l, '^([-*]|[0-9]+[.)])[ \\t\\n\\x0B\\f\\r]+.')
               UNION ALL SELECT doc_id, 1000000, 'Notes', 'use the ' || source || ' boilerplate' FROM documents),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal FROM bullet)
    SELECT doc_id, ordinal, section, CASE WHEN length(st) <= 300 THEN st ELSE substr(st, 1, 297) || '...' END AS statement,
      CASE WHEN regexp_matches(lower(section || ' ' || st), 'template|템플릿|boilerplate') THEN 'StandardTemplate' ELSE 'StandardRule' END AS label,
      CASE WHEN section LIKE 'Arch%' THEN 'ARCHITECTURE' ELSE 'CODING' END AS rule_type, {_uuid_sql("section || st || ordinal")} AS stable_id FROM numbered""")
def standard_rules(spark, sf):
    """Every line of a document as a bullet under a heading, and a second section behind it."""
    d = lake.texts(spark, sf, "documents")
    content = F.concat(F.lit("# Architecture "), "source", F.lit("\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")),
                       F.lit("\n  ## Notes\n* use the "), "source", F.lit(" boilerplate\nplain"))
    return x.standard_rules(d.select("doc_id", content.alias("content")))


@query("f3_name_uuid", f"SELECT doc_id, {_uuid_sql('text')} AS uuid, 'rag-source:' || {_uuid_sql(chr(39) + 'document:' + chr(39) + ' || doc_id')} AS graph_key FROM documents")
def name_uuid(spark, sf):
    return lake.raw(spark, sf, "documents").select(
        "doc_id", ids.name_uuid(F.col("text")).alias("uuid"), ids.graph_key(F.concat(F.lit(" document:"), _s("doc_id"))).alias("graph_key"))


@query("c20_metadata_stamp", f"""SELECT 'package:' || c_nationkey AS src, c_custkey, 'doc:' || c_custkey AS source_key, sha256(c_name) AS file_hash, 'v1' AS analysis_version, 1.0::DOUBLE AS confidence,
    'CodeFacts' AS extractor, 'rag-source:' || {_uuid_sql("'doc:' || c_custkey")} AS graph_key, '' AS valid_to, 'p' || c_nationkey AS project_id,
    'doc:' || c_custkey || ':chunk:0' AS evidence FROM customer""")
def metadata_stamp(spark, sf):
    c = lake.raw(spark, sf, "customer").select(F.concat(F.lit("package:"), _s("c_nationkey")).alias("src"), "c_custkey", "c_name", "c_nationkey")
    out = x.stamped(c, F.concat(F.lit("doc:"), _s("c_custkey")), F.sha2("c_name", 256), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "CodeFacts", "v1", x.CODE_CONFIDENCE,
                    F.concat(F.lit("p"), _s("c_nationkey")), F.array(F.concat(F.lit("doc:"), _s("c_custkey"), F.lit(":chunk:0"))))
    return out.select("src", "c_custkey", "source_key", "file_hash", "analysis_version", "confidence", "extractor", "graph_key", "valid_to", "project_id",
                      F.array_join("evidence_chunk_ids", ",").alias("evidence"))


@query("c21_project_listing", """WITH p AS (SELECT doc_id, lang, CASE source WHEN 'src3' THEN 'build/' WHEN 'src4' THEN 'a/.git/' ELSE 'Src/' END || 'Doc' || doc_id AS path FROM documents)
    SELECT lang, path, row_number() OVER (PARTITION BY lang ORDER BY lower(path), path) AS position FROM p WHERE path LIKE 'Src/%' QUALIFY position <= 100""")
def project_listing(spark, sf):
    d = lake.raw(spark, sf, "documents")
    path = F.concat(F.when(F.col("source") == "src3", "build/").when(F.col("source") == "src4", "a/.git/").otherwise("Src/"), F.lit("Doc"), _s("doc_id"))
    listed = d.select("lang", path.alias("path")).where(files.listed_path(F.col("path")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.lower("path"), "path"))
    return listed.withColumn("position", rank).where(F.col("position") <= files.LISTING_LIMIT)


# --- generated answers and tool texts ------------------------------------------------------------------

def _answers(spark, sf):
    key = _s("o_orderkey")
    text = F.concat(F.lit("Here:\n```java\n// v1\nimport a.B;\npublic class A"), key, F.lit(" { }\n```\nand\n```\nrecord B"), key, F.lit("(int x) { }\n\n``` end ```JAVA public class B"), key, F.lit(" {} ```"))
    return lake.texts(spark, sf, "orders").select(F.col("o_orderkey").alias("answer_id"), text.alias("content"))


@query("f12_code_blocks", """SELECT o_orderkey AS answer_id, unnest([0, 1, 2]) AS pos, unnest(['import a.B;' || chr(10) || 'public class A' || o_orderkey || ' { }', 'record B' || o_orderkey || '(int x) { }',
    'public class B' || o_orderkey || ' {}']) AS block FROM orders""")
def code_blocks(spark, sf):
    return _answers(spark, sf).select("answer_id", F.posexplode(code.code_blocks(F.col("content"))).alias("pos", "block"))


@query("f13_trim_to_java", "SELECT doc_id, 'class X' || doc_id || ' { }' AS code FROM documents")
def trim_to_java(spark, sf):
    """Java behind a foreword without Java keywords."""
    d = lake.raw(spark, sf, "documents").select("doc_id", F.concat(
        F.regexp_replace("text", "@|(package|import|public|class|interface|enum|record) ", "_"), F.lit("\nclass X"), _s("doc_id"), F.lit(" { }\n ")).alias("t"))
    return d.select("doc_id", code.trim_to_java(F.col("t")).alias("code"))


@query("c22_source_block", "SELECT o_orderkey AS answer_id, 'com.x.B' || o_orderkey AS type_name, 'record B' || o_orderkey || '(int x) { }' AS block FROM orders")
def source_block(spark, sf):
    answers = _answers(spark, sf)
    wanted = answers.select("answer_id", F.concat(F.lit("com.x.B"), _s("answer_id")).alias("type_name"))
    return x.source_block(answers, wanted)


def _generated(spark, sf):
    key = _s("o_orderkey")
    text = F.concat(
        F.lit('<result column="id"/> <result COLUMN = \'bad_'), key, F.lit("'/>\n<sql id=\"c\">o.total, o.state AS st,\n\"quoted\"</sql>\nINSERT INTO app.orders (id, cust_id) VALUES (1)\n"
              "<update id=\"u\">update app.orders set total = #{t}, state = 1 where id = 2</update>\nselect id, max(x), note_"), key, F.lit(" from app.orders"))
    return lake.texts(spark, sf, "orders").select("o_orderkey", text.alias("code"))


@query("c18_generated_columns", "SELECT o_orderkey, 'id,bad_' || o_orderkey || ',total,state,quoted,cust_id,note_' || o_orderkey AS columns FROM orders")
def generated_columns(spark, sf):
    return _generated(spark, sf).select("o_orderkey", F.array_join(sqltext.generated_columns(F.col("code")), ",").alias("columns"))


@query("j19_invalid_columns", "SELECT o_orderkey, unnest(['bad_' || o_orderkey, 'quoted', 'note_' || o_orderkey]) AS column_name FROM orders")
def invalid_columns(spark, sf):
    used = _generated(spark, sf).select("o_orderkey", F.explode(sqltext.generated_columns(F.col("code"))).alias("column_name"))
    allowed = lake.raw(spark, sf, "region").select(F.explode(F.array(*[F.lit(c) for c in ("ID", " Total", "state", "cust_id")])).alias("column_name"))
    return x.invalid_columns(used, allowed)


def _tool_texts(spark, sf):
    key = _s("p_partkey")
    j = F.concat(F.lit('{"tables":[{"kind":"base_'), key, F.lit('","table_name":"app.t_'), key, F.lit('","columns":[{"column_name":"c_'), key, F.lit('"}]},"u_'), key, F.lit('",["v_'), key, F.lit('"]]}'))
    labeled = F.concat(F.lit("Table: app.t_"), key, F.lit("\n- c_"), key, F.lit(": bigint, key"))
    piped = F.concat(F.lit("| a_"), key, F.lit(" | `b_"), key, F.lit("` |\nc_"), key, F.lit(" | int"))
    return lake.texts(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") < 15, j).when(F.col("p_size") < 30, labeled).otherwise(piped).alias("text"))


@query("c19_tool_text_names", """SELECT p_partkey, CASE WHEN p_size < 15 THEN 'app.t_' || p_partkey || ',base_' || p_partkey || ',c_' || p_partkey || ',u_' || p_partkey || ',v_' || p_partkey WHEN p_size < 30 THEN 'app.t_' || p_partkey || ',c_' || p_partkey
    ELSE 'a_' || p_partkey || ',b_' || p_partkey || ',c_' || p_partkey || ',int' END AS tables,
    CASE WHEN p_size < 15 THEN 'c_' || p_partkey WHEN p_size < 30 THEN 'Table,c_' || p_partkey ELSE 'c_' || p_partkey END AS columns FROM part""")
def tool_text_names(spark, sf):
    found = x.tool_names(_tool_texts(spark, sf).withColumnRenamed("p_partkey", "id"))
    return found.select(F.col("id").alias("p_partkey"), F.array_join("tables", ",").alias("tables"), F.array_join("columns", ",").alias("columns"))


@query("f17_clean_identifiers", """SELECT p_partkey, 'app.t_' || p_partkey AS table_name, 'c_' || p_partkey AS column_name FROM part""")
def clean_identifiers(spark, sf):
    key = _s("p_partkey")
    return lake.raw(spark, sf, "part").select(
        "p_partkey", sqltext.clean_table(F.concat(F.lit(" - [`app.t_"), key, F.lit("`],;"))).alias("table_name"),
        sqltext.clean_column(F.concat(F.lit("* \"x.c_"), key, F.lit("\" : bigint"))).alias("column_name"))


def _vocabulary(spark, sf):
    """Distinct words of the benchmark items, of any script."""
    b = lake.raw(spark, sf, "benchmark")
    return b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))).alias("w")).distinct()


_VOCAB = r"""vocab AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)) AS w FROM benchmark)),
plain AS (SELECT w FROM vocab WHERE regexp_full_match(w, '[a-z0-9_]+')), wide AS (SELECT w FROM vocab WHERE NOT regexp_full_match(w, '[a-z0-9_]+')),
prompt AS (SELECT doc_id AS id, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS ws FROM documents),
hit AS (SELECT id, w FROM (SELECT id, unnest(ws) AS w FROM prompt) SEMI JOIN plain USING (w)
  UNION ALL SELECT id, w FROM prompt JOIN wide ON contains(t, w) WHERE regexp_matches(t, '(^|[^a-z0-9_])' || w || '($|[^a-z0-9_])'))"""


@query("j22_tool_mentions", f"""WITH {_VOCAB}
    SELECT id AS message_id, arg_min(w, (-length(w), w)) AS tool FROM hit GROUP BY 1""")
def tool_mentions(spark, sf):
    messages = lake.texts(spark, sf, "documents").select(F.col("doc_id").alias("message_id"), "text")
    tools = _vocabulary(spark, sf).select(F.col("w").alias("id"), F.col("w").alias("tool"), F.length("w").alias("priority"))
    return x.best_mention(messages, tools)


@query("j18_prompt_tables", f"""WITH {_VOCAB},
    loose AS (SELECT id, w FROM prompt JOIN vocab ON contains(t, w) OR (length(w) > 3 AND w LIKE '%s' AND contains(t, substr(w, 1, length(w) - 1))) WHERE id NOT IN (SELECT id FROM hit))
    SELECT id AS prompt_id, 'app.' || w AS table_name, kind FROM (SELECT *, 'word' AS kind FROM hit UNION ALL SELECT *, 'contains' FROM loose)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY w) <= 3""")
def prompt_tables(spark, sf):
    prompts = lake.texts(spark, sf, "documents").select(F.col("doc_id").alias("prompt_id"), "text")
    tables = _vocabulary(spark, sf).select(F.concat(F.lit("app."), "w").alias("table_name"), F.col("w").alias("ordinal"))
    return x.match_tables(prompts, tables).select("prompt_id", "table_name", "kind")


@query("j18_searched_tables", """WITH t AS (SELECT n_nationkey, 'app.' || n_name AS table_name, lower(n_name) AS simple FROM nation), d AS (SELECT doc_id, lower(text) AS t FROM documents),
    hit AS (SELECT doc_id, n_nationkey, table_name FROM d JOIN t ON regexp_matches(d.t, '(^|[^a-z0-9_])' || simple || '($|[^a-z0-9_])'))
    SELECT doc_id AS prompt_id, table_name, 'word' AS kind FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_nationkey) <= 3
    UNION ALL SELECT doc_id, table_name, 'search' FROM documents JOIN t ON n_nationkey IN (n_chars % 25, doc_id % 25) WHERE doc_id NOT IN (SELECT doc_id FROM hit)""")
def searched_tables(spark, sf):
    """A search named two tables for every document, under another schema, and one that isn't there."""
    d = lake.texts(spark, sf, "documents")
    tables = lake.raw(spark, sf, "nation").select(F.concat(F.lit("app."), "n_name").alias("table_name"), F.col("n_nationkey").alias("ordinal"))
    named = tables.select(F.col("ordinal").alias("k"), F.concat(F.lit(" OTHER."), F.substring_index("table_name", ".", -1)).alias("candidate"))
    asked = d.select(F.col("doc_id").alias("prompt_id"), F.explode(F.array(F.col("n_chars") % 25, F.col("doc_id") % 25, F.lit(99).cast("long"))).alias("k"))
    hits = asked.join(named, "k", "left").select("prompt_id", F.coalesce("candidate", F.lit("no_such")).alias("candidate"), F.col("k").alias("ordinal"))
    return x.match_tables(d.select(F.col("doc_id").alias("prompt_id"), "text"), tables, hits=hits).select("prompt_id", "table_name", "kind")


def _capabilities(spark, sf):
    """Tools of parts and of customers; every line item and every order lists one, and customers without orders none."""
    cap, tool = F.lit("cap"), F.lit("tool_")
    current = lake.raw(spark, sf, "part").select(
        F.concat(cap, _s("p_partkey")).alias("capability_id"), F.concat(tool, _s("p_partkey")).alias("tool")).unionByName(
        lake.raw(spark, sf, "customer").select(
            F.concat(F.lit("capc"), _s("c_custkey")).alias("capability_id"), F.concat(F.lit("client_"), _s("c_custkey")).alias("tool")))
    live = lake.raw(spark, sf, "lineitem").select(F.concat(F.lit(" tool_"), _s("l_partkey")).alias("tool")).unionByName(
        lake.raw(spark, sf, "orders").select(F.concat(F.lit("client_"), _s("o_custkey"), F.lit(" ")).alias("tool"))).unionByName(
        lake.raw(spark, sf, "supplier").select(F.concat(F.lit("Vendor Tool-"), _s("s_suppkey")).alias("tool")))
    return current, live


@query("j21_catalog_reconcile", """SELECT 'cap' || p_partkey AS capability_id, 'tool_' || p_partkey AS tool,
    CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 'retained' ELSE 'removed' END AS action FROM part
    UNION ALL SELECT 'capc' || c_custkey, 'client_' || c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'retained' ELSE 'removed' END FROM customer
    UNION ALL SELECT 'auto.vendor.tool.' || s_suppkey, 'Vendor Tool-' || s_suppkey, 'added' FROM supplier""")
def catalog_reconcile(spark, sf):
    return x.reconcile(*_capabilities(spark, sf))


@query("j21_living_references", """SELECT DISTINCT 'cap' || l_partkey AS capability_id, 'capc' || o_custkey AS reference_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_partkey IN (SELECT p_partkey FROM part) AND o_custkey IN (SELECT c_custkey FROM customer)
    UNION SELECT 'capc' || c_custkey, 'capc' || (c_custkey + 1) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
      AND c_custkey + 1 IN (SELECT o_custkey FROM orders) AND c_custkey + 1 IN (SELECT c_custkey FROM customer)""")
def living_references(spark, sf):
    """References of parts to the customers who ordered them, and of each customer to the next one."""
    lines, orders = lake.raw(spark, sf, "lineitem"), lake.raw(spark, sf, "orders")
    bought = lines.select("l_orderkey", "l_partkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    references = bought.select(
        F.concat(F.lit("cap"), _s("l_partkey")).alias("capability_id"), F.concat(F.lit("capc"), _s("o_custkey")).alias("reference_id")).unionByName(
        lake.raw(spark, sf, "customer").select(
            F.concat(F.lit("capc"), _s("c_custkey")).alias("capability_id"), F.concat(F.lit("capc"), (F.col("c_custkey") + 1).cast("string")).alias("reference_id")))
    return x.living_references(references.distinct(), x.reconcile(*_capabilities(spark, sf)))


@query("j23_rule_evidence", f"""WITH d AS (SELECT conv_id * 1000000 + turn AS id, text AS doc, 'generation-rag' AS source_key FROM conversations WHERE trim(text) <> ''
      UNION ALL SELECT conv_id * 1000000 + turn, 'Rule [source: conv' || conv_id || ' ] body' || chr(10) || text, 'conv' || conv_id FROM conversations)
    SELECT 'generation:' || id AS src, 'rule:p:' || {_uuid_sql('doc')} AS dst, substr(string_split_regex(trim(doc, chr(10) || chr(13) || chr(9) || ' '), '\\r\\n|[\\n\\r]')[1], 1, 160) AS name, source_key FROM d""")
def rule_evidence(spark, sf):
    c = lake.raw(spark, sf, "conversations")
    marked = F.concat(F.lit("Rule [source: conv"), _s("conv_id"), F.lit(" ] body\n"), F.col("text"))
    history = c.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("id"), F.lit("p").alias("project_id"),
                       F.to_json(F.array("text", marked, F.lit(" "))).alias("rag_documents"))
    return x.rule_evidence(history).select("src", "dst", "name", "source_key")
