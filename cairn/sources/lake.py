"""Engine tables derived from the lake's Parquet files.

Each builder is a lazy projection (or a small join) over the raw tables, so column pruning and
filter pushdown reach the scans of whatever operator is put on top.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.session import spread

# The file suffix each collection of documents carries, by last digit of its name.
SUFFIX_BY_DIGIT = {
    "0": ".java", "1": ".xml", "2": ".md", "3": ".yml", "4": ".kt",
    "5": ".java", "6": ".sql", "7": ".java", "8": ".tmp", "9": ".txt",
}


@lru_cache(maxsize=256)
def _schema(application: str, path: str) -> StructType:
    """Schema of a table, looked up in its footers once per application rather than by a job at every read."""
    return SparkSession.active().read.parquet(path).schema


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(SparkSession.active().sparkContext.applicationId, path)).parquet(path)


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table read for work that is heavy per row."""
    return spread(raw(spark, sf_dir, name))


def _suffix(source: Column) -> Column:
    digit = F.right(source, F.lit(1))
    chain = F.when(digit == "0", ".java")
    for key, value in SUFFIX_BY_DIGIT.items():
        if key != "0":
            chain = chain.when(digit == key, value)
    return chain.otherwise("")


def minutes_after_epoch_2024(minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def documents_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document catalog: one row per stored file, soft-deleted rows included."""
    d = raw(spark, sf_dir, "documents")
    suffix = _suffix(F.col("source"))
    name = F.concat(F.lit("Doc"), F.col("doc_id").cast("string"), suffix)
    tree = F.when(F.right("source", F.lit(1)) == "7", "app/src/test/java/").otherwise("app/src/main/java/")
    key = F.concat(F.lit("document:"), F.col("doc_id").cast("string"))
    is_graph = suffix.isin(".java", ".xml", ".yml", ".yaml", ".md")
    status = (
        F.when(F.col("n_chars") < 100, "FAILED")
        .when(F.col("n_chars") < 400, "PENDING")
        .when(F.col("n_chars") < 800, "INDEXING")
        .otherwise("INDEXED")
    )
    created = minutes_after_epoch_2024(F.col("doc_id"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("project_key"),
        name.alias("original_file_name"),
        F.concat(tree, F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), name).alias("file_path"),
        F.col("n_chars").alias("file_size"),
        F.when(suffix == ".java", "STANDARD_SOURCE").otherwise("STANDARD_DOCUMENT").alias("document_type"),
        F.sha2("text", 256).alias("file_hash"),
        key.alias("vector_source_key"),
        F.when(is_graph, key).alias("graph_source_key"),
        status.alias("index_status"),
        status.alias("vector_index_status"),
        F.when(is_graph, status).otherwise("SKIPPED").alias("graph_index_status"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.when(F.col("source") == "src18", F.timestamp_add("DAY", F.lit(1), created)).alias("deleted_at"),
        F.col("text").alias("content"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge projects: every language of the corpus plus the default and one empty project."""
    langs = raw(spark, sf_dir, "documents").select(F.col("lang").alias("project_key")).distinct()
    extra = spark.range(1).select(F.explode(F.array(F.lit("default"), F.lit("unused"))).alias("project_key"))
    return langs.unionByName(extra).select(
        "project_key", F.concat(F.lit("Project "), F.col("project_key")).alias("name")
    )


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method facts measured over the corpus texts."""
    d = texts(spark, sf_dir, "documents")
    commas = F.regexp_count("text", F.lit(","))
    periods = F.regexp_count("text", F.lit("\\."))
    lines = F.regexp_count("text", F.lit("\n")) + 1
    return d.select(
        F.col("lang").alias("project_key"),
        F.concat(F.lit("method:"), F.col("lang"), F.lit(":"), F.col("doc_id").cast("string")).alias("method_uid"),
        F.col("source").alias("file_path"),
        F.col("doc_id").alias("start_line"),
        lines.cast("long").alias("line_count"),
        F.sha2(F.regexp_replace("text", "[ \t\r\n]+", ""), 256).alias("method_hash"),
        F.sha2(F.regexp_replace(F.lower("text"), "[0-9]+", "#"), 256).alias("structural_hash"),
        (commas + 1).cast("long").alias("cyclomatic"),
        (commas + periods * 2).cast("long").alias("cognitive"),
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("id"),
        "role",
        F.col("text").alias("message"),
        minutes_after_epoch_2024(F.col("conv_id") * 60 + F.col("turn")).alias("created_at"),
    )


def chat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation; the first letter of its opening message files it under a chat project."""
    m = chat_messages(spark, sf_dir)
    first = m.groupBy("conversation_id").agg(
        F.min_by("message", "id").alias("opening"), F.max("created_at").alias("updated_at")
    )
    letter = F.lower(F.substring("opening", 1, 1))
    project = (
        F.when(letter.between("a", "e"), 0).when(letter.between("f", "j"), 1)
        .when(letter.between("k", "o"), 2).when(letter.between("p", "t"), 3)
    )
    return first.select(
        F.col("conversation_id").alias("id"), "opening", project.cast("long").alias("project_id"), "updated_at"
    )


def chat_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))


def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan result rows: one per event, a user being the scanned project, a day of it a scan job."""
    e = raw(spark, sf_dir, "events")
    kind = F.col("event_type")
    day = F.date_format("ts", "yyyyMMdd")
    return e.select(
        F.col("user_id").alias("project_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), day).alias("scan_job_id"),
        F.col("event_id").alias("document_id"),
        F.concat(F.lit("File"), F.col("event_id").cast("string"), F.lit(".java")).alias("file_name"),
        F.lit("JAVA").alias("file_type"),
        F.when(kind == "error", "ERROR").when(kind == "view", "PASSED").otherwise("FINDING").alias("status"),
        F.when(kind.isin("error", "view"), "-").when(kind == "purchase", "HIGH").when(kind == "click", "LOW")
        .otherwise("WARNING").alias("severity"),
        F.when(kind.isin("error", "view"), "-").otherwise(
            F.concat(F.lit("rule-"), F.get_json_object("props", "$.k"))).alias("rule_id"),
        F.concat(F.lit("value "), F.col("value").cast("string")).alias("message"),
        F.col("ts").alias("created_at"),
    )


# The code layer that stands for each market segment.
LAYER_BY_SEGMENT = {
    "AUTOMOBILE": "Controller", "BUILDING": "Service", "FURNITURE": "ServiceImpl",
    "HOUSEHOLD": "DTO", "MACHINERY": "Domain",
}


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property-graph nodes of a code base laid over the sales tables.

    nation -> package and its base type, customer and supplier -> types, orders -> methods of the
    customer type, supplier -> a method and (for mappers) a statement, part -> database table.
    """
    places = raw(spark, sf_dir, "nation").join(
        raw(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        "n_nationkey", "n_name",
        F.concat(F.lit("com."), F.lower("r_name"), F.lit("."), F.lower("n_name")).alias("package_name"),
    )
    cust = raw(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    supp = raw(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("string")

    def node(df, uid, label, name, layer, package, external, graph_key):
        return df.select(
            uid.alias("uid"), F.lit(label).alias("label"), name.alias("name"), layer.alias("layer"),
            package.alias("package_name"), external.alias("external"), graph_key.alias("graph_key"),
            F.when(external, "vendor").otherwise("commerce").alias("project_id"),
        )

    def key(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    never = F.lit(False)
    pkg = F.col("package_name")
    gk = key("nation:", "n_nationkey")
    layer = F.lit("Domain")
    for segment, value in LAYER_BY_SEGMENT.items():
        layer = F.when(F.col("c_mktsegment") == segment, value).otherwise(layer)
    supplier_layer = F.when(F.col("s_acctbal") >= 5000, "Repository").otherwise("Mapper")
    parts = [
        node(places, key("package:", "n_nationkey"), "Package", pkg, none, pkg, never, gk),
        node(places, key("type:base:", "n_nationkey"), "JavaType",
             F.concat(F.lit("Base"), F.col("n_name"), F.lit("Service")), F.lit("Service"), pkg, never, gk),
        node(cust, key("type:c:", "c_custkey"), "JavaType", F.col("c_name"), layer, pkg, never, gk),
        node(supp, key("type:s:", "s_suppkey"), "JavaType", F.col("s_name"), supplier_layer, pkg,
             F.col("s_acctbal") < 0, gk),
        node(supp, key("method:s:", "s_suppkey"), "Method", key("supply", "s_suppkey"), none, none, never, gk),
        node(supp.where(F.col("s_acctbal") < 5000), key("statement:s:", "s_suppkey"), "SqlStatement",
             key("statement", "s_suppkey"), none, none, never, gk),
        node(raw(spark, sf_dir, "orders"), key("method:o:", "o_orderkey"), "Method", key("order", "o_orderkey"),
             none, none, never, F.concat(F.lit("year:"), F.year("o_orderdate").cast("string"))),
        node(raw(spark, sf_dir, "part"), key("table:p:", "p_partkey"), "DatabaseTable", F.col("p_name"),
             none, none, never, F.concat(F.lit("brand:"), F.col("p_brand"))),
    ]
    return reduce(DataFrame.union, parts)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges of the same code base, with the parallel edges of the line items kept."""
    cust, supp = raw(spark, sf_dir, "customer"), raw(spark, sf_dir, "supplier")
    orders, lines = (spread(raw(spark, sf_dir, name), light=True) for name in ("orders", "lineitem"))

    def edge(df, src, src_col, dst, dst_col, kind, graph_key):
        return df.select(
            F.concat(F.lit(src), F.col(src_col).cast("string")).alias("src"),
            F.concat(F.lit(dst), F.col(dst_col).cast("string")).alias("dst"),
            F.lit(kind).alias("type"), graph_key.alias("graph_key"),
        )

    c_gk = F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))
    s_gk = F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string"))
    o_gk = F.concat(F.lit("year:"), F.year("o_orderdate").cast("string"))
    l_gk = F.concat(F.lit("ship:"), F.year("l_shipdate").cast("string"))
    parts = [
        edge(cust, "package:", "c_nationkey", "type:c:", "c_custkey", "CONTAINS", c_gk),
        edge(supp, "package:", "s_nationkey", "type:s:", "s_suppkey", "CONTAINS", s_gk),
        edge(cust, "type:c:", "c_custkey", "type:base:", "c_nationkey", "EXTENDS", c_gk),
        edge(supp, "type:base:", "s_nationkey", "type:s:", "s_suppkey", "INJECTS", s_gk),
        edge(orders, "type:c:", "o_custkey", "method:o:", "o_orderkey", "HAS_METHOD", o_gk),
        edge(supp, "type:s:", "s_suppkey", "method:s:", "s_suppkey", "HAS_METHOD", s_gk),
        edge(supp.where(F.col("s_acctbal") < 5000), "type:s:", "s_suppkey", "statement:s:", "s_suppkey",
             "HAS_STATEMENT", s_gk),
        edge(lines, "method:o:", "l_orderkey", "method:s:", "l_suppkey", "CALLS", l_gk),
        edge(lines.where(F.col("l_returnflag") == "A"), "method:o:", "l_orderkey", "table:p:", "l_partkey",
             "WRITES_TO", l_gk),
        edge(lines.where(F.col("l_returnflag") == "R"), "statement:s:", "l_suppkey", "table:p:", "l_partkey",
             "READS_FROM", l_gk),
    ]
    return reduce(DataFrame.union, parts)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded chunks: one per vector, filed under the vector's label as project."""
    e = raw(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("chunk:"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("source:"), F.col("label").cast("string")).alias("source_key"),
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("project_id"),
        "embedding",
    )
