from cairn.operators import source_routes as sr
from cairn.operators.graph import node_source

NODE = "uid string, label string, name string, props map<string,string>"
EDGE = "src string, dst string, type string, graph_key string"
CATALOG = "id long, graph_source_key string, original_file_name string, file_path string, content string"
BLOCK = "history_id long, place int, fqn string, simple_name string, content string"


def sources(spark, nodes, edges=(), catalog=(), blocks=()):
    found = sr.node_sources(
        spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, "k") for e in edges], EDGE),
        spark.createDataFrame(list(catalog), CATALOG), spark.createDataFrame(list(blocks), BLOCK))
    return {r.uid: r for r in found.collect()}


def test_a_method_is_found_through_its_type_and_that_types_file(spark):
    nodes = [
        ("m", "Method", "run", {}), ("t", "JavaType", None, {"fqn": "com.a.Job", "sourceContent": "of type"}),
        ("f", "SourceFile", None, {"fileName": "Job.java", "source": " key ", "sourceKind": "STANDARD", "sourceContent": "of file"}),
        ("x", "Document", "not a file", {"fileName": "wrong", "source": "wrong"})]
    edges = [("t", "m", "HAS_METHOD"), ("f", "t", "DECLARES"), ("x", "m", "DECLARES"), ("x", "t", "HAS_METHOD")]
    got = sources(spark, nodes, edges)
    m = got["m"]
    assert (m.fqn, m.simple_name, m.file_name, m.source_kind, m.source_key) == ("com.a.Job", "Job", "Job.java", "STANDARD", "key")
    assert m.content == "of file" and m.missing == "" and got["t"].content == "of type" and got["t"].name == "com.a.Job"
    assert got["f"].name == "Job.java" and got["x"].content == "" and got["x"].missing == "catalog row"


def test_catalog_comes_before_generation_and_generation_before_stored_text(spark):
    props = {"fqn": "com.a.T", "source": "key", "historyId": "7", "sourceContent": "stored", "fileName": "own.java"}
    blocks = [(7, 2, "com.a.T", "T", "second"), (7, 1, "com.a.T", "T", "first"), (7, 0, "com.b.T", "T", "same simple name"), (8, 0, "com.a.T", "T", "other")]
    row = (2, "key", "T.java", "/p/T.java", "on disk")
    assert sources(spark, [("t", "JavaType", "T", props)], (), [row, (1, "other", "O", "/o", "o")], blocks)["t"].content == "on disk"
    unread = sources(spark, [("t", "JavaType", "T", props)], (), [(2, "key", " ", "/p/T.java", None)], blocks)["t"]
    assert (unread.content, unread.file_name, unread.file_path) == ("first", "own.java", "/p/T.java")
    assert sources(spark, [("t", "JavaType", "T", {**props, "fqn": "com.c.T"})], (), (), blocks)["t"].content == "same simple name"
    assert sources(spark, [("t", "JavaType", "T", {**props, "historyId": "none"})], (), (), blocks)["t"].content == "stored"


def test_what_is_missing_is_told(spark):
    nodes = [("a", "JavaType", "A", {"source": "key"}), ("b", "JavaType", "B", {"source": "gone"}), ("c", "Method", None, {}), ("d", "Method", "D", None)]
    got = sources(spark, nodes, (), [(1, "key", "A.java", "/a", "  ")])
    assert [got[u].missing for u in "abcd"] == ["file", "catalog row", "source", "source"]
    assert got["c"].name == "c" and got["d"].file_name == "D.java" and got["b"].file_name == "B.java"
    assert sources(spark, nodes[:1])["a"].missing == "catalog row"


def joins(df):
    """The joins of a plan without broadcasts, outermost first."""
    spark = df.sparkSession
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    return [line for line in plan.splitlines() if "Join" in line]


def test_texts_are_joined_last(spark):
    frames = [spark.createDataFrame([], s) for s in (NODE, EDGE, CATALOG, BLOCK)]
    assert "[source_key" in joins(sr.node_sources(*frames))[0]


def test_nodes_are_joined_by_their_own_id_only(spark):
    nodes = spark.createDataFrame([(u, la, u, "g", p, u) for u, la, p in [("m", "Method", None), ("t", "JavaType", None), ("f", "Package", "p")]],
                                  "uid string, label string, name string, graph_key string, package_name string, other string")
    edges = spark.createDataFrame([("f", "t", "DECLARES", "k"), ("t", "m", "HAS_METHOD", "k"), ("f", "gone", "DECLARES", "k"), ("gone", "f", "HAS_METHOD", "k")], EDGE)
    found = node_source(nodes, edges)
    assert {r.uid: (r.package_name, r.source_file, r.type_name) for r in found.collect()} == {
        "m": ("p", "f", "t"), "t": ("p", "f", "t"), "f": ("p", "f", "f")}
    assert all(line.count("[uid#") == 2 for line in joins(found))
