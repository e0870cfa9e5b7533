from cairn.operators import chunking as ch
from cairn.operators import retrieval as r

NODE = "uid string, label string, name string, project_id string, evidence_chunk_ids array<string>"
EDGE = "src string, dst string, type string, graph_key string, evidence_chunk_ids array<string>"
CHUNK = "chunk_id string, source_key string, content string, entity_ids array<string>"


def search(spark, **limits):
    chunks = spark.createDataFrame([
        ("vector", "s1", "vector text", ["n1"]), ("evidence-1", "s2", "first evidence", []), ("evidence-2", "s3", "second evidence", []), ("other", "s4", "x", [])], CHUNK)
    nodes = spark.createDataFrame([
        ("n1", "JavaType", "UserController", "commerce", ["evidence-1", "vector", " "]), ("n2", "JavaType", "UserService", "commerce", ["evidence-2"]),
        ("n3", "JavaType", "Foreign", "other", ["other"])], NODE)
    edges = spark.createDataFrame([("n1", "n2", "USES", "k", []), ("n1", "n3", "USES", "k", []), ("n2", "n1", "CALLS", "k", ["evidence-2"])], EDGE)
    hits = spark.createDataFrame([("vector", 0.9)], "chunk_id string, score double")
    return r.hybrid_search(chunks, nodes, edges, hits, "commerce", **limits)


def test_hits_then_evidence_and_context_order(spark):
    merged, nodes, edges = search(spark)
    assert [x.chunk_id for x in merged.orderBy("rank").collect()] == ["vector", "evidence-1", "evidence-2"]
    assert [x.uid for x in nodes.orderBy("rank").collect()] == ["n1", "n2"]
    assert edges.count() == 2
    context = r.build_context(merged, nodes, edges).first().context
    assert context.startswith("EVIDENCE CHUNKS:\n[chunkId: vector][source: s1]\nvector text")
    assert context.index("EVIDENCE CHUNKS") < context.index("GRAPH CONTEXT") and "UserService" in context


def test_caps_and_truncation(spark):
    merged, nodes, edges = search(spark, max_nodes=1, max_edges=1, max_chunks=2)
    assert [x.chunk_id for x in merged.orderBy("rank").collect()] == ["vector", "evidence-1"]
    assert nodes.count() == 1 and edges.count() == 0
    context = r.build_context(merged, nodes, edges, limit=140).first().context
    assert len(context) == 140 and context.endswith(r.TRUNCATION_MARKER)
    assert r.build_context(merged, nodes, edges, limit=10).first().context == "EVIDENCE C"


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    df = spark.createDataFrame([(1, "document:1", "p", "a.md", text), (2, "document:2", "p", "A.java", text), (3, "document:3", "p", "b.md", "")],
                               "id int, vector_source_key string, project_key string, file_path string, content string")
    rows = ch.plain_chunks(df).orderBy("index").collect()
    assert [len(x.content) for x in rows] == [1200, 1200, 400]
    assert rows[1].chunk_id == "document:1:chunk:1" and rows[0].content[1050:] == rows[1].content[:150]


def test_method_chunk_identity_is_stable(spark):
    df = spark.createDataFrame([("document:90", "p", "A.java", "com.A", f"m{i}()", "main", "{ }", f"method:p:com.A:m{i}()") for i in (1, 2)],
                               "source_key string, project_id string, file_path string, declaring_type string, signature string, module_name string, method_body string, method_uid string")
    first, again = ([(x.chunk_id, x.entity_ids) for x in ch.method_chunks(df.repartition(n)).orderBy("chunk_id").collect()] for n in (1, 3))
    assert first == again and len(first) == 2 and all(i.startswith("document:90:java-method:") for i, _ in first)
    assert set(first[0][1]) > {"type:p:com.A", "file:p:A.java"}


def test_replace_removes_every_former_chunk(spark):
    old = spark.createDataFrame([("a", "a:0"), ("a", "a:1"), ("b", "b:0")], "source_key string, chunk_id string")
    new = spark.createDataFrame([("a", "a:0")], "source_key string, chunk_id string")
    assert sorted(x.chunk_id for x in ch.replace_sources(old, new).collect()) == ["a:0", "b:0"]
