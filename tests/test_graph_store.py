"""The store against the whole-table operators, and which of its files a change touches."""

import os
import random

from pyspark.sql import functions as F

from cairn import session
from cairn.operators import graph as g
from cairn.sources.graph_store import EDGES, GraphStore

NODE = "uid string, seq int, label string, props map<string,string>"


def stored(store):
    return (sorted((r.uid, r.label, r.graph_key) for r in store.nodes().collect()),
            sorted((r.src, r.dst, r.type, r.graph_key) for r in store.edges().collect()))


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def frames(spark, nodes, edges):
    rows = [(u, i, label, {"graphKey": k, "name": u}) for i, (u, label, k) in enumerate(nodes)]
    return spark.createDataFrame(rows, NODE), spark.createDataFrame([(*e, {}) for e in edges], EDGES)


def test_write_merges_into_what_is_stored(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"), 4)
    first = spark.createDataFrame([
        ("type:A", 0, "JavaType", {"graphKey": "k1", "name": "A", "layer": "DTO", "sourceContent": "class A {}"}),
        ("doc:1", 1, "Document", {"graphKey": "k1", "content": "long", "title": "One"}), ("type:A", 2, "JavaType", {"name": "A2"})], NODE)
    edges = spark.createDataFrame([
        ("doc:1", "type:A", "DECLARES", "k1", {"line": "1"}), ("doc:1", "type:A", "DECLARES", "k1", {"line": "1"}),
        ("doc:1", "type:B", "DECLARES", "k1", {})], EDGES)
    store.write(first, edges)
    got = {r.uid: r for r in store.nodes().collect()}
    assert got["type:A"].props == {"graphKey": "k1", "name": "A2", "layer": "DTO"} and got["doc:1"].props == {"graphKey": "k1", "title": "One"}
    assert [(r.src, r.dst, r.props) for r in store.edges().collect()] == [("doc:1", "type:A", {"line": "1"})]
    # A second graph writes the same node under its own key: properties go over the stored ones, the node moves.
    second = spark.createDataFrame([("type:A", 0, "JavaType", {"graphKey": "k2", "layer": "Domain"}), ("type:B", 1, "JavaType", {"graphKey": "k2"})], NODE)
    store.write(second, spark.createDataFrame([
        ("type:A", "type:B", "USES", "k2", {}), ("doc:1", "type:A", "DECLARES", "k1", {"line": "7", "end": "9"}), ("type:B", "no", "USES", "k2", {})], EDGES))
    got = {r.uid: r for r in store.nodes().collect()}
    assert len(got) == 3 and got["type:A"].graph_key == "k2" and got["type:A"].props == {"graphKey": "k2", "name": "A2", "layer": "Domain"}
    assert sorted((r.src, r.dst, tuple(sorted(r.props.items()))) for r in store.edges().collect()) == [
        ("doc:1", "type:A", (("end", "9"), ("line", "7"))), ("type:A", "type:B", ())]


def graph(rng, n_keys=6):
    nodes, edges = [("project", "Project", "k0"), ("module", "Module", "k0")], [("project", "module", "CONTAINS", "k0")]
    for k in range(n_keys):
        key, names = f"k{k}", [f"t{k}-{i}" for i in range(4)]
        nodes += [(f"p{k // 2}", "Package", key), (f"f{k}", "SourceFile", key), *[(t, "JavaType", key) for t in names], (f"lone{k}", "Method", key)]
        edges += [("module", f"p{k // 2}", "CONTAINS", key), (f"p{k // 2}", f"f{k}", "CONTAINS", key), *[(f"f{k}", t, "DECLARES", key) for t in names]]
        for _ in range(3):
            edges.append((rng.choice(names), f"t{rng.randrange(k + 1)}-{rng.randrange(4)}", "USES", key))
        edges.append((f"t{k}-0", "table", "READS_FROM", key))
    return [*nodes, ("table", "DatabaseTable", "k1"), ("empty", "Package", "k2"), ("rule", "StandardRule", "k3")], sorted(set(edges))


def whole(spark, nodes, edges, keys):
    """The same deletion on the whole tables."""
    n = spark.createDataFrame([(u, label, k) for u, label, k in nodes], "uid string, label string, graph_key string")
    left, linked = g.delete_graph(n, spark.createDataFrame(edges, "src string, dst string, type string, graph_key string"),
                                  spark.createDataFrame([(k,) for k in keys], "graph_key string"))
    return sorted(map(tuple, left.select("uid", "label", "graph_key").collect())), sorted(map(tuple, linked.select("src", "dst", "type", "graph_key").collect()))


def test_deletion_equals_that_of_whole_tables(spark, tmp_path):
    nodes, edges = graph(random.Random(4))
    nodes = [*{u: (u, label, k) for u, label, k in nodes}.values()]
    store = GraphStore(spark, str(tmp_path / "store"), 5)
    store.write(*frames(spark, nodes, edges))
    assert stored(store) == (sorted(nodes), edges)
    for keys in (["k1"], ["k0", "k3"]):
        store.delete(spark.createDataFrame([(k,) for k in keys], "graph_key string"))
        nodes, edges = whole(spark, nodes, edges, keys)
        assert stored(store) == (nodes, edges)
    counted = {(r.uid, r.graph_key): r.n for r in store._table("ends").collect()}
    want = {}
    for src, dst, _, key in edges:
        for uid in {src, dst}:
            want[uid, key] = want.get((uid, key), 0) + 1
    assert counted == want


def test_a_key_has_its_own_files(spark, tmp_path):
    nodes, edges = [], []
    for k in range(40):
        nodes += [(f"f{k}", "SourceFile", f"k{k}"), (f"t{k}", "JavaType", f"k{k}")]
        edges.append((f"f{k}", f"t{k}", "DECLARES", f"k{k}"))
    store = GraphStore(spark, str(tmp_path / "store"), 64)
    store.write(*frames(spark, nodes, edges))
    mine = spark.range(1).select(store._bucket(F.lit("k7"))).first()[0]
    before = files(tmp_path / "store")
    store.delete(spark.createDataFrame([("k7",)], "graph_key string"))
    after = files(tmp_path / "store")
    changed = {f.split("/store/")[1].rsplit("/", 1)[0] for f in before.keys() ^ after.keys()}
    assert {c for c in changed if c.startswith(("nodes", "edges"))} == {f"nodes/key_bucket={mine}", f"edges/key_bucket={mine}"}
    assert len({c for c in changed if c.startswith(("places", "ends"))}) <= 4
    assert store.nodes().count() == 78 and store.edges().count() == 39
    plan = store._table("edges", [mine])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "key_bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_the_same_call_again_changes_nothing(spark, tmp_path):
    nodes, edges = graph(random.Random(9), 3)
    nodes = [*{u: (u, label, k) for u, label, k in nodes}.values()]
    store = GraphStore(spark, str(tmp_path / "store"), 4)
    store.write(*frames(spark, nodes, edges))
    once = stored(store)
    store.write(*frames(spark, nodes, edges))
    assert stored(store) == once
    gone = spark.createDataFrame([("k2",)], "graph_key string")
    store.delete(gone)
    once = stored(store)
    store.delete(gone)
    assert stored(store) == once


def test_an_empty_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"), 4)
    assert stored(store) == ([], [])
    store.delete(spark.createDataFrame([("k",)], "graph_key string"))
    assert stored(store) == ([], [])


def test_a_key_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    names = spark.range(0, 60000, 1, 8).select(F.concat(F.lit("n"), F.sha2(F.col("id").cast("string"), 256)).alias("uid"))
    nodes = names.select("uid", F.lit(0).alias("seq"), F.lit("Method").alias("label"), F.create_map(F.lit("graphKey"), F.lit("one")).alias("props"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        store = GraphStore(spark, f"{tmp_path}/store", 4)
        store.write(nodes, spark.createDataFrame([], "src string, dst string, type string, graph_key string, props map<string,string>"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    stored = store.nodes()
    assert stored.select("uid").exceptAll(names).isEmpty() and stored.count() == 60000
    assert stored.select(F.input_file_name()).distinct().count() > 1


def size(path):
    return sum(os.stat(f"{d}/{f}").st_size for d, _, names in os.walk(path) for f in names)


def test_what_a_call_writes_on_its_way_is_removed(spark, tmp_path, monkeypatch):
    """Edges lie on the disk twice at most at a time: while they are merged, and as they are stored."""
    most = []
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"{tmp_path}/shared")
    names = spark.range(0, 20000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("uid"), (F.col("id") % 7).cast("string").alias("key"))
    nodes = names.select("uid", F.lit(0).alias("seq"), F.lit("Method").alias("label"), F.create_map(F.lit("graphKey"), "key").alias("props"))
    edges = names.select(F.col("uid").alias("src"), F.sha2(F.lit("0"), 256).alias("dst"), F.lit("CALLS").alias("type"), F.col("key").alias("graph_key"),
                         F.lit(None).cast("map<string,string>").alias("props"))

    class Seen(GraphStore):
        def _replace(self, name, rows, within):
            super()._replace(name, rows, within)
            most.append((size(tmp_path / "shared") + size(tmp_path / "store"), size(tmp_path / "store")))

    store = Seen(spark, f"{tmp_path}/store", 4)
    store.write(nodes, edges)
    assert size(tmp_path / "shared") == 0 and max(m for m, _ in most) < 2.5 * most[-1][1]
    full = most[-1][1]
    store.delete(spark.createDataFrame([(str(k),) for k in range(6)], "graph_key string"))
    assert size(tmp_path / "shared") == 0 and max(m for m, _ in most) < 2.5 * full
    gone = names.where("key < 6 AND uid <> sha2('0', 256)").select("uid")
    assert store.edges().count() == names.where("key = 6").count() == store.nodes().count() - 1
    assert store.nodes().join(gone, "uid", "left_semi").isEmpty()


def test_missing_ends_and_edges_of_other_keys(spark, tmp_path):
    store = GraphStore(spark, f"{tmp_path}/store", 4)
    nodes = [("f", "SourceFile", "k1"), ("t", "JavaType", "k2"), ("u", "JavaType", "k2"), ("m", "Method", "k2")]
    edges = [("f", "t", "DECLARES", "k2"), ("f", "m", "DECLARES", None), ("t", "u", "USES", "k2"), ("t", "t", "CALLS", "k2"), ("t", "gone", "USES", "k2"), (None, "t", "USES", "k2")]
    store.write(*frames(spark, nodes, edges))
    for _ in range(2):
        got = {(r.src, r.dst, r.type, r.graph_key) for r in store.edges().collect()}
        assert got == set(edges[:4]) and store.edges().count() == 4
        assert {(r.uid, r.graph_key): r.n for r in store._table("ends").collect()} == {
            ("f", "k2"): 1, ("t", "k2"): 3, ("u", "k2"): 1, ("f", None): 1, ("m", None): 1}
        store.write(*frames(spark, nodes, edges[:4]))
    store.delete(spark.createDataFrame([("k1",)], "graph_key string"))
    assert stored(store) == ([("t", "JavaType", "k2"), ("u", "JavaType", "k2")], [("t", "t", "CALLS", "k2"), ("t", "u", "USES", "k2")])
    assert {(r.uid, r.graph_key): r.n for r in store._table("ends").collect()} == {("t", "k2"): 2, ("u", "k2"): 1}
