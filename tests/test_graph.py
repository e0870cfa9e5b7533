import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import graph as g
from cairn.operators import traversal as tr

NODE = "uid string, label string, name string, layer string, package_name string, external boolean, graph_key string, project_id string"
EDGE = "src string, dst string, type string, graph_key string"


def node(uid, label="JavaType", layer="Domain", package="com.a", external=False, key="k", project="p", name=None):
    return (uid, label, name or uid, layer, package, external, key, project)


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, "k") if len(e) == 3 else e for e in edges], EDGE)


def closure(pairs):
    reach, grown = set(pairs), True
    while grown:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        grown = bool(more)
        reach |= more
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_strongly_connected_groups_are_mutual_reachability(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(18)}
    reach = closure(pairs)
    expected = {frozenset(b for b in names if (a, b) in reach and (b, a) in reach) | {a} for a in names}
    expected = {frozenset(s) for s in expected if len(s) > 1}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    members = tr.strongly_connected(edges)
    groups = {}
    for r in members.collect():
        groups.setdefault(r.component, set()).add(r.member)
    assert {frozenset(v) for v in groups.values()} == expected
    assert all(min(v) == k for k, v in groups.items())
    for r in (tr.cycle_paths(edges, members).collect() if expected else []):
        assert r.path[0] == r.path[-1] == r.component and all((a, b) in pairs for a, b in zip(r.path, r.path[1:]))


def test_shortest_alphabetical_cycle(spark):
    edges = spark.createDataFrame([("a", "c"), ("c", "b"), ("b", "a"), ("a", "b"), ("c", "a")], "src string, dst string")
    assert tr.cycle_paths(edges, tr.strongly_connected(edges)).first().path == ["a", "b", "a"]


def test_neighbourhood_is_capped_scoped_and_monotone(spark):
    nodes, edges = frames(
        spark, [node(x) for x in "abcdef"] + [node("v", project="vendor"), node("z")],
        [("a", "b", "CALLS"), ("c", "b", "USES"), ("c", "d", "CALLS"), ("d", "e", "CONTAINS"), ("a", "v", "CALLS"), ("v", "z", "CALLS")])
    seeds = spark.createDataFrame([("a",), (" a ",), ("",), (None,)], "uid string")

    def walk(**kw):
        return [(r.uid, r.depth) for r in tr.neighbourhood(nodes, edges, seeds, **kw).orderBy("depth", "uid").collect()]

    assert walk(depth=1) == [("a", 0), ("b", 1), ("v", 1)]
    assert walk(depth=6) == [("a", 0), ("b", 1), ("v", 1), ("c", 2), ("z", 2), ("d", 3)]
    assert walk(depth=6, project="p") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert walk(depth=6, max_nodes=4) == walk(depth=6)[:4]
    assert set(walk(depth=2)) <= set(walk(depth=3))


def test_calls_are_lifted_and_merged(spark):
    nodes, edges = frames(
        spark, [node("A"), node("B"), node("X", external=True), node("m1", "Method"), node("m2", "Method"), node("T", "DatabaseTable")],
        [("A", "m1", "HAS_METHOD"), ("B", "m2", "HAS_METHOD"), ("m1", "m2", "CALLS"), ("A", "B", "USES"), ("A", "X", "USES"), ("A", "A", "USES"), ("m2", "T", "READS_FROM")])
    assert [tuple(r) for r in g.type_edges(nodes, edges).collect()] == [("A", "B", ["CALLS", "USES"])]
    assert [tuple(r) for r in g.table_edges(nodes, edges).collect()] == [("B", "T", ["READS_FROM"])]


def test_layer_flow_without_a_table_keeps_every_flow_edge(spark):
    nodes, edges = frames(
        spark, [node("C", layer="Controller"), node("S", layer="Service"), node("R", layer="Repository"), node("M", layer="Mapper")],
        [("C", "S", "USES"), ("R", "M", "USES"), ("R", "S", "USES")])
    kept, flow = tr.layer_flow(nodes, edges)
    assert sorted((r.src, r.dst) for r in flow.collect()) == [("C", "S"), ("R", "M")]
    assert sorted(r.uid for r in kept.collect()) == ["C", "M", "R", "S"]


def test_delete_cascades_to_facts_and_containers(spark):
    nodes, edges = frames(
        spark,
        [node("pr", "Project", key=None), node("mo", "Module", key=None), node("pa", "Package", key=None), node("f1", "SourceFile", key="k1"), node("t1", key="k1"),
         node("pb", "Package", key=None), node("f2", "SourceFile", key="k2"), node("t2", key="k2")],
        [("pr", "mo", "CONTAINS", "k2"), ("mo", "pa", "CONTAINS", "k1"), ("pa", "f1", "CONTAINS", "k1"), ("f1", "t1", "DECLARES", "k1"),
         ("mo", "pb", "CONTAINS", "k2"), ("pb", "f2", "CONTAINS", "k2"), ("f2", "t2", "DECLARES", "k2")])
    key = lambda k: spark.createDataFrame([(k,)], "graph_key string")
    left, _ = g.delete_graph(nodes, edges, key("k1"))
    assert sorted(r.uid for r in left.collect()) == ["f2", "mo", "pb", "pr", "t2"]
    left, rest = g.delete_graph(nodes, edges, key("k2"))
    assert sorted(r.uid for r in left.collect()) == ["f1", "mo", "pa", "t1"] and rest.count() == 3


def test_overview_quota_may_exceed_a_small_limit(spark):
    nodes = [node(f"{label}{i}", label) for label in g.OVERVIEW_LABELS for i in range(3)]
    df, _ = frames(spark, nodes, [("a", "b", "USES")])
    assert g.overview(df, 1).count() == 21  # one of each label although 20 were asked for
    shown = g.overview(df, 50)
    assert shown.count() == 63 and shown.where("phase = 1").count() == 0
    few, _ = frames(spark, [node(f"m{i:02d}", "Method") for i in range(40)] + [node("t")], [("a", "b", "USES")])
    assert sorted(r.uid for r in g.overview(few, 20).collect()) == sorted([f"m{i:02d}" for i in range(19)] + ["t"])


def test_packages(spark):
    packages = spark.createDataFrame([("com.acme.shop.order",), ("com.acme.shop",), ("com.acme.shop.order.api.v1",), ("(default package)",)], "package_name string")
    assert g.common_prefix(packages).first().root == "com.acme.shop"
    assert g.common_prefix(spark.createDataFrame([("com.a",), ("com.b",)], "package_name string")).first().root == ""
    parents = {r.package: r.parent for r in g.nearest_parent(packages.where("package_name like 'com%'")).collect()}
    assert parents == {"com.acme.shop": None, "com.acme.shop.order": "com.acme.shop", "com.acme.shop.order.api.v1": "com.acme.shop.order"}
    tree = {r.path: r.type_count for r in g.package_tree(packages).collect()}
    assert tree["com"] == 3 and tree["com.acme.shop.order"] == 2 and tree["(default package)"] == 1


def test_node_merge_goes_through_the_observations_once(spark):
    obs = spark.createDataFrame(
        [("n", 2, "B", "b", True, {}), ("n", 1, "A", None, False, {"a": "1", "b": "1"}), ("n", 3, None, "c", None, {"b": None}),
         ("none", 1, None, "x", False, None), ("none", 2, "L", None, True, {}), (None, 1, "N", "n", False, {"a": "9"})],
        "uid string, seq int, label string, name string, external boolean, props map<string,string>")
    merged = g.merge_nodes(obs)
    assert {r.uid: tuple(r)[1:] for r in merged.collect()} == {
        "n": ("A", "c", None, {"a": "1", "b": None}), "none": (None, None, True, None), None: ("N", "n", False, {"a": "9"})}
    plan = g.merge_nodes(obs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ExistingRDD") == 1


def test_observations_of_a_part_come_together_before_they_are_sorted(spark):
    from cairn.plans.graph import merged_nodes

    plan = merged_nodes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("REBALANCE_PARTITIONS_BY_COL") == 1
    assert plan.index("REBALANCE_PARTITIONS_BY_COL") > plan.rindex("Sort [")


def test_node_merge_and_rules(spark):
    obs = spark.createDataFrame(
        [("n", 1, "JavaType", "old", True, {"a": "1", "b": "1"}), ("n", 2, "Other", "new", False, {"b": "2"}), ("n", 3, "Other", "newest", True, {"c": "3"})],
        "uid string, seq int, label string, name string, external boolean, props map<string,string>")
    assert tuple(g.merge_nodes(obs).first()) == ("n", "JavaType", "newest", True, {"a": "1", "b": "2", "c": "3"})
    nodes, edges = frames(
        spark, [node("C", layer="Controller"), node("D", layer="Controller"), node("R", layer="Repository"), node("I", layer="ServiceImpl"), node("J", layer="ServiceImpl"),
                node("S", layer="Service", name="UserService"), node("c", "Method"), node("r", "Method")],
        [("C", "c", "HAS_METHOD"), ("R", "r", "HAS_METHOD"), ("c", "r", "CALLS"), ("I", "S", "IMPLEMENTS")])
    assert {r.uid: r.type for r in g.controller_rule(nodes, edges).collect()} == {"C": "VIOLATES", "D": "CONFORMS_TO"}
    assert {r.uid: r.type for r in g.service_rule(nodes, edges).collect()} == {"I": "CONFORMS_TO", "J": "VIOLATES"}
    unknown = spark.createDataFrame([("C", "R", "weird", "k"), ("C", "R", "uses ", "k"), ("C", "none", "USES", "k")], EDGE)
    assert [tuple(r) for r in g.storable_edges(unknown, nodes).collect()] == [("C", "R", "USES", "k")]
    assert spark.range(1).select(g.safe_label(F.lit("Nope"))).first()[0] == "JavaType"


def test_an_overview_of_all_labels_keeps_every_node_and_edge(spark):
    nodes = [node(f"{label}:{i:02d}", label=label) for label in g.OVERVIEW_LABELS for i in range(30)]
    edges = [(f"{label}:{i:02d}", f"{label}:{i + 1:02d}", "CALLS") for label in g.OVERVIEW_LABELS for i in range(28)]
    n, e = frames(spark, nodes, edges)
    chosen = g.overview(n, 600)
    assert chosen.count() == 29 * len(g.OVERVIEW_LABELS)
    assert g.induced_edges(e, chosen).count() == len(edges)


def test_seeds_are_taken_in_the_order_of_their_hits(spark):
    rows = [("a", 3), ("b", 1), ("c", 2), (" ", 0), ("b", 9)]
    seeds = tr.seed_ids(spark.createDataFrame(rows, "uid string, hit int"), limit=2)
    assert {r.uid for r in seeds.collect()} == {"b", "c"}


def test_a_thousand_requests_equal_their_single_answers(spark):
    rng = random.Random(5)
    names = [f"n{i:03d}" for i in range(300)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(500)] + [("n000", n) for n in names[100:200]]
    nodes, edges = frames(spark, [node(n, project="q" if n.endswith("7") else "p") for n in names], [(a, b, "CALLS") for a, b in pairs])
    asked = [(r, uid) for r in range(1000) for uid in rng.sample([*names, "absent", " "], rng.choice((1, 1, 3)))]
    seeds = spark.createDataFrame(asked, "request int, uid string")
    got = {}
    for r in tr.neighbourhoods(nodes, edges, seeds, 3, "p", max_nodes=40).collect():
        got.setdefault(r.request, []).append((r.depth, r.uid))
    near = {n: set() for n in names}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    wanted = {}
    for r, uid in asked:
        wanted.setdefault(r, set()).add(uid)
    for r, start in wanted.items():
        found = {u: 0 for u in start if u in near and not u.endswith("7")}
        for hop in (1, 2, 3):
            for u in [u for u, d in found.items() if d == hop - 1]:
                for v in near[u]:
                    if not v.endswith("7"):
                        found.setdefault(v, hop)
        assert sorted(got.get(r, [])) == sorted((d, u) for u, d in found.items())[:40]
    some = [r for r in range(1000) if r in got][:2]
    for r in some:
        one = tr.neighbourhood(nodes, edges, seeds.where(F.col("request") == r).select("uid"), 3, "p", max_nodes=40)
        assert sorted((x.depth, x.uid) for x in one.collect()) == sorted(got[r])
    visited = spark.createDataFrame([(r, u) for r in some for _, u in got[r]], "request int, uid string")
    inside = {(x.request, x.src, x.dst) for x in tr.neighbourhoods_edges(edges, visited).collect()}
    assert inside == {(r, a, b) for r in some for a, b in pairs if {a, b} <= {u for _, u in got[r]}}


def _written(spark, action):
    """Records that an action's stages shuffled, with joins that shuffle."""
    status, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        empty = spark._jvm.java.util.ArrayList
        stages = status.stageList(empty(), False, False, gateway.new_array(gateway.jvm.double, 0), empty())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before, limit = total(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = action()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    return result, sum(n for k, n in total().items() if k not in before)


def test_requests_at_one_hub_do_not_each_fetch_all_its_neighbours(spark):
    names = [f"t{i:04}" for i in range(600)]
    nodes, edges = frames(spark, [node(n) for n in [*names, "hub"]], [("hub", n, "CALLS") for n in names])
    seeds = spark.createDataFrame([(n, n) for n in names], "request string, uid string")
    got, written = _written(spark, lambda: tr.neighbourhoods(nodes, edges, seeds, 2, "p", max_nodes=5).collect())
    around = {}
    for r in got:
        around.setdefault(r.request, {})[r.uid] = r.depth
    for n in names:
        assert around[n] == {n: 0, "hub": 1, **dict.fromkeys([m for m in names if m != n][:3], 2)}
    assert written < 100_000  # 360,000 neighbours in all
    visited = spark.createDataFrame([(r.request, r.uid) for r in got], "request string, uid string")
    inside, written = _written(spark, lambda: tr.neighbourhoods_edges(edges, visited).collect())
    assert {(x.request, x.dst) for x in inside} == {(n, m) for n in names for m in around[n] if m != "hub"} and len(inside) == 4 * 600
    assert written < 50_000


def test_calls_outside_a_package_leave_before_they_are_gathered(spark):
    nodes = spark.createDataFrame([(u, "JavaType", x, p) for u, x, p in [("A", False, "p"), ("B", False, "q"), ("C", False, "q"), ("X", True, "p")]]
                                  + [("T", "DatabaseTable", False, None)], "uid string, label string, external boolean, package_name string")
    edges = spark.createDataFrame(
        [(t, f"{t}.m", "HAS_METHOD") for t in "ABCX"]
        + [(f"{a}.m", f"{b}.m", "CALLS") for a, b in ["AB", "CA", "BC", "AX", "XA", "AA"]]
        + [("A", "C", "USES"), ("B", "C", "USES"), ("X", "A", "USES")], "src string, dst string, type string")
    found = g.package_scope(nodes, edges, "p")
    assert {tuple(r) for r in found.collect()} == {("A", "B", "CALLS"), ("C", "A", "CALLS"), ("A", "C", "USES")}
    assert {tuple(r) for r in g.package_scope(nodes, edges, "q", related=False).collect()} == {("B", "C", "CALLS"), ("B", "C", "USES")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The types' package comes with the owners; links aren't joined with the package's types afterwards.
    assert "LeftOuter" not in plan


def test_packages_and_stages_meet_the_links_once(spark):
    nodes, edges = frames(
        spark, [node("C", layer="Controller", package="a"), node("S", layer="Service", package="b"), node("D", layer="Domain", package="b"),
                node("X", layer="Service", package="c", external=True), *[node(m, "Method") for m in ("c1", "s1", "d1", "x1")]],
        [("C", "c1", "HAS_METHOD"), ("S", "s1", "HAS_METHOD"), ("D", "d1", "HAS_METHOD"), ("X", "x1", "HAS_METHOD"), ("c1", "s1", "CALLS"),
         ("s1", "c1", "CALLS"), ("c1", "d1", "CALLS"), ("c1", "x1", "CALLS"), ("C", "S", "USES"), ("C", "D", "USES"), ("C", "C", "USES")])
    matrix = g.package_matrix(nodes, edges)
    assert {tuple(r)[:3]: r["types"] for r in matrix.collect()} == {("a", "b", 2): ["CALLS", "USES"], ("b", "a", 1): ["CALLS"]}
    assert matrix._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4  # the owners of both ends, the packages of both
    _, flow = tr.layer_flow(nodes, edges)
    assert [tuple(r) for r in flow.collect()] == [("C", "S", "CALLS, USES")]
