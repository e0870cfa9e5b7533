"""Iterative graph operators: neighbourhood, layer flow, strongly connected groups, cycle paths.

Every round is a join against the frontier followed by ``cut``: the small result is written to the
shared folder, so plans stay short and a lost executor costs one round. Counts of those written
frames end the loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions.text import clamp, non_blank
from cairn.operators.graph import RELATIONSHIP_TYPES, internal_types, role, staged_edges, table_edges
from cairn.session import cut

# Limits of a neighbourhood, the relationships it may follow, stages of the layer flow.
MAX_SEEDS, MAX_DEPTH, MAX_NODES, MAX_EDGES = 100, 6, 600, 5000
NEIGHBOURHOOD_TYPES = tuple(t for t in RELATIONSHIP_TYPES if t not in ("CONTAINS", "GENERATED", "INGESTED"))
MAX_ROUND_TABLES = 12  # written rounds kept apart before they are merged into one table
FLOW_STAGE = {"Controller": 0, "Service": 1, "Repository": 2, "Mapper": 2, "DatabaseTable": 3}


def seed_ids(ids: DataFrame, column: str = "uid", limit: int = MAX_SEEDS) -> DataFrame:
    """Distinct non-blank ids, the first ``limit`` in the order of ``hit`` where there is one, then of the id."""
    hit = F.col("hit") if "hit" in ids.columns else F.lit(0)
    trimmed = ids.select(non_blank(F.col(column)).alias("uid"), hit.alias("hit")).where(F.col("uid").isNotNull())
    return trimmed.groupBy("uid").agg(F.min("hit").alias("hit")).orderBy("hit", "uid").limit(limit)


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, project: str = "",
                  max_nodes: int = MAX_NODES, types: tuple[str, ...] = NEIGHBOURHOOD_TYPES) -> DataFrame:
    """Nodes within ``depth`` undirected hops of the seeds, in order (depth, uid), at most ``max_nodes``.

    Nearer nodes always come first, so each hop keeps just as many new nodes as still fit: if more
    arrive the result is full and no deeper hop can change it. The frontier and the visited set
    therefore never exceed the node limit, which is what makes them safe to broadcast.
    """
    depth, max_nodes = clamp(depth, 1, MAX_DEPTH), clamp(max_nodes, 1, MAX_NODES)
    allowed = nodes.where(F.col("project_id") == project) if project else nodes
    allowed = allowed.select("uid")
    both_ways = edges.where(F.col("type").isin(*types)).select(
        F.explode(F.array(F.struct(F.col("src").alias("near"), F.col("dst").alias("uid")),
                          F.struct(F.col("dst").alias("near"), F.col("src").alias("uid")))).alias("e")).select("e.*")
    start = seed_ids(seeds)
    visited = cut(allowed.join(F.broadcast(start), "uid").orderBy("hit", "uid").limit(max_nodes)
                  .select("uid", F.lit(0).alias("depth")))
    frontier, size = visited, visited.count()
    for hop in range(1, depth + 1):
        if size == 0 or size >= max_nodes:
            break
        reached = both_ways.join(F.broadcast(frontier.select(F.col("uid").alias("near"))), "near", "left_semi").select("uid").distinct()
        new = reached.join(F.broadcast(visited), "uid", "left_anti").join(allowed, "uid", "left_semi")
        frontier = cut(new.orderBy("uid").limit(max_nodes - size).select("uid", F.lit(hop).alias("depth")))
        found = frontier.count()
        if found == 0:
            break
        visited = cut(visited.unionByName(frontier))
        size += found
    return visited


def neighbourhood_edges(edges: DataFrame, visited: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """Relationships with both ends in a neighbourhood, which never has more than ``MAX_NODES`` nodes; ordered, capped."""
    ids = F.broadcast(visited.select("uid"))
    inside = edges.join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    return inside.select("type", "src", "dst", "graph_key").orderBy("type", "src", "dst", "graph_key").limit(clamp(limit, 1, MAX_EDGES))


def neighbourhoods(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, project: str = "",
                   max_nodes: int = MAX_NODES, types: tuple[str, ...] = NEIGHBOURHOOD_TYPES) -> DataFrame:
    """``neighbourhood`` of many requests at once: request, uid, depth from the seeds (request, uid) of each.

    Frontier and visited nodes are keyed by request and grow together, so hops and not requests set the number of jobs.
    Every request has a node limit of its own. Their number isn't bounded, so nothing is broadcast by hand.

    Only the first ``max_nodes`` allowed neighbours of a node are joined to the requests that reach it: no more than the
    visited ones of a request drop out, and the others fill its room. So a node of high degree doesn't send all its
    neighbours to each of its many requests.
    """
    depth, max_nodes = clamp(depth, 1, MAX_DEPTH), clamp(max_nodes, 1, MAX_NODES)
    allowed = (nodes.where(F.col("project_id") == project) if project else nodes).select("uid")
    both_ways = edges.where(F.col("type").isin(*types)).select(
        F.explode(F.array(F.struct(F.col("src").alias("near"), F.col("dst").alias("uid")),
                          F.struct(F.col("dst").alias("near"), F.col("src").alias("uid")))).alias("e")).select("e.*")

    def first(rows: DataFrame, limit, *order: str, by: str = "request") -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")

    hit = F.col("hit") if "hit" in seeds.columns else F.lit(0)
    named = seeds.select("request", non_blank(F.col("uid")).alias("uid"), hit.alias("hit")).where("uid IS NOT NULL AND request IS NOT NULL")
    asked = first(named.groupBy("request", "uid").agg(F.min("hit").alias("hit")), MAX_SEEDS, "hit", "uid")
    visited = cut(first(asked.join(allowed, "uid", "left_semi"), max_nodes, "hit", "uid").select("request", "uid", F.lit(0).alias("depth")))
    frontier = visited
    for hop in range(1, depth + 1):
        room = visited.groupBy("request").agg((max_nodes - F.count(F.lit(1))).alias("room")).where("room > 0")
        asking = frontier.join(room, "request").select("request", "room", F.col("uid").alias("near"))
        found = both_ways.join(asking.select("near").distinct(), "near", "left_semi").distinct().join(allowed, "uid", "left_semi")
        step = asking.join(first(found, max_nodes, "uid", by="near"), "near")
        new = step.select("request", "room", "uid").distinct().join(visited, ["request", "uid"], "left_anti")
        frontier = cut(first(new, F.least(F.col("room"), F.lit(max_nodes)), "uid").select("request", "uid", F.lit(hop).alias("depth")))
        if frontier.isEmpty():
            break
        visited = cut(visited.unionByName(frontier))
    return visited


def neighbourhoods_edges(edges: DataFrame, visited: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """Relationships inside each request's neighbourhood, ordered and capped for each request.

    An edge is handed to the requests that hold the rarer of its ends, and they are asked for the other one.
    """
    ends = visited.select("request", "uid")
    held = ends.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    known = edges.select("type", "src", "dst", "graph_key").join(held.select(F.col("uid").alias("src"), F.col("n").alias("_s")), "src").join(
        held.select(F.col("uid").alias("dst"), F.col("n").alias("_d")), "dst")
    rarer = F.col("_s") <= F.col("_d")
    sided = known.select("type", "src", "dst", "graph_key", F.when(rarer, F.col("src")).otherwise(F.col("dst")).alias("near"),
                         F.when(rarer, F.col("dst")).otherwise(F.col("src")).alias("far"))
    inside = sided.join(ends.withColumnRenamed("uid", "near"), "near").join(ends.withColumnRenamed("uid", "far"), ["request", "far"], "left_semi")
    place = F.row_number().over(W.partitionBy("request").orderBy("type", "src", "dst", "graph_key"))
    return inside.withColumn("_n", place).where(F.col("_n") <= clamp(limit, 1, MAX_EDGES)).select("request", "type", "src", "dst", "graph_key")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All nodes reachable along ``edges`` (src, dst) from ``start`` (uid), the start included."""
    frontier = cut(start.select("uid").distinct())
    rounds = [frontier]
    while True:
        visited = reduce(DataFrame.union, rounds)
        step = edges.join(frontier.withColumnRenamed("uid", "src"), "src", "left_semi").select(F.col("dst").alias("uid")).distinct()
        frontier = cut(step.join(visited, "uid", "left_anti"))
        if frontier.isEmpty():
            return visited
        rounds.append(frontier)
        if len(rounds) > MAX_ROUND_TABLES:
            rounds = [cut(reduce(DataFrame.union, rounds))]


def layer_flow(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (with stage) and edges of the controller-to-database flow.

    Edges never lead to an earlier stage. What controllers reach is kept; when no table is among it,
    every end of a flow edge is kept instead.
    """
    stage = F.lit(None).cast("int")
    kind = role(F.col("label"), F.col("layer"))
    for name, value in FLOW_STAGE.items():
        stage = F.when(kind == name, value).otherwise(stage)
    staged = cut(nodes.select("uid", "label", "name", "external", kind.alias("role"), stage.alias("stage")).where(F.col("stage").isNotNull()))
    ends = staged.select("uid", "stage")
    to_tables = (
        table_edges(nodes, edges).join(ends.select(F.col("uid").alias("src"), F.col("stage").alias("src_stage")), "src")
        .join(ends.select(F.col("uid").alias("dst"), F.col("stage").alias("dst_stage")), "dst")
        .where((F.col("src_stage") <= F.col("dst_stage")) & (F.col("src") != F.col("dst")))
    )
    flow = staged_edges(internal_types(staged).select("uid", "stage"), edges).unionByName(to_tables.select("src", "dst", "types"))
    # A pair can be a type and a table edge only for different node kinds, so pairs stay unique.
    flow = cut(flow.select("src", "dst", F.array_join("types", ", ").alias("types")))
    controllers = internal_types(staged).where(F.col("role") == "Controller").select("uid")
    included = reachable(flow.select("src", "dst"), controllers)
    tables = staged.where(F.col("label") == "DatabaseTable").join(included, "uid", "left_semi")
    if tables.isEmpty():
        included = cut(flow.select(F.explode(F.array("src", "dst")).alias("uid")).distinct())
    kept = staged.join(included, "uid", "left_semi")
    kept_edges = flow.join(included.withColumnRenamed("uid", "src"), "src", "left_semi").join(
        included.withColumnRenamed("uid", "dst"), "dst", "left_semi").select("src", "dst", "types")
    return kept, kept_edges


def _trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Drop edges at nodes without an incoming or an outgoing edge; they lie on no cycle."""
    for _ in range(rounds):
        edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
            edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    return edges


def _forward_colors(edges: DataFrame) -> DataFrame:
    """Greatest id that reaches each node (its color), by label propagation."""
    color = cut(edges.select(F.explode(F.array("src", "dst")).alias("uid")).distinct().withColumn("color", F.col("uid")))
    changed = color
    while True:
        pushed = edges.join(changed.select(F.col("uid").alias("src"), "color"), "src").groupBy(F.col("dst").alias("uid")).agg(
            F.max("color").alias("pushed"))
        new = color.join(pushed, "uid", "left").select(
            "uid", F.greatest("color", "pushed").alias("color"), (F.col("pushed") > F.col("color")).alias("_moved"))
        new = cut(new)
        changed = new.where(F.col("_moved"))
        color = new.select("uid", "color")
        if changed.isEmpty():
            return color


def strongly_connected(edges: DataFrame) -> DataFrame:
    """Members of every strongly connected group of at least two nodes, named by its least member.

    Forward colors split the graph; within a color, what reaches the color's own node backwards is its
    group. Found groups leave the graph and the rest goes round again.
    """
    remaining = _trimmed(cut(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct()))
    groups = remaining.select(F.col("src").alias("uid"), F.col("src").alias("color")).limit(0)
    while not remaining.isEmpty():
        color = _forward_colors(remaining)
        same = cut(
            remaining.join(color.select(F.col("uid").alias("src"), F.col("color").alias("c")), "src")
            .join(color.select(F.col("uid").alias("dst"), F.col("color").alias("c")), ["dst", "c"], "left_semi")
            .select("src", "dst", "c"))
        backwards = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = reachable(backwards, color.where(F.col("uid") == F.col("color")).select("uid"))
        found = cut(color.join(members, "uid", "left_semi"))
        groups = groups.unionByName(found)
        rest = same.join(members.withColumnRenamed("uid", "src"), "src", "left_anti").join(
            members.withColumnRenamed("uid", "dst"), "dst", "left_anti").select("src", "dst")
        remaining = _trimmed(rest, 1)
    sizes = groups.groupBy("color").agg(F.count(F.lit(1)).alias("size"), F.min("uid").alias("component")).where("size > 1")
    return groups.join(sizes, "color").select("component", F.col("uid").alias("member"), "size")


def cycle_paths(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One shortest cycle per group through its least member, the alphabetically first of those.

    Breadth first from that member; every node keeps only its first-reached, least path, so the
    frontier holds at most one row per member.
    """
    m = members.select("component", "member")
    inside = cut(
        edges.select("src", "dst").distinct()
        .join(m.select("component", F.col("member").alias("src")), "src")
        .join(m.select("component", F.col("member").alias("dst")), ["component", "dst"], "left_semi")
        .select("component", "src", "dst"))
    frontier = cut(m.select("component", F.col("component").alias("node"), F.array("component").alias("path")).distinct())
    visited = frontier.select("component", "node")
    done = None
    while True:
        step = frontier.withColumnRenamed("node", "src").join(inside, ["component", "src"]).select(
            "component", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        best = cut(step.groupBy("component", "node").agg(F.min("path").alias("path")))
        closed = best.where(F.col("node") == F.col("component")).select("component", "path")
        done = closed if done is None else done.unionByName(closed.join(done, "component", "left_anti"))
        frontier = cut(best.join(visited, ["component", "node"], "left_anti").join(done, "component", "left_anti"))
        if frontier.isEmpty():
            return done
        visited = cut(visited.unionByName(frontier.select("component", "node")))
