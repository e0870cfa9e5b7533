"""A property graph kept in Parquet partitions, changed one graph key at a time.

    nodes/key_bucket=…   uid, label, graph_key, props
    edges/key_bucket=…   src, dst, type, graph_key, props
    places/uid_bucket=…  uid, node_bucket: where a node is stored
    ends/uid_bucket=…    uid, graph_key, n: how many edges of each key touch it
    pending/             facts that came without edges and containers, not tested since

Nodes and edges lie in the bucket of their graph key, so writing or deleting a key rewrites that bucket and no other,
unless a node is shared with other keys. What touches a node is looked up in the bucket of its id; nothing reads all
edges. Partitions are replaced by dynamic overwrite: a rewritten bucket always holds one row without an id, as a bucket
without rows would stay as it was. Only bucket numbers come to the driver, at most ``buckets`` of them.

What a call writes on its way is removed when it ends (``scratch``).

Running a call again after it broke off gives its result: edges, which say what a call has to do, are written last.
Callers that change the same store take turns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.graph import CONTAINER_LABELS, CONTAINMENT, FACT_LABELS, merge_nodes, safe_relationship
from cairn.session import scratch

NODES = "uid string, label string, graph_key string, props map<string,string>"
EDGES = "src string, dst string, type string, graph_key string, props map<string,string>"
PLACES = "uid string, node_bucket int"
ENDS = "uid string, graph_key string, n long"
_KEYED = {"nodes": (NODES, "key_bucket"), "edges": (EDGES, "key_bucket"), "places": (PLACES, "uid_bucket"), "ends": (ENDS, "uid_bucket")}
_FIRST = {"nodes": "uid", "edges": "src", "places": "uid", "ends": "uid"}

Cut = Callable[[DataFrame], DataFrame]

# Properties that are never stored.
UNSTORED = ("sourceContent", "content")


def _ends() -> Column:
    """The nodes of an edge; one for a loop."""
    return F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))


def _counted(edges: DataFrame) -> DataFrame:
    """uid, graph_key, n: how many of these edges touch a node, by their key."""
    return edges.select(F.explode(_ends()).alias("uid"), "graph_key").groupBy("uid", "graph_key").agg(F.count(F.lit(1)).alias("n"))


def _touching(edges: DataFrame, uids: DataFrame) -> DataFrame:
    """Edges with a column ``touches``: one of its ends is among ``uids``, which are distinct."""
    src, dst = (uids.select(F.col("uid").alias(end), F.lit(True).alias(f"_{end}")) for end in ("src", "dst"))
    found = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
    return edges.join(src, "src", "left").join(dst, "dst", "left").select(*edges.columns, found.alias("touches"))


def _marked(edges: DataFrame, keys: DataFrame, dead: DataFrame) -> DataFrame:
    """Edges with a column ``gone``: their key is deleted, or one of their ends is among the dead containers.

    What is deleted is told from keys and containers, which are few; the deleted edges are never gathered themselves.
    """
    found = F.col("_key").isNotNull() | F.col("touches")
    edges_of = _touching(edges, dead).join(keys.select("graph_key", F.lit(True).alias("_key")), "graph_key", "left")
    return edges_of.select(*edges.columns, found.alias("gone"))


def merged_properties(old: Column, new: Column) -> Column:
    """New values over old ones; null maps are empty."""
    nothing = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, nothing), F.coalesce(new, nothing)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    # Reading

    def _table(self, name: str, within: list[int] | None = None, markers: bool = False) -> DataFrame:
        """A table, or some of its buckets: the others' folders aren't listed in the scan."""
        schema, bucket = _KEYED[name]
        try:
            rows = self.spark.read.schema(f"{schema}, {bucket} int").parquet(f"{self.path}/{name}")
        except Exception as missing:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = self.spark.createDataFrame([], f"{schema}, {bucket} int")
        rows = rows if markers else rows.where(F.col(_FIRST[name]).isNotNull())
        return rows if within is None else rows.where(F.col(bucket).isin(within))

    def nodes(self) -> DataFrame:
        return self._table("nodes").drop("key_bucket")

    def edges(self) -> DataFrame:
        return self._table("edges").drop("key_bucket")

    def _bucket(self, column: str | Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _numbers(self, *columns: DataFrame) -> list[int]:
        """The distinct bucket numbers in one-column frames."""
        every = reduce(DataFrame.union, columns).distinct()
        return sorted(r[0] for r in every.collect() if r[0] is not None)

    def _at(self, name: str, uids: DataFrame) -> DataFrame:
        """Rows of ``places`` or ``ends`` for the nodes in ``uids``, from their buckets."""
        within = self._numbers(uids.select(self._bucket("uid")))
        return self._table(name, within).join(uids.select("uid"), "uid", "left_semi")

    def _stored(self, uids: DataFrame) -> DataFrame:
        """Stored nodes of ``uids``, from the buckets they are in."""
        within = self._numbers(self._at("places", uids).select("node_bucket"))
        return self._table("nodes", within).join(uids.select("uid"), "uid", "left_semi")

    def _key_buckets(self, uids: DataFrame) -> list[int]:
        """Buckets of the keys whose edges touch a node of ``uids``."""
        return self._numbers(self._at("ends", uids).select(self._bucket("graph_key")))

    def _edges_of(self, uids: DataFrame) -> DataFrame:
        """Stored edges that touch a node of ``uids``, from the buckets of the keys that their ends name."""
        return _touching(self._table("edges", self._key_buckets(uids)), uids).where("touches").drop("touches")

    # Replacing

    def _replace(self, name: str, rows: DataFrame, within: list[int]) -> None:
        """The buckets ``within`` get these rows instead of theirs.

        A bucket can hold a key with most of all rows, so a large one is dealt to several tasks and files.
        """
        if not within:
            return
        schema, bucket = _KEYED[name]
        columns = [*self.spark.createDataFrame([], schema).columns, bucket]
        marker = self.spark.createDataFrame([(b,) for b in within], f"{bucket} int")
        full = rows.select(*columns).unionByName(marker, allowMissingColumns=True).hint("rebalance", F.col(bucket))
        full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(f"{self.path}/{name}")

    def _without(self, name: str, gone: DataFrame, keys: list[str], within: list[int]) -> None:
        rows = self._table(name, within)
        self._replace(name, rows.join(gone.select(*keys).distinct(), keys, "left_anti"), within)

    def _count_ends(self, added: DataFrame) -> None:
        """Counts of edges by end and key, raised by these (uid, graph_key, n); only the ends' buckets are rewritten."""
        within = self._numbers(added.select(self._bucket("uid")))
        old = self._table("ends", within).select("uid", "graph_key", "n")
        if not old.isEmpty():
            added = old.unionByName(added).groupBy("uid", "graph_key").agg(F.sum("n").alias("n"))
        self._replace("ends", added.withColumn("uid_bucket", self._bucket("uid")), within)

    def _discount_ends(self, keys: DataFrame, change: DataFrame, cut: Cut) -> None:
        """The counts without deleted keys, and lowered by the deleted edges (uid, graph_key, n) of other keys."""
        within = self._numbers(change.select(self._bucket("uid")))
        lost = cut(change.join(keys, "graph_key", "left_anti").groupBy("uid", F.col("graph_key").alias("_key")).agg(F.sum("n").alias("_n")))
        old = self._table("ends", within).join(keys, "graph_key", "left_anti").withColumnRenamed("uid", "_uid")
        left = old.join(lost, F.col("uid").eqNullSafe(F.col("_uid")) & F.col("_key").eqNullSafe(F.col("graph_key")), "left")
        left = left.select(F.col("_uid").alias("uid"), "graph_key", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"), "uid_bucket")
        self._replace("ends", left.where("n > 0"), within)

    # Changing

    def write(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Merge nodes (uid, seq, label, props) and edges (src, dst, type, graph_key, props) into the store.

        Properties go over stored ones, the stored label stays, source texts are dropped; ``graphKey`` among the
        properties is the node's key, under which it lies from now on. An edge is stored once per (src, type, key, dst),
        with a known type, if both its ends are there.
        """
        with scratch(self.spark) as cut:
            with scratch(self.spark) as brief:
                merged, node_buckets = self._merged_nodes(nodes, brief)
                edges = self._merged_edges(edges, merged.select("uid"), cut)
                given = edges.where("given").select(F.explode(_ends()).alias("uid"), "graph_key", F.when(~F.col("known"), 1).otherwise(0).cast("long").alias("n"))
                given = brief(given.groupBy("uid", "graph_key").agg(F.sum("n").alias("n")))

                self._loose(merged, given).write.mode("append").parquet(f"{self.path}/pending")
                unchanged = self._table("nodes", node_buckets).join(merged.select("uid"), "uid", "left_anti")
                self._replace("nodes", unchanged.unionByName(merged), node_buckets)
                places = merged.select("uid", F.col("key_bucket").alias("node_bucket"), self._bucket("uid").alias("uid_bucket"))
                within = self._numbers(places.select("uid_bucket"))
                self._replace("places", self._table("places", within).join(places.select("uid"), "uid", "left_anti").unionByName(places), within)

                within = self._numbers(given.select(self._bucket("graph_key")))
                self._count_ends(given.where("n > 0"))
            self._replace("edges", edges.where(F.col("key_bucket").isin(within)), within)

    def _merged_nodes(self, nodes: DataFrame, cut: Cut) -> tuple[DataFrame, list[int]]:
        """The nodes as they will be stored, and the buckets they are or will be in."""
        kept = F.map_filter("props", lambda k, v: ~k.isin(*UNSTORED) & v.isNotNull())
        none = F.lit(None).cast("string")
        with scratch(self.spark) as brief:
            new = brief(merge_nodes(nodes.select("uid", "seq", "label", kept.alias("props"), none.alias("name"), none.alias("external"))).select(
                "uid", "label", "props"))
            old = brief(self._stored(new))
            merged = new.join(old.select("uid", F.col("label").alias("_label"), F.col("props").alias("_props"), F.col("graph_key").alias("_key")), "uid", "left")
            props = merged_properties(F.col("_props"), F.col("props"))
            merged = merged.select(
                "uid", F.coalesce("_label", "label").alias("label"), F.coalesce(props["graphKey"], "_key").alias("graph_key"), props.alias("props"))
            merged = cut(merged.withColumn("key_bucket", self._bucket("graph_key")))
            return merged, self._numbers(merged.select("key_bucket"), old.select("key_bucket"))

    def _merged_edges(self, edges: DataFrame, known: DataFrame, cut: Cut) -> DataFrame:
        """Given edges with both ends among the ``known`` or stored nodes, over the stored ones of their keys' buckets.

        ``known``: it is stored; ``given``: it was among ``edges``. Both tables meet in one pass, once per edge, and the
        ends are asked for by node, so that only ends that are missing are looked up for each edge.
        """
        on, nothing = ["src", "dst", "type", "graph_key"], F.lit(None).cast("map<string,string>")
        typed = edges.withColumn("type", safe_relationship(F.col("type"))).where("src IS NOT NULL AND dst IS NOT NULL")
        typed = typed.select(*on, nothing.alias("old"), F.col("props").alias("new"), F.lit(False).alias("known"), F.lit(True).alias("given"))
        anything = not self._table("places").isEmpty()
        with scratch(self.spark) as brief:
            if anything:
                typed = brief(typed)
                stored = self._table("edges", self._numbers(typed.select(self._bucket("graph_key"))))
                typed = typed.unionByName(stored.select(*on, F.col("props").alias("old"), nothing.alias("new"), F.lit(True).alias("known"), F.lit(False).alias("given")))
            every = cut(typed.repartition(*on).groupBy(*on).agg(
                F.first("old", True).alias("old"), F.first("new", True).alias("new"), F.max("known").alias("known"), F.max("given").alias("given")))
        uids = every.where("given").select(F.explode(_ends()).alias("uid")).distinct()
        missing = cut(uids.join(known, "uid", "left_anti"))
        if anything:
            missing = cut(missing.join(self._at("places", missing).where("node_bucket IS NOT NULL"), "uid", "left_anti"))
        every = _touching(every, missing).withColumn("given", F.col("given") & ~F.col("touches")).where("known OR given")
        props = F.when(F.col("known"), merged_properties(F.col("old"), F.when(F.col("given"), F.col("new")))).otherwise(F.col("new"))
        return every.select(*on, props.alias("props"), "known", "given", self._bucket("graph_key").alias("key_bucket"))

    def _loose(self, nodes: DataFrame, ends: DataFrame) -> DataFrame:
        """Facts of a write that are no end of an edge of it, and its outer containers, which are few."""
        facts = nodes.where(F.col("label").isin(*FACT_LABELS)).join(ends, "uid", "left_anti").select("uid")
        return facts.union(nodes.where(F.col("label").isin(*[o for o, _ in CONTAINMENT])).select("uid"))

    def _pending(self) -> DataFrame:
        try:
            return self.spark.read.schema("uid string").parquet(f"{self.path}/pending").distinct()
        except Exception as missing:  # nothing was written
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], "uid string")

    def delete(self, graph_keys: DataFrame, containment=CONTAINMENT) -> None:
        """Delete graphs by key: their edges and containers, facts that no edge touches then, containers left empty.

        Only nodes that a deleted edge touched, or that came without edges since the last deletion, can be left alone
        or empty, so only they are tested.
        """
        with scratch(self.spark) as cut:
            keys = cut(graph_keys.select("graph_key").distinct())
            within = self._numbers(keys.select(self._bucket("graph_key")))
            emptied = containers = cut(self._table("nodes", within).where(F.col("label").isin(*CONTAINER_LABELS)).join(keys, "graph_key", "left_semi").select("uid"))
            within = sorted({*within, *self._key_buckets(containers)})
            change = cut(_counted(_marked(self._table("edges", within), keys, containers).where("gone")))

            lost = change.select("uid", F.col("n").alias("lost")).unionByName(self._pending().withColumn("lost", F.lit(0).cast("long")))
            touched = cut(lost.groupBy("uid").agg(F.sum("lost").alias("lost")))
            left = self._at("ends", touched).groupBy("uid").agg(F.sum("n").alias("n"))
            alone = touched.join(left, "uid", "left").where(F.coalesce("n", F.lit(0)) <= F.col("lost")).select("uid")
            outers = [outer for outer, _ in containment]
            near = cut(self._stored(touched).where(F.col("label").isin(*FACT_LABELS, *outers)).join(containers, "uid", "left_anti").select("uid", "label"))
            facts = near.where(F.col("label").isin(*FACT_LABELS)).join(alone, "uid", "left_semi").select("uid")
            dead = cut(containers.union(facts))
            near = cut(near.where(F.col("label").isin(*outers)))
            for outer, inner in containment:
                asked = cut(near.where(F.col("label") == outer).select("uid"))
                held = _marked(self._edges_of(asked).where(F.col("type") == "CONTAINS"), keys, emptied).where("NOT gone")
                held = cut(held.join(asked.withColumnRenamed("uid", "src"), "src", "left_semi").select("src", "dst"))
                inside = self._stored(held.select(F.col("dst").alias("uid")).distinct()).where(F.col("label") == inner)
                inside = inside.join(dead, "uid", "left_anti").select(F.col("uid").alias("dst"))
                holders = held.join(inside, "dst", "left_semi").select(F.col("src").alias("uid"))
                empty = cut(asked.join(holders, "uid", "left_anti"))
                also = cut(_marked(self._edges_of(empty), keys, emptied).where("NOT gone").select("src", "dst", "graph_key"))
                change = change.unionByName(_counted(also))
                emptied, dead = cut(emptied.union(empty)), cut(dead.union(empty))
                outer_of = self._stored(also.select(F.explode(_ends()).alias("uid")).distinct()).where(F.col("label").isin(*outers))
                near = cut(near.unionByName(outer_of.select("uid", "label")).distinct().join(emptied, "uid", "left_anti"))

            places = cut(self._at("places", dead).select("uid", "node_bucket", "uid_bucket"))
            self._without("nodes", places, ["uid"], self._numbers(places.select("node_bucket")))
            self._without("places", places, ["uid"], self._numbers(places.select("uid_bucket")))
            self.spark.createDataFrame([], "uid string").write.mode("overwrite").parquet(f"{self.path}/pending")
            self._discount_ends(keys, change, cut)
            within = self._numbers(change.select(self._bucket("graph_key")))
            self._replace("edges", _marked(self._table("edges", within), keys, emptied).where("NOT gone"), within)
