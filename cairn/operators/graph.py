"""Property-graph operators that need no iteration: lifting, merging, counts, packages, overviews."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions.text import clamp, first_text, non_blank
from cairn.operators.ordering import positions
from cairn.session import cut

# The closed ontology and the relationship sets of the analyses.
NODE_LABELS = (
    "Project", "Module", "Package", "SourceFile", "JavaType", "Method", "Field", "ApiEndpoint", "Service",
    "Repository", "DTO", "Domain", "Mapper", "DatabaseTable", "DatabaseColumn", "SqlStatement", "Document",
    "Chunk", "StandardRule", "StandardTemplate", "Generation", "ConfigurationFile", "ConfigurationProperty",
    "Bean", "Profile", "Provider",
)
RELATIONSHIP_TYPES = (
    "CONTAINS", "DECLARES", "HAS_METHOD", "HAS_FIELD", "IMPORTS", "EXTENDS", "IMPLEMENTS", "INJECTS", "USES",
    "CALLS", "HANDLED_BY", "READS_FROM", "WRITES_TO", "MAPS_TO", "USES_DTO", "CONFORMS_TO", "VIOLATES",
    "DESCRIBES", "EVIDENCE_FOR", "BASED_ON", "HAS_COLUMN", "EXECUTES", "HAS_SOURCE", "GENERATED", "INGESTED",
    "HAS_MAPPER_XML", "HAS_STATEMENT", "REFERENCES_COLUMN", "DEFINES", "CONFIGURES", "ACTIVATES",
)
CLASSIFICATIONS = ("Service", "Repository", "DTO", "Domain", "Mapper")
TYPE_RELATIONSHIPS = ("IMPORTS", "INJECTS", "IMPLEMENTS", "EXTENDS", "USES", "USES_DTO", "MAPS_TO")
TABLE_RELATIONSHIPS = ("READS_FROM", "WRITES_TO", "MAPS_TO")
MERGED_TYPES = (*TYPE_RELATIONSHIPS, "CALLS", "READS_FROM", "WRITES_TO")
DEPENDENCY_RELATIONSHIPS = (
    "IMPORTS", "EXTENDS", "IMPLEMENTS", "INJECTS", "USES", "USES_DTO", "CALLS", "READS_FROM", "WRITES_TO",
    "MAPS_TO", "EXECUTES", "HAS_STATEMENT", "HAS_MAPPER_XML",
)
OVERVIEW_LABELS = (
    "Project", "Module", "Package", "SourceFile", "JavaType", "Method", "Field", "ApiEndpoint", "DatabaseTable",
    "DatabaseColumn", "SqlStatement", "Document", "Chunk", "StandardRule", "StandardTemplate", "Generation",
    "ConfigurationFile", "ConfigurationProperty", "Bean", "Profile", "Provider",
)
DEFAULT_PACKAGE = "(default package)"
LABEL_LIMIT = 100
LABEL_EDGE_LIMIT = 500
DETAIL_EDGE_LIMIT = 500


def safe_label(label: Column) -> Column:
    return F.when(label.isin(*NODE_LABELS), label).otherwise("JavaType")


def safe_relationship(kind: Column) -> Column:
    name = F.upper(F.trim(kind))
    return F.when(name.isin(*RELATIONSHIP_TYPES), name).otherwise("USES")


def classification(label: Column, layer: Column) -> Column:
    """Second label of a stored type, by its layer."""
    of_layer = F.when(layer == "ServiceImpl", "Service").when(layer.isin(*CLASSIFICATIONS), layer)
    return F.when(label == "JavaType", of_layer)


def role(label: Column, layer: Column) -> Column:
    return (
        F.when(layer == "Controller", "Controller").when(layer.isin("Service", "ServiceImpl"), "Service")
        .when(layer == "Repository", "Repository").when(layer == "Mapper", "Mapper")
        .when(layer.isin("DTO", "Domain"), "DataModel")
        .when(label.isin("DatabaseTable", "ApiEndpoint", "SqlStatement"), label).otherwise("Common")
    )


def is_external(flag: Column) -> Column:
    return F.coalesce(F.lower(flag.cast("string")) == "true", F.lit(False))


def package_of(package_name: Column, fqn: Column) -> Column:
    """Given package, else the prefix of the qualified name, else the default package."""
    return F.coalesce(non_blank(package_name), F.nullif(F.regexp_extract(F.trim(fqn), "^(?s)(.*)\\.[^.]*$", 1), F.lit("")),
                      F.lit(DEFAULT_PACKAGE))


def internal_types(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("label") == "JavaType") & ~is_external(F.col("external")))


def owners(edges: DataFrame) -> DataFrame:
    """Type that owns a method or a statement; the owner of a method wins over that of a statement."""
    kinds = F.when(F.col("type") == "HAS_METHOD", 0).when(F.col("type") == "HAS_STATEMENT", 1)
    owned = edges.where(F.col("type").isin("HAS_METHOD", "HAS_STATEMENT"))
    return owned.groupBy(F.col("dst").alias("member")).agg(F.min_by("src", F.struct(kinds, F.col("src"))).alias("owner"))


def lifted_calls(edges: DataFrame) -> DataFrame:
    """Calls between methods as calls between their owning types.

    Repeated calls collapse before each join, so a method called from everywhere contributes one row
    per calling type to the second join rather than one per call.
    """
    return _lifted(edges).distinct()


def _lifted(edges: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Calls by owner; with ``types`` (uid and more columns) only between these, and what they say as src_… and dst_….

    The few owners are chosen before the many calls meet them.
    """
    owner, more = owners(edges.where(F.col("type") == "HAS_METHOD")), []
    if types is not None:
        more = [c for c in types.columns if c != "uid"]
        owner = owner.join(types.withColumnRenamed("uid", "owner"), "owner")
    calls = edges.where(F.col("type") == "CALLS").select("src", "dst")
    from_types = calls.join(owner, F.col("src") == F.col("member")).select(
        F.col("owner").alias("src"), "dst", *[F.col(c).alias(f"src_{c}") for c in more]).distinct()
    return from_types.join(owner, F.col("dst") == F.col("member")).select(
        "src", F.col("owner").alias("dst"), *[f"src_{c}" for c in more], *[F.col(c).alias(f"dst_{c}") for c in more])


def _between(links: DataFrame, types: DataFrame) -> DataFrame:
    """Links (src, dst and more) between these types (uid and more columns), with what they say as src_… and dst_…."""
    for end in ("src", "dst"):
        links = links.join(types.select(F.col("uid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in types.columns if c != "uid"]), end)
    return links


def _type_bit(kind: Column) -> Column:
    bit = F.lit(0).cast("long")
    for i, name in enumerate(MERGED_TYPES):
        bit = F.when(kind == name, F.lit(1 << i).cast("long")).otherwise(bit)
    return bit


def _merged_bits(kinds: Column) -> Column:
    """Set of relationship types in a group: one bit per type of the closed ontology, so the aggregate keeps a number
    per group, combines map-side and stays in generated code."""
    return F.bit_or(_type_bit(kinds))


def _types_of(bits: Column) -> Column:
    """The sorted types of a set."""
    names = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(1 << i).cast("long").alias("b")) for i, n in sorted(enumerate(MERGED_TYPES), key=lambda x: x[1])])
    return F.transform(F.filter(names, lambda s: bits.bitwiseAND(s["b"]) != 0), lambda s: s["n"])


def merged_types(kinds: Column) -> Column:
    """Sorted set of relationship types in a group."""
    return _types_of(_merged_bits(kinds))


def _linked(edges: DataFrame) -> DataFrame:
    """Merged links between types of any kind, direct ones and calls: no self loops, the relationship types as ``bits``."""
    direct = edges.where(F.col("type").isin(*TYPE_RELATIONSHIPS)).select("src", "dst", "type")
    lifted = _lifted(edges).select("src", "dst", F.lit("CALLS").alias("type"))
    both = direct.unionByName(lifted).where(F.col("src") != F.col("dst"))
    return both.groupBy("src", "dst").agg(_merged_bits(F.col("type")).alias("bits"))


def type_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Merged edges between internal types: no self loops, the sorted set of relationship types."""
    types = internal_types(nodes).select("uid")
    return _linked(edges).join(types.withColumnRenamed("uid", "src"), "src", "left_semi").join(
        types.withColumnRenamed("uid", "dst"), "dst", "left_semi").select("src", "dst", _types_of(F.col("bits")).alias("types"))


def staged_edges(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """The type edges that lead to no earlier stage; ``ends`` are the internal types with a ``stage`` (uid, stage).

    Owners bring their stage, so a call that leads back or to a type without a stage is dropped before calls are merged.
    """
    direct = _between(edges.where(F.col("type").isin(*TYPE_RELATIONSHIPS)).select("src", "dst", "type"), ends)
    both = direct.unionByName(_lifted(edges, ends).withColumn("type", F.lit("CALLS")))
    onward = both.where((F.col("src") != F.col("dst")) & (F.col("src_stage") <= F.col("dst_stage")))
    return onward.groupBy("src", "dst").agg(merged_types(F.col("type")).alias("types"))


def table_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from internal types to database tables, reached directly or through a method or statement."""
    access = edges.where(F.col("type").isin(*TABLE_RELATIONSHIPS)).select("src", "dst", "type")
    types = internal_types(nodes).select(F.col("uid").alias("src"))
    tables = nodes.where(F.col("label") == "DatabaseTable").select(F.col("uid").alias("dst"))
    through = access.join(owners(edges), F.col("src") == F.col("member"), "left").select(
        F.coalesce("owner", "src").alias("src"), "dst", "type")
    return (
        through.groupBy("src", "dst").agg(merged_types(F.col("type")).alias("types"))
        .join(types, "src", "left_semi").join(tables, "dst", "left_semi").select("src", "dst", "types")
    )


def impact(merged: DataFrame, selected: str | None = None) -> DataFrame:
    """Incoming and outgoing merged edges of each type, or of the selected one."""
    sides = F.array(
        F.struct(F.col("src").alias("selected"), F.lit("outgoing").alias("side"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("selected"), F.lit("incoming").alias("side"), F.col("src").alias("other")),
    )
    out = merged.select(F.explode(sides).alias("s"), "types").select("s.selected", "s.side", "s.other", "types")
    return out if selected is None else out.where(F.col("selected") == selected)


def _with_packages(merged: DataFrame, nodes: DataFrame) -> DataFrame:
    packages = internal_types(nodes).select("uid", package_of(F.col("package_name"), F.lit("")).alias("package"))
    return (
        merged.join(packages.select(F.col("uid").alias("src"), F.col("package").alias("src_package")), "src")
        .join(packages.select(F.col("uid").alias("dst"), F.col("package").alias("dst_package")), "dst")
    )


def package_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Merged edges per ordered pair of different packages, with the relationship types found on them."""
    # The package's join is also the choice of internal types.
    crossing = _with_packages(_linked(edges), nodes).where(F.col("src_package") != F.col("dst_package"))
    merged = crossing.groupBy("src_package", "dst_package").agg(F.count(F.lit(1)).alias("edge_count"), F.bit_or("bits").alias("bits"))
    return merged.select("src_package", "dst_package", "edge_count", _types_of(F.col("bits")).alias("types"))


def dependencies(nodes: DataFrame, edges: DataFrame, reverse: bool = False, selected: str | None = None) -> DataFrame:
    """One-hop relationships between types. Reversed, an edge reads selected -> dependent."""
    types = nodes.where(F.col("label") == "JavaType").select("uid", "name")
    near, far = ("dst", "src") if reverse else ("src", "dst")
    e = edges.where(F.col("type").isin(*DEPENDENCY_RELATIONSHIPS)).select(
        F.col(near).alias("selected"), F.col(far).alias("other"), "type")
    if selected is not None:
        e = e.where(F.col("selected") == selected)
    return e.join(types.select(F.col("uid").alias("selected")), "selected", "left_semi").join(
        types.select(F.col("uid").alias("other"), F.col("name").alias("other_name")), "other"
    ).select("selected", "type", "other", "other_name").distinct()


def node_source(nodes: DataFrame, edges: DataFrame, declares: str = "DECLARES") -> DataFrame:
    """Where the source of a node is found: its own columns, else its file's, its type's, or that type's file.

    What a file or type says is added to the edges from it, so that every join is by the id of a node that edges lead
    to, never by a parent that most nodes share or lack.
    """
    info = nodes.select("uid", F.struct("name", "graph_key", "package_name").alias("says"))

    def parents(kind, heads):
        links = edges.where(F.col("type") == kind).select(F.col("src").alias("uid"), F.col("dst").alias("child"))
        says = F.struct(*[c for c in heads.columns if c != "uid"])
        return links.join(heads, "uid", "left").groupBy("child").agg(F.min_by(says, "uid").alias("_p")).select(F.col("child").alias("uid"), "_p.*")

    files = parents(declares, info).withColumnRenamed("says", "file")
    # A type without a node of its own may still have a file.
    types = info.withColumnRenamed("says", "owner").join(files.withColumnRenamed("file", "owner_file"), "uid", "full")
    out = nodes.join(files, "uid", "left").join(parents("HAS_METHOD", types), "uid", "left")
    out = out.select("*", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("file", "owner", "owner_file") for c in ("name", "graph_key", "package_name")])
    pick = lambda c: first_text(F.col(c), F.col(f"file_{c}"), F.col(f"owner_{c}"), F.col(f"owner_file_{c}"))
    return out.select(
        "uid", "label", pick("package_name").alias("package_name"),
        first_text(F.col("graph_key"), F.col("file_graph_key"), F.col("owner_graph_key"), F.col("owner_file_graph_key")).alias("source_key"),
        first_text(F.col("file_name"), F.col("owner_file_name"), F.concat(F.col("name"), F.lit(".java"))).alias("source_file"),
        first_text(F.col("owner_name"), F.col("name")).alias("type_name"),
    )


def label_counts(nodes: DataFrame, labels: Column) -> DataFrame:
    return nodes.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("node_count"))


def label_graph(nodes: DataFrame, edges: DataFrame, labels: Column) -> DataFrame:
    """Edge counts per source label, type and target label, over all labels of both ends.

    Edges are counted per pair of label *sets* first, so the labels are unnested on a handful of rows.
    """
    tags = nodes.select("uid", labels.alias("labels"))
    # Counting per (source labels, target) between the joins leaves one row per target and kind of source.
    pairs = (
        edges.select("src", "dst", "type")
        .join(tags.select(F.col("uid").alias("src"), F.col("labels").alias("src_labels")), "src")
        .groupBy("src_labels", "type", "dst").agg(F.count(F.lit(1)).alias("n"))
        .join(tags.select(F.col("uid").alias("dst"), F.col("labels").alias("dst_labels")), "dst")
        .groupBy("src_labels", "type", "dst_labels").agg(F.sum("n").alias("n"))
    )
    return (
        pairs.withColumn("source_label", F.explode("src_labels")).withColumn("target_label", F.explode("dst_labels"))
        .groupBy("source_label", "type", "target_label").agg(F.sum("n").alias("edge_count"))
    )


def limited_with_flag(df: DataFrame, order: list, limit: int) -> DataFrame:
    """First ``limit`` rows in a total order and whether more were there, from ``limit + 1`` rows."""
    some = df.orderBy(*order).limit(limit + 1)
    everything = W.partitionBy(F.lit(1))  # at most limit + 1 rows
    flagged = some.withColumns({
        "truncated": F.count(F.lit(1)).over(everything) > limit, "_rank": F.row_number().over(everything.orderBy(*order))})
    return flagged.where(F.col("_rank") <= limit).drop("_rank")


def pair_fan_out(label_edges: DataFrame) -> DataFrame:
    """Per directed label pair: parallel edges, position of each, and whether the reverse direction exists."""
    pair = W.partitionBy("source_label", "target_label")
    order = pair.orderBy(F.desc("edge_count"), "type")
    reverse = label_edges.select(
        F.col("target_label").alias("source_label"), F.col("source_label").alias("target_label")
    ).distinct().withColumn("has_reverse", F.lit(True))
    return (
        label_edges.withColumns({"pair_count": F.count(F.lit(1)).over(pair), "pair_position": F.row_number().over(order) - 1})
        .join(reverse, ["source_label", "target_label"], "left")
        .withColumn("has_reverse", F.coalesce("has_reverse", F.lit(False)) & (F.col("source_label") != F.col("target_label")))
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected degree of every node; a self loop counts once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    counts = edges.select(F.explode(ends).alias("uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counts, "uid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def property_count(*columns: str) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total.cast("long")


def keyword_match(labels: Column, properties: list[str], label: str = "", keyword: str = "") -> Column:
    """Explorer search: exact label, and the keyword in a label or any property value."""
    hit = F.lit(True)
    if label:
        hit = F.array_contains(labels, label)
    if keyword:
        k = F.lit(keyword.lower())
        any_value = F.exists(labels, lambda x: F.contains(F.lower(x), k))
        for p in properties:
            any_value = any_value | F.coalesce(F.contains(F.lower(F.col(p).cast("string")), k), F.lit(False))
        hit = hit & any_value
    return hit


def detail_edges(edges: DataFrame, nodes: DataFrame, selected: DataFrame, limit: int = DETAIL_EDGE_LIMIT) -> DataFrame:
    """Edges of the selected node (a one-row frame with ``uid``) with direction and the other end."""
    sides = F.array(
        F.struct(F.col("src").alias("uid"), F.lit("OUTGOING").alias("direction"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("uid"), F.lit("INCOMING").alias("direction"), F.col("src").alias("other")),
    )
    around = edges.select(F.explode(sides).alias("s"), "type", "graph_key").select("s.*", "type", "graph_key")
    around = around.where(~((F.col("uid") == F.col("other")) & (F.col("direction") == "INCOMING")))
    named = around.join(F.broadcast(selected.select("uid").limit(1)), "uid", "left_semi").join(
        nodes.select(F.col("uid").alias("other"), F.col("name").alias("other_name"), F.col("label").alias("other_label")), "other")
    return named.orderBy("type", F.lower("other_name"), "other", "direction", "graph_key").limit(limit)


def overview(nodes: DataFrame, limit: int = 600) -> DataFrame:
    """Balanced sample of the graph: a quota per label by name, then the rest filled by label and name."""
    limit = clamp(limit, 20, 1500)
    quota = max(1, math.ceil(limit / len(OVERVIEW_LABELS)))
    rank = F.row_number().over(W.partitionBy("label").orderBy("name", "uid"))
    chosen = nodes.where(F.col("label").isin(*OVERVIEW_LABELS)).withColumn("_n", rank).where(F.col("_n") <= quota).drop("_n")
    first = chosen.withColumn("phase", F.lit(0))
    # At most quota * labels rows are chosen, so that many beyond the limit are enough to fill from.
    more = limit + quota * len(OVERVIEW_LABELS)
    fill = nodes.orderBy("label", "name", "uid").limit(more).join(chosen.select("uid"), "uid", "left_anti").select(
        *nodes.columns, F.lit(1).alias("phase"))
    both = first.unionByName(fill)
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("phase", "label", "name", "uid"))  # few thousand rows
    return both.withColumn("_place", place).where((F.col("phase") == 0) | (F.col("_place") <= limit)).drop("_place")


# The properties that an overview's search looks into, besides the labels.
SEARCHED = ("name", "fileName", "simpleName", "fqn", "source", "sourceKind")


def matched_scope(nodes: DataFrame, text: str, max_keys: int = 20) -> DataFrame:
    """Nodes that match a text, and every node of the first graph keys among the matches."""
    q = F.lit(text.strip().lower())
    hit = F.contains(F.lower(F.col("label")), q)
    if "layer" in nodes.columns:
        hit = hit | F.coalesce(F.contains(F.lower(classification(F.col("label"), F.col("layer"))), q), F.lit(False))
    for c in [c for c in SEARCHED if c in nodes.columns]:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), q), F.lit(False))
    matched = nodes.where(hit)
    keys = matched.where(F.col("graph_key").isNotNull()).select("graph_key").distinct().orderBy("graph_key").limit(max_keys)
    near = nodes.join(F.broadcast(keys.withColumn("_near", F.lit(True))), "graph_key", "left")  # at most max_keys rows
    return near.where(hit | F.col("_near").isNotNull()).select(*nodes.columns)


def induced_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends in a chosen node set (an overview, so a few thousand at most), six per node of it."""
    ids = cut(chosen.select("uid"))
    limit = clamp(ids.count() * 6, 200, 5000)
    inside = edges.join(F.broadcast(ids.withColumnRenamed("uid", "src")), "src", "left_semi").join(
        F.broadcast(ids.withColumnRenamed("uid", "dst")), "dst", "left_semi")
    return inside.select("type", "src", "dst", "graph_key").orderBy("type", "src", "dst", "graph_key").limit(limit)


# The properties a node's name is taken from, in this order.
NAME_CHAIN = ("name", "fileName", "simpleName", "fqn", "uid", "title", "id")


def display_name(nodes: DataFrame) -> Column:
    """The first of a node's naming properties that is there and not blank."""
    return F.coalesce(*[non_blank(F.col(c)) for c in NAME_CHAIN if c in nodes.columns], F.lit(None).cast("string"))


def java_file_count(nodes: DataFrame) -> DataFrame:
    """Distinct source file nodes whose id ends in ``.java``."""
    return nodes.where((F.col("label") == "SourceFile") & F.col("uid").endswith(".java")).agg(F.countDistinct("uid").alias("file_count"))


def merge_nodes(observed: DataFrame) -> DataFrame:
    """Observations (uid, seq, label, name, external, props) of one node merged into it.

    Later property values, names and external flags win, the first label stays. The observations are gone through once:
    values are reduced per (uid, key) before a node's map is rebuilt, so the rebuilt map holds each key once, and the
    first property of an observation, or an empty one, brings what isn't a property.
    """
    rows = observed.select("uid", "seq", "label", "name", "external", F.posexplode_outer("props"))
    at = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("seq"))
    values = rows.groupBy("uid", "key").agg(
        F.max_by("value", "seq").alias("value"), F.min_by("label", at).alias("label"), F.min(at).alias("since"),
        F.max_by(F.struct("name", "external"), at).alias("said"), F.max(at).alias("until"))
    merged = values.groupBy("uid").agg(
        F.min_by("label", "since").alias("label"), F.max_by("said", "until").alias("said"),
        F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))).alias("entries"))
    props = F.when(F.size("entries") > 0, F.map_from_entries(F.sort_array("entries")))
    return merged.select("uid", "label", "said.name", "said.external", props.alias("props"))


def merge_edges(observed: DataFrame) -> DataFrame:
    return observed.dropDuplicates(["src", "dst", "type", "graph_key"])


def storable_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges as stored: known type, one per (src, type, graph key, dst), both ends present."""
    ids = nodes.select("uid")
    clean = edges.withColumn("type", safe_relationship(F.col("type")))
    return merge_edges(clean).join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("uid", "dst"), "dst", "left_semi").select(*edges.columns)


def history_graph(nodes: DataFrame, edges: DataFrame, history_id: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one generation (``history_id``) in the order of label and name, and the edges between two of them."""
    mine = nodes.where(F.col("history_id") == history_id)
    ids = mine.select("uid")
    inside = edges.join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(ids.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    return mine.orderBy("label", "name", "uid"), inside.select("src", "dst", "type", "graph_key").orderBy("type", "src", "dst")


def same_generation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends belong to the same generated graph, with its key."""
    keys = nodes.select("uid", "graph_key")
    return (
        edges.drop("graph_key")
        .join(keys.select(F.col("uid").alias("src"), F.col("graph_key").alias("generation")), "src")
        .join(keys.select(F.col("uid").alias("dst"), F.col("graph_key").alias("generation")), ["dst", "generation"], "left_semi")
    )


def _without_edges_of(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the removed nodes."""
    ids = gone.select("uid")
    return edges.join(ids.withColumnRenamed("uid", "src"), "src", "left_anti").join(
        ids.withColumnRenamed("uid", "dst"), "dst", "left_anti")


# Containers removed with their graph key, and facts removed once nothing links to them.
CONTAINER_LABELS = ("Document", "SourceFile", "Generation", "RagSource")
FACT_LABELS = (
    "JavaType", "Method", "Field", "ApiEndpoint", "DatabaseTable", "DatabaseColumn", "SqlStatement", "Chunk",
    "StandardRule", "StandardTemplate", "ConfigurationFile", "ConfigurationProperty", "Bean", "Profile", "Provider",
)
CONTAINMENT = (("Package", "SourceFile"), ("Module", "Package"), ("Project", "Module"))


def delete_graph(nodes: DataFrame, edges: DataFrame, graph_keys: DataFrame, containment=CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """Remove graphs by key: their edges and containers, facts left isolated, then containers left empty.

    Each step reads what the one before left of both tables, so the steps are written out; otherwise
    every later step would run all earlier ones again, twice.
    """
    edges = cut(edges.join(graph_keys, "graph_key", "left_anti").select(*edges.columns))
    containers = nodes.where(F.col("label").isin(*CONTAINER_LABELS)).join(graph_keys, "graph_key", "left_semi")
    containers = cut(containers.select("uid"))
    nodes = nodes.join(containers, "uid", "left_anti")
    edges = _without_edges_of(edges, containers).select(*edges.columns)
    linked = edges.select(F.explode(F.array("src", "dst")).alias("uid")).distinct().withColumn("_linked", F.lit(True))
    columns = nodes.columns
    nodes = nodes.join(linked, "uid", "left").where(
        ~F.col("label").isin(*FACT_LABELS) | F.col("_linked").isNotNull()).select(*columns)
    nodes = cut(nodes)
    for outer, inner in containment:
        inside = nodes.where(F.col("label") == inner).select(F.col("uid").alias("dst"))
        holders = edges.where(F.col("type") == "CONTAINS").join(inside, "dst", "left_semi").select(F.col("src").alias("uid")).distinct()
        empty = cut(nodes.where(F.col("label") == outer).join(holders, "uid", "left_anti").select("uid"))
        nodes = nodes.join(empty.select("uid"), "uid", "left_anti").select(*columns)
        edges = _without_edges_of(edges, empty).select("src", "dst", "type", "graph_key")
    return nodes, edges


def package_prefixes(package: Column) -> Column:
    """Every dotted prefix of a package name, the name itself last."""
    parts = F.filter(F.split(package, "\\."), lambda s: s != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def package_tree(types: DataFrame, package: str = "package_name") -> DataFrame:
    """Type count of every package prefix, descendants included; counted per package before prefixes are unnested."""
    counts = types.groupBy(package).agg(F.count(F.lit(1)).alias("n"))
    prefixes = F.when(F.col(package) == DEFAULT_PACKAGE, F.array(package)).otherwise(package_prefixes(F.col(package)))
    return counts.select(F.explode(prefixes).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("type_count"))


def common_prefix(packages: DataFrame, package: str = "package_name") -> DataFrame:
    """Longest prefix shared by all packages: one row; empty when it has fewer than two segments.

    Two names bound the rest: what the least and the greatest have in common, all have in common.
    """
    parts = F.filter(F.split(F.col(package), "\\."), lambda s: s != "")
    ends = packages.where(F.col(package) != DEFAULT_PACKAGE).agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    size = F.least(F.size("a"), F.size("b"))
    differing = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("a", i) != F.element_at("b", i))
    shared = F.coalesce(F.array_min(differing) - 1, size)
    common = F.slice("a", F.lit(1), shared)
    return ends.select(F.when(shared >= 2, F.array_join(common, ".")).otherwise("").alias("root"))


def package_entries(packages: DataFrame, package: str = "package_name") -> DataFrame:
    """Each package with its name below the common prefix and its depth there."""
    names = packages.select(F.col(package).alias("package")).distinct()
    root = common_prefix(packages, package)
    joined = names.join(F.broadcast(root))  # one row
    inside = F.startswith("package", F.concat("root", F.lit(".")))
    relative = (F.when((F.col("root") != "") & inside, F.substr("package", F.length("root") + 2))
                .when(F.col("package") == F.col("root"), "(root)").otherwise(F.col("package")))
    depth = F.size(F.filter(F.split(relative, "\\."), lambda s: s != "")) - 1
    return joined.select("package", relative.alias("relative_name"), F.greatest(depth, F.lit(0)).cast("long").alias("depth"))


def package_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of the package view: one for each package with the number of its types."""
    types = internal_types(nodes).select(package_of(F.col("package_name"), F.lit("")).alias("name"))
    return types.groupBy("name").agg(F.count(F.lit(1)).alias("type_count")).select(
        F.concat(F.lit("package:"), "name").alias("id"), F.lit("Package").alias("label"), "name", "type_count")


def package_members(nodes: DataFrame) -> DataFrame:
    """The types of each package with their place in it, by display name; a package may hold most types."""
    types = internal_types(nodes).withColumn("display", F.coalesce(display_name(nodes), F.col("uid"))).select(
        F.concat(F.lit("package:"), package_of(F.col("package_name"), F.lit(""))).alias("package"), "uid", "display")
    return positions(types, ["package"], ["display", "uid"], "position").select("package", "uid", "position")


def nearest_parent(packages: DataFrame, package: str = "package_name") -> DataFrame:
    """Nearest existing ancestor of each package, null at the top."""
    names = packages.select(F.col(package).alias("package")).distinct()
    up = names.select("package", F.explode(package_prefixes(F.col("package"))).alias("candidate")).where(
        F.col("candidate") != F.col("package"))
    known = up.join(names.select(F.col("package").alias("candidate")), "candidate", "left_semi")
    best = known.groupBy("package").agg(F.max_by("candidate", F.length("candidate")).alias("parent"))
    return names.join(best, "package", "left")


def container_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links of the package view: package holds package, package holds type, type depends on type."""
    types = internal_types(nodes).select("uid", package_of(F.col("package_name"), F.lit("")).alias("package_name"))
    holds = types.select(F.concat(F.lit("package:"), "package_name").alias("source"), F.col("uid").alias("target"),
                         F.lit("CONTAINS").alias("type"), F.lit("contains").alias("link_kind"))
    nested = nearest_parent(types.where(F.col("package_name") != DEFAULT_PACKAGE)).where(F.col("parent").isNotNull()).select(
        F.concat(F.lit("package:"), "parent").alias("source"), F.concat(F.lit("package:"), "package").alias("target"),
        F.lit("PACKAGE").alias("type"), F.lit("package-hierarchy").alias("link_kind"))
    uses = type_edges(nodes, edges).select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.array_join("types", ", ").alias("type"),
        F.lit("dependency").alias("link_kind"))
    return holds.unionByName(nested).unionByName(uses)


def package_scope(nodes: DataFrame, edges: DataFrame, package: str, related: bool = True) -> DataFrame:
    """Links of one package: its types, optionally neighbours outside, statements and tables they reach."""
    # External types stay out of the related ones, so only internal ends are considered.
    types = internal_types(nodes).select("uid", (package_of(F.col("package_name"), F.lit("")) == package).alias("in"))
    inside = types.where("in")
    direct = _between(edges.where(F.col("type").isin(*TYPE_RELATIONSHIPS)).select("src", "dst", "type"), types)
    links = direct.unionByName(_lifted(edges, types).withColumn("type", F.lit("CALLS")))
    wanted = F.col("src_in") | F.col("dst_in") if related else F.col("src_in") & F.col("dst_in")
    type_links = links.where(wanted).select("src", "dst", "type")

    mine = inside.select("uid")
    statements = edges.where(F.col("type") == "HAS_STATEMENT").join(mine.withColumnRenamed("uid", "src"), "src", "left_semi").select("src", "dst", "type")
    mapper_files = edges.where(F.col("type") == "HAS_MAPPER_XML").join(mine.withColumnRenamed("uid", "dst"), "dst", "left_semi").select("src", "dst", "type")
    owner = owners(edges.where(F.col("type") == "HAS_METHOD")).join(mine.withColumnRenamed("uid", "owner"), "owner", "left_semi")
    endpoints = edges.where(F.col("type") == "HANDLED_BY").join(owner, F.col("dst") == F.col("member")).select(
        "src", F.col("owner").alias("dst"), "type")
    access = edges.where(F.col("type").isin("READS_FROM", "WRITES_TO")).join(owner, F.col("src") == F.col("member")).select(
        F.col("owner").alias("src"), "dst", "type")
    tables = nodes.where(F.col("label") == "DatabaseTable").select(F.col("uid").alias("dst"))
    reach = mine.unionByName(statements.select(F.col("dst").alias("uid"))).withColumnRenamed("uid", "src").distinct()
    to_tables = edges.select("src", "dst", "type").join(reach, "src", "left_semi").join(tables, "dst", "left_semi").select("src", "dst", "type")
    out = type_links
    for part in (statements, mapper_files, endpoints, access, to_tables):
        out = out.unionByName(part)
    return out.where(F.col("src") != F.col("dst")).distinct()


def controller_rule(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Controllers must not call repositories: VIOLATES or CONFORMS_TO per internal controller."""
    layers = nodes.where(F.col("label") == "JavaType").select("uid", "layer")
    calls = lifted_calls(edges).join(
        layers.where(F.col("layer") == "Repository").select(F.col("uid").alias("dst")), "dst", "left_semi").select(
        F.col("src").alias("uid")).distinct().withColumn("_calls", F.lit(True))
    controllers = internal_types(nodes).where(F.col("layer") == "Controller").select("uid")
    return controllers.join(calls, "uid", "left").select(
        "uid", F.lit("controller-must-not-call-repository").alias("rule_id"),
        F.when(F.col("_calls"), "VIOLATES").otherwise("CONFORMS_TO").alias("type"))


def service_rule(nodes: DataFrame, edges: DataFrame, implements: str = "IMPLEMENTS") -> DataFrame:
    """A service implementation must implement an interface named like a service."""
    services = nodes.where(F.lower("name").endswith("service")).select(F.col("uid").alias("dst"))
    good = edges.where(F.col("type") == implements).join(services, "dst", "left_semi").select(
        F.col("src").alias("uid")).distinct().withColumn("_ok", F.lit(True))
    return internal_types(nodes).where(F.col("layer") == "ServiceImpl").select("uid").join(good, "uid", "left").select(
        "uid", F.lit("service-impl-must-implement-service").alias("rule_id"),
        F.when(F.col("_ok"), "CONFORMS_TO").otherwise("VIOLATES").alias("type"))


def rule_evaluations(nodes: DataFrame, conforms: list[str], violates: list[str], project: str) -> DataFrame:
    """Explicit evaluation of a request: every internal type against the rule ids it names."""
    def uid(rule):
        return rule if rule.startswith("rule:") else f"rule:{project}:{rule.strip()}"

    pairs = [(uid(r), "CONFORMS_TO") for r in conforms if r.strip()] + [(uid(r), "VIOLATES") for r in violates if r.strip()]
    named = F.array(*[F.struct(F.lit(r).alias("dst"), F.lit(t).alias("type")) for r, t in pairs])
    return internal_types(nodes).select(F.col("uid").alias("src"), F.explode(named).alias("r")).select("src", "r.dst", "r.type")
