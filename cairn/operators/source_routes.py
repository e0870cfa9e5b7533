"""Where the source text of a graph node comes from: ranked routes over the node and what declares it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import first_text, non_blank
from cairn.session import cut

# For every answer the properties that can give it, best first. ``file`` declares the node, ``type`` has
# it as a method and ``type_file`` declares that type.
CHAINS = {
    "fqn": (("node", "fqn"), ("node", "primaryType"), ("type", "fqn"), ("file", "primaryType"), ("type_file", "primaryType")),
    "simple_name": (("node", "simpleName"), ("type", "simpleName")),
    "source_key": (
        ("node", "source"), ("file", "source"), ("type", "source"), ("type_file", "source"),
        ("node", "sourceKey"), ("file", "sourceKey"), ("type", "sourceKey"), ("type_file", "sourceKey"),
        ("node", "graphSourceKey"), ("file", "graphSourceKey"), ("type_file", "graphSourceKey")),
    "file_name": (("node", "fileName"), ("file", "fileName"), ("type_file", "fileName")),
    "source_kind": (("node", "sourceKind"), ("file", "sourceKind"), ("type", "sourceKind"), ("type_file", "sourceKind")),
    "history_id": (("node", "historyId"), ("file", "historyId"), ("type", "historyId"), ("type_file", "historyId")),
    "own_content": (("node", "sourceContent"), ("file", "sourceContent"), ("type_file", "sourceContent"), ("type", "sourceContent")),
}


def _usable(name: str):
    return (lambda c: c.try_cast("long")) if name == "history_id" else non_blank


def _at(slot: str) -> list[Column]:
    """For every answer the best property of ``props`` if a node stands in this slot, with its rank."""
    out = []
    for name, chain in CHAINS.items():
        usable = _usable(name)
        ranked = [(k, usable(F.col("props")[p])) for k, (s, p) in enumerate(chain) if s == slot]
        none = F.lit(None).cast("struct<k:int,v:bigint>" if name == "history_id" else "struct<k:int,v:string>")
        out.append(F.coalesce(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in ranked], none).alias(name))
    return out


def _better(*slots: str) -> list[Column]:
    """For every answer the one of least rank among these columns of answers."""
    return [F.least(*[F.col(s)[name] for s in slots]).alias(name) for name in CHAINS]


def routes(nodes: DataFrame, edges: DataFrame, declares: str = "DECLARES", file_label: str = "SourceFile") -> DataFrame:
    """uid, label, name, props and ``found``: the best answers over the node, its file, its type and that type's file.

    What a file or type answers is added to the edges from it, so that nodes move once, by their own id, and no join has
    the same or no key for most of the rows. Where several declare a node, the least uid does.
    """
    def above(kind: str, heads: DataFrame) -> DataFrame:
        ends = edges.where(F.col("type") == kind).select(F.col("src").alias("at"), F.col("dst").alias("uid"))
        answers = F.struct(*[c for c in heads.columns if c != "at"])
        return ends.join(heads, "at").groupBy("uid").agg(F.min_by(answers, "at").alias("a")).select("uid", "a.*")

    def heads(label: str, *slots: str) -> DataFrame:
        return nodes.where(F.col("label") == label).select(F.col("uid").alias("at"), *[F.struct(*_at(s)).alias(s) for s in slots])

    files = above(declares, heads(file_label, "file"))
    of_types = above(declares, heads(file_label, "type_file")).withColumnRenamed("uid", "at")
    types = heads("JavaType", "type").join(of_types, "at", "left").select("at", F.struct(*_better("type", "type_file")).alias("type"))
    own = nodes.select("uid", "label", "name", "props", F.struct(*_at("node")).alias("node"))
    every = own.join(files, "uid", "left").join(above("HAS_METHOD", types), "uid", "left")
    return every.select("uid", "label", "name", "props", F.struct(*_better("node", "file", "type")).alias("found"))


def node_sources(nodes: DataFrame, edges: DataFrame, catalog: DataFrame, blocks: DataFrame,
                 declares: str = "DECLARES", file_label: str = "SourceFile") -> DataFrame:
    """Names, file and source text of every node (uid, label, name, props map).

    ``catalog`` has (id, graph_source_key, original_file_name, file_path, content), the content null where a file can't
    be read; ``blocks`` has (history_id, place, fqn, simple_name, content), the types in the code of each generation.
    A text is the catalog's, else the generation's first block of the node's type, else one stored on a route. Where
    there is none, ``missing`` says what was: the file, the catalog row, or any source.
    """
    p = F.col("props")
    shown = F.coalesce("name", p["simpleName"], p["fileName"], p["fqn"], "uid")
    told = routes(nodes, edges, declares, file_label).select("uid", "label", shown.alias("name"), *[F.col("found")[n]["v"].alias(n) for n in CHAINS])
    simple = first_text(F.col("simple_name"), F.regexp_extract("fqn", "([^.]*)$", 1), F.col("name"))
    told = cut(told.withColumn("simple_name", simple))

    # A node asks its generation for its full name and, after that, for its simple name. Only nodes with a generation
    # are joined with blocks and only those with a key with the catalog: no task gets all nodes without one.
    def block(name: str, out: str) -> DataFrame:
        named = blocks.where(F.col("history_id").isNotNull() & F.col(name).isNotNull())
        return named.groupBy("history_id", name).agg(F.min_by(F.struct("content"), F.struct("place")).alias(out))

    asks = told.where("history_id IS NOT NULL").join(block("fqn", "by_fqn"), ["history_id", "fqn"], "left").join(
        block("simple_name", "by_name"), ["history_id", "simple_name"], "left")
    made = F.when(F.col("by_fqn").isNotNull(), F.col("by_fqn.content")).otherwise(F.col("by_name.content"))
    none = F.lit(None).cast("string")
    told = asks.withColumn("made_content", made).drop("by_fqn", "by_name").unionByName(
        told.where("history_id IS NULL").withColumn("made_content", none))

    # Texts come last: a file's text is repeated for all nodes of the file and isn't moved after that.
    row = F.min_by(F.struct("original_file_name", "file_path", F.col("content").alias("catalog_content")), "id")
    files = catalog.where(non_blank(F.col("graph_source_key")).isNotNull()).groupBy(F.col("graph_source_key").alias("source_key")).agg(row.alias("r"))
    keyed = told.where("source_key IS NOT NULL").join(files.select("source_key", "r.*"), "source_key", "left")
    told = keyed.unionByName(told.where("source_key IS NULL").select("*", *[none.alias(c) for c in ("original_file_name", "file_path", "catalog_content")]))

    def whole(name: str) -> Column:
        return F.when(non_blank(F.col(name)).isNotNull(), F.col(name))

    content = F.coalesce(whole("catalog_content"), whole("made_content"), whole("own_content"), F.lit(""))
    path = F.coalesce(non_blank(F.col("file_path")), F.lit(""))
    missing = F.when(content != "", "").when(path != "", "file").when(F.col("source_key").isNotNull(), "catalog row").otherwise("source")
    return told.select(
        "uid", "label", "name", F.coalesce("fqn", F.lit("")).alias("fqn"), "simple_name",
        first_text(F.col("original_file_name"), F.col("file_name"), F.when(F.col("simple_name") != "", F.concat("simple_name", F.lit(".java")))).alias("file_name"),
        F.coalesce("source_kind", F.lit("")).alias("source_kind"), F.coalesce("source_key", F.lit("")).alias("source_key"),
        path.alias("file_path"), content.alias("content"), missing.alias("missing"))
