"""Vector search, graph-expanded retrieval and bounded context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions.code import let
from cairn.functions.text import non_blank
from cairn.operators import traversal
from cairn.session import cut

# Defaults of the hybrid search.
TOP_K = 5
HYBRID_DEPTH, HYBRID_NODES, HYBRID_EDGES, HYBRID_EVIDENCE = 2, 50, 200, 12
CONTEXT_CHARACTERS = 60_000
TRUNCATION_MARKER = "\n\n[Context truncated to configured character limit]"
HASH_DIMENSIONS = 512


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    def of(x: Column, y: Column) -> Column:
        parts = F.struct(_dot(x, y).alias("dot"), (F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))).alias("norms"))
        return let(parts, lambda p: F.when(p["norms"] == 0, F.lit(0.0)).otherwise(p["dot"] / p["norms"]))

    return let(a.cast("array<double>"), lambda x: let(b.cast("array<double>"), lambda y: of(x, y)))


def mean_vector(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Component-wise mean as a single row; one row per dimension leaves each task."""
    parts = vectors.select(F.posexplode(F.col(column))).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("v"))
    return parts.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("query"))


def vector_search(chunks: DataFrame, query: Column, k: int = TOP_K, project: str = "") -> DataFrame:
    """Best ``k`` chunks for one query vector, optionally inside a project."""
    scope = chunks.where(F.col("project_id") == project) if project else chunks
    return scope.withColumn("score", cosine(F.col("embedding"), query)).orderBy(F.desc("score"), "chunk_id").limit(k)


def vector_search_by_project(chunks: DataFrame, query: Column, k: int = TOP_K) -> DataFrame:
    """The same search answered for every project at once; each task passes on ``k`` rows per project."""
    w = W.partitionBy("project_id").orderBy(F.desc("score"), "chunk_id")
    scored = chunks.withColumn("score", cosine(F.col("embedding"), query)).drop("embedding")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hashed_terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse hash embedding: (key, bucket, weight) with integer term counts, one text per key.

    A text's buckets are sorted and counted within its row, so nothing is shuffled.
    """
    terms = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    buckets = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % HASH_DIMENSIONS)

    def runs(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(s, i - 1) != F.get(s, i)))
        counted = let(ends, lambda e: F.transform(e, lambda x, k: F.struct(
            F.get(s, x - 1).alias("bucket"), (x - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("long").alias("weight"))))
        return F.when(n > 0, counted)

    return texts.select(key, F.inline(let(F.sort_array(buckets), runs)))


def hashed_search(index: DataFrame, query: DataFrame, key: str, k: int = TOP_K) -> DataFrame:
    """Cosine top-k over a sparse index for one query (bucket, weight): an equi-join on buckets.

    Dot products and norms are whole numbers until the last division, so equal scores tie exactly.
    """
    q = cut(query.select("bucket", F.col("weight").alias("q")))  # at most HASH_DIMENSIONS rows
    matched = index.join(F.broadcast(q), "bucket", "left")
    sums = matched.groupBy(key).agg(
        F.sum(F.col("weight") * F.coalesce("q", F.lit(0))).alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("n2"))
    q2 = q.agg(F.sum(F.col("q") * F.col("q")).alias("q2")).scalar()
    score = F.col("dot") / (F.sqrt(F.col("n2").cast("double")) * F.sqrt(q2.cast("double")))
    return sums.where("dot > 0").select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def entity_seeds(hits: DataFrame, column: str = "entity_ids") -> DataFrame:
    """Distinct non-blank entity ids in the order of their hits, at most the seed limit of a neighbourhood."""
    rank = F.col("rank") if "rank" in hits.columns else F.lit(0)
    ids = hits.select(rank.alias("rank"), F.posexplode(column).alias("place", "uid"))
    return traversal.seed_ids(ids.select("uid", F.struct("rank", "place").alias("hit")))


def evidence_ids(hits: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = HYBRID_EVIDENCE) -> DataFrame:
    """Chunk ids to fetch, in order: the hits, then what nodes and edges name as evidence; first mention counts.

    ``hits`` carries (chunk_id, rank), ``nodes`` and ``edges`` (evidence_chunk_ids, rank); all are bounded
    by the search limits.
    """
    def named(df, source):
        return df.select(F.lit(source).alias("source"), "rank", F.posexplode("evidence_chunk_ids").alias("pos", "chunk_id"))

    own = hits.select(F.lit(0).alias("source"), "rank", F.lit(0).alias("pos"), "chunk_id")
    all_ids = own.unionByName(named(nodes, 1)).unionByName(named(edges, 2)).where(non_blank(F.col("chunk_id")).isNotNull())
    first = all_ids.groupBy("chunk_id").agg(F.min(F.struct("source", "rank", "pos")).alias("at"))
    return first.orderBy("at", "chunk_id").limit(limit)


def fetch_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks by id; ``ids`` is bounded by the evidence limit, so it is what gets broadcast."""
    return chunks.join(F.broadcast(ids), "chunk_id")


def merge_chunks(hits: DataFrame, evidence: DataFrame, limit: int = HYBRID_EVIDENCE) -> DataFrame:
    """Hits first, then evidence, one row per chunk, at most ``limit``; both carry (chunk_id, rank, ...)."""
    both = hits.withColumn("source", F.lit(0)).unionByName(evidence.withColumn("source", F.lit(1)))
    once = W.partitionBy("chunk_id").orderBy("source", "rank")
    return both.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n").orderBy("source", "rank", "chunk_id").limit(limit)


def hybrid_search(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, hits: DataFrame, project: str = "",
                  depth: int = HYBRID_DEPTH, max_nodes: int = HYBRID_NODES, max_edges: int = HYBRID_EDGES,
                  max_chunks: int = HYBRID_EVIDENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits of a vector search (chunk_id, score) widened by the graph around their entities.

    Returns the merged chunks, the graph nodes and its edges, each with a ``rank`` for its order.
    """
    place = W.partitionBy(F.lit(1))  # only ever over the bounded results below
    hits = hits.orderBy(F.desc("score"), "chunk_id").limit(traversal.MAX_SEEDS)  # the graph takes no more seeds
    scored = cut(fetch_chunks(chunks, hits).withColumn("rank", F.row_number().over(place.orderBy(F.desc("score"), "chunk_id"))))
    around = traversal.neighbourhood(nodes, edges, entity_seeds(scored), depth, project, max_nodes)
    found = cut(nodes.join(F.broadcast(around), "uid").withColumn("rank", F.row_number().over(place.orderBy("depth", "uid"))))
    ids = F.broadcast(cut(found.select("uid")))
    inside = edges.join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(ids.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    top = inside.orderBy("type", "src", "dst", "graph_key").limit(max_edges)
    links = cut(top.withColumn("rank", F.row_number().over(place.orderBy("type", "src", "dst", "graph_key"))))
    if "evidence_chunk_ids" not in links.columns:
        links_ids = links.withColumn("evidence_chunk_ids", F.array().cast("array<string>"))
    else:
        links_ids = links
    wanted = cut(evidence_ids(scored.select("chunk_id", "rank"), found, links_ids, max_chunks)
                 .withColumn("rank", F.row_number().over(place.orderBy("at", "chunk_id"))).select("chunk_id", "rank"))
    columns = [c for c in chunks.columns]
    evidence = fetch_chunks(chunks, wanted).select(*columns, "rank")
    merged = merge_chunks(scored.select(*columns, "rank"), evidence, max_chunks)
    merged = merged.withColumn("rank", F.row_number().over(place.orderBy("source", "rank", "chunk_id")))
    return merged, found, links


def truncate_context(text: Column, limit: int = CONTEXT_CHARACTERS) -> Column:
    marker = TRUNCATION_MARKER
    if limit <= len(marker):
        return F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - len(marker)), F.lit(marker)))


def build_context(merged: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = CONTEXT_CHARACTERS) -> DataFrame:
    """One context text: evidence chunks, then the graph as JSON, cut to the limit. All inputs are bounded results."""
    def gathered(df, value):
        return F.transform(F.sort_array(F.collect_list(F.struct("rank", value.alias("v")))), lambda s: s["v"])

    chunk_text = F.concat(F.lit("[chunkId: "), "chunk_id", F.lit("][source: "), "source_key", F.lit("]\n"), "content")
    e = merged.groupBy().agg(F.array_join(gathered(merged, chunk_text), "\n\n").alias("chunks"))
    n = nodes.groupBy().agg(gathered(nodes, F.struct(F.col("uid").alias("id"), "label", "name")).alias("nodes"))
    r = edges.groupBy().agg(gathered(edges, F.struct(F.col("src").alias("sourceId"), F.col("dst").alias("targetId"), "type")).alias("relationships"))
    one = e.join(F.broadcast(n)).join(F.broadcast(r))  # three single rows
    evidence = F.when(F.col("chunks") != "", F.concat(F.lit("EVIDENCE CHUNKS:\n"), "chunks"))
    graph = F.when((F.size("nodes") > 0) | (F.size("relationships") > 0),
                   F.concat(F.lit("GRAPH CONTEXT:\n"), F.to_json(F.struct("nodes", "relationships"))))
    return one.select(truncate_context(F.concat_ws("\n\n", evidence, graph), limit).alias("context"))
