"""Retrieval queries: vector search, hashed search, chunks, hybrid search and its context."""

from pyspark.sql import functions as F

from cairn.operators import chunking as ch
from cairn.operators import retrieval as r
from cairn.plans.oracle_tables import DOCUMENT, GRAPH, with_tables
from cairn.plans.registry import query
from cairn.session import cut, spread
from cairn.sources import lake

_EMBEDDED = """q AS (SELECT list(v ORDER BY pos) AS query FROM (SELECT pos, avg(v) AS v FROM (
      SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)),
scored AS (SELECT 'chunk:' || vec_id AS chunk_id, 'p' || label AS project_id,
           list_cosine_similarity(embedding::DOUBLE[], (SELECT query FROM q)) AS score FROM embeddings)"""


def _mean_query(spark, sf):
    """The request: the mean of all vectors, one value per dimension."""
    return F.array(*[F.lit(v) for v in r.mean_vector(lake.chunks(spark, sf)).first()["query"]])


@query("v1_vector_top_k", with_tables(
    "SELECT chunk_id, project_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 5", _EMBEDDED))
def vector_top_k(spark, sf):
    return r.vector_search(lake.chunks(spark, sf), _mean_query(spark, sf)).select("chunk_id", "project_id", F.round("score", 6).alias("score"))


@query("v1_vector_top_k_by_project", with_tables(
    """SELECT chunk_id, project_id, round(score, 6) AS score, row_number() OVER (PARTITION BY project_id ORDER BY scored.score DESC, chunk_id) AS rank
    FROM scored QUALIFY rank <= 5""", _EMBEDDED))
def vector_top_k_by_project(spark, sf):
    return r.vector_search_by_project(lake.chunks(spark, sf), _mean_query(spark, sf)).select(
        "chunk_id", "project_id", F.round("score", 6).alias("score"), "rank")


_CHUNKS = """chunk AS (SELECT document_id, source_key, project_id, file_path, i AS index, source_key || ':chunk:' || i AS chunk_id,
      substr(content, (i * 1050 + 1)::BIGINT, 1200) AS content
    FROM (SELECT id AS document_id, vector_source_key AS source_key, project_key AS project_id, file_path, content,
                 unnest(range(0, greatest(ceil((length(content) - 1200) / 1050), 0)::BIGINT + 1)) AS i
          FROM document WHERE original_file_name NOT LIKE '%.java' AND length(content) > 0))"""


def text_chunks(spark, sf):
    return ch.plain_chunks(spread(lake.documents_catalog(spark, sf)))


@query("c17_plain_chunks", with_tables(f"{_CHUNKS} SELECT chunk_id, document_id, index, content FROM chunk", DOCUMENT))
def plain_chunks(spark, sf):
    return text_chunks(spark, sf).select("chunk_id", "document_id", "index", "content")


@query("a22_ingest_counts", with_tables(
    f"""{_CHUNKS} SELECT document_id, 'text' AS content_type, count(*) AS chunk_count FROM chunk GROUP BY 1""", DOCUMENT))
def ingest_counts(spark, sf):
    return ch.ingest_counts(text_chunks(spark, sf).withColumn("content_type", F.lit("text")))


@query("a22_ingest_totals", with_tables(
    f"""{_CHUNKS}, every AS (SELECT source_key, 'base' AS kind FROM chunk
      UNION ALL SELECT 'doc:' || o_orderkey, 'statement' FROM orders UNION ALL SELECT 'doc:' || o_orderkey, 'statement' FROM orders
      UNION ALL SELECT 'doc:' || o_orderkey, 'statement' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
      UNION ALL SELECT 'doc:' || o_custkey, 'method' FROM orders)
    SELECT source_key, count(*) FILTER (kind = 'base') AS base_chunks, count(*) FILTER (kind = 'statement') AS statement_chunks,
      count(*) FILTER (kind = 'method') AS method_chunks, count(*) AS chunk_count FROM every GROUP BY 1""", DOCUMENT))
def ingest_totals(spark, sf):
    """What an ingest reports for each source: chunks of text, of mapper statements and of methods."""
    from cairn.plans.extract import method_chunk_rows, statement_chunk_rows

    return ch.ingest_totals(text_chunks(spark, sf), statement_chunk_rows(spark, sf), method_chunk_rows(spark, sf))


@query("s10_chunk_replace", with_tables(
    f"""{_CHUNKS} SELECT chunk_id, length(content) AS size FROM chunk WHERE source_key NOT IN (SELECT 'document:' || doc_id FROM labels WHERE quality = 0)
    UNION ALL SELECT 'document:' || doc_id || ':chunk:0', 7 FROM labels WHERE quality = 0""", DOCUMENT))
def chunk_replace(spark, sf):
    """Low-quality documents are ingested again as a short placeholder."""
    stored = text_chunks(spark, sf).select("source_key", "chunk_id", F.length("content").cast("long").alias("size"))
    key = F.concat(F.lit("document:"), F.col("doc_id").cast("string"))
    incoming = lake.raw(spark, sf, "labels").where("quality = 0").select(
        key.alias("source_key"), F.concat(key, F.lit(":chunk:0")).alias("chunk_id"), F.lit(7).cast("long").alias("size"))
    return ch.replace_sources(stored, incoming).select("chunk_id", "size")


_TERMS = """term AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '([a-z0-9]+)', 1)) AS term FROM chunk),
idx AS (SELECT chunk_id, bucket, sum(n)::BIGINT AS weight FROM (
          SELECT chunk_id, ('0x' || substr(md5(term), 1, 4))::INTEGER % 512 AS bucket, count(*) AS n FROM term GROUP BY chunk_id, term)
        GROUP BY ALL)"""


@query("v4_hash_embedding", with_tables(f"{_CHUNKS}, {_TERMS} SELECT * FROM idx", DOCUMENT))
def hash_embedding(spark, sf):
    return r.hashed_terms(text_chunks(spark, sf), "chunk_id", "content")


REQUEST = "the nation of then, and eron entes that was queux"
_HITS = f"""qterm AS (SELECT ('0x' || substr(md5(term), 1, 4))::INTEGER % 512 AS bucket, count(*) AS q
          FROM (SELECT unnest(regexp_extract_all('{REQUEST}', '([a-z0-9]+)', 1)) AS term) GROUP BY 1),
hit AS (SELECT chunk_id, dot / (sqrt(n2::DOUBLE) * sqrt((SELECT sum(q * q) FROM qterm)::DOUBLE)) AS score
        FROM (SELECT chunk_id, sum(weight * coalesce(q, 0)) AS dot, sum(weight * weight) AS n2 FROM idx LEFT JOIN qterm USING (bucket) GROUP BY 1)
        WHERE dot > 0 ORDER BY score DESC, chunk_id LIMIT 5)"""


def _hits(spark, sf, chunks=None):
    index = r.hashed_terms(chunks if chunks is not None else text_chunks(spark, sf), "chunk_id", "content")
    asked = spark.range(1).select(F.lit("q").alias("key"), F.lit(REQUEST).alias("text"))
    return r.hashed_search(index, r.hashed_terms(asked, "key", "text"), "chunk_id")


@query("v4_hashed_search", with_tables(f"{_CHUNKS}, {_TERMS}, {_HITS} SELECT chunk_id, round(score, 9) AS score FROM hit", DOCUMENT))
def hashed_search(spark, sf):
    return _hits(spark, sf).select("chunk_id", F.round("score", 9).alias("score"))


def _linked_chunks(spark, sf):
    """Chunks of a document belong to the customer type of the same number."""
    return text_chunks(spark, sf).select(
        "chunk_id", "source_key", "content", "document_id",
        F.array(F.concat(F.lit("type:c:"), F.col("document_id").cast("string"))).alias("entity_ids"))


def _evident_nodes(spark, sf):
    """Customer types name the first chunk of their document as evidence."""
    number = F.regexp_extract("uid", "^type:c:(\\d+)$", 1)
    ids = F.when(number != "", F.array(F.concat(F.lit("document:"), number, F.lit(":chunk:0")))).otherwise(F.array().cast("array<string>"))
    return lake.graph_nodes(spark, sf).withColumn("evidence_chunk_ids", ids)


_HYBRID = f"""{_CHUNKS}, {_TERMS}, {_HITS},
rhit AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM hit),
und AS (SELECT DISTINCT src AS near, dst AS uid FROM edge WHERE type <> 'CONTAINS' UNION SELECT DISTINCT dst, src FROM edge WHERE type <> 'CONTAINS'),
ok AS (SELECT uid FROM node WHERE project_id = 'commerce'),
h0 AS (SELECT DISTINCT uid, 0 AS depth FROM ok SEMI JOIN (SELECT 'type:c:' || document_id AS uid FROM chunk SEMI JOIN hit USING (chunk_id)) USING (uid)),
h1 AS (SELECT DISTINCT u.uid, 1 AS depth FROM und u SEMI JOIN h0 ON u.near = h0.uid SEMI JOIN ok ON u.uid = ok.uid ANTI JOIN h0 ON u.uid = h0.uid),
h2 AS (SELECT DISTINCT u.uid, 2 AS depth FROM und u SEMI JOIN h1 ON u.near = h1.uid SEMI JOIN ok ON u.uid = ok.uid ANTI JOIN h0 ON u.uid = h0.uid ANTI JOIN h1 ON u.uid = h1.uid),
near AS (SELECT * FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) ORDER BY depth, uid LIMIT 50),
link AS (SELECT src, dst, type, graph_key FROM edge WHERE src IN (SELECT uid FROM near) AND dst IN (SELECT uid FROM near) ORDER BY type, src, dst, graph_key LIMIT 200),
wanted AS (SELECT chunk_id, min((source, rank, chunk_id)) AS pos_at FROM (
    SELECT chunk_id, 0 AS source, rank FROM rhit
    UNION ALL SELECT 'document:' || substr(uid, 8) || ':chunk:0', 1, row_number() OVER (ORDER BY depth, uid) FROM near WHERE uid LIKE 'type:c:%')
  GROUP BY chunk_id ORDER BY pos_at LIMIT 12),
merged AS (SELECT c.*, row_number() OVER (ORDER BY pos_at) AS rank FROM wanted JOIN chunk c USING (chunk_id))"""


def _hybrid(spark, sf):
    # Chunks and edges are stored tables to a search: written once, read by each of its steps.
    chunks, edges = cut(_linked_chunks(spark, sf)), cut(lake.graph_edges(spark, sf))
    return r.hybrid_search(chunks, cut(_evident_nodes(spark, sf)), edges, _hits(spark, sf, chunks), "commerce")


@query("v2_hybrid_search", with_tables(f"{_HYBRID} SELECT rank, chunk_id, source_key, content FROM merged", DOCUMENT, GRAPH))
def hybrid_search(spark, sf):
    return _hybrid(spark, sf)[0].select("rank", "chunk_id", "source_key", "content")


@query("v3_context", with_tables(
    f"""{_HYBRID} SELECT CASE WHEN length(t) <= 12000 THEN t ELSE substr(t, 1, 12000 - 51) || chr(10) || chr(10) || '[Context truncated to configured character limit]' END AS context FROM (
    SELECT 'EVIDENCE CHUNKS:' || chr(10) || (SELECT string_agg('[chunkId: ' || chunk_id || '][source: ' || source_key || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) FROM merged)
    || chr(10) || chr(10) || 'GRAPH CONTEXT:' || chr(10) || '{{"nodes":[' || (SELECT string_agg('{{"id":"' || uid || '","label":"' || label || '","name":"' || name || '"}}', ',' ORDER BY depth, uid) FROM near JOIN node USING (uid))
    || '],"relationships":[' || (SELECT string_agg('{{"sourceId":"' || src || '","targetId":"' || dst || '","type":"' || type || '"}}', ',' ORDER BY type, src, dst, graph_key) FROM link) || ']}}' AS t)""",
    DOCUMENT, GRAPH))
def context(spark, sf):
    return r.build_context(*_hybrid(spark, sf), limit=12000)


@query("j13_evidence_chunks", with_tables(
    f"{_CHUNKS} SELECT uid, chunk_id, document_id FROM (SELECT uid, 'document:' || substr(uid, 8) || ':chunk:0' AS chunk_id FROM node WHERE uid LIKE 'type:c:%') JOIN chunk USING (chunk_id)",
    DOCUMENT, GRAPH))
def evidence_chunks(spark, sf):
    """Evidence of every node, not only of one neighbourhood: both sides are large, so nothing is broadcast by hand."""
    ids = _evident_nodes(spark, sf).select("uid", F.explode("evidence_chunk_ids").alias("chunk_id"))
    return text_chunks(spark, sf).join(ids, "chunk_id").select("uid", "chunk_id", "document_id")


@query("u1_first_wins_merge", with_tables(
    f"""{_CHUNKS}, long AS (SELECT chunk_id, row_number() OVER (ORDER BY length(content) DESC, chunk_id) AS rank FROM chunk ORDER BY rank LIMIT 8),
    early AS (SELECT chunk_id, row_number() OVER (ORDER BY length(content) DESC, document_id, index DESC) AS rank FROM chunk ORDER BY rank LIMIT 8)
    SELECT chunk_id, source FROM (SELECT chunk_id, 0 AS source, rank FROM long UNION ALL SELECT chunk_id, 1, rank FROM early WHERE chunk_id NOT IN (SELECT chunk_id FROM long))
    ORDER BY source, rank LIMIT 12""", DOCUMENT))
def first_wins_merge(spark, sf):
    size = F.length("content")
    chunks = text_chunks(spark, sf)

    def best(*order):
        from pyspark.sql import Window as W
        top = chunks.select("chunk_id", "document_id", "index", size.alias("size")).orderBy(*order).limit(8)
        return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))).select("chunk_id", "rank")

    return r.merge_chunks(best(F.desc("size"), "chunk_id"), best(F.desc("size"), "document_id", F.desc("index"))).select("chunk_id", "source")


@query("u3_entity_seeds", with_tables(
    f"""{_CHUNKS} SELECT DISTINCT 'type:c:' || document_id AS uid FROM chunk ORDER BY uid LIMIT 100""", DOCUMENT))
def entity_seeds(spark, sf):
    return r.entity_seeds(_linked_chunks(spark, sf)).select("uid")
