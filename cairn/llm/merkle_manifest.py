"""Merkle manifest of a dataset: a hash tree over its rows with a proof for every row, by lag and lead windows.

Rows are numbered within their group by range partitions, so that no task holds a group. The ordered nodes of a group
are cut into blocks of 8**3, and a window over a block serves three levels: a node lies on the row of its first leaf, so
its siblings on level ``k`` are ``8**k`` to ``7 * 8**k`` rows away. Lags and leads with these fixed offsets, masked by
the node's slot in its run and the length of the run, are its siblings to the left and right; a first child's row hashes
itself and its leads to the parent. The blocks' roots are the nodes of the next tier, 512 times fewer, until each group
has one node; the groups' roots are ordered into one more tree in the same way. On the way down each block's steps go
before those of its root, which joins its leaves where their window has left them.

Nothing is collected but the largest group's size and the number of groups; a step is at most seven digests for each
side, and a row's path has one step for each level (nine for 100 million rows).

Defined cases: nulls are `-` in a leaf, apart from empty texts; the null group is the first; a null id comes first in
its group; rows with the same id are ordered by their leaf, so equal rows take equal places in any order; a group of
one row has no step below its root; an empty table gives no rows; further columns are not part of a leaf.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.llm.common import table
from cairn.llm.registry import query
from cairn.operators.ordering import positions
from cairn.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
_STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column] | None = None) -> Column:
    """The leaf of a row, with other values for some of its fields."""
    return digest(*(field((values or {}).get(name, F.col(name))) for name in FIELDS))


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` and the siblings of ``path`` lead to."""
    return F.aggregate(path, start, lambda at, step: digest(step["left"], at, step["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, pos, n, digest) with block, path (their steps within it), top (the block's root, on its first row)."""
    by_block = W.partitionBy("key", "block").orderBy("pos")
    so_far = by_block.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("top", F.col("digest"))
    steps = []
    for k in range(LEVELS):
        apart = ARITY**k
        level = out.select(
            "*", F.expr(f"(n + {apart - 1}) div {apart}").alias("_nodes"), F.expr(f"(pos div {apart}) % {ARITY}").alias("_slot"),
        ).withColumn("_run", F.least(F.lit(ARITY), F.col("_nodes") - (F.expr(f"pos div {apart}") - F.col("_slot"))))
        here = (F.col("_nodes") > 1) & (F.expr(f"pos % {apart}") == 0)
        left = [F.when(F.col("_slot") >= d, F.lag("top", d * apart).over(by_block)) for d in range(ARITY - 1, 0, -1)]
        right = [F.when(F.col("_slot") + d < F.col("_run"), F.lead("top", d * apart).over(by_block)) for d in range(1, ARITY)]
        level = level.withColumn("_left", F.concat_ws("", *left)).withColumn("_right", F.concat_ws("", *right))
        step = F.struct(F.col("_left").alias("left"), F.col("_right").alias("right"))
        parent = F.when(F.col("_nodes") > 1, digest(F.col("top"), F.col("_right"))).otherwise(F.col("top"))
        name = f"_step{k}"
        out = level.withColumn(name, F.when(here, step)).withColumn(
            "top", F.when(F.expr(f"pos % {apart * ARITY}") == 0, parent)).drop("_nodes", "_slot", "_run", "_left", "_right")
        if k:  # the rows behind the first leaf of a node take over its step
            out = out.withColumn(name, F.last(name, True).over(so_far))
        steps.append(name)
    return out.withColumn("path", F.array_compact(F.array(*steps))).drop(*steps)


def _tiers(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every tier but the last, and each key's root (key, digest)."""
    tiers = []
    while True:
        tiers.append(nodes)
        tops = _climbed(nodes).where(F.expr(f"pos % {BLOCK}") == 0)
        nodes = cut(tops.select(
            "key", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("digest")))
        largest = -(-largest // BLOCK)
        if largest <= 1:
            return tiers, nodes.select("key", "digest")


def _descended(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first tier's nodes with their whole path; ``above`` (key, path, and what goes along) is what is over each root."""
    above = above.withColumn("at", F.lit(0).cast("long"))
    for i, nodes in reversed(list(enumerate(tiers))):
        inner = _climbed(nodes).drop("top").withColumnRenamed("path", "_own")
        over = above.withColumnRenamed("at", "block").withColumnRenamed("path", "_over")
        found = inner.join(over, ["key", "block"]).withColumn("path", F.concat("_own", "_over"))
        if i == 0:
            return found.drop("block", "_own", "_over", "n", "key")
        kept = [c for c in above.columns if c not in ("key", "at", "path")]
        above = cut(found.select("key", F.col("pos").alias("at"), "path", *kept))
    raise ValueError("no tier")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """pos, from 0, and n within each key."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return positions(rows, ["key"], order, "pos").withColumn("pos", F.col("pos") - 1).join(sizes, "key")


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, altered (a leaf to test, by default the row's own), subroot, root and path of every row."""
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    own = leaf()
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), own.alias("digest"), (own if altered is None else altered).alias("altered")))
    schema = "doc_id long, leaf string, altered string, subroot string, root string, path array<" + _STEP + ">"
    largest = rows.groupBy("key").count().agg(F.max("count")).first()[0]
    if largest is None:
        return rows.sparkSession.createDataFrame([], schema)
    leaves = cut(_numbered(rows, ["doc_id", "digest"]))
    tiers, subroots = _tiers(leaves, largest)

    groups = subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    n_groups = groups.count()
    groups = cut(_numbered(groups, ["group"]))
    group_tiers, root = _tiers(groups, n_groups)
    above = root.select("key", F.col("digest").alias("root"), F.array().cast(f"array<{_STEP}>").alias("path"))
    over = _descended(group_tiers, above).select(F.col("group").alias("key"), F.col("digest").alias("subroot"), "root", "path")
    found = _descended(tiers, cut(over))
    return found.select("doc_id", F.col("digest").alias("leaf"), "altered", "subroot", "root", "path")


def proofs(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the altered leaf and the path) and verified."""
    return manifest(docs, altered).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        fold(F.col("altered"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_third() -> Column:
    """The leaf after tampering: the text's A-Z lower-cased where 3 divides the id's checksum."""
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0
    return F.when(chosen, leaf({"text": F.translate("text", ascii_uppercase, ascii_lowercase)})).otherwise(leaf())


#: The checksum in SQL: a table of 256 entries from the polynomial, then one step for each byte.
CRC_SQL = """crc_steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS v
    FROM range(256) AS r(i)))"""

SQL = f"""
WITH RECURSIVE {CRC_SQL},
docs AS (
  SELECT *, coalesce('=' || lang, '-') AS g,
    xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % 3 = 0 AS chosen
  FROM documents, crc_steps),
leaves AS (
  SELECT *, sha256(before || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(before || coalesce(strlen(text)::VARCHAR || ':' ||
      translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '-')) AS lowered
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') ||
    coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') ||
    coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS before FROM docs)),
placed AS (
  SELECT doc_id, g, leaf, CASE WHEN chosen THEN lowered ELSE leaf END AS altered,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT 0 AS level, g, pos, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, g, pos // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS alive FROM nodes) WHERE alive > 1 GROUP BY level, g, pos // 8),
subroots AS (
  SELECT g, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM nodes GROUP BY g),
tops AS (
  SELECT 0 AS level, pos, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS alive FROM tops) WHERE alive > 1 GROUP BY level, pos // 8),
every AS (SELECT * FROM nodes UNION ALL SELECT level, '' AS g, pos, digest FROM tops),
sides AS (
  SELECT level, g, pos,
    coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY level, g) AS alive FROM every) WHERE alive > 1
  WINDOW r AS (PARTITION BY level, g, pos // 8 ORDER BY pos)),
folds AS (
  SELECT doc_id, leaf, g, pos, 0 AS level, altered AS built, '' AS seen FROM placed
  UNION ALL
  SELECT doc_id, leaf, f.g, f.pos // 8, f.level + 1, sha256(l || built || r), seen || l || r
  FROM folds f JOIN sides s ON s.g = f.g AND s.level = f.level AND s.pos = f.pos),
joined AS (
  SELECT doc_id, leaf, subroot, s.pos AS pos, 0 AS level, built, seen
  FROM folds f JOIN subroots s USING (g)
  WHERE f.level = (SELECT max(level) FROM nodes n WHERE n.g = f.g)),
rest AS (
  SELECT * FROM joined
  UNION ALL
  SELECT doc_id, leaf, subroot, f.pos // 8, f.level + 1, sha256(l || built || r), seen || l || r
  FROM rest f JOIN sides s ON s.g = '' AND s.level = f.level AND s.pos = f.pos)
SELECT doc_id, leaf, subroot, top.digest AS root, sha256(seen) AS proof_sha256, built AS folded_root, built = top.digest AS verified
FROM rest, (SELECT arg_max(digest, level) AS digest, max(level) AS level FROM tops) AS top
WHERE rest.level = top.level
"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"), lowered_third())
