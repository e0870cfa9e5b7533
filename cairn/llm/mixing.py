"""Mixing sources to target weights by nested hash thresholds.

Each document has a fixed 60-bit hash. A source that may give ``b`` words more than its whole epochs takes the
documents with the smallest hashes, as many as fit; a larger budget takes all of those and more (the budgets nest).
The threshold is read off histograms: words are summed by source and leading hash bits, the bucket in which the budget
ends is found, and only the documents of that bucket are summed again by the next bits. Nothing is sorted, and what is
gathered is one row per source and bucket.

Defined cases: a null text has no words; null sources are one source, ordered last; documents without an id are hashed
by their text; rows that repeat another one wholly share its hash and are taken or left together; an empty table
gives no rows; without any word all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.llm.common import columns_of, fresh, n_words, row_hash, table, text_of
from cairn.llm.registry import query
from cairn.session import cut

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
#: No source is used more often than this.
EPOCHS = 2
#: Hash bits that each pass looks at, and the passes: 33 bits of 60, over eight thousand million buckets a source.
STEP, PASSES = 11, 3


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target``: the source's share of ``budget`` times all words, held at ``epochs`` times its own.

    What a held source leaves is dealt to the others by weight, so the shares are ``level * weight`` with one level
    for all, which the sources ordered by the level at which they fill up determine. One row per source is windowed.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), turn)
    limit = F.col("source_size") * epochs
    filled = W.orderBy("full_at", F.col("source").isNull(), "source")
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    rest = filled.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("total") * budget - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    every = W.partitionBy()
    return (
        sources.withColumn("weight", weight).withColumn("limit", limit)
        .withColumn("full_at", F.col("limit") / F.col("weight")).withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", level)
        # The first source that its level doesn't fill sets it for those after it, whose own are smaller; earlier ones are full.
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("full_at") <= F.coalesce("level", "full_at"), F.col("limit").cast("double"))
                    .otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def _prefix(steps: int) -> Column:
    """The leading ``steps * STEP`` of the 60 bits."""
    return F.shiftright("hash", 60 - steps * STEP)


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source the whole epochs and the prefix below which a document is taken once more.

    ``rows``: source, size, hash. ``wanted``: source, source_size, target.
    """
    full = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        F.least(F.lit(EPOCHS), F.floor(F.col("target") / F.col("source_size"))))
    state = wanted.withColumn("full", full.cast("long")).select(
        "source", "source_size", "target", "full",
        (F.col("target") - F.col("full") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("bound"))
    for step in range(1, PASSES + 1):
        old = state.select(F.col("source").alias("of"), "bound")
        # Of a source with buckets left to look at, those under the boundary bucket of the pass before.
        mine = rows.join(old, F.col("source").eqNullSafe(F.col("of"))).where(_prefix(step - 1) == F.col("bound"))
        sums = mine.groupBy("source", _prefix(step).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        known = state.select(F.col("source").alias("of"), "left")
        over = sums.withColumn("upto", upto).join(known, F.col("source").eqNullSafe(F.col("of")))
        found = over.groupBy("of").agg(
            # At most 2^STEP buckets of a source: those that fit, and the first that doesn't.
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("used"),
            F.min(F.when(F.col("upto") > F.col("left"), F.col("bucket"))).alias("next"))
        first = F.shiftleft(F.col("bound"), STEP)
        state = cut(state.join(found, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "full", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
            # Nothing over the budget: the boundary is past the last bucket, and later passes find no rows there.
            F.coalesce("next", first + F.lit(1 << STEP)).alias("bound")))
    return state


def mixed(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """``rows`` (source, size, hash and more) with source_size, target and ``copies``: how often the mix takes each."""
    sources = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = thresholds(rows, targets(sources, weights, budget)).select(
        F.col("source").alias("of"), "source_size", "target", "full", "bound")
    copies = F.col("full") + F.when(_prefix(PASSES) < F.col("bound"), 1).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "copies", F.least(copies, F.lit(EPOCHS)).cast("int")).drop("of", "full", "bound")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(text_of()).alias("size"), row_hash(docs, "mix:").alias("hash"))


def apply_to_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """The documents as often as the mix takes them, with the columns they came with."""
    rows = cut(sized(docs))
    sources = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    names = {x: fresh(docs, x) for x in ("of", "full", "bound", "hash", "copy")}
    plan = thresholds(rows, targets(sources, weights, budget)).select(
        F.col("source").alias(names["of"]), F.col("full").alias(names["full"]), F.col("bound").alias(names["bound"]))
    lead = F.shiftright(names["hash"], 60 - PASSES * STEP)
    copies = F.least(F.col(names["full"]) + F.when(lead < F.col(names["bound"]), 1).otherwise(0), F.lit(EPOCHS))
    hashed = docs.select(*columns_of(docs), row_hash(docs, "mix:").alias(names["hash"]))
    dealt = hashed.join(plan, F.col("source").eqNullSafe(F.col(names["of"]))).where(copies > 0)
    return dealt.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*columns_of(docs))


def mix_sql(docs: str = "documents") -> str:
    """Common table expressions that end in ``mix``: doc_id, size, source_size, target, copies of every row."""
    weight = f"list_value{WEIGHTS}[1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)})]"
    return rf"""
  s0 AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT
                  >> {60 - PASSES * STEP} AS h
         FROM {docs}),
  s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM s0 GROUP BY source),
  s2 AS (SELECT *, {weight} AS weight, source_size * {EPOCHS} AS lim, sum(source_size) OVER () AS total FROM s1),
  s3 AS (SELECT *, lim / weight AS full_at FROM s2),
  s4 AS (SELECT *, (total * {BUDGET}::DOUBLE
                    - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
         FROM s3 WINDOW o AS (ORDER BY full_at, source IS NULL, source)),
  s5 AS (SELECT *, max(CASE WHEN lev <= full_at THEN lev END) OVER () AS level FROM s4),
  s6 AS (SELECT source, source_size,
                CASE WHEN full_at <= coalesce(level, full_at) THEN lim::DOUBLE ELSE level * weight END AS target FROM s5),
  s7 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least({EPOCHS}, floor(target / source_size)) END AS epochs FROM s6),
  s8 AS (SELECT s0.*, s7.source_size, s7.target, s7.epochs,
                sum(size) OVER (PARTITION BY s0.source ORDER BY h) AS upto
         FROM s0 JOIN s7 ON s0.source IS NOT DISTINCT FROM s7.source),
  mix AS (SELECT *, least({EPOCHS}, epochs + CASE WHEN upto <= target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS copies
          FROM s8)
"""


@query("op4_source_mix", f"""
WITH {mix_sql()}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM mix""")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return mixed(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
