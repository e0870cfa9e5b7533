"""Quality rules as a ledger: every rule is evaluated once per document, its failure kept as one bit.

``ledger`` measures each text and sets bit ``i`` of ``fail_bits`` when rule ``i`` fails. Policies (named, versioned
sets of rules) and ablations then work on the bits alone: a document passes a policy if ``fail_bits & mask`` is 0,
and taking rule ``i`` out of a policy is the same test with one bit less. No text is read again for them.

All of it is row-wise arithmetic on built-in functions; only ``ablations`` groups, and what it groups by is the bit
pattern, of which there are few.

Defined cases: a null or empty text has no words and no lines, so it fails the base rules; repeated rows are judged
row by row; columns of the input with the names of measures are not touched (``apply_to_documents`` returns exactly
the input's columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.code import let
from cairn.llm.common import NOT_SPACE, columns_of, fresh, table, text_of, words
from cairn.llm.registry import query
from cairn.session import cut

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# Rules by position of their bit. Each says when a document fails, over the measures below; integer arithmetic only,
# so that every engine decides alike.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("capitals", "2 * n_capitals > n_letters"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

# Policies by name and version: the rules whose failure rejects a document. A policy always holds the base rules.
POLICIES: dict[str, int] = {
    "base@1": BASE,
    "web@1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "web@2": sum(BIT.values()),
}
PRODUCTION = "web@2"


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that stand in the text twice or more.

    Windows are sorted with their positions, so equal ones are neighbours; the positions that have an equal
    neighbour are sorted again, and each covers three words or as many as lie before the next one.
    """
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def repeated(s: Column) -> Column:
        twin = F.transform(s, lambda x, j: F.when(
            (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]), x["i"]))
        return let(F.sort_array(F.array_compact(twin)), covered)

    def among(ws: Column) -> Column:
        keyed = F.transform(ws, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        # Most texts have no window twice; a hash set tells that for less than a sort.
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(let(F.sort_array(keyed), repeated))

    return F.when(n < 3, F.lit(0)).otherwise(let(windows, among))


def measures(text: Column) -> Column:
    """All measures of one text as a struct of longs."""

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))

    def of(w: Column, lines: Column) -> Column:
        fields = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": count(SYMBOLS),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(w),
            "n_capitals": count("A-Z"),
            "n_letters": count("A-Za-z"),
            "n_exclamations": count("!"),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in fields.items()])

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return let(words(text), lambda w: let(lines, lambda x: of(w, x)))


def failure_bits(m: str) -> Column:
    """The bits of the failed rules over the measures in struct column ``m``."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letters", "n_exclamations")
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        said = " ".join(f"`{m}`.{x}" if x in names else x for x in fails.split(" "))
        bits = bits + F.when(F.expr(said), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def _judged(docs: DataFrame, keep: list[Column], m: str, bits: str) -> DataFrame:
    return docs.select(*keep, measures(text_of()).alias(m)).select("*", failure_bits(m).alias(bits))


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fail_bits and every measure."""
    out = _judged(docs, [F.col("doc_id")], "m", "fail_bits")
    return out.select("doc_id", "fail_bits", "m.*")


def passes(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger's rows with ``base_failed`` and ``kept`` under ``policy``."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & passes(F.col("fail_bits"), policy))


def ablations(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of ``policy``: documents that fail it, and those that only it rejects (kept without it)."""
    mask = POLICIES[policy]
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    counts = []
    for name, bit in BIT.items():
        if mask & bit:
            fails = F.col("fail_bits").bitwiseAND(F.lit(bit).cast("long")) != 0
            rest = F.col("fail_bits").bitwiseAND(F.lit(mask & ~bit).cast("long")) == 0
            counts.append(F.struct(
                F.lit(name).alias("rule"),
                F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
                F.sum(F.when(fails & rest, F.col("n")).otherwise(0)).alias("only_this")))
    one = patterns.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return one.na.fill(0, ["failed", "only_this"])


def apply_to_documents(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The documents that pass ``policy``, with the columns they came with. Judged in the row, so nothing is joined."""
    m = fresh(docs, "m")
    bits = fresh(docs, "bits")
    out = _judged(docs, columns_of(docs), m, bits).where(passes(F.col(bits), policy))
    return out.select(*columns_of(docs))


MEASURE_SQL = r"""
  w AS (SELECT doc_id, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM {docs}),
  k AS (SELECT doc_id, t, w, lines,
               list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS ws FROM w),
  x AS (SELECT doc_id, unnest(ws) AS g, unnest(range(0, len(ws))) AS i FROM k),
  r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1),
  v AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words FROM r GROUP BY doc_id),
  m AS (SELECT k.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
               len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
               coalesce(v.n_repeat_words, 0)::BIGINT AS n_repeat_words,
               length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
               length(regexp_replace(t, '[^A-Za-z]+', '', 'g'))::BIGINT AS n_letters,
               length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclamations
        FROM k LEFT JOIN v ON k.doc_id = v.doc_id),
  f AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
"""


def measure_sql(docs: str = "documents") -> str:
    """The common table expressions that end in ``f``: measures and fail_bits of every row of ``docs`` (unique ids)."""
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES))
    return MEASURE_SQL.replace("{bits}", bits).replace("{docs}", docs)


@query("op10_quality_rules", f"""
WITH {measure_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed,
       (fail_bits & {POLICIES[PRODUCTION]}) = 0 AS kept, fail_bits
FROM f""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return apply_policy(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")
