"""Code-quality dashboard: duplicate groups, summary, gate, ranking, snapshots and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Thresholds used when a project has none of its own.
DEFAULT_THRESHOLDS = {"cyclomatic": 10, "cognitive": 15, "duplicate_ratio": 10.0, "minimum_lines": 5}
LIST_LIMIT = 100
TREND_LIMIT = 30
RATIO_TOLERANCE = 0.0001


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, half-up to two places; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 100.0 / whole * 100.0 + 0.5) / 100.0)


def with_thresholds(methods: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Attach each project's thresholds, or the defaults where it has none."""
    names = {"cyclomatic": "t_cyclomatic", "cognitive": "t_cognitive",
             "duplicate_ratio": "t_duplicate_ratio", "minimum_lines": "t_minimum_lines"}
    if thresholds is None:
        return methods.select("*", *[F.lit(DEFAULT_THRESHOLDS[k]).alias(v) for k, v in names.items()])
    own = thresholds.select("project_key", *[F.col(k).alias(v) for k, v in names.items()])
    joined = methods.join(own, "project_key", "left")
    return joined.withColumns({v: F.coalesce(F.col(v), F.lit(DEFAULT_THRESHOLDS[k])) for k, v in names.items()})


def keyed_by_hash(methods: DataFrame) -> DataFrame:
    """One row per method and kind of duplicate key, from a single pass over the methods."""
    kinds = F.array(
        F.struct(F.lit("EXACT").alias("type"), F.col("method_hash").alias("hash")),
        F.struct(F.lit("STRUCTURAL").alias("type"), F.col("structural_hash").alias("hash")),
    )
    eligible = methods.where(F.col("line_count") >= F.col("t_minimum_lines"))
    return eligible.withColumn("k", F.explode(kinds)).where(F.trim("k.hash") != "").select(
        *methods.columns, F.col("k.type").alias("type"), F.col("k.hash").alias("hash")
    )


def duplicate_groups(methods: DataFrame) -> DataFrame:
    """Groups of at least two methods with one hash; sums combine map-side, so a huge group is one row per task."""
    return (
        keyed_by_hash(methods)
        .groupBy("project_key", "type", "hash")
        .agg(F.count(F.lit(1)).alias("method_count"), F.sum("line_count").alias("duplicated_lines"))
        .where("method_count >= 2")
    )


def duplicate_members(methods: DataFrame) -> DataFrame:
    """Members of every duplicate group, one row each (a group is never gathered into one value)."""
    groups = duplicate_groups(methods).select("project_key", "type", "hash")
    return keyed_by_hash(methods).join(groups, ["project_key", "type", "hash"], "left_semi")


def group_members(methods: DataFrame, kind: str, project_key: str, hash_value: Column) -> DataFrame:
    """Detail of one group, whatever the line threshold; empty unless it has at least two members."""
    column = "method_hash" if kind == "EXACT" else "structural_hash"
    found = methods.where((F.col("project_key") == project_key) & (F.col(column) == hash_value))
    size = found.agg(F.count(F.lit(1))).scalar()
    return found.where(size >= 2)


def summary(methods: DataFrame) -> DataFrame:
    """Per project: totals, duplicates, ratio, methods over threshold and maxima."""
    groups = duplicate_groups(methods)
    per_project_groups = groups.groupBy("project_key").agg(F.count(F.lit(1)).alias("duplicate_groups"))
    # A method counts once though it may sit in an exact and a structural group.
    duplicated = (
        duplicate_members(methods).select("project_key", "method_uid").distinct()
        .groupBy("project_key").agg(F.count(F.lit(1)).alias("duplicate_methods"))
    )
    over = (F.col("cyclomatic") > F.col("t_cyclomatic")) | (F.col("cognitive") > F.col("t_cognitive"))
    totals = methods.groupBy("project_key").agg(
        F.count(F.lit(1)).alias("total_methods"),
        F.count_if(over).alias("high_complexity"),
        F.max("cyclomatic").cast("long").alias("max_cyclomatic"),
        F.max("cognitive").cast("long").alias("max_cognitive"),
        F.max("t_duplicate_ratio").cast("double").alias("t_duplicate_ratio"),
    )
    joined = totals.join(duplicated, "project_key", "left").join(per_project_groups, "project_key", "left")
    counts = joined.withColumns({
        "duplicate_methods": F.coalesce("duplicate_methods", F.lit(0)).cast("long"),
        "duplicate_groups": F.coalesce("duplicate_groups", F.lit(0)).cast("long"),
    })
    return counts.withColumn("duplicate_ratio", percent(F.col("duplicate_methods"), F.col("total_methods")))


def gate(summary_df: DataFrame) -> DataFrame:
    """PASS, or FAIL with the reasons."""
    complex_reason = F.when(
        F.col("high_complexity") > 0,
        F.concat(F.col("high_complexity").cast("string"), F.lit(" methods exceed the complexity threshold")),
    )
    ratio_reason = F.when(
        F.col("duplicate_ratio") > F.col("t_duplicate_ratio"), F.lit("duplicate ratio exceeds the threshold")
    )
    reasons = F.filter(F.array(complex_reason, ratio_reason), lambda r: r.isNotNull())
    return summary_df.withColumn("reasons", reasons).withColumn(
        "gate_status", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL")
    )


def top_complex(methods: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    over = (F.col("cyclomatic") > F.col("t_cyclomatic")) | (F.col("cognitive") > F.col("t_cognitive"))
    return methods.where(over).orderBy(F.desc("cyclomatic"), F.desc("cognitive"), "method_uid").limit(limit)


def top_groups(methods: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    return duplicate_groups(methods).orderBy(F.desc("duplicated_lines"), "type", "hash", "project_key").limit(limit)


# Measures whose change makes a new snapshot.
MEASURES = ("total_methods", "duplicate_methods", "duplicate_groups", "high_complexity", "max_cyclomatic", "max_cognitive")


def latest_per_key(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Newest row per key by an aggregate that combines map-side (no per-key sort in one task)."""
    picked = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def changed_snapshots(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Summaries that differ from the project's latest stored snapshot, or have none."""
    columns = [*MEASURES, "duplicate_ratio"]
    latest = latest_per_key(stored, "project_key", ["created_at", "id"], columns)
    old = latest.select("project_key", F.lit(True).alias("_has"), *[F.col(c).alias(f"_old_{c}") for c in columns])
    same = F.coalesce(F.col("_has"), F.lit(False))
    for c in MEASURES:
        same = same & (F.col(c) == F.col(f"_old_{c}"))
    same = same & (F.abs(F.col("duplicate_ratio") - F.col("_old_duplicate_ratio")) < RATIO_TOLERANCE)
    return current.join(old, "project_key", "left").where(~same).select(*current.columns)


def changes(evaluated: DataFrame, stored: DataFrame) -> DataFrame:
    """Of several evaluations of a project those that differ from the one before, the first from the latest stored."""
    columns = [*MEASURES, "duplicate_ratio"]
    latest = latest_per_key(stored, "project_key", ["created_at", "id"], [c for c in evaluated.columns if c != "project_key"])
    both = evaluated.withColumn("_new", F.lit(True)).unionByName(latest.select(*evaluated.columns).withColumn("_new", F.lit(False)))
    w = W.partitionBy("project_key").orderBy("_new", "created_at", "id")
    both = both.withColumns({"_has": F.lag(F.lit(True)).over(w), **{f"_old_{c}": F.lag(c).over(w) for c in columns}})
    same = F.coalesce(F.col("_has"), F.lit(False))
    for c in MEASURES:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    same = same & F.coalesce(F.abs(F.col("duplicate_ratio") - F.col("_old_duplicate_ratio")) < RATIO_TOLERANCE, F.lit(False))
    return both.where(F.col("_new") & ~same).select(*evaluated.columns)


def trend(snapshots: DataFrame, limit: int = TREND_LIMIT) -> DataFrame:
    """Newest snapshots per project; the rank filter prunes each task to ``limit`` rows per key before the shuffle."""
    w = W.partitionBy("project_key").orderBy(F.desc("created_at"), F.desc("id"))
    return snapshots.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").parquet(path)
