"""Quality dashboard queries."""

import uuid

from pyspark.sql import functions as F

from cairn.operators import quality as q
from cairn.plans.oracle_tables import METHODS, with_tables
from cairn.plans.registry import query
from cairn.session import cut, shared_dir
from cairn.sources import lake

# Besides the defaults, thresholds that separate long texts from short ones.
STRICT = {"cyclomatic": 100, "cognitive": 300}


def _methods(spark, sf):
    """Method facts are measured once and stored, as an ingest would; every branch reads the narrow table."""
    return q.with_thresholds(cut(lake.methods(spark, sf)))


_KEYED = """keyed AS (
  SELECT project_key, method_uid, line_count, file_path, start_line, 'EXACT' AS type, method_hash AS hash
    FROM methods WHERE line_count >= 5
  UNION ALL SELECT project_key, method_uid, line_count, file_path, start_line, 'STRUCTURAL', structural_hash
    FROM methods WHERE line_count >= 5),
grp AS (SELECT project_key, type, hash, count(*) AS method_count, sum(line_count)::BIGINT AS duplicated_lines
        FROM keyed WHERE trim(hash) <> '' GROUP BY ALL HAVING count(*) >= 2)"""

_SUMMARY = """summary AS (
  SELECT m.project_key, count(*) AS total_methods,
         count(*) FILTER (cyclomatic > {cyc} OR cognitive > {cog}) AS high_complexity,
         max(cyclomatic)::BIGINT AS max_cyclomatic, max(cognitive)::BIGINT AS max_cognitive,
         (SELECT count(DISTINCT method_uid) FROM keyed k JOIN grp g USING (project_key, type, hash)
           WHERE k.project_key = m.project_key) AS duplicate_methods,
         (SELECT count(*) FROM grp g WHERE g.project_key = m.project_key) AS duplicate_groups
  FROM methods m GROUP BY m.project_key),
rated AS (SELECT *, floor(duplicate_methods * 100.0::DOUBLE / total_methods * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS duplicate_ratio
          FROM summary)"""

_SUMMARY_COLUMNS = ["project_key", "total_methods", "duplicate_methods", "duplicate_groups", "duplicate_ratio",
                    "high_complexity", "max_cyclomatic", "max_cognitive"]


@query("a2_quality_summary", with_tables(
    f"{_KEYED}, {_SUMMARY.format(cyc=10, cog=15)} SELECT {', '.join(_SUMMARY_COLUMNS)} FROM rated", METHODS))
def quality_summary(spark, sf):
    return q.summary(_methods(spark, sf)).select(*_SUMMARY_COLUMNS)


@query("a3_duplicate_groups", with_tables(f"{_KEYED} SELECT * FROM grp", METHODS))
def duplicate_groups(spark, sf):
    return q.duplicate_groups(_methods(spark, sf))


@query("u2_duplicate_group_members", with_tables(
    f"{_KEYED} SELECT project_key, type, hash, method_uid, file_path, start_line FROM keyed "
    "SEMI JOIN grp USING (project_key, type, hash)", METHODS))
def duplicate_members(spark, sf):
    return q.duplicate_members(_methods(spark, sf)).select(
        "project_key", "type", "hash", "method_uid", "file_path", "start_line")


@query("a4_quality_gate", with_tables(
    f"""{_KEYED}, {_SUMMARY.format(cyc=100, cog=300)}
    SELECT project_key, CASE WHEN high_complexity > 0 OR duplicate_ratio > 10 THEN 'FAIL' ELSE 'PASS' END AS gate_status,
           array_to_string(list_filter([CASE WHEN high_complexity > 0 THEN high_complexity || ' methods exceed the complexity threshold' END,
             CASE WHEN duplicate_ratio > 10 THEN 'duplicate ratio exceeds the threshold' END], lambda x: x IS NOT NULL), '; ') AS reasons
    FROM rated""", METHODS))
def quality_gate(spark, sf):
    methods = _methods(spark, sf).withColumns({f"t_{k}": F.lit(v) for k, v in STRICT.items()})
    return q.gate(q.summary(methods)).select("project_key", "gate_status", F.array_join("reasons", "; ").alias("reasons"))


@query("t3_top_complex_methods", with_tables(
    """SELECT project_key, method_uid, cyclomatic, cognitive FROM methods WHERE cyclomatic > 10 OR cognitive > 15
    ORDER BY cyclomatic DESC, cognitive DESC, method_uid LIMIT 100""", METHODS))
def top_complex(spark, sf):
    return q.top_complex(_methods(spark, sf)).select("project_key", "method_uid", "cyclomatic", "cognitive")


@query("t4_top_duplicate_groups", with_tables(
    f"{_KEYED} SELECT * FROM grp ORDER BY duplicated_lines DESC, type, hash, project_key LIMIT 100", METHODS))
def top_groups(spark, sf):
    return q.top_groups(_methods(spark, sf))


@query("j25_duplicate_group_detail", with_tables(
    """top AS (SELECT project_key, structural_hash FROM methods GROUP BY ALL ORDER BY count(*) DESC, structural_hash, project_key LIMIT 1)
    SELECT method_uid, file_path, start_line, structural_hash FROM methods SEMI JOIN top USING (project_key, structural_hash)
    WHERE (SELECT count(*) FROM methods SEMI JOIN top USING (project_key, structural_hash)) >= 2""", METHODS))
def duplicate_group_detail(spark, sf):
    """Members of the largest structural group, found by its key as a user would open it."""
    methods = cut(lake.methods(spark, sf))
    top = (methods.groupBy("project_key", "structural_hash").count()
           .orderBy(F.desc("count"), "structural_hash", "project_key").limit(1).select("project_key", "structural_hash"))
    found = methods.join(top, ["project_key", "structural_hash"], "left_semi")
    enough = found.groupBy("structural_hash").count().where("count >= 2")
    return found.join(enough, "structural_hash", "left_semi").select(
        "method_uid", "file_path", "start_line", "structural_hash")


def _snapshots(spark, sf):
    """Snapshot history: an order is one evaluation of the customer's project."""
    o = lake.raw(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("project_key"), F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"), F.floor("o_totalprice").cast("long").alias("total_methods"))


@query("w7_snapshot_trend", """
    SELECT 'c' || o_custkey AS project_key, o_orderkey AS id, floor(o_totalprice)::BIGINT AS total_methods,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position
    FROM orders QUALIFY position <= 30""")
def snapshot_trend(spark, sf):
    return q.trend(_snapshots(spark, sf)).select("project_key", "id", "total_methods", "position")


def _evaluations(spark, sf):
    """Two evaluations of every customer's project: all its orders, and all but those still open."""
    o = lake.raw(spark, sf, "orders").withColumn("project_key", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))

    def measured(df):
        return df.groupBy("project_key").agg(
            F.count(F.lit(1)).alias("total_methods"),
            F.count_if(F.col("o_orderstatus") == "F").alias("duplicate_methods"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("duplicate_groups"),
            F.count_if(F.col("o_totalprice") > 100000).alias("high_complexity"),
            F.max(F.month("o_orderdate")).cast("long").alias("max_cyclomatic"),
            F.max(F.dayofmonth("o_orderdate")).cast("long").alias("max_cognitive"),
        ).withColumn("duplicate_ratio", q.percent(F.col("duplicate_methods"), F.col("total_methods")))

    stored = measured(o.where("o_orderstatus <> 'P'")).withColumns(
        {"id": F.lit(1), "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})
    return measured(o), stored


_EVALUATION = """SELECT 'c' || o_custkey AS project_key, count(*) AS total_methods,
    count(*) FILTER (o_orderstatus = 'F') AS duplicate_methods, count(*) FILTER (o_orderpriority = '1-URGENT') AS duplicate_groups,
    count(*) FILTER (o_totalprice > 100000) AS high_complexity, max(month(o_orderdate)) AS max_cyclomatic,
    max(day(o_orderdate)) AS max_cognitive FROM orders"""


@query("w6_snapshot_if_changed", f"""
    WITH cur AS ({_EVALUATION} GROUP BY o_custkey), old AS ({_EVALUATION} WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
    SELECT project_key, total_methods, duplicate_methods, high_complexity FROM cur
    WHERE NOT EXISTS (SELECT 1 FROM old WHERE old = cur)""")
def snapshot_if_changed(spark, sf):
    current, stored = _evaluations(spark, sf)
    return q.changed_snapshots(current, stored).select(
        "project_key", "total_methods", "duplicate_methods", "high_complexity")


@query("s11_snapshot_append", with_tables(
    f"""{_KEYED}, {_SUMMARY.format(cyc=10, cog=15)} SELECT project_key, total_methods, duplicate_ratio, unnest([1, 2]) AS id FROM rated""", METHODS))
def snapshot_append(spark, sf):
    """Summaries of two evaluations appended to the snapshot table."""
    table = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    summary = q.summary(_methods(spark, sf)).select("project_key", "total_methods", "duplicate_ratio")
    for number in (1, 2):
        q.append_snapshots(summary.withColumn("id", F.lit(number)), table)
    return spark.read.parquet(table)
