"""Scan results as JSON text: find the result object wherever it is wrapped, one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import non_blank

# Wrapper keys in the order they are tried.
WRAPPERS = ("text", "content", "result", "data")

NODE = "struct<text:string,content:string,result:string,data:string,status:string,findings:string>"
HITS = "array<struct<path:string,node:string>>"
LEVEL = f"array<struct<path:string,node:string,f:{NODE}>>"
FINDING = "struct<severity:string,ruleId:string,message:string,startLine:int,startColumn:int,endLine:int,endColumn:int>"
RESULT = f"struct<status:string,findings:array<{FINDING}>,errorMessage:string>"


def _opened(path: Column, node: Column) -> Column:
    """Place and fields of a JSON value: one parse yields both what marks a result and where to look on."""
    return F.struct(path.alias("path"), node.alias("node"), F.from_json(node, NODE).alias("f"))


def _items(path: Column, node: Column) -> Column:
    """Elements of a JSON array with their position appended to the path, or the value itself."""
    elements = F.transform(
        F.from_json(node, "array<string>"), lambda e, i: _opened(F.concat(path, F.lpad(i.cast("string"), 9, "0")), e))
    return F.when(F.ltrim(node).startswith("["), elements).otherwise(F.array(_opened(path, node)))


def _is_result(item: Column) -> Column:
    return item["f"]["status"].isNotNull() | item["f"]["findings"].isNotNull()


def _deeper(level: Column) -> Column:
    """Values under the wrapper keys of a level's values, those of results left out."""
    inner = F.filter(level, lambda n: ~_is_result(n))
    wrapped = F.flatten(F.transform(inner, lambda n: F.filter(
        F.array(*[F.struct(F.concat(n["path"], F.lit(str(i))).alias("path"), n["f"][w].alias("node")) for i, w in enumerate(WRAPPERS)]),
        lambda v: v["node"].isNotNull())))
    return F.flatten(F.transform(wrapped, lambda v: F.coalesce(_items(v["path"], v["node"]), F.array())))


def result_object(text: Column) -> Column:
    """JSON text of the first object with ``status`` or ``findings``, depth first.

    Strings and arrays are opened and wrapper keys followed in their order. Levels are walked together;
    the path kept with each value tells which result a depth-first search meets first. A result's own
    children are not searched. A value lies no deeper than the text has opening brackets, which bounds the
    walk; below the last level there is nothing to open and a step costs next to nothing.
    """
    def step(state: Column, _: Column) -> Column:
        hits = F.transform(F.filter(state["level"], _is_result), lambda n: F.struct(n["path"].alias("path"), n["node"].alias("node")))
        below = F.when(F.size(state["level"]) > 0, _deeper(state["level"])).otherwise(F.array().cast(LEVEL))
        return F.struct(F.coalesce(below, F.array()).cast(LEVEL).alias("level"), F.concat(state["hits"], hits).cast(HITS).alias("hits"))

    levels = F.sequence(F.lit(0), F.regexp_count(text, F.lit(r"[\[{]")))
    start = F.struct(F.coalesce(_items(F.lit(""), text), F.array()).cast(LEVEL).alias("level"), F.array().cast(HITS).alias("hits"))
    return F.array_min(F.aggregate(levels, start, step, lambda state: state["hits"]))["node"]


def findings(files: DataFrame, text_column: str = "response") -> DataFrame:
    """Result rows of scanned files: findings, one PASSED row without any, or one ERROR row."""
    parsed = files.withColumn("_object", result_object(F.col(text_column))).withColumn(
        "_r", F.from_json("_object", RESULT))
    done = F.upper("_r.status") == "COMPLETED"
    failed = F.col("_object").isNull() | ~F.coalesce(done, F.lit(False))
    message = F.when(F.col("_object").isNull(), F.lit("The scanner returned an empty result.")).otherwise(
        F.coalesce(non_blank(F.col("_r.errorMessage")), F.lit("Scan failed.")))
    rows = parsed.withColumns({"_failed": failed, "_message": message}).select(
        *files.columns, "_failed", "_message",
        F.explode_outer(F.when(~failed, F.col("_r.findings"))).alias("f"))
    finding = F.col("f").isNotNull()
    dash = F.lit("-")

    def pick(value, fallback, passed):
        return F.when(F.col("_failed"), dash if passed == "-" else F.col("_message")).when(
            finding, F.coalesce(non_blank(value), F.lit(fallback))).otherwise(passed)

    return rows.select(
        *[c for c in files.columns if c != text_column],
        F.when(F.col("_failed"), "ERROR").when(finding, "FINDING").otherwise("PASSED").alias("status"),
        pick(F.col("f.severity"), "WARNING", "-").alias("severity"),
        pick(F.col("f.ruleId"), "unknown", "-").alias("rule_id"),
        pick(F.col("f.message"), "Security finding", "No security findings").alias("message"),
        F.col("f.startLine").alias("start_line"), F.col("f.startColumn").alias("start_column"),
        F.col("f.endLine").alias("end_line"), F.col("f.endColumn").alias("end_column"),
    )
