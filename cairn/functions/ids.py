"""Stable identifiers: uids by kind, name-based UUIDs, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.files import normalize_path
from cairn.functions.text import non_blank

DEFAULT_PROJECT = "default"
DEFAULT_MODULE = "default"


def project_or_default(project: Column) -> Column:
    return F.coalesce(non_blank(project), F.lit(DEFAULT_PROJECT))


def uid(kind: str, project: Column, *parts: Column) -> Column:
    """``kind:project:part…`` with trimmed parts."""
    return F.concat_ws(":", F.lit(kind), project_or_default(project), *[F.trim(p) for p in parts])


def file_uid(project: Column, path: Column) -> Column:
    return F.concat_ws(":", F.lit("file"), project_or_default(project), normalize_path(path))


def table_uid(project: Column, schema: Column, table: Column) -> Column:
    return uid("table", project, F.coalesce(non_blank(schema), F.lit("public")), table)


def column_uid(project: Column, schema: Column, table: Column, column: Column) -> Column:
    return uid("column", project, F.coalesce(non_blank(schema), F.lit("public")), table, column)


def rule_uid(project: Column, rule: Column) -> Column:
    return F.when(rule.startswith("rule:"), rule).otherwise(uid("rule", project, rule))


def name_uuid(text: Column) -> Column:
    """Name-based UUID (version 3) of the UTF-8 bytes."""
    h = F.md5(text)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def graph_key(source: Column) -> Column:
    return F.concat(F.lit("rag-source:"), name_uuid(F.trim(source)))
