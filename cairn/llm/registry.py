"""Queries of this package: name -> Spark builder and, where SQL can say it, DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

MODULES = (
    "near_copies", "line_crf", "url_filter", "mixing", "decontaminate", "surrogates", "token_planes", "chat_format",
    "sharding", "quality_rules", "token_counts", "merkle_manifest", "spelling_variants",
)


def query(name: str, sql: str | None = None):
    def register(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        import_module(f"cairn.llm.{module}")
