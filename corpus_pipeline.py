"""The corpus pipeline: quality rules, one document of each near-duplicate group, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` applies them to ``documents`` one after the
other, each stage's result written to the shared folder and read again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, mixing, near_copies, quality_rules, token_planes
from cairn.llm.common import table
from cairn.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the production policy."""
    return quality_rules.apply_to_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that are connected by similarities of 0.8 or more."""
    return near_copies.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.apply_to_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once, twice or not at all."""
    return mixing.apply_to_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of id planes."""
    return token_planes.encode_and_read(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_ids),
]

#: SQL has neither the shingle join's pruning, the singular vectors nor the tokenizer: tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
