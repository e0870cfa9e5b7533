"""A sample of the registered queries against DuckDB on the smallest data set."""

import os

import pytest

from cairn.plans import load_all
from cairn.plans.registry import ORACLE, QUERIES
from tools.check import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "a2_quality_summary", "a3_duplicate_groups", "j2_conversation_list", "j6_source_inventory", "w1_duplicate_documents", "a15_job_final_status",
    "a10_package_matrix", "a24_pair_fan_out", "g1_neighbourhood", "g3_layer_flow_edges", "c9_column_lineage", "c12_standard_rules",
    "j18_prompt_tables", "v2_hybrid_search", "d1_insert_absent", "d12_index_outcomes", "st1_inbox_ingest", "w10_match_numbers",
]

load_all()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["s4_inbox_chunks", "st1_inbox_ingest"])
def test_streams_read_tables_of_many_files(spark, duck, name, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    cur = duck.execute(ORACLE[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
