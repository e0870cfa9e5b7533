"""Small awkward tables and DuckDB comparison for the tests of this folder."""

from __future__ import annotations

import os
import re

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, n_words string, `a.b` int, m int"

LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def awkward(spark, copies: int = 3):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, further columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20000))
    rows = [
        (1, LINE * 4, "a", "x", 1, 1), (2, "", "a", None, None, None), (3, None, "b", "x", 1, 1), (4, " \t\n ", None, "x", 1, 1),
        (None, LINE, "a", "x", 1, 1), (None, None, None, None, None, None), (5, long, "b", "x", 1, 1), (6, "one two", "c", "x", 1, 1),
        (7, "schön été 漢字 #*$ %&| <>  x", "c", "x", 1, 1), *[(8, LINE + "\n" + LINE, "d", "x", 1, 1)] * copies,
        (9, "\n".join([LINE] * 5), "d", "x", 1, 1), (10, LINE.upper() + "!!! " * 30, "a", "x", 1, 1),
    ]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def compare(spark, query, sql, sf_dir: str = SF_DIR) -> None:
    import duckdb

    from tools.check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
