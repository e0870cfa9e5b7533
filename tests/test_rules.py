"""Literal cases of job guards, package names, evidence, failures and references in very long texts."""

import random

from pyspark.sql import functions as F

from cairn.functions import agent, files
from cairn.operators import chunking, extract, mutation
from cairn.operators import graph as g


def by_hand(total, events):
    """One job's events in order under the guards."""
    status, counts = "QUEUED", {"PASSED": 0, "FINDING": 0, "ERROR": 0}
    for _, kind, outcome in sorted(events):
        if kind == "RUN" and status == "QUEUED":
            status = "RUNNING"
        elif kind == "FILE" and status == "RUNNING":
            counts[outcome] += 1
            if sum(counts.values()) >= total:
                status = "COMPLETED_WITH_ERRORS" if counts["ERROR"] else "COMPLETED"
        elif kind == "FAIL" and status in ("QUEUED", "RUNNING"):
            status = "FAILED"
    return status, sum(counts.values()), counts["PASSED"], counts["FINDING"], counts["ERROR"]


def test_job_guards(spark):
    rng = random.Random(1)
    jobs, events = [], []
    for j in range(60):
        jobs.append((f"j{j}", rng.randint(1, 3)))
        for at in range(rng.randint(0, 8)):
            kind = rng.choice(["RUN", "FILE", "FILE", "FILE", "FAIL" if rng.random() < 0.4 else "FILE"])
            events.append((f"j{j}", at, kind, rng.choice(["PASSED", "FINDING", "ERROR"])))
    got = mutation.job_states(spark.createDataFrame(jobs, "job string, total_files int"),
                              spark.createDataFrame(events, "job string, at int, kind string, outcome string"))
    want = {(j, *by_hand(n, [e[1:] for e in events if e[0] == j])) for j, n in jobs}
    # A job that failed before its start keeps no files, whatever came then.
    assert {tuple(r) for r in got.collect()} == want


def test_package_entries(spark):
    def entries(*names):
        rows = g.package_entries(spark.createDataFrame([(n,) for n in names], "package_name string")).collect()
        return {r.package: (r.relative_name, r.depth) for r in rows}

    assert entries("com.a", "com.a.b", "com.a.b.c", "(default package)") == {
        "com.a": ("(root)", 0), "com.a.b": ("b", 0), "com.a.b.c": ("b.c", 1), "(default package)": ("(default package)", 0)}
    assert entries("x.y", "z") == {"x.y": ("x.y", 1), "z": ("z", 0)}


def test_search_looks_into_the_named_properties_only(spark):
    rows = [("a", "JavaType", "A", "DTO", None, "k1"), ("b", "Method", "B", None, "needle.x", "k2"), ("c", "Method", "C", None, None, "k1"), ("d", "Method", "D", None, None, "k3")]
    nodes = spark.createDataFrame(rows, "uid string, label string, name string, layer string, fqn string, graph_key string").withColumn("package_name", F.lit("needle"))
    assert {r.uid for r in g.matched_scope(nodes, "Needle").collect()} == {"b"}
    assert {r.uid for r in g.matched_scope(nodes, "dto").collect()} == {"a", "c"}


def test_evidence_edges(spark):
    rows = [("t1", ["c1", " ", "c1", "c2", None]), ("t2", None)]
    got = extract.evidence_edges(spark.createDataFrame(rows, "uid string, evidence_chunk_ids array<string>")).collect()
    assert {tuple(r) for r in got} == {(c, "t1", k) for c in ("c1", "c2") for k in ("DESCRIBES", "EVIDENCE_FOR")}


def test_archive_failures(spark):
    rows = [("a/../../x.java", 1), ("a.java", files.ARCHIVE_MAX_ENTRY_BYTES + 1), ("a.bin", files.ARCHIVE_MAX_ENTRY_BYTES + 1), ("b.java", 5)]
    got = files.archive_failures(spark.createDataFrame(rows, "path string, size long")).collect()
    assert [(r.path, r.reason) for r in got] == [("a/../../x.java", "UNSAFE_PATH"), ("a.java", "TOO_LARGE")]


def test_ingest_totals(spark):
    def chunks(*keys):
        return spark.createDataFrame([(k,) for k in keys], "source_key string")

    got = {tuple(r) for r in chunking.ingest_totals(chunks("a", "a"), chunks("b", "a"), chunks("b")).collect()}
    assert got == {("a", 2, 1, 0, 3), ("b", 0, 1, 1, 2)}


def test_references_in_very_long_texts(spark):
    long = ["a/" * 500_000, "a." * 500_000, "a" * 1_000_000, "/" * 1_000_000, "C:\\x" + "\\y" * 500_000, "a.java " * 100_000, "x.y.OrderService and " + "q." * 300_000]
    rows = spark.createDataFrame(list(enumerate(long)), "id int, t string")
    got = rows.select("id", F.length(agent.path_argument(F.col("t"), "path")).alias("path"), F.length(agent.file_argument(F.col("t"))).alias("file"),
                      agent.java_reference(F.col("t")).alias("java")).orderBy("id").collect()
    assert got[0].path == 999_999 and got[2].path == 0 and got[5].file == 6 and len(got[1].java) == 999_999
    cases = {"see src/main/A.java.": "src/main/A.java", "x /a/b, y": "/a/b", "a//b/c": "/b/c", "open C:\\x\\y.txt;": "C:\\x\\y.txt", "no path": ""}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r.got == r.want for r in rows.select("want", agent.path_argument(F.col("t"), "path").alias("got")).collect())
    names = {"call com.acme.OrderService.java now": "com.acme.OrderService", "9a.b c1": "c1", "the class": "the"}
    rows = spark.createDataFrame(list(names.items()), "t string, want string")
    assert all(r.got == r.want for r in rows.select("want", agent.java_reference(F.col("t")).alias("got")).collect())


def test_names_in_json_replies(spark):
    cases = {
        '["orders","users"]': (["orders", "users"], []), '"alone"': (["alone"], ["alone"]), '{"name":"n","table":"tt"}': (["tt", "n"], ["n"]),
        '{"b":{"z":["deep"],"tableName":"first"},"a":"last","j":"{\\"table\\":\\"inner\\"}","n":5}': (["first", "deep", "last"], []),
        '[{"column":"c1","type":"int8x"},{"field":"","name":"c2"}]': (["int8x", "c1", "c2"], ["c1", "c2"]), "orders": (["orders"], ["orders"]), "[1, null]": ([], []), "": ([], []),
        '{"a":"x"} y': ([], ["y"]),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = {r.id: r for r in extract.tool_names(rows).collect()}
    for i, (text, (tables, columns)) in enumerate(cases.items()):
        if text in ('{"a":"x"} y',):
            continue  # no JSON: what its line says is another rule's affair
        assert [t for t in got[i].tables] == tables or set(got[i].tables) == set(tables), (text, got[i].tables)
        assert [c for c in got[i].columns if not c.startswith(("[", "{", '"'))] == columns, (text, got[i].columns)


def test_all_table_names_of_a_reply(spark):
    names = [f"app.orders_{i:02d}" for i in range(40)]
    replies = ["[" + ",".join(f'"{n}"' for n in names) + "]", "\n".join(f"{n}: rows of {n}" for n in names), "| " + " | ".join(names) + " |", " ".join(f"table={n};" for n in names)]
    got = {r.id: r.tables for r in extract.tool_names(spark.createDataFrame(list(enumerate(replies)), "id int, text string")).collect()}
    assert got == {i: names for i in range(len(replies))}
