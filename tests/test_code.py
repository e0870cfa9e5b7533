import hashlib
import uuid

from pyspark.sql import functions as F

from cairn.functions import agent, code, files, ids, sqltext
from cairn.functions import text as tx

CALCULATE = """{
    // if (never) { while (counted) }
    if (input > 0 && ready) {
        for (int i = 0; i < input; i++) {
            while (i > 3) {
                log("for if while && || ?");
            }
        }
        return input;
    }
    throw new IllegalStateException("x");
}"""


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def metrics(spark, body):
    row = one(spark, F.struct(code.complexity(F.lit(body)).alias("c"), code.counters(F.lit(body)).alias("k")))
    return tuple(row.c), (row.k.returns, row.k.throws, row.k.calls)


def test_documented_example(spark):
    assert metrics(spark, CALCULATE) == ((3, 5, 7, 3), (1, 1, 1))


def test_nesting_forms(spark):
    assert metrics(spark, "{ if (a) x(); else if (b) y(); else { if (c) z(); } }")[0] == (3, 4, 6, 3)
    assert metrics(spark, "{ switch (k) { case 1: if (a || b) { r(); } break; default: r(); } }")[0] == (3, 5, 8, 3)
    assert metrics(spark, "{ do { x(); } while (y); int v = a ? 1 : 2; List<?> l; try { } catch (E e) { } }")[0] == (3, 4, 3, 1)
    assert metrics(spark, "{ for (int i = 0; i < 3; i++) if (i > 1) x(); y(); if (z) w(); }")[0] == (3, 4, 4, 2)


def test_hashes(spark):
    def hashes(body, name):
        return tuple(one(spark, F.struct(code.method_hash(F.lit(body)), code.structural_hash(F.lit(body), F.array(F.lit(name))))))

    a, b = hashes("{ return input + 1; }", "input"), hashes("{\n  return value + 999;\n}", "value")
    assert a[0] != b[0] and a[1] == b[1]
    assert hashes("{ return  input+1; } // note", "input")[0] == a[0]
    assert hashes('{ return "a b"; }', "x")[0] != hashes('{ return "ab"; }', "x")[0]
    assert hashes("{ return input.value; }", "value")[1] != hashes("{ return input.other; }", "other")[1]


def test_layers_names_and_paths(spark):
    assert one(spark, code.layer(F.lit("UserServiceImpl"), F.lit(None))) == "ServiceImpl"
    assert one(spark, code.layer(F.lit("Users"), F.array(F.lit("RestController")))) == "Controller"
    assert one(spark, code.layer(F.lit("UserResponse"), F.array(F.lit("Data")))) == "DTO"
    assert one(spark, code.endpoint_path(F.lit("users/"), F.lit("/{id}/"))) == "/users/{id}"
    assert one(spark, code.endpoint_path(F.lit(""), F.lit(""))) == "/"
    assert one(spark, files.normalize_path(F.lit("a\\b/./../c//D.java"))) == "a/c/D.java"
    assert one(spark, ids.uid("method", F.lit("commerce"), F.lit("com.example.UserService"), F.lit("findUser(Long,java.util.List<String>)"))) == \
        "method:commerce:com.example.UserService:findUser(Long,java.util.List<String>)"
    assert one(spark, ids.table_uid(F.lit("commerce"), F.lit("app"), F.lit("users"))) == "table:commerce:app:users"
    for text in ("abc", "", "ä€"):
        assert one(spark, ids.name_uuid(F.lit(text))) == str(uuid.UUID(bytes=hashlib.md5(text.encode()).digest(), version=3))


def test_test_sources_and_archive_entries(spark):
    cases = {
        "src/test/java/A.java": True, "Tests/A.java": True, "src/main/UserTest.java": True, "src/ITUser.java": True, "src/UserITCase.java": True,
        "src/main/Latest.java": False, "src/main/Contest.java": False, "test/readme.md": False, "src/testing/A.java": False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", files.is_test_source(F.col("p")).alias("v")).collect()
    assert {r.p: r.v for r in rows} == cases
    unsafe = {"../x": True, "a/../../x": True, "/etc/x": True, "C:/x": True, " ": True, "a/../x": False, "a/b.java": False}
    rows = spark.createDataFrame([(k,) for k in unsafe], "p string").select("p", files.is_unsafe_entry(F.col("p")).alias("v")).collect()
    assert {r.p: r.v for r in rows} == unsafe


def test_archive_report(spark):
    rows = [("p", "src/A.java", 10), ("p", "a.png", 5), ("p", "src/test/B.java", 5), ("q", "../x.java", 1), ("r", "big.sql", 11 * 1024 * 1024)]
    out = {r.project_key: r for r in files.archive_report(spark.createDataFrame(rows, "project_key string, path string, size long")).collect()}
    assert (out["p"].discovered, out["p"].indexed, out["p"].skipped, out["p"].failed, out["p"].rejected) == (3, 1, 2, 0, False)
    assert out["q"].rejected and out["r"].rejected and out["r"].failed == 1


def test_sql_text(spark):
    read = "SELECT u.id, u.name AS n FROM app.users u, (x) JOIN roles r ON r.id = u.role"
    assert one(spark, sqltext.statement_tables(F.lit(read), F.lit("READ"))) == ["app.users", "roles"]
    assert one(spark, sqltext.statement_columns(F.lit(read), F.lit("READ"))) == ["id", "name"]
    assert one(spark, sqltext.statement_columns(F.lit("SELECT * FROM t"), F.lit("READ"))) == []
    assert one(spark, sqltext.statement_tables(F.lit("delete from app.users where x in (select y from z)"), F.lit("WRITE"))) == ["app.users"]
    assert one(spark, sqltext.generated_columns(F.lit("SELECT now(), a.b FROM t"))) == ["b"]


def test_text_functions(spark):
    assert one(spark, tx.search_terms(F.lit('find "two words" Find x ""'))) == ["two words", "Find", "x"]
    masked = one(spark, tx.mask_properties(F.create_map(F.lit("dbPassword"), F.lit("p"), F.lit("name"), F.lit("n"))))
    assert masked == {"dbPassword": "******", "name": "n"}
    assert one(spark, tx.json_list(F.lit("not json"))) == [] and one(spark, tx.json_list(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(spark, tx.placeholder_default(F.lit("${X:openai}"))) == "openai"


def test_agent_functions(spark):
    assert one(spark, agent.intent(F.lit("show the Rules List of java"))) == "RULE_LIST"
    assert one(spark, agent.intent(F.lit("analyze project at D:\\work\\shop"))) == "PROJECT_STRUCTURE_ANALYSIS"
    assert one(spark, agent.intent(F.lit("hello"))) == "SERVER_INFO"
    assert one(spark, agent.java_reference(F.lit("class of com.acme.UserService.java or Other"))) == "com.acme.UserService"
    assert one(spark, agent.explicit_argument(F.lit('run(table_name="app.users", x)'), "table_name")) == "app.users"
