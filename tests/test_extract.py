from cairn.operators import extract as x
from cairn.operators import mentions
from cairn.session import cut


def test_mapper_statements(spark):
    xml = """<?xml version="1.0"?><!DOCTYPE mapper PUBLIC "a" "b">
    <mapper namespace="com.acme.UserMapper">
      <select id="find" resultType="U">SELECT id FROM app.users <where><if test="name != null">name = #{name}</if></where></select>
      <update id="touch"><![CDATA[UPDATE app.users SET n = 1 WHERE a < 2]]></update>
    </mapper>"""
    rows = x.mapper_statements(spark.createDataFrame([("p", xml)], "project_id string, content string")).orderBy("statement_id").collect()
    assert [(r.statement_id, r.command, r.operation) for r in rows] == [("find", "SELECT", "READ"), ("touch", "UPDATE", "WRITE")]
    assert rows[0].conditions == ["name != null"] and rows[0].sql == "SELECT id FROM app.users name = #{name}"
    assert rows[1].sql == "UPDATE app.users SET n = 1 WHERE a < 2"


def test_yaml(spark):
    text = "spring:\n  profiles:\n    active: local\nllm:\n  provider: ${P:openai}\n  api-key: abc\n# c\nbeans:\n  paymentClient:\n    url: x\nroot: 1"
    props = x.yaml_properties(spark.createDataFrame([(1, text)], "id int, content string"))
    assert {r.key: r.value for r in props.collect()} == {
        "spring.profiles.active": "local", "llm.provider": "${P:openai}", "llm.api-key": "abc", "beans.paymentClient.url": "x", "root": "1"}
    assert sorted((r.kind, r.name) for r in x.yaml_entities(props).collect()) == [("Bean", "paymentClient"), ("Profile", "local"), ("Provider", "openai")]


def test_markdown(spark):
    text = "- free\n# Architecture\n- layers first\nplain\n1) numbered\n## Templates\n* use it"
    rows = x.standard_rules(spark.createDataFrame([(1, text)], "id int, content string")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.section, r.statement, r.label, r.rule_type) for r in rows] == [
        (0, "General", "free", "StandardRule", "CODING"), (1, "Architecture", "layers first", "StandardRule", "ARCHITECTURE"),
        (2, "Architecture", "numbered", "StandardRule", "ARCHITECTURE"), (3, "Templates", "use it", "StandardTemplate", "TEMPLATE")]


def test_tables_of_a_prompt(spark):
    prompts = spark.createDataFrame([(1, "rows of app.users please"), (2, "all the ordering stuff"), (3, "nothing here"), (4, "USERS, user_roles!")], "prompt_id int, text string")
    tables = spark.createDataFrame([("app.orders", 1), ("app.users", 2), ("app.user_roles", 3)], "table_name string, ordinal int")
    got = sorted((r.prompt_id, r.table_name, r.kind) for r in x.match_tables(prompts, tables).collect())
    assert got == [(1, "app.users", "word"), (2, "app.orders", "contains"), (4, "app.user_roles", "word"), (4, "app.users", "word")]


def test_no_more_than_three_tables(spark):
    prompts = spark.createDataFrame([(1, "users"), (2, "superusers")], "prompt_id int, text string")
    tables = spark.createDataFrame([(f"s{i}.users", i) for i in range(6)], "table_name string, ordinal int")
    got = sorted((r.prompt_id, r.table_name) for r in x.match_tables(prompts, tables).collect())
    assert got == [(p, f"s{i}.users") for p in (1, 2) for i in range(3)]


def test_tool_mentions(spark):
    messages = spark.createDataFrame([(1, "call scan_source now"), (2, "rescan_sources"), (3, "use my-tool v2, scan_source")], "message_id int, text string")
    tools = spark.createDataFrame([("scan_source", 1, "b"), ("my-tool v2", 5, "a")], "tool string, priority int, id string")
    assert {r.message_id: r.tool for r in x.best_mention(messages, tools).collect()} == {1: "scan_source", 3: "my-tool v2"}


NAMES = ["app.order$items", "검색", "주문", "user", "my tool v2", "$$", "a", "über", "the", "the user", "검색 도구", "x\\Ey"]
TEXTS = ["app.order$items!", "myapp.order$items", "지금 검색해", "x주문 주문y", "the 주문, the", "user_s user", "my tool  v2", "my tool v2.", "use $$ now", "a$$b", "naïve a", "überall über",
         "the users", "the user", "새 검색 도구로", "검색  도구", "x\\Ey", "", None]


def test_names_of_any_characters(spark):
    import re

    messages = spark.createDataFrame(list(enumerate(TEXTS)), "message_id int, text string")
    tools = spark.createDataFrame([(n, 1, n) for n in NAMES], "tool string, priority int, id string")
    got = sorted((r.message_id, r.tool) for r in x.mentioned(messages, tools).collect())
    want = sorted((i, n) for i, t in enumerate(TEXTS) for n in NAMES
                  if t is not None and re.search(rf"(?<![A-Za-z0-9_]){re.escape(n.lower())}(?![A-Za-z0-9_])", t.lower()))
    assert got == want and (2, "검색") in got and (0, "app.order$items") in got and (14, "검색 도구") in got


def test_parts_that_texts_contain(spark):
    texts = spark.createDataFrame([(i, (t or "").lower()) for i, t in enumerate(TEXTS)], "id int, text string")
    parts = spark.createDataFrame([(n,) for n in NAMES], "part string")
    got = {(r.id, r.part) for r in mentions.contained(texts, parts).collect()}
    assert got == {(i, n) for i, t in enumerate(TEXTS) for n in NAMES if n in (t or "").lower()}


def test_tables_that_a_search_names(spark):
    prompts = spark.createDataFrame([(1, "app.users now"), (2, "something else"), (3, "superusers"), (4, "모든 주문내역")], "prompt_id int, text string")
    tables = spark.createDataFrame([("app.users", 1), ("app.orders", 2), ("old.orders", 3), ("app.주문", 4)], "table_name string, ordinal int")
    hits = spark.createDataFrame([(1, "orders", 0), (2, " X.ORDERS", 0), (2, "nowhere", 1), (2, "users", 2)], "prompt_id int, candidate string, ordinal int")
    got = sorted((r.prompt_id, r.table_name, r.kind) for r in x.match_tables(prompts, tables, hits=hits).collect())
    assert got == [(1, "app.users", "word"), (2, "app.orders", "search"), (2, "app.users", "search"), (3, "app.users", "contains"), (4, "app.주문", "word")]
    none = x.match_tables(prompts, tables.limit(0), hits=hits).collect()
    assert sorted((r.prompt_id, r.table_name) for r in none) == [(1, "orders"), (2, " X.ORDERS"), (2, "nowhere"), (2, "users")]


def test_names_and_references(spark):
    refs = spark.createDataFrame([("A.java", "p", "type:p:com.A", "com", n, "USES") for n in ("UserDto", "List", "java.io.File", "B", "A")],
                                 "file_path string, project_id string, type_uid string, package_name string, ref_name string, kind string")
    imports = spark.createDataFrame([("A.java", "UserDto", "org.UserDto")], "file_path string, simple_name string, fqn string")
    got = sorted((r.dst, r.type) for r in x.type_relationships(refs, imports).collect())
    assert got == [("type:p:com.B", "USES"), ("type:p:org.UserDto", "USES"), ("type:p:org.UserDto", "USES_DTO")]


def test_reconcile(spark):
    current = spark.createDataFrame([("a", "t1"), ("b", "t2")], "capability_id string, tool string")
    live = spark.createDataFrame([(" t1 ",), ("New Tool",), ("",)], "tool string")
    assert sorted(tuple(r) for r in x.reconcile(current, live).collect()) == [("a", "t1", "retained"), ("auto.new.tool", "New Tool", "added"), ("b", "t2", "removed")]


def test_new_capabilities_get_ids_of_their_own(spark):
    current = spark.createDataFrame([("auto.x", "kept"), ("gone", "old")], "capability_id string, tool string")
    live = spark.createDataFrame([("kept",), ("a b",), ("a.b",), ("!!",), ("x",)], "tool string")
    got = {r.tool: (r.capability_id, r.action) for r in x.reconcile(current, live).collect()}

    def base36(name):
        h, out = 0, ""
        for c in name:
            h = (h * 31 + ord(c)) % (1 << 32)
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out

    assert got == {
        "kept": ("auto.x", "retained"), "old": ("gone", "removed"), "a b": ("auto.a.b", "added"),
        "a.b": (f"auto.a.b.{base36('a.b')}", "added"), "!!": ("auto.tool", "added"), "x": (f"auto.x.{base36('x')}", "added")}


def test_mapper_includes_quotes_and_entities(spark):
    xml = """<!DOCTYPE mapper [<!ENTITY x "y">]>
    <mapper namespace="n.M"><sql id="cols">id, <include refid="more"/></sql><sql id="more">name</sql>
      <select id="a">SELECT <include refid="cols"/> FROM app.users <if test='a &lt; 2 &amp;&amp; b == "x"'>WHERE k = 1</if></select>
      <select id="b">SELECT <include refid="n.M.more" /> FROM <include refid="elsewhere"></include> t</select>
    </mapper>"""
    rows = {r.statement_id: r for r in x.mapper_statements(spark.createDataFrame([("p", xml)], "project_id string, content string")).collect()}
    assert rows["a"].sql == "SELECT id, name FROM app.users WHERE k = 1" and rows["a"].conditions == ['a < 2 && b == "x"']
    assert rows["b"].sql == "SELECT name FROM /* UNRESOLVED INCLUDE elsewhere */ t" and rows["b"].conditions == ["unresolved-include:elsewhere"]


def test_includes_that_cannot_be_opened_leave_a_mark(spark):
    many = "".join(f'<sql id="f{i}">x{i} <include refid="f{i}"/> <include refid="f{i}"/></sql>' for i in range(40))
    chain = "".join(f'<sql id="c{i}">{i} <include refid="c{i + 1}"/></sql>' for i in range(12))
    xml = f"""<mapper namespace="n.M">{many}{chain}<sql id="c12">end</sql><sql id="c12">second</sql>
      <select id="loop">SELECT <include refid="f3"/><if test="a">AND b</if> <include refid="other.M.f1"/></select>
      <select id="chain">SELECT <include refid="c0"/></select></mapper>"""
    # Rows of the same content, and one file's fragments are no other file's.
    other = '<mapper namespace="n.N"><select id="far">SELECT <include refid="c12"/></select></mapper>'
    files = spark.createDataFrame([("p", xml), ("q", xml), ("r", other)], "project_id string, content string")
    rows = {(r.project_id, r.statement_id): r for r in x.mapper_statements(files).collect()}
    assert len(rows) == 5
    loop = rows["q", "loop"]
    assert loop.sql == "SELECT x3 /* CYCLIC INCLUDE f3 */ /* CYCLIC INCLUDE f3 */ AND b /* UNRESOLVED INCLUDE other.M.f1 */"
    assert loop.conditions == ["cyclic-include:f3", "cyclic-include:f3", "a", "unresolved-include:other.M.f1"]
    assert rows["p", "chain"].sql == "SELECT " + " ".join(map(str, range(12))) + " end"
    assert rows["r", "far"].conditions == ["unresolved-include:c12"]


def test_properties_are_put_into_included_fragments(spark):
    xml = """<mapper namespace="n.M"><sql id="outer">${t}.id, <include refid="inner"><property name="c" value="${t}.name"/><property name="t" value="z"/></include></sql>
      <sql id="inner">${c} AS ${t}<if test="${t} != null">!</if></sql>
      <select id="a">SELECT <include refid="outer"><property value='u' name='t'/></include> FROM ${left}</select></mapper>"""
    row = x.mapper_statements(spark.createDataFrame([("p", xml)], "project_id string, content string")).first()
    assert row.sql == "SELECT u.id, z.name AS z ! FROM ${left}" and row.conditions == ["z != null"]


def test_heavy_rows_are_dealt_out_without_a_setting(spark):
    from cairn.session import spread

    setting = spark.conf.get("spark.cairn.scan.partitions")
    spark.conf.unset("spark.cairn.scan.partitions")
    try:
        dealt = spread(spark.range(0, 100, 1, 1))
    finally:
        spark.conf.set("spark.cairn.scan.partitions", setting)
    assert dealt.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_texts_are_not_searched_by_the_tasks_of_the_scan(spark):
    """A filter moves through projections and the dealing out; it would do the work of the projections there again."""
    from cairn.operators import extract as x
    from cairn.session import spread

    def filters(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return [line for line in plan.splitlines() if "Filter" in line]

    files = spread(spark.createDataFrame([("<mapper namespace=\"n\"><select id=\"a\">SELECT 1</select></mapper>",)], "content string"))
    found = x.mapper_statements(files)
    assert [r["statement_id"] for r in found.collect()] == ["a"]
    assert not any("regexp_replace" in f for f in filters(found))
    replies = spread(spark.createDataFrame([(1, '{"table_name":"a.t"}'), (2, "[")], "id long, text string"))
    named = x.json_names(x.cut(replies), ("table_name",), False)
    assert [tuple(r) for r in named.select("id", "name").collect()] == [(1, "a.t")]
    plan = x.tool_names(replies)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan


def test_only_words_that_a_name_has_are_written(spark, monkeypatch):
    written = []

    def seen(df):
        written.append(out := cut(df))
        return out

    monkeypatch.setattr(mentions, "cut", seen)
    texts = spark.createDataFrame([(i, f"plain words and ada, x{i} _ b-c [ada] big\u00a0one ad\u00e9\tbig table\n(x") for i in range(20)] + [(99, None), (98, "")], "id long, text string")
    names = spark.createDataFrame([("ada",), ("b-c",), ("ad\u00e9",), ("big table",), ("x",), ("nowhere else",)], "name string")
    got = mentions.whole_word_mentions(texts, names).collect()
    assert sorted((r.id, r.name) for r in got) == sorted((i, n) for i in range(20) for n in ("ada", "b-c", "ad\u00e9", "big table", "x"))
    words = [r.word for df in written if "word" in df.columns and "id" in df.columns for r in df.collect()]
    assert set(words) == {"ada", "big", "table", "x"}
    odd = [r.token for df in written if df.columns == ["id", "token"] for r in df.where("id = 3").collect()]
    assert sorted(odd) == sorted(["ada,", "b-c", "[ada]", "big\u00a0one", "ad\u00e9", "(x"])


def test_tables_given_twice_take_one_place(spark):
    prompts = spark.createDataFrame([(1, "t4 t3 t2 t1"), (2, "xt4x xt2x")], "prompt_id long, text string")
    tables = spark.createDataFrame([(f"app.t{i}", i) for i in (1, 2, 2, 3, 4, 4)], "table_name string, ordinal int")
    got = sorted((r.prompt_id, r.table_name, r.kind) for r in x.match_tables(prompts, tables).collect())
    assert got == [(1, "app.t1", "word"), (1, "app.t2", "word"), (1, "app.t3", "word"), (2, "app.t2", "contains"), (2, "app.t4", "contains")]


def test_rows_beyond_the_limit_are_left_out_before_they_are_sent(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "b", 2), (1, "a", 2), (1, "c", 3), (1, "d", None), (1, "d", None), (2, "c", 3), (2, "c", 3)], "k int, table_name string, ordinal int")
    first = x._first_distinct(rows, "k", 3)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.rindex("Exchange hashpartitioning")
    assert sorted((r.k, r.table_name) for r in first.collect()) == [(1, "a"), (1, "b"), (1, "d"), (2, "c")]
