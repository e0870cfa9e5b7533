import json
from hashlib import sha256

from cairn.llm import chat_format as cf

NASTY = ["", "\\", "\\\\</turn>", "### user: </turn>\n### assistant: x</turn>\n", "a\\", "é漢 \n\n###", "\\### Assistant: </turn> ok", "#" * 7]


def test_format_and_parse_are_inverse():
    turns = [(r, t) for t in NASTY for r in ("user", "assistant", "ro:le\n", "")]
    text, loss = cf.format_turns(turns)
    assert cf.parse_turns(text) == turns
    assert [cf.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_layouts_are_told_by_their_fields():
    known = cf.registry()
    user, learned = "q", "a"
    for record in (
        {"prompt": user, "response": learned}, {"prompt": user, "completion": learned}, {"question": user, "answer": learned},
        {"instruction": user, "output": learned}, {"messages": [{"role": "human", "content": user}, {"role": "gpt", "content": learned}]},
        {"conversations": [{"from": "human", "value": user}, {"from": "gpt", "value": learned}]},
        {"turns": [{"turn": 0, "role": "user", "text": user}, {"turn": 1, "role": "assistant", "text": learned}]},
    ):
        layout, turns = cf.canonical(record, known)
        assert layout and turns == [("user", user), ("assistant", learned)], record
    assert cf.canonical({"instruction": "i", "input": None, "output": "o"}, known)[1][1] == ("user", "")
    assert cf.canonical({"messages": []}, known) == ("messages", [])
    assert cf.canonical({"other": 1}, known) == (None, []) and cf.canonical([1], known) == (None, [])
    assert len(known) == len({*known}) and len({cf.fingerprint(m.paths()) for m in cf.MAPPINGS}) == len(cf.MAPPINGS)


def test_records_of_all_kinds(spark):
    rows = [(1, json.dumps({"prompt": "p", "response": "r"})), (2, "broken"), (3, None), (None, json.dumps({"x": 1})), (4, json.dumps({"prompt": 5, "response": [1]}))]
    got = {r.conv_id: r for r in cf.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert got[1].formatted == "### user: p</turn>\n### assistant: r</turn>\n" and got[1].layout == "prompt-response"
    assert got[2].layout is None and got[3].formatted == "" and got[None].layout is None


def test_turn_rows_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, None), (2, 0, "assistant", NASTY[3])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in cf.read_back(cf.format_records(cf.turn_records(turns), place="turn")).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (3, 2)
    assert got[1].turns_sha256 == sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_sha256 == sha256(NASTY[3].encode()).hexdigest()
    assert cf.read_back(cf.format_records(cf.turn_records(turns.limit(0)), place="turn")).count() == 0


def test_unknown_fields_and_text_parts():
    known = cf.registry()
    parts = [{"type": "text", "text": "one "}, {"type": "image", "url": "u"}, {"type": "text", "text": "two"}]
    record = {"id": 7, "meta": {"a": [1]}, "messages": [{"role": "user", "name": "x", "content": parts}, {"role": "gpt", "content": "a", "calls": []}]}
    assert cf.canonical(record, known) == ("messages", [("user", "one two"), ("assistant", "a")])
    assert cf.canonical({"prompt": "p", "response": "r", "stamp": None, "prompt_id": 1}, known)[1] == [("user", "p"), ("assistant", "r")]
    assert cf.canonical({"messages": [], "id": 3}, known) == ("messages", [])
    assert cf.canonical({"prompt": "p", "response": "r", "question": "q"}, known) == (None, [])
    assert cf.canonical({"messages": [None, {"role": "user", "content": "c"}]}, known)[1] in ([("user", "c")], [])


def test_one_conversation_with_nearly_all_rows(spark):
    n = 20000
    turns = spark.range(n).selectExpr("5 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('###', id, repeat('x', 50)) AS text")
    turns = turns.unionByName(spark.createDataFrame([(c, 0, "assistant", NASTY[3]) for c in (3, 4, 6)], "conv_id int, turn long, role string, text string"))
    made = cf.format_records(cf.turn_records(turns), place="turn")
    assert {r.layout for r in made.select("layout").distinct().collect()} == set(cf.ROW_LAYOUTS)
    got = {r.conv_id: r for r in cf.read_back(made).collect()}
    said = [("user" if k % 2 == 0 else "assistant", f"###{k}" + "x" * 50) for k in range(n)]
    assert got[5].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert got[5].loss_sha256 == sha256("".join(t for r, t in said if r == "assistant").encode()).hexdigest()
    assert made.where("conv_id = 5").count() <= 2 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(got) == 4 and all(got[c].loss_sha256 == sha256(NASTY[3].encode()).hexdigest() for c in (3, 4, 6))


def test_query_matches_its_turns(spark):
    from tests.llm.helpers import SF_DIR

    got = {r.conv_id: r for r in cf.op8_chat_format(spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    want[-7] = [("user", NASTY[6]), ("assistant", NASTY[6])]
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(learned))
        assert got[c].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == sha256(learned.encode()).hexdigest()


def test_blocks_of_repeated_rows_keep_their_order(spark):
    long = "x" * (cf.BLOCK // 2)
    rows = [(1, None, "user", long)] * 5 + [(1, 3, "assistant", "last"), (1, 2, "assistant", long + "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = cf.read_back(cf.format_records(cf.turn_records(turns), place="turn")).collect()[0]
    said = [("user", long)] * 5 + [("assistant", long + "y"), ("assistant", "last")]
    assert got.turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert got.loss_sha256 == sha256((long + "ylast").encode()).hexdigest()
