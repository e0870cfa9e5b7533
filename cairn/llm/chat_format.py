"""Chat formatting: records of any known layout become one marked text with a loss mask.

A record's layout is told by its fingerprint, a hash of its sorted nested field paths (``messages[].role``). The
fingerprint selects a declarative mapping that says where the turns are. Fields that no mapping knows don't hide a
layout: a record whose fingerprint is unknown is looked up again by its known fields alone, a list or object in the
place of a text counting as that text. Layouts unknown even then give no turns and keep a null layout, so that they can
be counted.

Template: ``### <role>: <text></turn>\\n`` for each turn. Inside role and text a backslash, the mark ``###``, the mark
``</turn>`` and, in a role, a colon or line break are escaped by a backslash before them; taking one backslash away
before any character restores the text. The loss mask is a list of half-open ranges of code points of the formatted
text, one for each assistant turn's escaped text.

A conversation may come in pieces, records with a place in it. They are sorted over all partitions and formatted where
they lie, so a long conversation is spread over many tasks; neighbours are put together in blocks of up to ``BLOCK``
characters, and the conversation's text is that of its blocks in order. Reading back goes through a conversation's
blocks one after the other, holding digests and one block, so no conversation is gathered, however long.

Defined cases: null texts and roles are empty; a list of text parts is their text joined, anything else that isn't a
string its JSON; pieces are ordered by place, then by a hash of their record, null places first; repeated rows are
repeated pieces; rows without a conv_id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha1, sha256
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bytescan import slices
from cairn.llm.common import map_batches, table
from cairn.llm.registry import query
from cairn.session import cut

LEARNED = "assistant"
BLOCK = 1 << 20
SPECIAL = -7
SPECIAL_TEXT = "\\### Assistant: </turn> ok"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns``: (role, field) pairs read in this order, or for ``each``: the list and, in its items, the fields of role
    and text. ``roles`` renames roles. ``optional`` fields may be missing, ``ignored`` ones are known and not used.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        own = {f for _, f in self.turns} | set(self.ignored)
        if self.each:
            items, role, text = self.each
            own |= {f"{items}[].{role}", f"{items}[].{text}"}
        return own


NAMES = (("human", "user"), ("prompter", "user"), ("gpt", LEARNED), ("bot", LEARNED), ("model", LEARNED))
MAPPINGS = (
    Mapping("prompt-response", turns=(("system", "system"), ("user", "prompt"), (LEARNED, "response")), optional=("system",)),
    Mapping("prompt-completion", turns=(("user", "prompt"), (LEARNED, "completion"))),
    Mapping("question-answer", turns=(("user", "question"), (LEARNED, "answer"))),
    Mapping("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), (LEARNED, "output")),
            optional=("system", "input")),
    Mapping("messages", each=("messages", "role", "content"), roles=NAMES),
    Mapping("conversations", each=("conversations", "from", "value"), roles=NAMES),
    Mapping("turn-rows", each=("turns", "role", "text"), optional=("turns[].turn",), ignored=("turns[].turn",)),
    Mapping("dialogue", each=("dialogue", "speaker", "utterance")),
    Mapping("thread", each=("thread", "author", "body")),
)
ROW_LAYOUTS = ("turn-rows", "dialogue", "thread")  # they rename no role, so rows of turns can be told in any of them


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a record; an empty list or object counts by its own name."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list) and value:
        return {p for v in value for p in field_paths(v, f"{at}[]")}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return sha1("\n".join(sorted(paths)).encode()).hexdigest()


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Fingerprint -> mapping, for every choice of a layout's optional fields."""
    out = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for gone in combinations(m.optional, n):
                out[fingerprint(m.paths() - set(gone))] = m
        if m.each:
            out[fingerprint({m.each[0]})] = m
    return out


def _said(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        parts = [x.get("text") if isinstance(x, dict) else x for x in value]
        if any(isinstance(x, str) for x in parts):
            return "".join(x for x in parts if isinstance(x, str))
    return "" if value is None else json.dumps(value, ensure_ascii=False)


@lru_cache
def _known_fields(mappings: tuple[Mapping, ...]) -> tuple[frozenset[str], frozenset[str]]:
    """Paths of texts, and names of lists of turns, which count only where the list is empty."""
    return frozenset(p for m in mappings for p in m.paths()), frozenset(m.each[0] for m in mappings if m.each)


def known_paths(paths: set[str], mappings: tuple[Mapping, ...]) -> set[str]:
    """What the mappings know of a record's paths."""
    texts, lists = _known_fields(mappings)
    out = paths & lists
    for p in paths:
        ends = [len(p), *(m.start() for m in re.finditer(r"[.\[]", p))]
        out |= {p[:e] for e in ends} & texts
    return out


def canonical(record: dict, known: dict[str, Mapping]) -> tuple[str | None, list[tuple[str, str]]]:
    """The record's layout and its turns as (role, text)."""
    paths = field_paths(record)
    m = known.get(fingerprint(paths)) or known.get(fingerprint(known_paths(paths, tuple(dict.fromkeys(known.values())))))
    if m is None or not isinstance(record, dict):
        return None, []
    if m.each:
        items, role, text = m.each
        rename = dict(m.roles)
        turns = [(_said(x.get(role)), _said(x.get(text))) for x in record[items] or [] if isinstance(x, dict)]
        return m.name, [(rename.get(r, r), t) for r, t in turns]
    return m.name, [(role, _said(record[field])) for role, field in m.turns if field in record]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    parts, loss, at = [], [], 0
    for role, text in turns:
        head = "### " + re.sub(r"([:\n])", r"\\\1", escape(role)) + ": "
        body = escape(text)
        if role == LEARNED:
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len(parts[-1])
    return "".join(parts), loss


_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?!</turn>)[^\\])*+)</turn>\n", re.S)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


FORMATTED = "conv_id long, place long, tie long, part long, layout string, formatted string, loss array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Block:
    """Formatted neighbours of one conversation, under the place of the first of them."""

    def __init__(self, at: tuple, layout: str | None):
        self.at, self.layout, self.size = at, layout, 0
        self.texts: list[str] = []
        self.loss: list[dict] = []

    def takes(self, conv_id, layout: str | None, text: str) -> bool:
        return self.at[0] == conv_id and self.layout == layout and self.size + len(text) <= BLOCK

    def add(self, text: str, loss: list[tuple[int, int]]) -> None:
        self.texts.append(text)
        self.loss += [{"start": self.size + a, "end": self.size + b} for a, b in loss]
        self.size += len(text)


def _blocks_batch(blocks: list[_Block]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    at = [pa.array([b.at[k] for b in blocks], pa.int64()) for k in range(4)]
    return pa.RecordBatch.from_arrays(
        [*at, pa.array([b.layout for b in blocks], pa.string()), pa.array(["".join(b.texts) for b in blocks], pa.string()),
         pa.array([b.loss for b in blocks], spans)], names=["conv_id", "place", "tie", "part", "layout", "formatted", "loss"])


def format_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, place: str | None = None) -> DataFrame:
    """``records`` (conv_id, record as JSON) formatted: conv_id, layout, formatted, loss. Broken JSON has no layout.

    ``place`` names the column that orders the records of one conversation, where it comes in pieces; without it every
    record gives a row of its own. A conversation's rows are in order by place, tie and part; ranges of a row's loss
    mask count from the start of its own text.
    """
    joined = place is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(mappings)
        block, part = None, 0
        for whole in batches:
            for batch in slices(whole, "record"):
                done = []
                columns = (batch.column(c).to_pylist() for c in ("conv_id", "place", "tie", "record"))
                for conv_id, at, tie, record in zip(*columns, strict=True):
                    try:
                        layout, turns = canonical(json.loads(record or "null"), known)
                    except (ValueError, RecursionError):
                        layout, turns = None, []
                    text, loss = format_turns(turns)
                    if block is None or not joined or not block.takes(conv_id, layout, text):
                        done += [block] if block else []
                        block, part = _Block((conv_id, at, tie, part), layout), part + 1
                    block.add(text, loss)
                if done:
                    yield _blocks_batch(done)
        if block:
            yield _blocks_batch([block])

    rows = records.select(
        F.col("conv_id").cast("long").alias("conv_id"), (F.col(place) if joined else F.lit(0)).cast("long").alias("place"),
        F.xxhash64("record").alias("tie"), "record")
    if joined:
        rows = rows.repartitionByRange("conv_id", "place", "tie").sortWithinPartitions("conv_id", "place", "tie")
    return map_batches(rows, work, FORMATTED)


class _Read:
    """What has been read of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.n_loss, self.n_chars = conv_id, 0, 0, 0
        self.turns, self.loss = sha256(), sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        for role, said in parse_turns(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for x in loss:
            learned = unescape(text[x["start"]: x["end"]])
            self.n_loss += len(learned)
            self.loss.update(learned.encode())
        self.n_chars += len(text)

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.n_chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the conversations' formatted texts and their loss masks say.

    A digest depends on all turns in order, so the blocks of a conversation go through one task, one at a time.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def told(done: list[_Read]) -> pa.RecordBatch:
        columns = zip(*(r.row() for r in done), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for whole in batches:
            for batch in slices(whole, "formatted"):
                done = []
                columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))
                for conv_id, text, loss in zip(*columns, strict=True):
                    if now is None or now.conv_id != conv_id:
                        done += [now] if now else []
                        now = _Read(conv_id)
                    now.add(text, loss)
                if done:
                    yield told(done)
        if now:
            yield told([now])

    ordered = formatted.drop("layout").repartition("conv_id").sortWithinPartitions("conv_id", "place", "tie", "part")
    return map_batches(ordered, work, DIGESTS)


def turn_records(turns: DataFrame) -> DataFrame:
    """Rows of turns (conv_id, turn, role, text) as records of one turn each: conv_id, turn, record.

    The conversation's id decides in which of ``ROW_LAYOUTS`` its turns are told.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    kind = F.pmod(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)), F.lit(len(ROW_LAYOUTS)))
    record = None
    for k, name in enumerate(ROW_LAYOUTS):
        items, of_role, of_text = next(m.each for m in MAPPINGS if m.name == name)
        told = F.to_json(F.struct(F.array(F.struct(role.alias(of_role), text.alias(of_text))).alias(items)))
        record = F.when(kind == k, told) if record is None else record.when(kind == k, told)
    return turns.select("conv_id", "turn", record.alias("record"))


@query("op8_chat_format")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    special = spark.createDataFrame(
        [(SPECIAL, 0, "user", SPECIAL_TEXT), (SPECIAL, 1, LEARNED, SPECIAL_TEXT)], stored.schema)
    return read_back(cut(format_records(turn_records(stored.unionByName(special)), place="turn")))
