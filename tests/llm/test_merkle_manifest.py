"""The tree against one that is built node by node, in Python."""

from hashlib import sha256
from zlib import crc32

import pytest

from cairn.llm import merkle_manifest
from cairn.llm.merkle_manifest import FIELDS, lowered_third, op12_merkle_manifest, proofs
from tests.llm.helpers import compare

ROW = "doc_id long, source string, lang string, n_chars long, text string, pos int, digest string, `key` string, `a.b` int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [text if f == "text" else row[f] for f in FIELDS]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node the (left, right) siblings of every level."""
    paths, at, owners = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(at) > 1:
        up, up_owners = [], []
        for first in range(0, len(at), 8):
            run = at[first: first + 8]
            for slot in range(len(run)):
                for i in owners[first + slot]:
                    paths[i].append((run[:slot], run[slot + 1:]))
            up.append(H(*run))
            up_owners.append(sum(owners[first: first + 8], []))
        at, owners = up, up_owners
    return at[0], paths


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted(groups[g], key=lambda m: m[:3]) for g in order}
    built = {g: ([m[3] for m in members[g]], [m[2] for m in members[g]]) for g in order}
    trees = {g: tree(built[g][1]) for g in order}
    root, over = tree([trees[g][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for r, own, path in zip(*built[g], trees[g][1], strict=True):
            path = path + over[i]
            at = own
            if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                at = leaf_of(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in path:
                at = H(*left, at, *right)
            out.append((r["doc_id"], own, trees[g][0], root, H(*(d for left, right in path for d in left + right)), at, at == root))
    return sorted(out, key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], ROW)


def check(spark, rows, partitions=3):
    docs = table_of(spark, rows).repartition(partitions)
    got = sorted((tuple(r) for r in proofs(docs, lowered_third()).collect()), key=str)
    assert got == by_hand([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows])


@pytest.mark.parametrize("sizes", [[1], [9], [600, 64, 512, 8, 2, 1, 1, 1, 1, 3]])
def test_groups_of_many_sizes(spark, sizes):
    rows = [(g * 10_000 + i, "s", f"l{g}" if g else None, i, f"Text {i % 5} É") for g, n in enumerate(sizes) for i in range(n)]
    check(spark, rows)


def test_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "LEVELS", 1)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8)
    check(spark, [(i, "s", "en" if i % 3 else f"l{i % 70}", i, f"Text {i}") for i in range(700)])


def test_nulls_ties_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 1, ""), (1, "", "", 0, "A" * 3_000_000), (1, "", "", 0, "B"), (1, "", "", 0, "B"),
            (2, "-", "-", -1, "1:A"), (3, "s", "é", None, None), (4, "s", "Ž漢", 2, "\0 \n"), (5, None, "en", 1, "x"), (6, None, "en", 1, "x")]
    check(spark, rows)


def test_empty_table(spark):
    found = proofs(table_of(spark, []))
    assert found.collect() == [] and found.columns[:4] == ["doc_id", "leaf", "subroot", "root"]


def test_untouched_rows_verify(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(20)]
    assert all(r.verified for r in proofs(table_of(spark, rows)).collect())


def test_query_equals_sql(spark):
    compare(spark, op12_merkle_manifest, merkle_manifest.SQL)
