import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import sharding as sh
from tests.llm.helpers import awkward, empty


def least_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c, used, left = (low + high) // 2, 1, 0
        for s in sizes:
            if left + s > c:
                used, left = used + 1, 0
            left += s
        low, high = (low, c) if used <= k else (c + 1, high)
    return low


@pytest.mark.parametrize("k", [1, 2, 5, 16])
def test_capacity_is_the_smallest(spark, k, monkeypatch):
    monkeypatch.setattr(sh, "BLOCKS", 40)  # so few that boundaries must be refined several times
    rng = random.Random(k)
    sizes = [rng.choice([1, 2, 3, 50, 400, 2000]) for _ in range(3000)]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    cuts = sh.minimax_cuts(spark.createDataFrame(list(zip(starts, sizes)), "start long, bytes long"), k)
    edges = [0, *cuts, sum(sizes)]
    assert set(cuts) <= set(starts) and len(cuts) == k - 1
    assert max(b - a for a, b in zip(edges, edges[1:])) == least_capacity(sizes, k)


def test_shards_hold_whole_groups_and_gapless_slots(spark):
    docs = awkward(spark, 30)
    out = sh.minimax_shards(docs, 4).collect()
    assert len(out) == docs.count()
    texts = {r.crc: r for r in docs.select(F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc")).collect()}
    assert len({(r.text_crc32, r.shard) for r in out}) == len(texts)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sum(r["size"] for r in out) == sum(len((r.text or "").encode()) + 1 for r in docs.collect())


def test_empty_table(spark):
    assert sh.minimax_shards(empty(spark)).count() == 0
