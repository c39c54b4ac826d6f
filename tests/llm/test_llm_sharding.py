import random

import pytest

from groundscope.llm import sharding
from cases import no_documents, odd_documents


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if fill + s > middle:
                used, fill = used + 1, 0
            fill += s
        if used <= shards:
            high = middle
        else:
            low = middle + 1
    return low


@pytest.mark.parametrize("segments", [4, 65_536])
def test_capacity_is_exact(spark, monkeypatch, segments):
    monkeypatch.setattr(sharding, "SEGMENTS", segments)
    rng = random.Random(segments)
    groups = sorted((rng.randrange(-(1 << 63), 1 << 63), rng.choice([1, 2, 5, 40, 90])) for _ in range(120))
    groups += [(groups[-1][0] + i, 7) for i in range(1, 12)]
    keys, capacity = sharding.boundaries(spark.createDataFrame(groups, "key long, bytes long"), 6)
    assert capacity == smallest_capacity([b for _, b in groups], 6)
    shards = {}
    for key, size in groups:
        number = sum(key >= k for k in keys)
        shards[number] = shards.get(number, 0) + size
    assert max(shards.values()) <= capacity


def test_defined_results(spark):
    rows = sharding.shard_by_bytes(odd_documents(spark)).collect()
    assert len(rows) == 14 and {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(no_documents(spark)).count() == 0


def test_a_large_group_gets_its_own_shard(spark):
    rows = [(i, "same text " * 20) for i in range(300)] + [(1000 + i, f"text {i} " * 10) for i in range(600)]
    frame = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    sizes = {r["shard"]: (r["b"], r["n"]) for r in frame.groupBy("shard").agg({"size": "sum", "doc_id": "count"}).toDF("shard", "b", "n").collect()}
    assert set(sizes) == {0, 1, 2, 3, 4}
    rest = [b for b, n in sizes.values() if n != 300]
    assert len(rest) == 4 and max(rest) - min(rest) < 300
