import zlib
from collections import Counter

import pytest
from fixtures import documents, folder, texts

from quern.llm import sharding


def brute(counts, shards):
    """The ring walked key by key."""
    points = sharding.ring(shards)
    room = sharding.capacities(sum(counts.values()), shards)
    used, out, over = [0] * shards, {}, []

    def home(place):
        return next((k for k, (p, _) in enumerate(points) if p >= place), 0)

    for place in sorted(counts):
        for rank in range(counts[place]):
            s = points[home(place)][1]
            if used[s] < room[s]:
                out[place, rank] = (s, used[s])
                used[s] += 1
            else:
                over.append((place, rank))
    for place, rank in over:
        at = home(place)
        while used[points[at][1]] >= room[points[at][1]]:
            at = (at + 1) % len(points)
        s = points[at][1]
        out[place, rank] = (s, used[s])
        used[s] += 1
    return out


@pytest.mark.parametrize("shards,keys", [(1, 50), (5, 333), (24, 2000), (24, 7)])
def test_walk(shards, keys):
    counts = Counter(sharding._mix(7, k) % sharding.SLOTS for k in range(keys))
    counts[11] += keys // 2  # a hot place
    got = {}
    for place, low, high, shard, base in sharding.walk(counts, shards):
        for rank in range(low, high):
            got[place, rank] = (shard, base + rank - low)
    assert got == brute(counts, shards)


def test_limited_movement():
    counts = Counter(sharding._mix(9, k) % sharding.SLOTS for k in range(40_000))
    owner = []
    for shards in (24, 25):
        owner.append({(p, r): s for p, low, high, s, _ in sharding.walk(counts, shards) for r in range(low, high)})
    moved = sum(owner[0][k] != owner[1][k] for k in owner[0]) / len(owner[0])
    assert moved < 0.25  # all to a new modulus: 0.96


@pytest.mark.parametrize("base", [None, [], ["same"] * 500])
def test_op6(spark, tmp_path, base):
    rows = sharding.op6_sharding(spark, folder(spark, tmp_path, base)).collect()
    every = texts() if base is None else base
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(every)]
    n = Counter(r.shard for r in rows)
    assert max((n[s] for s in range(24)), default=0) - min((n[s] for s in range(24)), default=0) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n[s])) for s in n)


def test_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 3)
    hot = spark.range(400).selectExpr("cast(null as long) as doc_id", "'same' as text")
    rows = sharding.shard_rows(hot.union(spark.range(100).selectExpr("id as doc_id", "'same' as text")), 7).collect()
    assert len(rows) == 500 and len({(r.shard, r.slot) for r in rows}) == 500
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and sum(r.doc_id is None for r in rows) == 400
    docs = documents(spark).selectExpr("cast(null as long) as doc_id", "text").union(documents(spark).select("doc_id", "text"))
    rows = sharding.shard_rows(docs.union(docs), 5).collect()
    assert len(rows) == 4 * len(texts()) and len({(r.shard, r.slot) for r in rows}) == len(rows)
