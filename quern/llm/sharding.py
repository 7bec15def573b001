"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``SLOTS`` places. Each shard has ``nodes`` virtual nodes at hashed places; the arc up to a node
belongs to its shard. A key's place is its hash. Shard s has a capacity: the row counts of all shards differ by
one at most (law ``rows``), so the capacities are the floor or the ceiling of the mean, the larger ones for the
first shards. Going round clockwise, each shard takes the keys of its own arcs until it is full; keys of an arc whose
shard is full go on clockwise to the next node with room.

Which shard a key gets depends on the number of keys at each place and on its rank at its place alone. So one
grouped count (at most ``SLOTS`` rows, which no input makes larger) is collected, the ring is walked over counts in
the driver, and the result is a small table of rank ranges (at most one for each place and one more for each
shard that fills up), joined by place. Ranks come from a window per place over rows that were counted by all that the result tells of them:
no task has more than the different rows of a place, a 16,384th of them. Adding a shard takes arcs from all shards evenly, and what moves beyond
those is the overflow alone; the test measures it.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import crc_text, documents

SLOTS = 1 << 14
NODES = 64
CHUNK = 1 << 16  # equal rows that one row stands for


def _mix(*values: int) -> int:
    """A 64-bit hash of small integers for the places of nodes."""
    x = 0x9E3779B97F4A7C15
    for v in values:
        x = ((x ^ v) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
        x = (x * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
    return x


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes in order; where two meet, the smaller shard has the place."""
    places: dict[int, int] = {}
    for s in range(shards):
        for k in range(nodes):
            p = _mix(s, k) % SLOTS
            places[p] = min(s, places.get(p, s))
    return sorted(places.items())


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """Rank ranges (place, first rank, rank behind the last, shard, first slot in the shard)."""
    points = ring(shards, nodes)
    places = [p for p, _ in points]
    room = capacities(sum(counts.values()), shards)
    used = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []

    def put(place: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n > 0:
            out.append((place, first, first + n, shard, used[shard]))
            used[shard] += n
        return max(n, 0)

    over: list[tuple[int, int, int, int]] = []
    for place in sorted(counts):
        at = bisect.bisect_left(places, place) % len(points)
        n = counts[place]
        taken = put(place, 0, n, points[at][1])
        if taken < n:
            over.append((place, taken, n - taken, at))
    # what is over goes on clockwise; nodes of full shards are passed over for good
    ahead = list(range(1, len(points) + 1))

    def next_open(at: int) -> int:
        trail = []
        while used[points[at][1]] >= room[points[at][1]]:
            trail.append(at)
            at = ahead[at] % len(points)
        for t in trail:
            ahead[t] = at
        return at

    for place, first, n, at in over:
        while n:
            at = next_open(at)
            taken = put(place, first, n, points[at][1])
            first, n = first + taken, n - taken
    return out


def shard_rows(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """Puts every row into one of ``shards`` shards whose row counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot (the row's number in its
    shard, without gaps from 0). A null text counts as empty. Null ids share one place; rows of one id are told apart by their texts'
    checksums and sizes, and rows that repeat wholly get one slot each. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)).alias("size"), crc_text(text).alias("text_crc32"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text_crc32"))
    rows = rows.withColumn("place", F.pmod("hash", F.lit(SLOTS)).cast("int"))
    # rows that repeat wholly can't be told apart: they are counted, get one range of ranks, and are dealt out again in chunks
    rows = rows.groupBy("place", "hash", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("copies"))
    counts = {r.place: r["n"] for r in rows.groupBy("place").agg(F.sum("copies").alias("n")).collect()}  # SLOTS rows at most
    names = ("at", "low", "high", "shard", "base")
    ranges = json.dumps([dict(zip(names, x)) for x in walk(counts, shards, nodes)])
    kind = "array<struct<at: int, low: long, high: long, shard: int, base: long>>"
    pieces = spark.range(1).select(F.inline(F.from_json(F.lit(ranges), kind)))
    order = Window.partitionBy("place").orderBy("hash", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("first", F.coalesce(F.sum("copies").over(order), F.lit(0)))
    # SLOTS + shards rows of 32 bytes at most: the bound is a constant of the ring
    found = ranked.join(F.broadcast(pieces), (F.col("place") == F.col("at")) & (F.col("first") < F.col("high")) & (F.col("first") + F.col("copies") > F.col("low")))
    found = found.select("doc_id", "size", "text_crc32", "shard", F.greatest("first", "low").alias("start"), F.least(F.col("first") + F.col("copies"), F.col("high")).alias("stop"), (F.col("base") - F.col("low")).alias("base"))
    few = found.filter(F.col("stop") - F.col("start") <= CHUNK)
    many = found.filter(F.col("stop") - F.col("start") > CHUNK).withColumn("start", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(CHUNK).cast("long"))))
    many = many.withColumn("stop", F.least("stop", F.col("start") + CHUNK)).repartition("shard", "start")
    ranks = F.explode(F.sequence("start", F.col("stop") - 1)).alias("rank")
    return few.union(many).select("doc_id", "size", "text_crc32", "shard", "base", ranks).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_rows(documents(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
