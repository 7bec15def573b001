"""Per-shape queries on small planted tables, against brute force."""

from collections import defaultdict

import numpy as np

from quern import registry
from quern.operators import raster
from quern.plans import objects

SCHEMA = "vec_id long, embedding array<float>, label int"


def shapes(spark, tmp_path, rows):
    """A folder with an embeddings table of (id, the pixels of a bitmap as a number, label)."""
    data = [(i, [1.0 if m >> k & 1 else -1.0 for k in range(64)], label) for i, m, label in rows]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_topology_delta_pairs_over_stretches(spark, tmp_path):
    # stretches of 256 ids: borders, stretches of one shape of a block, and gaps of whole stretches
    ids = [*range(250, 262), *range(500, 4000, 97), 9_000]
    rows = [(i, (i * 0x9E3779B97F4A7C15) % 2**64, i % 3) for i in ids]
    by = defaultdict(list)
    for i, _, label in sorted(rows):
        by[label].append(i)
    want = sorted(pair for b in by.values() for pair in zip(b, b[1:]))
    got = registry.QUERIES["topology_delta"](spark, shapes(spark, tmp_path, rows)).collect()
    assert sorted((r.a, r.b) for r in got) == want


def number(grid):
    return sum(1 << k for k, v in enumerate(grid.ravel()) if v)


def planted():
    """Turns, mirror images, copies and neighbours of random rasters, most of them not the first of their coarse pattern."""
    rng = np.random.default_rng(7)
    grids = [np.zeros((8, 8), bool)] * 2
    for _ in range(12):
        g = rng.random((8, 8)) < 0.5
        near, far = g.copy(), g.copy()
        near[0, 0] ^= True
        far[2:4, 2:4] ^= True
        grids += [g, np.rot90(g), np.rot90(g, 2), np.fliplr(g), g, near, far]
    grids += [np.rot90(grids[2], 3), np.fliplr(grids[2]), np.ones((8, 8), bool)]
    return grids


def test_families_of_whole_rasters(spark, tmp_path):
    grids = planted()
    sf = shapes(spark, tmp_path, [(i, number(g), i % 3) for i, g in enumerate(grids)])
    first = {}
    for i, g in enumerate(grids):
        first.setdefault(g.tobytes(), i)

    orbits = defaultdict(list)
    for i in first.values():
        turns = [np.rot90(grids[i], k).tobytes() for k in range(4)]
        orbits[min(turns)].append((turns.index(min(turns)), i))
    want = sorted((phase, i, len(o)) for o in orbits.values() if len(o) >= 3 for phase, i in o)
    got = objects.raster_orbits(spark, sf).collect()
    assert len(want) >= 36 and sorted((r.phase, r.vec_id, r.size) for r in got) == want

    pairs = set()
    for i, g in enumerate(grids):
        j = first.get(np.fliplr(g).tobytes())
        if j is not None and (g != np.fliplr(g)).any():
            pairs.add((min(i, j), max(i, j)))
    got = objects.raster_mirrors(spark, sf).collect()
    assert len(pairs) >= 24 and sorted((r.lo, r.hi) for r in got) == sorted(pairs)

    zones = [tuple(np.clip((g.reshape(4, 2, 4, 2).mean((1, 3)) * 3).astype(int), 0, 2).ravel()) for g in grids]
    head = list(range(len(grids)))
    for i, a in enumerate(grids):
        for j, b in enumerate(grids[:i]):
            if zones[i] == zones[j] and (a | b).any() and (a & b).sum() / (a | b).sum() >= 0.78:
                lo, hi = sorted((head[i], head[j]))
                head = [lo if h == hi else h for h in head]
    want = sorted((h, i, head.count(h)) for i, h in enumerate(head) if head.count(h) > 1)
    got = objects.cycle_components(spark, sf).collect()
    assert len(want) >= 24 and sorted((r.component, r.vec_id, r.size) for r in got) == want


def test_ramps_of_a_large_bin(spark, tmp_path):
    grow = [np.zeros((8, 8), bool) for _ in range(3)]
    for g, n in zip(grow, (4, 5, 6)):
        g[2:5, 1 : 1 + n] = True
    assert len({int(np.argmax(raster.orientation_shares(g))) for g in grow}) == 1
    sf = shapes(spark, tmp_path, [(i, number(grow[i % 3]), 0) for i in range(630)])
    (got,) = registry.QUERIES["ramp_families"](spark, sf).collect()
    assert got.skipped == 0 and got.members == sorted(range(630), key=lambda i: (i % 3, i))
