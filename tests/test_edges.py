"""Run edges by classes and by order against their SQL, on shapes of all extents, copies, and axes that round to either side."""

import random

import numpy as np
import pytest
from test_findings import UPRIGHT, same
from test_objects import SCHEMA, number, shapes

from quern import registry
from quern.operators import edges

QUERIES = ("run_edges", "run_edge_quota", "run_paths", "run_collapse", "topk_length_diverse")
#: Those that don't pair marks.
CLASSED = ("run_collapse", "run_paths", "topk_length_diverse", "run_edge_quota", "run_edges")


def small(rng):
    """A shape of any extent: random ink within a random box, or a line."""
    grid = np.zeros((8, 8), bool)
    (y0, y1), (x0, x1) = sorted(rng.choices(range(8), k=2)), sorted(rng.choices(range(8), k=2))
    grid[y0 : y1 + 1, x0 : x1 + 1] = rng.random() < 0.3 or np.array([[rng.random() < 0.6 for _ in range(x1 - x0 + 1)] for _ in range(y1 - y0 + 1)])
    return number(grid)


def planted(seed, n=90):
    rng = random.Random(seed)
    lines = [number(g) for g in (np.eye(8, dtype=bool), np.eye(8, dtype=bool)[::-1], np.ones((8, 1), bool) * (np.arange(8) == 3), (np.ones((1, 8), bool) * (np.arange(8) == 4)[:, None]))]
    kinds = [small(rng) for _ in range(n // 2)] + [rng.getrandbits(64) for _ in range(n // 8)] + UPRIGHT[:4] + lines
    return [(7 * k % 1009, rng.choice(kinds), k % 3 == 0) for k in range(n)]


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("seed", [1, 2])
def test_edges_of_all_extents(spark, tmp_path, name, seed):
    same(spark, shapes(spark, tmp_path, [(i, m, int(b)) for i, m, b in planted(seed)]), name)


@pytest.mark.parametrize("name", CLASSED)
def test_edges_pair_no_marks(spark, name):
    """Marks of a block don't meet in a join: no row is made for each pair."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    meets = [x for x in plan.split("\n") if "Join" in x and "label#" in x]
    assert not any(x.count("id#") > 1 for x in meets) and (name == "run_edges" or not meets)


def test_marks_without_a_block(spark, tmp_path):
    """Null labels are equal to none, so such marks only repeat."""
    rows = [(k, [1.0] * 64, None if k < 3 else 0) for k in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("run_edges", "run_edge_quota"):
        rows = same(spark, tmp_path, name)
    assert {x.src for x in rows if x.rule != "repeat"} <= {3, 4}


def block(n, seed):
    """Marks with directions of few and of many values, among them below 0, at bins' borders and exactly 45 apart."""
    rng = np.random.default_rng(seed)
    c0 = rng.integers(0, 5, n)
    c1 = np.minimum(7, c0 + rng.integers(0, 8, n))
    dom = np.where(rng.random(n) < 0.5, rng.integers(-6, 12, n) * 15.0, np.round(rng.random(n) * 180, rng.choice([1, 9])))
    return {"id": rng.permutation(n) * 3, "a0": rng.integers(0, 8, n), "a1": rng.integers(0, 8, n), "c0": c0, "c1": c1, "size": c1 - c0 + 1, "cen": rng.integers(0, 57, n) / 8, "b_right": rng.integers(0, 4, n), "b_left": rng.integers(0, 4, n), "dom": dom}


@pytest.mark.parametrize("n,seed", [(1, 0), (2, 1), (9, 2), (40, 3), (400, 4), (400, 5), (400, 6)])
def test_edges_by_all_pairs(n, seed):
    """Each share of a block's marks has the edges of a quota over all pairs; and the sums of its turns."""
    m, own = block(n, seed), np.random.default_rng(seed).random(n) < 0.7
    got = edges.kept(m, own)
    s, t = (v.ravel() for v in np.meshgrid(np.flatnonzero(own), np.arange(n), indexing="ij"))
    s, t = s[s != t], t[s != t]
    a, b = {c: v[s] for c, v in m.items()}, {c: v[t] for c, v in m.items()}
    both = np.minimum(a["c1"], b["c1"]) >= np.maximum(a["c0"], b["c0"])
    right, left = a["b_right"], b["b_left"]
    j = np.where((right != 0) & (left != 0), np.bitwise_count(right & left) / np.maximum(1, np.bitwise_count(right | left)), 0.0)
    far = np.min([abs(a[x] - b[y]) for x in ("c0", "c1") for y in ("c0", "c1")], axis=0)
    by = np.minimum(abs(a["dom"] - b["dom"]), 180 - abs(a["dom"] - b["dom"]))
    to = [np.fmod(np.fmod(np.floor(a["dom"] / 15), 12) + 12 + w, 12) for w in range(-3, 4)]
    bins = np.logical_or.reduce([x == np.fmod(np.floor(b["dom"] / 15), 12) for x in to])
    want = {
        "contact": ((a["a1"] >= b["a0"] + 3) & both, 7 - a["a1"] + b["a0"] + 1.0 - j),
        "step": ((a["size"] <= 5) & (b["size"] <= 5) & (abs(a["cen"] - b["cen"]) <= 1), np.full(len(s), 0.5)),
        "turn": ((a["size"] >= 4) & (b["size"] >= 4) & bins & (by <= 45) & both, 1.0 + by / 45),
        "end": (~both & (np.maximum(a["size"], b["size"]) > 5) & (far <= 4), 1.0 + far / 4),
    }
    for rule, (goes, cost) in want.items():
        rows = edges.quota(a["id"][goes], b["id"][goes], cost[goes])
        found = got.get(rule, (np.empty(0, int), np.empty(0, int), np.empty(0)))
        assert sorted(zip(*(v.tolist() for v in rows))) == sorted(zip(*(v.tolist() for v in found))), rule
    goes, cost = want["turn"]
    count, least, most, total = edges.turn_sums(m, own)
    assert count == goes.sum() and total == pytest.approx(cost[goes].sum())
    assert not count or (least, most) == (cost[goes].min(), cost[goes].max())


def test_a_share_for_each_cost():
    src, dst = np.array([1] * 5 + [2] * 4 + [3] * 4), np.arange(13)
    cost = np.array([0.1, 0.2, 0.3, 1.5, 1.6, 0.1, 1.2, 2.2, 2.1, 0.4, 0.3, 0.2, 0.1])
    got = edges.quota(src, dst, cost)
    assert sorted(zip(got[0].tolist(), got[1].tolist())) == [(1, 0), (1, 1), (1, 3), (2, 5), (2, 6), (2, 8), (3, 10), (3, 11), (3, 12)]
