"""Directed families, fills and radius clusters on planted shapes."""

import random
import zlib

import numpy as np
import pytest
from test_objects import number, shapes

from quern import registry
from quern.operators import raster as r
from quern.plans import families

ARROW = ["........", "...##...", "..#..#..", ".#....#.", "........", "........", "........", "........"]
OUTLINE = ["........", ".######.", ".#....#.", ".#....#.", ".#..###.", ".#..#...", ".####...", "........"]


def solid(grid):
    return grid | r.interior(grid)


def test_insides_of_many():
    rng = np.random.default_rng(9)
    stack = rng.random((200, 9, 7)) < 0.6
    assert (r.insides(stack) == np.array([r.interior(g) for g in stack])).all()


def test_crc_of_the_least_image(spark, tmp_path):
    rng = np.random.default_rng(4)
    grids = [rng.random((8, 8)) < p for p in (0.2, 0.5, 0.8) for _ in range(15)] + [r.from_rows(OUTLINE), np.zeros((8, 8), bool), np.ones((8, 8), bool)]
    got = {x.vec_id: (x.crc, x.solid_crc) for x in registry.QUERIES["symmetry_crc"](spark, shapes(spark, tmp_path, [(k, number(g), 0) for k, g in enumerate(grids)])).collect()}
    images = lambda g: [np.rot90(m, k) for m in (g, g[:, ::-1]) for k in range(4)]
    crc = lambda g: zlib.crc32(min(np.ascontiguousarray(m).astype(np.uint8).tobytes() for m in images(g)))
    assert got == {k: (crc(g), crc(solid(g))) for k, g in enumerate(grids)}


def test_fills_of_planted_outlines(spark, tmp_path):
    base = r.from_rows(OUTLINE)
    rows, want = [], set()
    for turn in range(4):  # outlines in every turn, each with two fills, and one in another turn that doesn't cover it
        g = np.rot90(base, turn)
        part = solid(g).copy()
        part[tuple(np.argwhere(r.interior(g))[0])] = False
        rows += [(10 * turn, g), (10 * turn + 1, solid(g)), (10 * turn + 2, part), (10 * turn + 3, g)]
        want |= {(a, b) for a in (10 * turn, 10 * turn + 3) for b in (10 * turn + 1, 10 * turn + 2)} | {(10 * turn + 2, 10 * turn + 1)}
    sf = shapes(spark, tmp_path, [(i, number(g), 0) for i, g in rows])
    got = {(x.outline, x.fill): (x.cover, x.filled) for x in registry.QUERIES["fill_pairs"](spark, sf).collect()}
    by = dict(rows)
    every = {}
    for a, g in rows:
        hole = r.interior(g)
        for b, h in rows:
            if a == b or not hole.any() or h.sum() < g.sum() or r.interior(h).sum() >= hole.sum():
                continue
            images = {np.ascontiguousarray(np.rot90(m, k)).tobytes() for m in (solid(g), solid(g)[:, ::-1]) for k in range(4)}
            cover, filled = (g & h).sum() / g.sum(), (h & hole).sum() / hole.sum()
            if np.ascontiguousarray(solid(h)).tobytes() in images and cover >= 0.7 and filled >= 0.45:
                every[a, b] = (round(float(cover), 6), round(float(filled), 6))
    assert got == every and want <= set(got) and by


def test_a_hot_silhouette(spark, tmp_path):
    """Very many copies of one outline and its fill: pairs come from one pair of rasters."""
    g = r.from_rows(OUTLINE)
    sf = shapes(spark, tmp_path, [(k, number(g if k < 300 else solid(g)), 0) for k in range(303)])
    got = registry.QUERIES["fill_pairs"](spark, sf).collect()
    assert len(got) == 900 and {(x.cover, x.filled) for x in got} == {(1.0, 1.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_radius_clusters_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pts = [(k, rng.choice("ab"), *(round(rng.random() * 2, 1) for _ in range(3))) for k in range(150)]
    rng.shuffle(pts)
    got = {x.id: x.seed for x in families.radius_clusters(spark.createDataFrame(pts, "id long, p string, x double, y double, z double"), ["x", "y", "z"], 0.45, ["p"]).collect()}
    seeds, want = [], {}
    for p in sorted(pts):
        near = [s for s in seeds if s[1] == p[1] and sum((a - b) ** 2 for a, b in zip(s[2:], p[2:])) ** 0.5 <= 0.45]
        want[p[0]] = near[0][0] if near else p[0]
        seeds += [] if near else [p]
    assert got == want and len(set(want.values())) > 5


def test_directed_families_of_turns(spark, tmp_path):
    arrow = r.from_rows(ARROW)
    bar = r.from_rows(["########", "........", "........", "........", "........", "........", "........", "........"])
    rows = [(40 + 7 * k, np.ascontiguousarray(np.rot90(arrow, -k))) for k in range(4)] + [(70 + k, np.ascontiguousarray(np.rot90(arrow, -k))) for k in range(2)] + [(1 + k, np.rot90(bar, -k)) for k in range(3)]
    got = registry.QUERIES["directed_families"](spark, shapes(spark, tmp_path, [(i, number(g), 0) for i, g in rows])).collect()
    # north first, clockwise; of equally clear shapes the smallest id stays; a bar has three headings only
    by = dict(rows)
    best = {}
    for i in sorted(by):
        best.setdefault(by[i].tobytes(), i)
    turns = [best[np.ascontiguousarray(np.rot90(arrow, -k)).tobytes()] for k in range(4)]
    assert [(x.seed, x["size"], x.members) for x in got] == [(40, 4, " ".join(map(str, turns)))]
