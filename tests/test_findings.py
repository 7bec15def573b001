"""Planted tables on which plans and their SQL once differed, or whose plans once grew faster than the table."""

import random

import duckdb
import numpy as np
import pytest
from test_goldens import DOT
from test_objects import SCHEMA, number, shapes
from test_plans import canon

from quern import registry
from quern.operators import raster as r
from quern.plans import meeting
from quern.sources.tables import cells


def same(spark, sf, name, table="embeddings"):
    """The rows of a query, which are those of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
    got, found = registry.QUERIES[name](spark, str(sf)), con.execute(registry.ORACLE[name])
    rows = got.collect()
    assert canon(rows, got.columns) == canon(found.fetchall(), [c[0] for c in found.description]) and rows
    return rows


def test_balanced_ink_heads_to_bin_4(spark, tmp_path):
    side = ["........"] * 3 + ["......##"] * 2 + ["........"] * 3
    sf = shapes(spark, tmp_path, [(k, number(r.from_rows(x)), 0) for k, x in enumerate([DOT, side])])
    assert {x.vec_id: (x.magnitude, x.bin) for x in same(spark, sf, "heading8")} == {0: (0.0, 4), 1: (0.75, 2)}


#: Upright marks, and two others; the axis of an upright one is at 90 or at -90 degrees by the rounding of its sum, which is in the order of pixels.
UPRIGHT = [0xa6756c315df837d6, 0x36d29a4119cf9866, 0x536d783c4d719e93, 0xceedcec042dcad9c, 0x1a1ba250b9f24d, 0xff7c40f89ab6f27d, 0x27a7fd3e265bd9b3, 0x36a21ca13be74fee]


def test_moments_in_the_order_of_pixels(spark, tmp_path):
    sf = shapes(spark, tmp_path, [(k, m, 0) for k, m in enumerate(UPRIGHT)])
    got = {x.vec_id: x for x in cells(spark, sf).collect()}
    for k, m in enumerate(UPRIGHT):
        spots = [divmod(p, 8) for p in range(64) if m >> p & 1]
        mx, my, total = (sum(p[1] for p in spots) / len(spots), sum(p[0] for p in spots) / len(spots), 0.0)
        for y, x in spots:
            total += (x - mx) * (y - my)
        assert (got[k].sxy, got[k].cen, got[k].ink) == (total, my, len(spots))
    for name in ("edge_masks", "run_edges", "run_edge_quota", "run_walks", "topk_length_diverse"):
        same(spark, sf, name)


def test_odd_vectors_have_cells(spark, tmp_path):
    """Null and short vectors, null components and those that are no numbers."""
    nan = float("nan")
    rows = [(0, None, 0), (1, [1.0, None, nan], 0), (2, [-1.0] * 64, 0), (3, [-1.0] * 63 + [1.0], 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.vec_id: (x.ink, x.m_top, x.m_bottom, x.i_left, x.i_right) for x in cells(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 5, 0, 0, 2), 3: (1, 0, 128, 7, 7)}


SEAMS = ("seam_port_join", "seam_beside_join", "seam_band_join", "seam_capped", "seam_merged")


def test_seams_of_copies_and_loners(spark, tmp_path):
    """Many copies, whose ties go by id; and shapes of few partners."""
    rng = random.Random(3)
    kinds = [rng.getrandbits(64) for _ in range(6)] + [0, 1, 0xFF << 56, 0x18 << 24 | 1 << 60]
    sf = shapes(spark, tmp_path, [(k, kinds[k % 4] if k < 60 else rng.choice(kinds), k % 2) for k in range(90)])
    for name in SEAMS:
        same(spark, sf, name)


def test_too_few_left_by_the_bound(spark, tmp_path, monkeypatch):
    """A bound that leaves next to nothing changes no result."""
    monkeypatch.setattr(meeting, "SPARE", 1)
    rng = random.Random(4)
    same(spark, shapes(spark, tmp_path, [(k, rng.getrandbits(64), 0) for k in range(80)]), "seam_capped")


def test_counts_of_pairs_make_no_pairs(spark):
    for name in SEAMS[:3]:
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.split("\n") if "Join Inner" in x]
        assert 1 <= len(joins) <= 2 and all("vec_id" not in x for x in joins)  # masks with masks, and shapes with their class


PAGES = ("lattice_cells", "bigram_coverage", "trigrams", "idiom_subtraction", "window_patterns")


@pytest.mark.parametrize("name", PAGES)
def test_counts_by_page(spark, tmp_path, name):
    """Wide and rare characters, blank and empty lines, and pages without text; no row leaves a page for each of its characters."""
    texts = ["the tion the\n\n  ab ab ab\n", "ab ab ab  xx\nthe　the \U0001f600\U0001f600\U0001f600", None, "", "\n\n", "a", "ab", " ", "ab ab\nab ab\nab ab"] * 2
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, tmp_path, name, "documents")
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Expand" not in plan


def test_browser_page_finds_its_ids_first(spark):
    plan = registry.QUERIES["browser_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    limits = [k for k, x in enumerate(lines) if "GlobalLimit 8192" in x]
    assert any("embedding" not in lines[k + 2] for k in limits) and "LeftSemi" in plan


def test_topology_by_labels():
    """Counted as the labels of parts and of enclosed ground are, on rasters of many sizes and densities; and no label is made."""
    rng = np.random.default_rng(5)
    for h, w in ((8, 8), (16, 8), (8, 16), (1, 1), (1, 9), (9, 1), (24, 8)):
        for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
            for _ in range(12):
                m = rng.random((h, w)) < share
                assert r.topology(m) == (r.count_parts(m), int(r.label(r.interior(m), eight=False).max(initial=0)))


def test_topology_makes_no_labels(monkeypatch):
    monkeypatch.setattr(r, "label", None)
    assert r.topology(r.from_rows(["###.", "#.#.", "###.", "...#"])) == (1, 1)
