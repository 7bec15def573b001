"""Values worked out by hand from the definitions, on small drawn tables: no second run of a plan."""

import math

import numpy as np
import pytest
from test_objects import number, shapes

from quern import registry
from quern.operators import raster as r
from quern.plans.dialect import EM, WIDTHS

BAR = ["........", "........", "........", ".######.", "........", "........", "........", "........"]
POST = ["...#....", "...#....", "...#....", "...#....", "...#....", "...#....", "...#....", "...#...."]
RING = ["........", ".#####..", ".#...#..", ".#...#..", ".#...#..", ".#####..", "........", "........"]
THICK = ["........", "........", ".######.", ".######.", ".######.", "........", "........", "........"]
DOT = ["........", "........", "........", "...##...", "...##...", "........", "........", "........"]


@pytest.fixture(scope="module")
def drawn(spark, tmp_path_factory):
    grids = [r.from_rows(x) for x in (BAR, POST, RING, THICK, DOT)]
    return shapes(spark, tmp_path_factory.mktemp("drawn"), [(i, number(g), 0) for i, g in enumerate(grids)])


def rows(spark, sf, name):
    return {x.vec_id: x for x in registry.QUERIES[name](spark, sf).collect()}


def test_crop_fit(spark, drawn):
    got = rows(spark, drawn, "crop_fit")
    wide = "." * 16 * 6  # six of one by six pixels are 16 by three (2.67) rows, six blank rows above
    assert got[0].grid == wide + "#" * 48 + "." * 16 * 7
    assert got[4].grid == "#" * 256


def test_thinned_and_despurred(spark, drawn):
    got = rows(spark, drawn, "thinned")
    assert (got[0].pixels, got[0].ends, got[0].branches) == (6, 2, 0)
    assert (got[1].pixels, got[1].ends, got[1].branches) == (8, 2, 0)
    assert (got[2].ends, got[2].branches) == (0, 0)
    assert got[3].ends == 2 and got[3].branches == 0 and got[3].pixels < 18
    assert all(x.removed == 0 for i, x in rows(spark, drawn, "despurred").items() if i < 2)


def test_fingerprints(spark, drawn):
    got = rows(spark, drawn, "fingerprints")
    for i, length in ((0, 5 / 8), (1, 7 / 8)):
        assert (got[i].ends, got[i].branches, got[i].parts) == (2, 0, 1)
        assert got[i].length == pytest.approx(length) and got[i].straight == pytest.approx(1) and got[i].winding == pytest.approx(0, abs=1e-9)
    assert got[0].aspect == pytest.approx(6) and got[1].aspect == pytest.approx(1 / 8)


def test_orientation_continuity_log_polar(spark, drawn):
    got = rows(spark, drawn, "stroke_orientation")
    assert abs(got[1].degrees - 90) < 1 and min(got[0].degrees, 180 - got[0].degrees) < 1
    assert got[1].shares[6] + got[1].shares[5] == pytest.approx(1)
    # an upright stroke is its own reference but for its column
    assert rows(spark, drawn, "continuity")[1].distance == pytest.approx(0, abs=1e-9)
    mass = rows(spark, drawn, "log_polar")
    assert all(x.points == 16 for x in mass.values()) and mass[3].mass > mass[0].mass > mass[4].mass > 0


def test_stability(spark, drawn):
    got = rows(spark, drawn, "stability")
    assert got[4].marks == [] and got[0].marks == ["sides"]  # a bar touches a side when it is moved to it
    assert "ink" in got[1].marks


def test_topology_delta(spark, drawn):
    got = {(x.a, x.b): x for x in registry.QUERIES["topology_delta"](spark, drawn).collect()}
    assert sorted(got) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    # the post touches the upper border, the bar above doesn't reach it: no part joins
    assert [(x.parts, x.holes) for _, x in sorted(got.items())] == [(0, 0)] * 4
    assert all(x.second_matters for x in got.values())


def test_stroke_records(spark, drawn):
    got = rows(spark, drawn, "stroke_records")
    assert [got[i].kind for i in (0, 1)] == ["bar", "bar"] and got[2].kind == "arc_loop"
    assert (got[0].heading, got[1].heading, got[2].heading) == (0, 6, None)
    assert got[2].fill == "hollow" and got[4].fill == "solid" and got[0].strokes == 1
    assert got[0].hand is None and got[0].stable


def big(points, size=40):
    g = np.zeros((size, size), bool)
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        n = max(abs(x1 - x0), abs(y1 - y0)) * 2
        for k in range(n + 1):
            x, y = round(x0 + (x1 - x0) * k / n), round(y0 + (y1 - y0) * k / n)
            g[y - 1 : y + 2, x - 1 : x + 2] = True
    return g


def test_stroke_kinds_and_hands():
    hook, wave = big([(8, 5), (8, 30), (30, 30)]), big([(30, 5), (10, 5), (10, 20), (30, 20), (30, 35), (10, 35)])
    record = lambda g: r.stroke_record(g)
    assert record(hook)["kind"] == "single_hook" and record(wave)["kind"] == "wave"
    assert record(big([(5, 50), (95, 50)], 100) | big([(50, 5), (50, 95)], 100))["kind"] == "compound"
    assert record(big([(5, 5), (95, 5)], 100) | big([(50, 5), (50, 95)], 100))["kind"] == "branch"
    # turning keeps the hand, mirroring changes it
    hook = big([(8, 4), (8, 34), (20, 34)])
    hands = [record(np.rot90(hook, k))["hand"] for k in range(4)] + [record(np.rot90(hook[:, ::-1], k))["hand"] for k in range(4)]
    assert len(set(hands[:4])) == len(set(hands[4:])) == 1 and {hands[0], hands[4]} == {"normal", "mirrored"}


def test_bends_and_inflections():
    turn = np.array([0.3, 0.3, 0.01, 0.3, -0.3, -0.3, -0.3, 0.2])
    assert r.bends(turn) == 2 and r.inflections(turn) == 2 and r.bends(np.zeros(4)) == 0


def test_part_axes(spark, drawn):
    got = rows(spark, drawn, "part_axes")
    assert (got[0]["size"], got[0].degrees, got[0].ratio) == (6, 0.0, None)
    assert got[1].degrees == pytest.approx(90) and got[3].ratio == pytest.approx(math.sqrt((35 / 12) / (2 / 3)))


def test_log_moments_do_not_change(spark):
    g = big([(8, 5), (8, 30), (30, 30)])
    a = r.log_moments(g)
    for other in (np.rot90(g), r.moved(g, 3, -2)):
        assert r.log_moments(other)[:4] == pytest.approx(a[:4], rel=1e-6)


def test_topo_search(spark, drawn):
    got = registry.QUERIES["topo_search"](spark, drawn).collect()
    # of a bar: the thick bar thins to a shorter one, the post is its quarter turn
    assert {x.vec_id for x in got[:2]} == {1, 3} and got[0].distance <= got[1].distance


def test_alike_prints_is_complete_linkage():
    rng = np.random.default_rng(3)
    prints = [r.fingerprint(rng.random((8, 8)) < 0.4) for _ in range(90)]
    want = r.complete_linkage(list(range(90)), lambda a, b: r.fingerprint_distance(prints[a], prints[b]) <= 4.0, 1)
    assert r.alike_prints(prints, 4.0) == want and any(len(c) > 2 for c in want)


def test_topo_families_of_a_large_bucket(spark, tmp_path):
    sf = shapes(spark, tmp_path, [(i, number(r.from_rows(BAR)), 0) for i in range(520)] + [(600 + i, number(r.from_rows(POST)), 0) for i in range(3)])
    got = registry.QUERIES["topo_families"](spark, sf).collect()
    assert [x.members for x in got] == [[600, 601, 602]] and all(x.skipped == 0 for x in got)


def test_page_texts(spark, tmp_path):
    html = "<html><head><title>T</title><script>var a = '<p>';</script><style>p{}</style></head><body><p>One &amp; two<br>three</p><a href=x>link</a><ul><li>a<li>b</ul></body></html>"
    spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: (x.body, x.links) for x in registry.QUERIES["page_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: ("T\nOne & two\nthreelink\na\nb", 1), 2: ("", 0), 3: ("", 0)} or got[1] == ("T\nOne & two\nthree\nlink\na\nb", 1)


def test_bootstrap_interval(spark, tmp_path):
    # one source: every resample that draws it has its mean
    docs = spark.createDataFrame([(1, "x" * 10, "en", "s", 10), (2, "x" * 30, "en", "s", 30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = registry.QUERIES["bootstrap_interval"](spark, str(tmp_path)).collect()
    assert (got.low, got.high) == (20.0, 20.0)


def documents(spark, tmp_path, texts, benchmark=("x",)):
    rows_ = [(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_tone_bands(spark, tmp_path):
    sf = documents(spark, tmp_path, ["a ***b %%%% c", "*#*#*# x", "%*#$ ****"])
    got = {x.unit: (x.n, x.pages, x.longest) for x in registry.QUERIES["tone_bands"](spark, sf).collect()}
    assert got == {"%": (1, 1, 4), "*#": (1, 1, 6), "(aperiodic)": (1, 1, 4), "*": (1, 1, 4)}


def test_hatch_runs_and_spans(spark, tmp_path):
    sf = documents(spark, tmp_path, ["=== // /// iill", "|l| =≡= \\\\\\", "aaa abc ｶﾆ ひらがな カタカナ ＡＢ く"])
    got = sorted((x.family, x.size, x.n) for x in registry.QUERIES["hatch_runs"](spark, sf).collect())
    assert got == [("d", 3, 2), ("h", 3, 2), ("v", 4, 1)]
    got = sorted((x.kind, x["size"], x.n) for x in registry.QUERIES["language_spans"](spark, sf).collect())
    assert got == [("jp", 4, 1), ("latin", 3, 1), ("wide", 2, 1)] or got == [("jp", 4, 2), ("latin", 3, 1), ("wide", 2, 1)]


def test_fragments_are_found_whole(spark, tmp_path):
    item = "first words of it and a rather uncommonword to end"
    sf = documents(spark, tmp_path, [f"before\n{item} after", item[:-1], f"x{item}y", "to end", "rather uncommonword"], [item, "to end", "uncommon", ""])
    got = {x.item_id: x.pages for x in registry.QUERIES["fragment_containment"](spark, sf).collect()}
    assert got == {0: 2, 1: 3, 2: 4}
    got = sorted((x.doc_id, x.item_id, x.found_at) for x in registry.QUERIES["slice_check"](spark, sf).collect())
    assert (0, 0, 8) in got and (2, 0, 2) in got and not any(d == 1 and i == 0 for d, i, _ in got)


def test_long_line(spark, tmp_path):
    sf = documents(spark, tmp_path, ["ab" * 500_000])
    got = {x.ch: x.n for x in registry.QUERIES["glyph_counts"](spark, sf).collect()}
    assert got == {"a": 500_000, "b": 500_000}
    assert {x.g: x.n for x in registry.QUERIES["bigrams"](spark, sf).collect()} == {"ab": 500_000, "ba": 499_999}


def test_ids_beyond_a_million(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 70_000, 600_000)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    lit = {x.id: (x.cx, x.cy) for x in registry.QUERIES["lut_dense"](spark, str(tmp_path)).filter("alpha = 255").collect()}
    assert lit == {258: (0, 0), 140_256: (1, 0), 1_200_256: (2, 0)}
    assert registry.QUERIES["lut_dense"](spark, str(tmp_path)).count() == 1_200_001


def test_window_sizes_by_brute_force(spark, tmp_path):
    plates = ["ww ww\n ww w\nww ww", "ww ww\n ww w", "", "w  w w\n\nw  w w", "  \n w", "wa wb wa wb\nwa wb wa wb\nwa wb wa wb"]
    sf = documents(spark, tmp_path, [], plates)
    advance = lambda ch: round(WIDTHS[ord(ch) - 32] * EM / 1000)
    found: dict = {}
    for item, text in enumerate(plates):
        cells: dict = {}
        for row, line in enumerate(text.split("\n")):
            pen = 0
            for ch in line:
                cells[row, pen // 16] = cells.get((row, pen // 16), "") + ch
                pen += advance(ch)
        cells = {at: code for at, code in cells.items() if code.strip(" ")}
        for h in range(2, 13):
            for w in range(2, 13):
                for top in range(max((y for y, _ in cells), default=-1) - h + 2):
                    for left in range(max(x for _, x in cells) - w + 2):
                        own = {(y, x): cells[top + y, left + x] for y in range(h) for x in range(w) if (top + y, left + x) in cells}
                        if {y for y, _ in own} >= {0, h - 1} and {x for _, x in own} >= {0, w - 1}:
                            found.setdefault((h, w), []).append((item, tuple(sorted(own.items()))))
    want = {}
    for size, windows in found.items():
        kinds = {k for _, k in windows}
        n = {k: sum(k == x for _, x in windows) for k in kinds}
        items = {k: len({i for i, x in windows if x == k}) for k in kinds}
        outline = sum(len({ch for _, code in k for ch in code} - {" "}) > 1 for k in kinds)
        want[size] = (len(windows), len(kinds), sum(x == 1 for x in n.values()), sum(x >= 2 for x in items.values()), 0, outline)
    got = {(x.height, x.width): (x.windows, x.patterns, x.singles, x.in_two, x.in_ten, x.outlines) for x in registry.QUERIES["window_sizes"](spark, sf).collect()}
    assert got == want
    assert any(x[3] for x in want.values()) and any(h > 2 for h, _ in want)
