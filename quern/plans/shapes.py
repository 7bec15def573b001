"""Queries over binary shapes: an embedding's signs are the pixels of an 8 by 8 bitmap, its label is the block."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import bits
from quern.plans.dialect import _text, plan
from quern.registry import query
from quern.sources.tables import bitmaps, table

LENSES = {
    "iou": lambda m, q: F.lit(1.0) - bits.iou(m, q),
    "iou_dil": lambda m, q: F.lit(1.0) - bits.iou(bits.dilate(m), bits.dilate(q)),
    "hamming": bits.hamming,
}


def nearest(spark, sf_dir: str, lens: str, seed: int = 0, k: int = 12):
    """The k shapes nearest to a seed under a lens; the seed is one row, so it is broadcast."""
    maps = bitmaps(spark, sf_dir)
    one = F.broadcast(maps.filter(F.col("vec_id") == seed).limit(1).select(F.col("mask").alias("q")))
    near = maps.filter(F.col("vec_id") != seed).crossJoin(one)
    near = near.select("vec_id", F.round(LENSES[lens](F.col("mask"), F.col("q")), 6).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(k)


_NEAR = "q AS (SELECT y, x, v AS q FROM {0} WHERE vec_id = 0) SELECT vec_id, round({1}, 6) AS distance FROM {0} JOIN q USING (y, x) WHERE vec_id <> 0 GROUP BY vec_id ORDER BY distance, vec_id LIMIT 12"
_IOU = "1.0 - CASE WHEN sum(greatest(v, q)) = 0 THEN 1.0 ELSE sum(v * q)::DOUBLE / sum(greatest(v, q)) END"
DIL = "@pix, dil AS (SELECT a.vec_id, a.label, a.y, a.x, max(b.v) AS v FROM pix a JOIN pix b ON a.vec_id = b.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.vec_id, a.label, a.y, a.x)"


def _oracle(text: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"\1", _text(text, 1))


query("similar_iou", _oracle("WITH @pix, " + _NEAR.format("pix", _IOU)))(lambda spark, sf: nearest(spark, sf, "iou"))
query("similar_iou_dilated", _oracle(f"WITH {DIL}, " + _NEAR.format("dil", _IOU)))(lambda spark, sf: nearest(spark, sf, "iou_dil"))
query("similar_hamming", _oracle("WITH @pix, " + _NEAR.format("pix", "sum(abs(v - q)) / 64.0")))(lambda spark, sf: nearest(spark, sf, "hamming"))


def _vector_near(spark, sf_dir: str, how: str, seed: int = 0, k: int = 12):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = F.broadcast(rows.filter(F.col("vec_id") == seed).limit(1).select(F.col("e").alias("q")))
    near = rows.filter(F.col("vec_id") != seed).crossJoin(one)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    if how == "l2":
        d = F.sqrt(total(F.zip_with("e", "q", lambda a, b: (a - b) * (a - b))))
    else:
        dot, na, nb = (total(F.zip_with(a, b, lambda x, y: x * y)) for a, b in (("e", "q"), ("e", "e"), ("q", "q")))
        d = F.lit(1.0) - dot / (F.sqrt(na) * F.sqrt(nb) + F.lit(1e-9))
    return near.select("vec_id", F.round(d, 6).alias("distance")).orderBy("distance", "vec_id").limit(k)


_VEC = "WITH @vec, q AS (SELECT k, e AS q FROM vec WHERE vec_id = 0) SELECT vec_id, round({}, 6) AS distance FROM vec JOIN q USING (k) WHERE vec_id <> 0 GROUP BY vec_id ORDER BY distance, vec_id LIMIT 12"
query("similar_l2", _oracle(_VEC.format("sqrt(sum((e - q) * (e - q)))")))(lambda spark, sf: _vector_near(spark, sf, "l2"))
query("similar_cosine", _oracle(_VEC.format("1.0 - sum(e * q) / (sqrt(sum(e * e)) * sqrt(sum(q * q)) + 1e-9)")))(lambda spark, sf: _vector_near(spark, sf, "cosine"))


@query("iou_pairs", _oracle("WITH @pix, b AS (SELECT *, max(vec_id) OVER () AS m FROM pix) SELECT a.label, a.vec_id AS a_id, b.vec_id AS b_id, round(CASE WHEN sum(greatest(a.v, b.v)) = 0 THEN 1.0 ELSE sum(a.v * b.v)::DOUBLE / sum(greatest(a.v, b.v)) END, 6) AS iou FROM pix a JOIN pix b ON a.label = b.label AND a.vec_id < b.vec_id AND a.y = b.y AND a.x = b.x GROUP BY a.label, a.vec_id, b.vec_id HAVING sum(a.v * b.v)::DOUBLE / greatest(sum(greatest(a.v, b.v)), 1) >= 0.5"))
def iou_pairs(spark, sf_dir: str, least: float = 0.5):
    """Pairs of one block whose overlap is at least ``least``. A block is a group; the pair of masks decides within code generation."""
    m = bitmaps(spark, sf_dir)
    a, b = m.select("label", F.col("vec_id").alias("a_id"), F.col("mask").alias("a")), m.select("label", F.col("vec_id").alias("b_id"), F.col("mask").alias("b"))
    out = a.join(b, "label").filter("a_id < b_id").withColumn("share", bits.iou(F.col("a"), F.col("b"))).filter(F.col("share") >= least)
    return out.select("label", "a_id", "b_id", F.round("share", 6).alias("iou"))


# Ink, fewer than three pixels are no glyph
query("raster_ink", _oracle("WITH @pix SELECT vec_id, label, sum(v)::INT AS ink, round(sum(v) / 64.0, 6) AS density FROM pix GROUP BY vec_id, label HAVING sum(v) >= 3"))(
    lambda spark, sf: bitmaps(spark, sf).withColumn("ink", bits.ink(F.col("mask"))).filter("ink >= 3").select("vec_id", "label", "ink", F.round(F.col("ink") / 64.0, 6).alias("density"))
)
# Dilation; C16: shift; R8, R9: canonical forms
query("raster_dilate", _oracle(f"WITH {DIL} SELECT vec_id, $cat(v::VARCHAR; ''; y * 8 + x$) AS grid, sum(v)::INT AS ink FROM dil GROUP BY vec_id"))(
    lambda spark, sf: bitmaps(spark, sf).withColumn("d", bits.dilate(F.col("mask"))).select("vec_id", bits.text(F.col("d")).alias("grid"), bits.ink(F.col("d")).alias("ink"))
)
query("raster_shift", _oracle("WITH @pix, o AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dy, dx)) SELECT a.vec_id, dy, dx, sum(coalesce(b.v, 0))::INT AS ink FROM pix a CROSS JOIN o LEFT JOIN pix b ON a.vec_id = b.vec_id AND b.y = a.y - dy AND b.x = a.x - dx GROUP BY a.vec_id, dy, dx"))(
    lambda spark, sf: bitmaps(spark, sf).select("vec_id", F.inline(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), bits.ink(bits.shift(F.col("mask"), dy, dx)).alias("ink")) for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1))])))
)
_TURNS = "t AS (SELECT vec_id, 0 AS k, y, x, v FROM pix UNION ALL SELECT vec_id, 1, 7 - x, y, v FROM pix UNION ALL SELECT vec_id, 2, 7 - y, 7 - x, v FROM pix UNION ALL SELECT vec_id, 3, x, 7 - y, v FROM pix)"
query("rotation_key", _oracle(f"WITH @pix, {_TURNS}, s AS (SELECT vec_id, k, $cat(v::VARCHAR; ''; y * 8 + x$) AS grid FROM t GROUP BY vec_id, k), m AS (SELECT vec_id, min(grid) AS key FROM s GROUP BY vec_id) SELECT m.vec_id, key, min(k)::INT AS phase FROM m JOIN s ON m.vec_id = s.vec_id AND s.grid = m.key GROUP BY m.vec_id, key"))(
    lambda spark, sf: bitmaps(spark, sf).withColumn("grid", bits.text(F.col("mask"))).withColumn("turns", F.array(*bits.orbit(F.col("grid")))).select("vec_id", F.array_min("turns").alias("key"), (F.array_position("turns", F.array_min("turns")) - 1).cast("int").alias("phase"))
)
query("symmetry_key", _oracle(f"WITH @pix, {_TURNS}, u AS (SELECT * FROM t UNION ALL SELECT vec_id, k + 4, y, 7 - x, v FROM t), s AS (SELECT vec_id, k, $cat(v::VARCHAR; ''; y * 8 + x$) AS grid FROM u GROUP BY vec_id, k) SELECT vec_id, min(grid) AS key FROM s GROUP BY vec_id"))(
    lambda spark, sf: bitmaps(spark, sf).withColumn("grid", bits.text(F.col("mask"))).select("vec_id", F.least(*bits.orbit(F.col("grid"), True)).alias("key"))
)
# Symmetries of the shape with a tolerance of one pixel
query(
    "symmetry_lines",
    _oracle(f"WITH {DIL}, m AS (SELECT vec_id, y, x, v FROM pix), f AS (SELECT 'vertical' AS line, vec_id, y, 7 - x AS x, v FROM m UNION ALL SELECT 'horizontal', vec_id, 7 - y, x, v FROM m UNION ALL SELECT 'diagonal', vec_id, x, y, v FROM m) SELECT f.vec_id, f.line FROM f JOIN dil d ON f.vec_id = d.vec_id AND f.y = d.y AND f.x = d.x GROUP BY f.vec_id, f.line HAVING sum(f.v) > 0 AND sum(f.v * d.v) >= 0.88 * sum(f.v)"),
)(
    lambda spark, sf: bitmaps(spark, sf)
    .select("vec_id", "mask", F.inline(F.array(*[F.struct(F.lit(n).alias("line"), f(F.col("mask")).alias("image")) for n, f in (("vertical", bits.flip_columns), ("horizontal", bits.flip_rows), ("diagonal", bits.transpose))])))
    .filter((bits.ink(F.col("image")) > 0) & (bits.ink(F.col("image").bitwiseAND(bits.dilate(F.col("mask")))) >= 0.88 * bits.ink(F.col("image"))))
    .select("vec_id", "line")
)

# Zone densities and occupied quadrants
plan("raster_zoning", "WITH @pix SELECT vec_id, CAST(floor(y / 2) * 4 + floor(x / 2) AS INT) AS zone, round(avg(CAST(v AS DOUBLE)), 6) AS density FROM pix GROUP BY vec_id, floor(y / 2), floor(x / 2)")
plan("coverage_quadrants", "WITH @pix, z AS (SELECT vec_id, CAST(floor(y / 2) * 4 + floor(x / 2) AS INT) AS zone, max(v) AS lit FROM pix GROUP BY vec_id, floor(y / 2), floor(x / 2)) SELECT vec_id, CAST(sum(lit * power(2, zone)) AS INT) AS quadrants FROM z GROUP BY vec_id")
# Moments that don't change with place, size and rotation
plan(
    "hu_moments",
    """WITH @pix, c AS (SELECT vec_id, CAST(sum(v) AS DOUBLE) AS m, sum(x * v) / CAST(sum(v) AS DOUBLE) AS xb, sum(y * v) / CAST(sum(v) AS DOUBLE) AS yb FROM pix GROUP BY vec_id HAVING sum(v) > 0),
d AS (SELECT p.vec_id, m, x - xb AS dx, y - yb AS dy, v FROM pix p JOIN c ON p.vec_id = c.vec_id),
e AS (SELECT vec_id, sum(dx*dx*v)/power(max(m),2.0) AS n20, sum(dy*dy*v)/power(max(m),2.0) AS n02, sum(dx*dy*v)/power(max(m),2.0) AS n11, sum(dx*dx*dx*v)/power(max(m),2.5) AS n30, sum(dx*dy*dy*v)/power(max(m),2.5) AS n12, sum(dx*dx*dy*v)/power(max(m),2.5) AS n21, sum(dy*dy*dy*v)/power(max(m),2.5) AS n03 FROM d GROUP BY vec_id),
h AS (SELECT vec_id, n20+n02 AS h1, (n20-n02)*(n20-n02)+4*n11*n11 AS h2, (n30-3*n12)*(n30-3*n12)+(3*n21-n03)*(3*n21-n03) AS h3, (n30+n12)*(n30+n12)+(n21+n03)*(n21+n03) AS h4,
(n30-3*n12)*(n30+n12)*((n30+n12)*(n30+n12)-3*(n21+n03)*(n21+n03))+(3*n21-n03)*(n21+n03)*(3*(n30+n12)*(n30+n12)-(n21+n03)*(n21+n03)) AS h5,
(n20-n02)*((n30+n12)*(n30+n12)-(n21+n03)*(n21+n03))+4*n11*(n30+n12)*(n21+n03) AS h6,
(3*n21-n03)*(n30+n12)*((n30+n12)*(n30+n12)-3*(n21+n03)*(n21+n03))-(n30-3*n12)*(n21+n03)*(3*(n30+n12)*(n30+n12)-(n21+n03)*(n21+n03)) AS h7 FROM e)
SELECT vec_id, round(sign(h1)*log10(abs(h1)+1e-30), 4) AS h1, round(sign(h2)*log10(abs(h2)+1e-30), 2) AS h2, round(sign(h3)*log10(abs(h3)+1e-30), 2) AS h3, round(sign(h4)*log10(abs(h4)+1e-30), 2) AS h4, round(h5, 9) + 0.0 AS h5, round(h6, 9) + 0.0 AS h6, round(h7, 9) + 0.0 AS h7 FROM h""",
)
# Undirected gradient directions in eight bins, by strength
plan(
    "orient_hist",
    """WITH @pix, g AS (SELECT vec_id, y, x, CASE WHEN x BETWEEN 1 AND 6 THEN lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) - lag(v) OVER (PARTITION BY vec_id, y ORDER BY x) ELSE 0 END AS gx, CASE WHEN y BETWEEN 1 AND 6 THEN lead(v) OVER (PARTITION BY vec_id, x ORDER BY y) - lag(v) OVER (PARTITION BY vec_id, x ORDER BY y) ELSE 0 END AS gy FROM pix),
b AS (SELECT vec_id, CASE WHEN gy = 0 THEN 0 WHEN gx = 0 THEN 4 WHEN gx * gy > 0 THEN 2 ELSE 6 END AS bin, sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) AS mag FROM g WHERE gx <> 0 OR gy <> 0),
s AS (SELECT vec_id, bin, sum(mag) AS mag FROM b GROUP BY vec_id, bin) SELECT vec_id, CAST(bin AS INT) AS bin, round(mag / sum(mag) OVER (PARTITION BY vec_id), 6) AS share FROM s""",
)
# Densities of bands, diagonals, transitions, and the class that follows from them
_STATS = """@pix, n AS (SELECT a.vec_id, a.y, a.x, a.v, CASE WHEN a.x > 0 AND a.v <> lag(a.v) OVER (PARTITION BY a.vec_id, a.y ORDER BY a.x) THEN 1 ELSE 0 END + CASE WHEN a.y > 0 AND a.v <> lag(a.v) OVER (PARTITION BY a.vec_id, a.x ORDER BY a.y) THEN 1 ELSE 0 END AS flips FROM pix a),
d AS (SELECT vec_id, avg(CAST(v AS DOUBLE)) AS d, avg(CAST(CASE WHEN y < 2 THEN v END AS DOUBLE)) AS top_d, avg(CAST(CASE WHEN y >= 2 AND y < 4 THEN v END AS DOUBLE)) AS mid_d, avg(CAST(CASE WHEN y >= 4 THEN v END AS DOUBLE)) AS bot_d,
 avg(CAST(CASE WHEN x < 4 THEN v END AS DOUBLE)) AS left_d, avg(CAST(CASE WHEN x >= 4 THEN v END AS DOUBLE)) AS right_d,
 avg(CAST(CASE WHEN x < 4 AND y < 4 THEN v END AS DOUBLE)) AS q1, avg(CAST(CASE WHEN x >= 4 AND y < 4 THEN v END AS DOUBLE)) AS q2, avg(CAST(CASE WHEN x < 4 AND y >= 4 THEN v END AS DOUBLE)) AS q3, avg(CAST(CASE WHEN x >= 4 AND y >= 4 THEN v END AS DOUBLE)) AS q4,
 avg(CAST(CASE WHEN abs(x - y) <= 2 THEN v END AS DOUBLE)) AS nwse, avg(CAST(CASE WHEN abs(7 - x - y) <= 2 THEN v END AS DOUBLE)) AS nesw, CAST(sum(flips) AS DOUBLE) / 112 AS rate FROM n GROUP BY vec_id),
m AS (SELECT *, greatest(q1, q2, q3, q4) * (1.0 - least(q1, q2, q3, q4)) AS corner, abs(mid_d - (top_d + bot_d) * 0.5) AS hb, abs(left_d - right_d) AS vb, greatest(nwse, nesw) AS db FROM d),
a AS (SELECT *, greatest(0.0, least(1.0, rate * 1.35 + least(top_d + mid_d + bot_d, 1.0) * 0.15 - corner * 0.35)) AS curve FROM m),
k AS (SELECT *, CASE WHEN d < 0.05 THEN 'dot' WHEN d > 0.62 THEN 'block' WHEN corner > 0.22 THEN 'corner' WHEN db > 0.34 AND db > greatest(mid_d, left_d, right_d) THEN 'diagonal' WHEN hb > 0.18 AND mid_d >= greatest(top_d, bot_d) THEN 'horizontal' WHEN vb < 0.08 AND left_d + right_d > 0.28 THEN 'vertical' WHEN curve > 0.42 THEN 'curve' WHEN rate > 0.38 THEN 'cross' ELSE 'line' END AS stroke_class FROM a)"""
plan("stroke_class", f"WITH {_STATS} SELECT vec_id, stroke_class, round(d, 4) AS density, round(top_d, 4) AS top_weight, round(mid_d, 4) AS mid_weight, round(bot_d, 4) AS bottom_weight, round(nesw, 4) AS diag_ne_sw, round(nwse, 4) AS diag_nw_se, round(curve, 4) AS curve_score, round(corner, 4) AS corner_score FROM k")
plan("shape_axes", f"WITH {_STATS}, x AS (SELECT vec_id, 'density' AS axis, d AS value FROM k UNION ALL SELECT vec_id, 'curve', curve FROM k UNION ALL SELECT vec_id, 'corner', corner FROM k) SELECT axis, vec_id, round(value, 6) AS value, CAST(row_number() OVER (PARTITION BY axis ORDER BY round(value, 6), vec_id) AS INT) AS place FROM x")
plan("shape_roles", f"WITH {_STATS}, r AS (SELECT vec_id, 'corner_lip' AS role FROM k WHERE stroke_class = 'corner' UNION ALL SELECT vec_id, 'dense_fill' FROM k WHERE round(d, 4) > 0.45 UNION ALL SELECT vec_id, 'fracture' FROM k WHERE stroke_class IN ('cross', 'diagonal') UNION ALL SELECT vec_id, 'grass_top' FROM k WHERE round(curve, 4) >= 0.35 AND round(top_d, 4) >= 0.12 UNION ALL SELECT vec_id, 'rock_face' FROM k WHERE stroke_class IN ('vertical', 'diagonal') OR greatest(round(nesw, 4), round(nwse, 4)) >= 0.30 UNION ALL SELECT vec_id, 'sparse_detail' FROM k WHERE round(d, 4) < 0.18) SELECT vec_id, $cat(role; ','; role$) AS roles FROM r GROUP BY vec_id")
# Weighted densities of six regions
plan(
    "shape6",
    """WITH @pix, c AS (SELECT * FROM (VALUES (0, 0.25, 0.167), (1, 0.75, 0.167), (2, 0.25, 0.5), (3, 0.75, 0.5), (4, 0.25, 0.833), (5, 0.75, 0.833)) t(region, cx, cy)),
w AS (SELECT vec_id, region, v, 1.0 - (power((x - cx * 7) / 1.76, 2) + power((y - cy * 7) / 1.44, 2)) AS w FROM pix CROSS JOIN c) SELECT vec_id, CAST(region AS INT) AS region, round(sum(v * w) / sum(w), 4) AS density FROM w WHERE w >= 0 GROUP BY vec_id, region""",
)
# Heading of the ink, its radial profile, and which shapes are simple
_HEAD = """@pix, c AS (SELECT vec_id, label, CAST(sum(v) AS INT) AS ink, avg(CAST(CASE WHEN v = 1 THEN x END AS DOUBLE)) - 3.5 AS dx, avg(CAST(CASE WHEN v = 1 THEN y END AS DOUBLE)) - 3.5 AS dy FROM pix GROUP BY vec_id, label HAVING sum(v) > 0),
h AS (SELECT vec_id, label, ink, sqrt(dx * dx + dy * dy) / 4.0 AS mag, (CAST(%RINT%(atan2(dx, -dy) / (pi() / 4.0)) AS INT) + 8) % 8 AS bin FROM c)"""
_RING = """r AS (SELECT vec_id, least(3, CAST(floor(sqrt(power(x - 3.5, 2) + power(y - 3.5, 2)) / ((sqrt(2.0) * 4.0 + 1e-6) / 4)) AS INT)) AS ring, v FROM pix), t AS (SELECT vec_id, ring, sum(v) AS n, sum(sum(v)) OVER (PARTITION BY vec_id) AS total FROM r GROUP BY vec_id, ring),
p AS (SELECT vec_id, concat($cat(CAST(least(4, CAST(floor(n * 1.0 / total * 5) AS INT)) AS VARCHAR(9)); ''; ring$), '-', CAST(least(9, CAST(floor(max(total) / 64.0 * 10) AS INT)) AS VARCHAR(9))) AS profile FROM t WHERE total > 0 GROUP BY vec_id)"""


def _rint(name: str, body: str) -> None:
    # DuckDB's atan2(0, -0) is pi, Spark's is 0: balanced ink heads to bin 4
    spark = body.replace("%RINT%(atan2(dx, -dy) / (pi() / 4.0))", "CASE WHEN dx = 0 AND dy = 0 THEN 4 ELSE rint(atan2(dx, -dy) / (pi() / 4.0)) END")
    plan(name, spark, body.replace("%RINT%(atan2(dx, -dy) / (pi() / 4.0))", "round_even(atan2(dx, -dy) / (pi() / 4.0), 0)"))


_rint("heading8", f"WITH {_HEAD} SELECT vec_id, ink, round(mag, 6) AS magnitude, CAST(bin AS INT) AS bin FROM h")
plan("radial_profile", f"WITH @pix, {_RING} SELECT vec_id, profile FROM p")
# A6 (best shape for each heading of a profile)
_rint("heading_families", f"WITH {_HEAD}, {_RING}, k AS (SELECT h.vec_id, profile, bin, mag, row_number() OVER (PARTITION BY profile, bin ORDER BY mag DESC, h.vec_id) AS rk, ink FROM h JOIN p ON h.vec_id = p.vec_id WHERE mag >= 0.02 AND ink BETWEEN 16 AND 48), f AS (SELECT *, count(*) OVER (PARTITION BY profile) AS frames FROM k WHERE rk = 1) SELECT profile, CAST(bin AS INT) AS bin, vec_id, round(mag, 6) AS magnitude, frames FROM f WHERE frames >= 3")

# Extents, contacts, runs and incidence on the border
plan("ink_extents", "WITH @pix SELECT vec_id, CAST(min(y) AS INT) AS top, CAST(max(y) AS INT) AS bottom, CAST(min(x) AS INT) AS left_x, CAST(max(x) AS INT) AS right_x FROM pix WHERE v = 1 GROUP BY vec_id")
_SIDES = "s AS (SELECT vec_id, 'top' AS side, x AS p, v FROM pix WHERE y = 0 UNION ALL SELECT vec_id, 'bottom', x, v FROM pix WHERE y = 7 UNION ALL SELECT vec_id, 'left', y, v FROM pix WHERE x = 0 UNION ALL SELECT vec_id, 'right', y, v FROM pix WHERE x = 7)"
plan("edge_occupancy", f"WITH @pix, {_SIDES} SELECT vec_id, side, $cat(CAST(v AS VARCHAR(1)); ''; p$) AS occupied FROM s GROUP BY vec_id, side")
plan("edge_runs", f"WITH @pix, {_SIDES}, i AS (SELECT *, p - row_number() OVER (PARTITION BY vec_id, side ORDER BY p) AS island FROM s WHERE v = 1) SELECT vec_id, side, CAST(min(p) AS INT) AS start, CAST(max(p) + 1 AS INT) AS stop FROM i GROUP BY vec_id, side, island")
plan("edge_span", f"WITH @pix, {_SIDES} SELECT vec_id, side, CAST(min(p) AS INT) AS start, CAST(max(p) + 1 AS INT) AS stop FROM s WHERE v = 1 GROUP BY vec_id, side")
plan("border_incidence", f"WITH @pix, {_SIDES}, t AS (SELECT vec_id, max(CASE WHEN side = 'top' THEN v ELSE 0 END) AS t, max(CASE WHEN side = 'bottom' THEN v ELSE 0 END) AS b, max(CASE WHEN side = 'left' THEN v ELSE 0 END) AS l, max(CASE WHEN side = 'right' THEN v ELSE 0 END) AS r FROM s GROUP BY vec_id) SELECT vec_id, CASE WHEN t + b = 2 AND l + r = 2 THEN 'both' WHEN t + b = 2 THEN 'through_v' WHEN l + r = 2 THEN 'through_h' WHEN t + b + l + r = 0 THEN 'floating' ELSE 'terminal' END AS incidence FROM t")
plan("edge_masks", "WITH @cells SELECT vec_id, m_top, m_bottom, m_left, m_right, b_top, b_bottom, b_left, b_right FROM cells")
