"""Seams, runs, families and combinations of shapes.

Masks of an edge have 256 values, so set-similarity joins go over distinct masks first and then by equality: the
quadratic part doesn't grow with the shapes. Samples within a quota go by a hash of the pair.
"""

from quern.plans import marks, meeting
from quern.plans.dialect import MADE, _text, plan
from quern.registry import query

# Exit masks of A against entry masks of B, Jaccard similarity of at least a half
_JOIN = """{cells}, ma AS (SELECT DISTINCT {a} AS ma FROM cells WHERE {a} <> 0), mb AS (SELECT DISTINCT {b} AS mb FROM cells WHERE {b} <> 0),
jm AS (SELECT ma, mb, CAST(bit_count(ma & mb) AS DOUBLE) / bit_count(ma | mb) AS j FROM ma CROSS JOIN mb WHERE 2 * bit_count(ma & mb) >= bit_count(ma | mb)),
pairs AS (SELECT a.vec_id AS ia, b.vec_id AS ib, j, CAST(7 - a.{end} + b.{start} AS INT) AS gap FROM cells a JOIN jm ON a.{a} = jm.ma JOIN cells b ON b.{b} = jm.mb {where})"""
PORT = _JOIN.format(cells="@cells", a="m_bottom", b="m_top", end="i_bottom", start="i_top", where="")
BAND = _JOIN.format(cells="@cells", a="b_bottom", b="b_top", end="i_bottom", start="i_top", where="WHERE 7 - a.i_bottom + b.i_top <= 4")
BESIDE = _JOIN.format(cells="@cells", a="m_right", b="m_left", end="i_right", start="i_left", where="")
plan("seam_port_join", meeting.partners("m_bottom", "m_top", "i_bottom", "i_top", "best, least_gap,"), f"WITH {PORT} SELECT ia, count(*) AS partners, round(max(j), 6) AS best, round(avg(j), 6) AS mean, CAST(min(gap) AS INT) AS least_gap FROM pairs GROUP BY ia")
plan("seam_beside_join", meeting.partners("m_right", "m_left", "i_right", "i_left"), f"WITH {BESIDE} SELECT ia, count(*) AS partners, round(avg(j), 6) AS mean FROM pairs GROUP BY ia")
plan("seam_band_join", meeting.gaps("b_bottom", "b_top", "i_bottom", "i_top", "7 - at + sb <= 4"), f"WITH {BAND} SELECT gap, count(*) AS n, round(avg(j), 6) AS mean FROM pairs GROUP BY gap")
# Size of a join without its rows
plan(
    "seam_join_size",
    f"""WITH @cells, a AS (SELECT b_bottom AS ma, 7 - i_bottom AS da, count(*) AS na FROM cells WHERE b_bottom <> 0 GROUP BY 1, 2), b AS (SELECT b_top AS mb, i_top AS db, count(*) AS nb FROM cells WHERE b_top <> 0 GROUP BY 1, 2)
SELECT 'band' AS kind, CAST(sum(na * nb) AS BIGINT) AS pairs FROM a JOIN b ON 2 * bit_count(ma & mb) >= bit_count(ma | mb) AND da + db <= 4""",
)
# Half of a quota goes to the best by similarity and gap, the other half to those that a hash of the pair picks; port before band
_DRAW = "sha2(concat(CAST(ia AS VARCHAR(20)), '-', CAST(ib AS VARCHAR(20))), 256)"
_HALVES = "k AS (SELECT *, row_number() OVER (%PART%ORDER BY j DESC, gap, ia, ib) AS rk FROM {src}), h AS (SELECT *, row_number() OVER (%PART%ORDER BY CASE WHEN rk <= {half} THEN 0 ELSE 1 END, CASE WHEN rk > {half} THEN %DRAW% END, rk) AS place FROM k)"


def _drawn(name: str, run, text: str) -> None:
    sql = _text(text.replace("%DRAW%", _DRAW.replace("sha2(", "sha256(").replace(", 256)", ")")), 1)
    query(name, sql.replace("{embeddings}", "embeddings"))(run)


_drawn("seam_capped", meeting.capped, f"WITH {PORT}, " + _HALVES.format(src="pairs", half=6).replace("%PART%", "PARTITION BY ia ") + " SELECT ia, ib, round(j, 6) AS j, gap, rk <= 6 AS best FROM h WHERE place <= 12")
_NEAR_BAND = "band AS (SELECT a.vec_id AS ia, b.vec_id AS ib, CAST(bit_count(a.b_bottom & b.b_top) AS DOUBLE) / bit_count(a.b_bottom | b.b_top) AS j, CAST(7 - a.i_bottom + b.i_top AS INT) AS gap FROM cells a JOIN cells b ON a.label = b.label AND a.b_bottom <> 0 AND b.b_top <> 0 AND 7 - a.i_bottom + b.i_top <= 1 AND 10 * bit_count(a.b_bottom & b.b_top) >= 9 * bit_count(a.b_bottom | b.b_top))"
_MERGED = f"{PORT}, {_NEAR_BAND}, u AS (SELECT ia, ib, j, gap, 0 AS kind FROM pairs WHERE j >= 0.9 UNION ALL SELECT ia, ib, j, gap, 1 FROM band), m AS (SELECT *, row_number() OVER (PARTITION BY ia, ib ORDER BY j DESC, kind) AS rm FROM u), one AS (SELECT ia, ib, j, gap, kind FROM m WHERE rm = 1)"
# the best half by a limit, then the other one by a limit of what is left: no window over all pairs
_CAP = "head AS (SELECT * FROM one ORDER BY j DESC, gap, ia, ib LIMIT 150), tail AS (SELECT o.* FROM one o LEFT JOIN head h ON o.ia = h.ia AND o.ib = h.ib WHERE h.ia IS NULL), drawn AS (SELECT * FROM tail ORDER BY %DRAW%, ia, ib LIMIT 150), both AS (SELECT *, TRUE AS best FROM head UNION ALL SELECT *, FALSE FROM drawn)".replace("both", "capped")
_drawn("seam_merged", meeting.merged, f"WITH {_MERGED}, {_CAP} SELECT ia, ib, round(j, 6) AS j, CASE WHEN kind = 0 THEN 'port' ELSE 'band' END AS kind, best FROM capped")
# Composites of a shape over the next one of its block, their gaps and ports
_NEXT = f"@cells, pr AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM cells)"
plan("seam_gap_profile", f"WITH {_NEXT}, lo AS (SELECT vec_id, x, max(CASE WHEN v = 1 THEN y END) AS last_y, min(CASE WHEN v = 1 THEN y END) AS first_y FROM pix GROUP BY vec_id, x), g AS (SELECT pr.a, pr.b, lo.x, 7 - lo.last_y + hi.first_y AS gap FROM pr JOIN lo ON lo.vec_id = pr.a JOIN lo hi ON hi.vec_id = pr.b AND hi.x = lo.x) SELECT a, b, CAST(min(gap) AS INT) AS least, CAST(max(gap) AS INT) AS most, count(gap) AS lines, round(CAST(median(gap) AS DOUBLE), 6) AS middle, min(gap) = 0 AS connected FROM g GROUP BY a, b")
plan("port_overlap", f"WITH {_NEXT} SELECT a, b, round(CASE WHEN bit_count(x.m_bottom | y.m_top) = 0 THEN 0.0 ELSE CAST(bit_count(x.m_bottom & y.m_top) AS DOUBLE) / bit_count(x.m_bottom | y.m_top) END, 6) AS port FROM pr JOIN cells x ON x.vec_id = a JOIN cells y ON y.vec_id = b")
plan("stacked_composite", f"WITH {_NEXT}, g AS (SELECT a, b, y, x, v FROM pr JOIN pix ON vec_id = a WHERE b IS NOT NULL UNION ALL SELECT a, b, y + 8, x, v FROM pr JOIN pix ON vec_id = b) SELECT a, b, $cat(CAST(v AS VARCHAR(1)); ''; y * 8 + x$) AS grid FROM g GROUP BY a, b")
plan("half_block_rows", "WITH @pix SELECT a.vec_id, CAST(a.y / 2 AS INT) AS line, $cat(CASE WHEN a.v = 1 AND b.v = 1 THEN '#' WHEN a.v = 1 THEN 'u' WHEN b.v = 1 THEN 'l' ELSE '.' END; ''; a.x$) AS packed FROM pix a JOIN pix b ON a.vec_id = b.vec_id AND a.x = b.x AND b.y = a.y + 1 WHERE a.y % 2 = 0 GROUP BY a.vec_id, a.y")

# Run edges within a block
# Each rule joins by equality within a block: the entry margins that an exit still reaches, rounded centroids, bins of 15 degrees on a
# circle of 180, and the extents (36 at most) that one end parts.
_SHARED, _TURN = "least(a.c1, b.c1) >= greatest(a.c0, b.c0)", "least(abs(a.dom - b.dom), 180 - abs(a.dom - b.dom))"
_ENDS = "least(abs(x.c0 - y.c0), abs(x.c1 - y.c1), abs(x.c0 - y.c1), abs(x.c1 - y.c0))"
EDGES = f"""@node,
reach AS (SELECT o.*, margin FROM (SELECT * FROM node WHERE a1 >= 3) o $each(0; a1 - 3; margin$)),
contact AS (SELECT a.id AS src, b.id AS dst, 'contact' AS rule, CAST(7 - a.a1 + b.a0 AS DOUBLE) + 1.0 - CASE WHEN a.b_right <> 0 AND b.b_left <> 0 THEN CAST(bit_count(a.b_right & b.b_left) AS DOUBLE) / bit_count(a.b_right | b.b_left) ELSE 0.0 END AS cost FROM reach a JOIN node b ON a.label = b.label AND b.a0 = a.margin WHERE a.id <> b.id AND {_SHARED}),
rep AS (SELECT id AS src, id AS dst, 'repeat' AS rule, CAST(0.5 AS DOUBLE) AS cost FROM node),
low AS (SELECT *, CAST(round(cen) AS INT) AS height FROM node WHERE size <= 5),
lows AS (SELECT o.*, level FROM low o $each(round(cen - 1); round(cen + 1); level$)),
step AS (SELECT a.id AS src, b.id AS dst, 'step' AS rule, CAST(0.5 AS DOUBLE) AS cost FROM lows a JOIN low b ON a.label = b.label AND b.height = a.level WHERE a.id <> b.id AND abs(a.cen - b.cen) <= 1),
facing AS (SELECT *, CAST(floor(dom / 15) AS INT) % 12 AS bin FROM node WHERE size >= 4),
faces AS (SELECT o.*, (bin + 12 + way) % 12 AS towards FROM facing o $each(-3; 3; way$)),
turn AS (SELECT a.id AS src, b.id AS dst, 'turn' AS rule, 1.0 + {_TURN} / 45 AS cost FROM faces a JOIN facing b ON a.label = b.label AND b.bin = a.towards WHERE a.id <> b.id AND {_TURN} <= 45 AND {_SHARED}),
extent AS (SELECT DISTINCT c0, c1, size FROM node),
parted AS (SELECT x.c0 AS p0, x.c1 AS p1, y.c0 AS q0, y.c1 AS q1, {_ENDS} AS far FROM extent x CROSS JOIN extent y WHERE least(x.c1, y.c1) < greatest(x.c0, y.c0) AND greatest(x.size, y.size) > 5 AND {_ENDS} <= 4),
tall AS (SELECT o.*, q0, q1, far FROM node o JOIN parted ON o.c0 = p0 AND o.c1 = p1),
ends AS (SELECT a.id AS src, b.id AS dst, 'end' AS rule, 1.0 + a.far / CAST(4 AS DOUBLE) AS cost FROM tall a JOIN node b ON a.label = b.label AND b.c0 = a.q0 AND b.c1 = a.q1),
edges AS (SELECT * FROM contact UNION ALL SELECT * FROM rep UNION ALL SELECT * FROM step UNION ALL SELECT * FROM turn UNION ALL SELECT * FROM ends)"""
# Spark counts classes of equal marks instead of pairs, less each mark with itself (at its own cost); turns are counted in order
_TOUCH = "CAST(7 - a.a1 + b.a0 AS DOUBLE) + 1.0 - CASE WHEN a.b_right <> 0 AND b.b_left <> 0 THEN CAST(bit_count(a.b_right & b.b_left) AS DOUBLE) / bit_count(a.b_right | b.b_left) ELSE 0.0 END"
_CLASSES = f"""node AS (SELECT * FROM {{marks}}), rows AS (SELECT label, a0, a1, c0, c1, b_right, b_left, count(*) AS n FROM node GROUP BY ALL),
exits AS (SELECT label, a1, b_right, c0, c1, sum(n) AS n FROM rows WHERE a1 >= 3 GROUP BY ALL), entries AS (SELECT label, a0, b_left, c0, c1, sum(n) AS n FROM rows GROUP BY ALL),
reach AS (SELECT o.*, margin FROM exits o $each(0; a1 - 3; margin$)),
met AS (SELECT a.n * b.n AS n, {_TOUCH} AS cost FROM reach a JOIN entries b ON a.label = b.label AND b.a0 = a.margin AND {_SHARED} UNION ALL SELECT -a.n, {_TOUCH.replace("b.", "a.")} FROM rows a WHERE a0 <= a1 - 3 AND label IS NOT NULL),
contact AS (SELECT 'contact' AS rule, sum(n) AS n, cost FROM met GROUP BY cost),
low AS (SELECT label, cen, CAST(round(cen) AS INT) AS height, count(*) AS n FROM node WHERE size <= 5 GROUP BY ALL),
lows AS (SELECT o.*, level FROM low o $each(round(cen - 1); round(cen + 1); level$)),
step AS (SELECT 'step' AS rule, a.n * b.n - CASE WHEN a.cen = b.cen THEN a.n ELSE 0 END AS n, CAST(0.5 AS DOUBLE) AS cost FROM lows a JOIN low b ON a.label = b.label AND b.height = a.level WHERE abs(a.cen - b.cen) <= 1),
spans AS (SELECT label, c0, c1, count(*) AS n FROM node GROUP BY ALL),
extent AS (SELECT DISTINCT c0, c1, c1 - c0 + 1 AS size FROM spans),
parted AS (SELECT x.c0 AS p0, x.c1 AS p1, y.c0 AS q0, y.c1 AS q1, {_ENDS} AS far FROM extent x CROSS JOIN extent y WHERE least(x.c1, y.c1) < greatest(x.c0, y.c0) AND greatest(x.size, y.size) > 5 AND {_ENDS} <= 4),
tall AS (SELECT o.*, q0, q1, far FROM spans o JOIN parted ON o.c0 = p0 AND o.c1 = p1),
ends AS (SELECT 'end' AS rule, a.n * b.n AS n, 1.0 + a.far / CAST(4 AS DOUBLE) AS cost FROM tall a JOIN spans b ON a.label = b.label AND b.c0 = a.q0 AND b.c1 = a.q1),
classes AS (SELECT rule, n, cost FROM contact UNION ALL SELECT rule, n, cost FROM step UNION ALL SELECT rule, n, cost FROM ends UNION ALL SELECT 'repeat', count(*), CAST(0.5 AS DOUBLE) FROM node),
parts AS (SELECT rule, n, cost AS least, cost AS most, n * cost AS total FROM classes WHERE n > 0 UNION ALL SELECT 'turn', n, least, most, total FROM {{turn_sums}})"""
MADE |= {"marks": marks.marks_written, "turn_sums": marks.turn_sums, "kept": marks.kept, "kept_written": marks.kept_written}
plan("run_edges", f"WITH {_CLASSES} SELECT rule, CAST(sum(n) AS BIGINT) AS n, round(min(least), 6) AS least, round(max(most), 6) AS most, round(sum(total) / sum(n), 6) AS mean FROM parts GROUP BY rule", f"WITH {EDGES} SELECT rule, count(*) AS n, round(min(cost), 6) AS least, round(max(cost), 6) AS most, round(avg(cost), 6) AS mean FROM edges GROUP BY rule")
_QUOTA = f"{EDGES}, b AS (SELECT *, floor(cost) AS bucket FROM edges), r1 AS (SELECT *, row_number() OVER (PARTITION BY src, rule, bucket ORDER BY cost, dst) AS rb, row_number() OVER (PARTITION BY src, rule ORDER BY cost, dst) AS ra FROM b), nb AS (SELECT src, rule, greatest(1, CAST(floor(3.0 / count(DISTINCT bucket)) AS INT)) AS quota FROM b GROUP BY src, rule), o AS (SELECT r1.*, row_number() OVER (PARTITION BY r1.src, r1.rule ORDER BY CASE WHEN rb <= quota THEN 0 ELSE 1 END, ra) AS place FROM r1 JOIN nb ON r1.src = nb.src AND r1.rule = nb.rule), kept AS (SELECT src, dst, rule, cost FROM o WHERE place <= 3)"
_ROUNDED = "SELECT src, dst, rule, round(cost, 6) AS cost FROM"
plan("run_edge_quota", f"{_ROUNDED} {{kept}}", f"WITH {_QUOTA} {_ROUNDED} kept")
# Coherent paths of three marks, a quota for each start and mix of rules
_GOES = "(e.src <> e.dst OR e.rule = 'repeat') AND (f.src <> f.dst OR f.rule = 'repeat')"
_P3 = "p3 AS (SELECT e.src AS s, e.dst AS m, f.dst AS t, e.rule AS r1, f.rule AS r2, (e.cost + f.cost) / 2 AS mean,"
_RANKED = """mix AS (SELECT *, concat(least(r1, r2), CASE WHEN r1 <> r2 THEN concat('+', greatest(r1, r2)) ELSE '' END) AS rules FROM p3),
k AS (SELECT *, row_number() OVER (PARTITION BY s, rules ORDER BY mean, m, t, r1, r2) AS rk FROM mix)"""
_WALK = f"""{_QUOTA}, {_P3} x.cen AS z0, y.cen AS z1, w.cen AS z2 FROM kept e JOIN kept f ON e.dst = f.src JOIN node x ON x.id = e.src JOIN node y ON y.id = e.dst JOIN node w ON w.id = f.dst WHERE {_GOES}),
{_RANKED}"""
_KEPT_WALK = f"""{_P3} e.z_src AS z0, e.z_dst AS z1, f.z_dst AS z2 FROM {{kept_written}} e JOIN {{kept_written}} f ON e.dst = f.src WHERE {_GOES}),
{_RANKED}"""
_PATHS = " SELECT s, m, t, r1, r2, round(mean, 6) AS mean, CASE WHEN abs(z1 - z0) < 0.75 AND abs(z2 - z1) < 0.75 THEN 'flat' WHEN z1 - z0 >= 0.75 AND z2 - z1 <= -0.75 THEN 'cup' WHEN z1 - z0 <= -0.75 AND z2 - z1 >= 0.75 THEN 'cap' WHEN z2 > z0 THEN 'falling' ELSE 'rising' END AS profile FROM k WHERE rk <= 2"
plan("run_paths", f"WITH {_KEPT_WALK}{_PATHS}", f"WITH {_WALK}{_PATHS}")
# Paths with the same marks are one run; a quota for each length, the longest first
_COLLAPSED = ", g AS (SELECT least(s, m, t) AS lo, greatest(s, m, t) AS hi, s + m + t AS total, count(*) AS members, min(mean) AS best FROM k WHERE rk <= 2 GROUP BY 1, 2, 3) SELECT lo, hi, total, members, round(best, 6) AS best FROM g WHERE members >= 2"
plan("run_collapse", f"WITH {_KEPT_WALK}{_COLLAPSED}", f"WITH {_WALK}{_COLLAPSED}")
_DIVERSE = "r AS (SELECT 2 AS length, src AS s, dst AS t, cost AS score FROM kept UNION ALL SELECT 3, e.src, f.dst, e.cost + f.cost FROM kept e JOIN kept f ON e.dst = f.src AND e.rule = 'turn' AND f.rule = 'contact'), k AS (SELECT length, s, t, min(score) AS score FROM r GROUP BY length, s, t), q AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY score, s, t) AS rl FROM k), best AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rl <= 20 THEN 0 ELSE 1 END, length DESC, score, s, t) AS place FROM q WHERE rl <= 60) SELECT CAST(length AS INT) AS length, s, t, round(score, 6) AS score FROM best WHERE place <= 60"
plan("topk_length_diverse", f"WITH kept AS (SELECT * FROM {{kept_written}}), {_DIVERSE}", f"WITH {_QUOTA}, {_DIVERSE}")

# A5, and coarse forms of A3, J14 and A2's buckets; the families of whole rasters and A2's components are functions in objects.py
_COARSE = "@pix, co AS (SELECT vec_id, label, CAST(floor(y / 4) AS INT) AS y, CAST(floor(x / 4) AS INT) AS x, CASE WHEN sum(v) >= 8 THEN 1 ELSE 0 END AS v FROM pix GROUP BY vec_id, label, floor(y / 4), floor(x / 4)), g AS (SELECT vec_id, label, max(CASE WHEN y = 0 AND x = 0 THEN v END) AS a, max(CASE WHEN y = 0 AND x = 1 THEN v END) AS b, max(CASE WHEN y = 1 AND x = 0 THEN v END) AS c, max(CASE WHEN y = 1 AND x = 1 THEN v END) AS d FROM co GROUP BY vec_id, label)"
plan("spin_orbits", f"WITH {_COARSE}, t AS (SELECT vec_id, label, concat(a, b, c, d) AS f0, concat(b, d, a, c) AS f1, concat(d, c, b, a) AS f2, concat(c, a, d, b) AS f3 FROM g), k AS (SELECT vec_id, label, f0, least(f0, f1, f2, f3) AS key, CASE least(f0, f1, f2, f3) WHEN f0 THEN 0 WHEN f1 THEN 1 WHEN f2 THEN 2 ELSE 3 END AS phase FROM t), u AS (SELECT label, key, f0, phase, min(vec_id) AS vec_id FROM k GROUP BY label, key, f0, phase), n AS (SELECT *, count(*) OVER (PARTITION BY label, key) AS frames FROM u) SELECT label, key, CAST(phase AS INT) AS phase, vec_id, frames FROM n WHERE frames >= 3")
plan("mirror_pairs", f"WITH {_COARSE}, k AS (SELECT vec_id, label, concat(a, b, c, d) AS own, concat(b, a, d, c) AS mirrored FROM g), f AS (SELECT label, own, mirrored, min(vec_id) AS vec_id FROM k GROUP BY label, own, mirrored) SELECT a.label, least(a.vec_id, b.vec_id) AS lo, greatest(a.vec_id, b.vec_id) AS hi FROM f a JOIN f b ON a.label = b.label AND a.mirrored = b.own AND a.own < b.own")
plan("zoning_buckets", "WITH @pix, z AS (SELECT vec_id, label, floor(y / 4) * 2 + floor(x / 4) AS zone, least(2, CAST(floor(avg(CAST(v AS DOUBLE)) * 3) AS INT)) AS q FROM pix GROUP BY vec_id, label, floor(y / 4), floor(x / 4)), k AS (SELECT vec_id, label, $cat(CAST(q AS VARCHAR(2)); ''; zone$) AS bucket FROM z GROUP BY vec_id, label) SELECT label, bucket, count(*) AS size, min(vec_id) AS least FROM k GROUP BY label, bucket HAVING count(*) >= 2")

#: Letters and decimal digits among the first code points, which shapes have as their ids; and the first letters beyond.
_ALNUM = "(i.vec_id BETWEEN 48 AND 57 OR i.vec_id BETWEEN 65 AND 90 OR i.vec_id BETWEEN 97 AND 122 OR i.vec_id IN (170, 181, 186) OR i.vec_id BETWEEN 192 AND 705 AND i.vec_id NOT IN (215, 247) OR i.vec_id BETWEEN 880 AND 1791 OR i.vec_id BETWEEN 2304 AND 8191 OR i.vec_id BETWEEN 12353 AND 42191 OR i.vec_id BETWEEN 44032 AND 55203)"
# Distraction of glyphs within their block
_MED = "@pix, i AS (SELECT vec_id, label, CAST(sum(v) AS INT) AS ink, sum(v) / CAST(64 AS DOUBLE) AS density FROM pix GROUP BY vec_id, label), m AS (SELECT label, median(density) AS med FROM i GROUP BY label)"
plan("block_median_density", f"WITH {_MED} SELECT label, round(med, 6) AS median_density FROM m")
_DIS = f"{_MED}, @parts, t AS (SELECT i.*, med, CASE WHEN {_ALNUM} THEN CAST(0.55 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS alnum, CAST(0.25 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), density / CAST(0.5 AS DOUBLE)) AS ink_term, CAST(0.1 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), greatest(parts.parts - 1, 0) / CAST(6.0 AS DOUBLE)) AS part_term, CAST(0.1 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), greatest(CAST(0.0 AS DOUBLE), density - med) / greatest(med, 1 / CAST(64 AS DOUBLE))) AS contrast FROM i JOIN m ON i.label = m.label JOIN parts ON i.vec_id = parts.vec_id), w AS (SELECT *, round(CAST(alnum AS DOUBLE) + ink_term + CAST(part_term AS DOUBLE) + contrast, 6) AS weight FROM t)"
plan("distraction_rank", f"WITH {_DIS} SELECT vec_id, label, weight, CAST(row_number() OVER (ORDER BY weight DESC, vec_id) AS INT) AS place FROM (SELECT * FROM w ORDER BY weight DESC, vec_id LIMIT 40) t")
plan("distraction_quietest", f"WITH {_DIS} SELECT vec_id, label, weight FROM w ORDER BY weight, vec_id LIMIT 40")
_FLAGS = "WITH @chars SELECT ch, CASE WHEN ch IN ('o', 'O', 'v', 'T', 'l', '7') THEN 'whitelist' WHEN ch IN ('u', 'c', 'C', 'x') THEN 'marginal' WHEN %LIKE% THEN 'alnum' ELSE '' END AS flag FROM (SELECT DISTINCT ch FROM chars) c"
plan("distract_flags", _FLAGS.replace("%LIKE%", "regexp_like(ch, '^[\\\\p{L}\\\\p{Nd}]$')"), _FLAGS.replace("%LIKE%", "regexp_matches(ch, '^[\\p{L}\\p{Nd}]$')"))
# Ids of admitted shapes, new ones in order of first use
plan("export_ids", "WITH adm AS (SELECT s_suppkey AS id FROM {supplier}), f AS (SELECT label AS family, vec_id AS cp, row_number() OVER (ORDER BY label, vec_id) AS used FROM {embeddings}), j AS (SELECT f.*, adm.id FROM f LEFT JOIN adm ON f.cp = adm.id), n AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN id IS NULL THEN 1 ELSE 0 END ORDER BY used) AS fresh FROM j) SELECT family, cp, coalesce(id, (SELECT max(id) FROM adm) + fresh) AS glyph_id, id IS NOT NULL AS admitted FROM n")
plan("admitted_latest", "WITH f AS (SELECT o_custkey AS scalar_value, o_orderkey AS file_no, o_totalprice AS price FROM {orders}), k AS (SELECT *, row_number() OVER (PARTITION BY scalar_value ORDER BY file_no DESC) AS rk FROM f) SELECT scalar_value, file_no, price FROM k WHERE rk = 1")

# Exhaustive combinations of an alphabet over shapes of two and three cells
_ABC = "abc AS (SELECT * FROM (VALUES (0,'-'),(1,'/'),(2,'|'),(3,'\\\\'),(4,'('),(5,')'),(6,'_'),(7,'`'),(8,''''),(9,'.'),(10,','),(11,':'),(12,';'),(13,'<'),(14,'>'),(15,'='),(16,'+'),(17,'*'),(18,'#'),(19,'%'),(20,'o'),(21,'v'),(22,'l'),(23,'T'),(24,'7'),(25,'O'),(26,'^'),(27,'~'),(28,'\"')) t(i, ch))"
_ABC_DUCK = _ABC.replace("'\\\\'", "'\\'")
_MIRROR = "CASE ch WHEN '/' THEN '<bs>' WHEN '<bs>' THEN '/' WHEN '(' THEN ')' WHEN ')' THEN '(' WHEN '<' THEN '>' WHEN '>' THEN '<' ELSE ch END"
_COMBO = "{abc}, m AS (SELECT i, ch, {mirror} AS mi FROM abc), two AS (SELECT s.shape, a.i * 29 + b.i AS code, concat(a.ch, b.ch) AS chars, CASE WHEN s.shape = 'line_h' THEN concat(b.mi, a.mi) ELSE concat(a.mi, b.mi) END AS mirrored FROM m a CROSS JOIN m b CROSS JOIN (VALUES ('line_h'), ('line_v')) s(shape)), three AS (SELECT s.shape, (a.i * 29 + b.i) * 29 + c.i AS code, concat(a.ch, b.ch, c.ch) AS chars, CASE WHEN s.shape = 'line_h3' THEN concat(c.mi, b.mi, a.mi) ELSE concat(a.mi, b.mi, c.mi) END AS mirrored FROM m a CROSS JOIN m b CROSS JOIN m c CROSS JOIN (VALUES ('line_h3'), ('line_v3'), ('el_tl'), ('el_tr'), ('el_bl'), ('el_br')) s(shape)), combos AS (SELECT * FROM two UNION ALL SELECT * FROM three)"
_S = _COMBO.format(abc=_ABC, mirror=_MIRROR.replace("<bs>", "\\\\"))
_D = _COMBO.format(abc=_ABC_DUCK, mirror=_MIRROR.replace("<bs>", "\\"))
plan("combo_enumerate", f"WITH {_S} SELECT shape, count(*) AS n, CAST(sum(code) AS BIGINT) AS codes, count(DISTINCT chars) AS texts FROM combos GROUP BY shape", f"WITH {_D} SELECT shape, count(*) AS n, sum(code)::BIGINT AS codes, count(DISTINCT chars) AS texts FROM combos GROUP BY shape")
plan("combo_mirror", f"WITH {_S} SELECT shape, count(*) AS n, count(*) FILTER (WHERE chars = mirrored) AS self_symmetric FROM combos GROUP BY shape", f"WITH {_D} SELECT shape, count(*) AS n, count(*) FILTER (WHERE chars = mirrored) AS self_symmetric FROM combos GROUP BY shape")
plan("combo_adjacency", "WITH c AS (SELECT * FROM (VALUES ('line_h', 0, 0, 0), ('line_h', 1, 1, 0), ('el_tl', 0, 0, 0), ('el_tl', 1, 1, 0), ('el_tl', 2, 0, 1), ('line_v', 0, 0, 0), ('line_v', 1, 0, 1)) t(shape, idx, col, ln)) SELECT a.shape, a.idx AS a, b.idx AS b, CASE WHEN b.col = a.col + 1 THEN 'beside' ELSE 'stacked' END AS relation FROM c a JOIN c b ON a.shape = b.shape AND ((b.col = a.col + 1 AND b.ln = a.ln) OR (b.col = a.col AND b.ln = a.ln + 1))")
# Pairs are measured once, by the rows that both shapes have ink in, and joined back to the combinations; a pair without such a row has no gap
_GAPS = "edge AS (SELECT vec_id, y, max(CASE WHEN v = 1 THEN x END) AS last_x, min(CASE WHEN v = 1 THEN x END) AS first_x FROM pix WHERE vec_id < 29 GROUP BY vec_id, y), d AS (SELECT a.vec_id AS x, b.vec_id AS y, min(7 - a.last_x + b.first_x) AS gap FROM edge a JOIN edge b ON a.y = b.y GROUP BY a.vec_id, b.vec_id)"
_MEASURED = "j AS (SELECT code, chars, p.gap AS g1, q.gap AS g2 FROM combos JOIN d p ON p.x = %A% AND p.y = %B% JOIN d q ON q.x = %B% AND q.y = code % 29 WHERE shape = 'line_h3') SELECT coalesce(g1 = 0 AND g2 = 0, FALSE) AS connected_all, coalesce(g1 = 0, FALSE) OR coalesce(g2 = 0, FALSE) AS connected_any, count(*) AS n, round(avg(CASE WHEN g1 IS NULL THEN CAST(g2 AS DOUBLE) WHEN g2 IS NULL THEN CAST(g1 AS DOUBLE) ELSE (g1 + g2) / CAST(2 AS DOUBLE) END), 6) AS mean_gap FROM j GROUP BY 1, 2"
plan("combo_measured", f"WITH @pix, {_S}, {_GAPS}, " + _MEASURED.replace("%A%", "CAST(floor(code / 841) AS INT)").replace("%B%", "CAST(floor(code / 29) AS INT) % 29"), f"WITH @pix, {_D}, {_GAPS}, " + _MEASURED.replace("%A%", "code // 841").replace("%B%", "(code // 29) % 29"))
# Profile of a run of altitudes
plan("profile_class", "WITH @rws, p AS (SELECT vec_id, y, CAST(bit_count(bits) AS DOUBLE) AS z FROM rws), d AS (SELECT vec_id, y, z - lag(z) OVER (PARTITION BY vec_id ORDER BY y) AS d FROM p), s AS (SELECT vec_id, y, CASE WHEN abs(d) < 0.75 THEN 0 ELSE sign(d) END AS s FROM d WHERE d IS NOT NULL), n AS (SELECT vec_id, y, s, lag(s) OVER (PARTITION BY vec_id ORDER BY y) AS before FROM s WHERE s <> 0), a AS (SELECT vec_id, count(*) AS moves, count(*) FILTER (WHERE before IS NOT NULL AND before <> s) AS turns, min(y) AS first_y FROM n GROUP BY vec_id), f AS (SELECT v.vec_id, coalesce(moves, 0) AS moves, coalesce(turns, 0) AS turns, n.s AS first_s FROM (SELECT DISTINCT vec_id FROM rws) v LEFT JOIN a ON v.vec_id = a.vec_id LEFT JOIN n ON n.vec_id = a.vec_id AND n.y = a.first_y) SELECT vec_id, CASE WHEN moves = 0 THEN 'flat' WHEN turns = 0 AND first_s < 0 THEN 'rising' WHEN turns = 0 THEN 'falling' WHEN turns = 1 AND first_s < 0 THEN 'cap' WHEN turns = 1 THEN 'cup' ELSE 'wave' END AS profile FROM f")
