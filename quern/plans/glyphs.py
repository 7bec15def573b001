"""Plans over characters, plates and shapes: scripts, hatching, language spans, selections, placements, rasters of rows."""

from pyspark.sql import functions as F

from quern.plans.dialect import _text, plan
from quern.plans.shapes import _STATS
from quern.registry import query
from quern.sources import checked, scratch
from quern.sources.tables import table

# Counts by script
_SCRIPT = "CASE WHEN ascii(ch) BETWEEN 12353 AND 12438 THEN 'hiragana' WHEN ascii(ch) BETWEEN 12449 AND 12534 THEN 'katakana' WHEN ascii(ch) BETWEEN 19968 AND 40959 THEN 'kanji' ELSE 'other' END"
plan("script_counts", f"WITH @chars, c AS (SELECT stratum, ch, count(*) AS n FROM chars GROUP BY stratum, ch) SELECT stratum, {_SCRIPT} AS script, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds FROM c GROUP BY 1, 2")
# Runs of hatching. The glyphs of the three families, and the least lengths 3, 4 and 3 of the same glyph
_HATCH = r"[=≡ニ三二ﾆ]{3,}|[!I|ilｉｌ]{4,}|/{3,}|／{3,}|\\{3,}|＼{3,}"
_FAMILY = "CASE WHEN instr('=≡ニ三二ﾆ', substr(h, 1, 1)) > 0 THEN 'h' WHEN instr('!I|ilｉｌ', substr(h, 1, 1)) > 0 THEN 'v' ELSE 'd' END"
plan(
    "hatch_runs",
    "WITH @lines, m AS (SELECT page, h FROM lines LATERAL VIEW explode($all(line; '" + _HATCH.replace("\\", "\\\\") + f"'$)) t AS h) SELECT {_FAMILY} AS family, CAST(length(h) AS INT) AS size, count(*) AS n, count(DISTINCT page) AS pages FROM m GROUP BY 1, 2",
    f"WITH @lines, m AS (SELECT page, unnest($all(line; '{_HATCH}'$)) AS h FROM lines) SELECT {_FAMILY} AS family, length(h)::INT AS size, count(*) AS n, count(DISTINCT page) AS pages FROM m GROUP BY 1, 2",
)
# Spans of language: Japanese by its hiragana or by kanji and katakana, Latin words of three different letters, wide letters and digits.
# The hiragana that are usually drawn as strokes
_KINDS = {"jp": "[ぁ-ゖァ-ヶ一-鿿ー、。！？…っ]{3,}", "latin": "[A-Za-z]{3,}", "wide": "[Ａ-Ｚａ-ｚ０-９]{2,}"}
_SPAN = """kinds AS (SELECT kind, s, n, CASE kind WHEN 'wide' THEN TRUE WHEN 'latin' THEN {distinct_low} >= 3 ELSE {distinct} >= 3 AND (length({sub}(s, '[^ぁ-ゖ]|[くしつへ]', ''{g})) >= 2 OR length({sub}(s, '[^ァ-ヶ一-鿿]', ''{g})) >= 3) END AS ok FROM found)
SELECT kind, CAST(length(s) AS INT) AS size, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds FROM kinds WHERE ok GROUP BY 1, 2"""
plan(
    "language_spans",
    "WITH @lines, found AS (SELECT kind, s, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, s FROM lines LATERAL VIEW explode($all(line; '{x}'$)) t AS s" for k, x in _KINDS.items()) + ") u GROUP BY kind, s), "
    + _SPAN.format(distinct_low="size(array_distinct(split(lower(s), '')))", distinct="size(array_distinct(split(s, '')))", sub="regexp_replace", g=""),
    "WITH @lines, found AS (SELECT kind, s, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest($all(line; '{x}'$)) AS s FROM lines" for k, x in _KINDS.items()) + ") u GROUP BY kind, s), "
    + _SPAN.format(distinct_low="len(list_distinct(string_split(lower(s), '')))", distinct="len(list_distinct(string_split(s, '')))", sub="regexp_replace", g=", 'g'"),
)
# Grams of art (no '#', not all letters and digits, those only from a list) and of outline (not all of fine texture)
_ART = "instr(g, '#') = 0 AND NOT %LIKE%(g, '^[A-Za-z0-9]+$') AND NOT %LIKE%(translate(g, 'oOvTl7', ''), '[A-Za-z0-9]') AS art, NOT %LIKE%(g, '^[%*#$&|!.:;]+$') AS outline"
plan("art_grams", "WITH @bigr, c AS (SELECT g, count(*) AS n FROM bigr GROUP BY g) SELECT g, n, " + _ART.replace("%LIKE%", "regexp_like") + " FROM c", "WITH @bigr, c AS (SELECT g, count(*) AS n FROM bigr GROUP BY g) SELECT g, n, " + _ART.replace("%LIKE%", "regexp_matches") + " FROM c")
# Repertoire of a code point, the first range that has it
_REPERTOIRE = "CASE WHEN ascii(ch) < 128 THEN 'ascii' WHEN ascii(ch) < 256 THEN 'latin1' WHEN ascii(ch) < 592 THEN 'latin_extended' WHEN ascii(ch) BETWEEN 8192 AND 8303 THEN 'punctuation' WHEN ascii(ch) BETWEEN 9472 AND 9631 THEN 'box_and_block' WHEN ascii(ch) BETWEEN 12288 AND 40959 THEN 'cjk' ELSE 'other' END"
plan("repertoire", f"WITH @chars SELECT {_REPERTOIRE} AS repertoire, count(DISTINCT ch) AS glyphs, count(*) AS n FROM chars GROUP BY 1")
# selection for seams: inked, of few parts and little ink, in the allowed blocks; explicit ids go before
plan("seam_selection", f"WITH @cells, @parts, allow AS (SELECT DISTINCT label FROM cells WHERE label <> 0) SELECT c.vec_id, c.label, c.ink, CAST(p.parts AS BIGINT) AS parts FROM cells c JOIN parts p ON c.vec_id = p.vec_id JOIN allow a ON c.label = a.label WHERE p.parts <= 2 AND c.ink <= 40")
# A browser's page: the first 8192 shapes, then those of a class, in order of a measure
_SORTS = ("density", "curve", "corner", "top_d", "mid_d", "bot_d", "nesw", "nwse", "rate")
_BROWSED = f"WITH {_STATS}, page AS (SELECT *, d AS density FROM k ORDER BY vec_id LIMIT 8192), picked AS (SELECT * FROM page WHERE stroke_class IN ('block', 'cross', 'curve', 'diagonal')), s AS (" + " UNION ALL ".join(f"SELECT '{x}' AS key, vec_id, round({x}, 6) AS value FROM picked" for x in _SORTS) + ") SELECT key, vec_id, value, CAST(row_number() OVER (PARTITION BY key ORDER BY value DESC, vec_id) AS INT) AS place FROM s"
# the first ids are found before anything is measured: one task reads ids only
plan("browser_page", _BROWSED.replace("@pix", _text("@pix", 0).replace("FROM {embeddings}", "FROM (SELECT * FROM {embeddings} WHERE vec_id IN (SELECT vec_id FROM {embeddings} WHERE size(embedding) > 0 ORDER BY vec_id LIMIT 8192))"), 1), _BROWSED)
# Order of candidates: least gap first, those without one last, then by port and ink
plan("candidate_order", f"WITH @cells, pr AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM cells), lo AS (SELECT vec_id, x, max(CASE WHEN v = 1 THEN y END) AS last_y, min(CASE WHEN v = 1 THEN y END) AS first_y FROM pix GROUP BY vec_id, x), g AS (SELECT pr.a, pr.b, min(7 - lo.last_y + hi.first_y) AS gap FROM pr JOIN lo ON lo.vec_id = pr.a JOIN lo hi ON hi.vec_id = pr.b AND hi.x = lo.x GROUP BY pr.a, pr.b), j AS (SELECT g.a, g.b, gap, bit_count(p.m_bottom & q.m_top) AS port, p.ink + q.ink AS ink FROM g JOIN cells p ON p.vec_id = g.a JOIN cells q ON q.vec_id = g.b) SELECT a, b, CAST(gap AS INT) AS gap, CAST(port AS INT) AS port, ink FROM j ORDER BY gap ASC NULLS LAST, port DESC, ink, a LIMIT 100")
# Two by two shapes of a block in one raster
plan("lattice_composite", f"WITH @cells, q AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM cells), g AS (SELECT q.label, CAST(floor(i / 4) AS BIGINT) AS tile, CAST(floor((i % 4) / 2) * 8 + y AS INT) AS y, CAST((i % 2) * 8 + x AS INT) AS x, v FROM q JOIN pix ON q.vec_id = pix.vec_id), t AS (SELECT o.*, k FROM (SELECT DISTINCT label, tile FROM g) o $each(0; 255; k$)) SELECT t.label, t.tile, $cat(CAST(coalesce(v, 0) AS VARCHAR(1)); ''; k$) AS grid FROM t LEFT JOIN g ON g.label = t.label AND g.tile = t.tile AND g.y * 16 + g.x = t.k GROUP BY t.label, t.tile")
# P20: the two relations of a join with their sides' roles swapped
plan("axis_roles", f"WITH @cells, s AS (SELECT 'stacked' AS relation, m_bottom AS exit_mask, m_top AS entry_mask FROM cells UNION ALL SELECT 'beside', m_right, m_left FROM cells) SELECT relation, count(*) FILTER (WHERE exit_mask <> 0) AS exits, count(*) FILTER (WHERE entry_mask <> 0) AS entries, count(*) FILTER (WHERE exit_mask <> 0 AND exit_mask = entry_mask) AS same FROM s GROUP BY relation")
# Rows of plates as pixels, a window of them, and shares of ink and of blank surroundings within a row's span
plan("native_raster", "WITH @plated SELECT item_id, r, count(*) AS ink, CAST(min(x) AS INT) AS first_x, CAST(max(x) AS INT) AS last_x FROM plated GROUP BY item_id, r")
plan("crop_raster", "WITH @plated SELECT item_id, y, $cat(CAST(x - 16 AS VARCHAR(9)); ','; x$) AS lit FROM plated WHERE x >= 16 AND x < 80 GROUP BY item_id, y")
_NEAR = ("near AS (SELECT DISTINCT item_id, r, x + dx AS x, y + dy AS y FROM plated LATERAL VIEW explode(array(-2, -1, 0, 1, 2)) a AS dx LATERAL VIEW explode(array(-2, -1, 0, 1, 2)) b AS dy)", "o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d), near AS (SELECT DISTINCT item_id, r, x + a.d AS x, y + b.d AS y FROM plated CROSS JOIN o a CROSS JOIN o b)")
_SHARE = ", span AS (SELECT item_id, r, min(x) AS x0, max(x) + 1 AS x1, count(*) AS ink FROM plated GROUP BY item_id, r), c AS (SELECT s.item_id, s.r, count(n.x) AS covered FROM span s LEFT JOIN near n ON n.item_id = s.item_id AND n.r = s.r AND n.x >= s.x0 AND n.x < s.x1 AND n.y >= s.r * 8 AND n.y < s.r * 8 + 8 GROUP BY s.item_id, s.r) SELECT s.item_id, round(CAST(sum(s.ink) AS DOUBLE) / (max(s.x1) * 8 * count(*)), 6) AS ink_share, round(CAST(sum((s.x1 - s.x0) * 8 - c.covered) AS DOUBLE) / sum((s.x1 - s.x0) * 8), 6) AS blank_share FROM span s JOIN c ON c.item_id = s.item_id AND c.r = s.r GROUP BY s.item_id"
plan("render_metrics", "WITH @plated, " + _NEAR[0] + _SHARE, "WITH @plated, " + _NEAR[1] + _SHARE)
# Where fragments stand in plates: how often, the first place, and the pen there
plan("fragment_placement", "WITH @pchars, pen AS (SELECT item_id, r, p, CAST(sum($adv(ch$)) OVER (PARTITION BY item_id, r ORDER BY p ROWS UNBOUNDED PRECEDING) - $adv(ch$) AS INT) AS x FROM pchars), f AS (SELECT * FROM (VALUES ('th'), ('on'), ('. '), ('er')) t(fragment)), o AS (SELECT item_id, r, fragment, CAST(instr(line, fragment) AS INT) AS p, CAST((length(line) - length(replace(line, fragment, ''))) / length(fragment) AS BIGINT) AS n FROM plate CROSS JOIN f WHERE instr(line, fragment) > 0) SELECT o.item_id, o.r, o.fragment, o.n, o.p, pen.x FROM o JOIN pen ON pen.item_id = o.item_id AND pen.r = o.r AND pen.p = o.p")
# Build scope with its fallback, metrics by alphabet, records enriched by their id
plan("build_scope", "WITH a AS (SELECT e.vec_id FROM {embeddings} e JOIN {supplier} s ON e.vec_id = s.s_suppkey), n AS (SELECT count(*) AS n FROM a) SELECT vec_id, TRUE AS admitted FROM a UNION ALL SELECT e.vec_id, FALSE FROM {embeddings} e CROSS JOIN n WHERE n.n = 0")
plan("enriched_records", "SELECT d.lang, d.source, count(*) AS n, count(l.doc_id) AS known, CAST(sum(coalesce(l.quality, -1)) AS BIGINT) AS quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang, d.source")
plan("alphabet_metrics", "WITH @pix, abc AS (SELECT * FROM (VALUES (45, '-'), (47, '/'), (124, '|'), (92, 'b'), (40, '('), (41, ')'), (95, '_'), (79, 'O'), (118, 'v'), (55, '7'), (1000000007, '?')) t(cp, ch)), i AS (SELECT vec_id, CAST(sum(v) AS INT) AS ink FROM pix GROUP BY vec_id) SELECT cp, ch, ink IS NOT NULL AS renderable, coalesce(ink, 0) AS ink FROM abc LEFT JOIN i ON cp = vec_id")
# Characters of a text in the order in which they come first, and those that an alphabet cannot reach
plan(
    "first_seen_chars",
    "SELECT n_nationkey, array_join(array_distinct(split(n_name, '')), '') AS alphabet, length(translate(n_name, 'AEIOU', '')) AS unreached FROM {nation}",
    "WITH c AS (SELECT n_nationkey, unnest(string_split(n_name, '')) AS ch, unnest(range(length(n_name))) AS p FROM {nation}), f AS (SELECT n_nationkey, ch, min(p) AS p FROM c GROUP BY n_nationkey, ch) SELECT n.n_nationkey, string_agg(ch, '' ORDER BY p) AS alphabet, any_value(length(translate(n_name, 'AEIOU', '')))::INT AS unreached FROM f JOIN {nation} n ON n.n_nationkey = f.n_nationkey GROUP BY n.n_nationkey",
)
# Families with a control character go; literal families keep what the corpus has
plan("control_families", "SELECT label AS family, count(*) AS size, count(*) FILTER (WHERE vec_id < 32 OR vec_id BETWEEN 127 AND 159 OR vec_id = 173) AS controls, count(*) FILTER (WHERE vec_id < 32 OR vec_id BETWEEN 127 AND 159 OR vec_id = 173) = 0 AS kept FROM {embeddings} GROUP BY label")
plan("literal_families", "WITH f AS (SELECT * FROM (VALUES ('slopes', 47), ('slopes', 92), ('bars', 124), ('bars', 73), ('bars', 108), ('rounds', 40), ('rounds', 41), ('rounds', 1000000007)) t(family, cp)), j AS (SELECT family, cp FROM f JOIN {embeddings} e ON e.vec_id = cp) SELECT family, count(*) AS size, min(cp) AS first_cp FROM j GROUP BY family HAVING count(*) >= 2")
# An export cut at its delimiter, with the number of each part
plan("export_split", "SELECT doc_id, CAST(i AS INT) AS part, CAST(length(body) AS INT) AS size FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS i, body", "SELECT doc_id, unnest(range(len(ps)))::INT AS part, length(unnest(ps))::INT AS size FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM {documents})")
# Receipt of a chain of files: pinned hashes against those that are there, in order


@query("chain_receipt", "SELECT item_id, sha256(text) AS digest FROM benchmark")
def chain_receipt(spark, sf_dir):
    """Digests of rows that went through checked parts: written with a manifest, and read again with every part held against it."""
    path = scratch.folder(spark)
    checked.write(table(spark, sf_dir, "benchmark").select("item_id", "text"), path, rows_a_part=64)
    return checked.read(spark, path).select("item_id", F.sha2("text", 256).alias("digest"))


# A gallery: the first of each kind and all of a set; names as bitmaps with the characters that have none
plan("gallery", "WITH k AS (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rk FROM {part}) SELECT p_partkey, p_type, CAST(rk AS INT) AS rk FROM k WHERE rk <= 3 OR p_brand = 'Brand#11'")
plan("name_bitmap", "WITH @pix, c AS (SELECT n_nationkey, p, substr(n_name, p, 1) AS ch FROM {nation} CROSS JOIN (SELECT i + 1 AS p FROM nums) k WHERE p <= length(n_name)), j AS (SELECT c.n_nationkey, c.ch, e.vec_id, e.ink FROM c LEFT JOIN (SELECT vec_id, sum(v) AS ink FROM pix GROUP BY vec_id) e ON e.vec_id = ascii(c.ch)) SELECT n_nationkey, CAST(sum(coalesce(ink, 0)) AS BIGINT) AS ink, count(*) FILTER (WHERE vec_id IS NULL) AS missing FROM j GROUP BY n_nationkey".replace("WITH @pix,", "WITH @nums, @pix,"))
# Reported measures parsed from text and compared as they are printed
plan("reported_checks", "SELECT s_suppkey, CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT) AS reported, CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT) = s_suppkey AS same FROM {supplier} WHERE regexp_extract(s_name, '([0-9]+)', 1) <> ''")
# A source's path by its kind
plan("source_paths", "SELECT source, CASE WHEN source IN ('src0', 'src1') THEN concat('lib/', source, '.txt') WHEN lang = 'en' THEN concat('txt/', source, '.txt') ELSE concat('mlt/', lang, '/', source) END AS path, count(*) AS n FROM {documents} GROUP BY 1, 2")
