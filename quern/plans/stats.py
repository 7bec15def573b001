"""Sampled and weighted statistics over a corpus, layout of rows, and rules over catalogues and manifests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.plans.dialect import plan
from quern.registry import query
from quern.sources.tables import table

# Metrics of a piece, its style and stratum
_PIECE = """piece AS (SELECT doc_id AS piece, lang AS stratum, source AS slug, n_chars AS glyphs, CAST(length(text) - length(replace(text, '%', '')) + length(text) - length(replace(text, '*', '')) + length(text) - length(replace(text, '|', '')) AS DOUBLE) / greatest(length(text), 1) AS tone,
CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) / greatest(length(text), 1) AS space, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) / greatest(length(text), 1) AS ink FROM {documents}),
styled AS (SELECT *, CASE WHEN tone >= 0.05 THEN 'tone' WHEN ink > 0.11 THEN 'dense' WHEN space < 0.14 THEN 'tight' WHEN tone >= 0.01 THEN 'mixed' ELSE 'line_minimal' END AS style FROM piece)"""
plan("piece_metrics", f"WITH {_PIECE} SELECT piece, stratum, round(tone, 6) AS tone, round(space, 6) AS space, round(ink, 6) AS ink FROM piece")
plan("style_class", f"WITH {_PIECE} SELECT stratum, style, count(*) AS n FROM styled GROUP BY stratum, style")
# Summaries at several levels at once
plan(
    "summary_grouping_sets",
    f"WITH {_PIECE} SELECT coalesce(stratum, '*') AS stratum, coalesce(slug, '*') AS slug, count(*) AS pieces, round(median(tone), 6) AS median_tone, round(avg(ink), 6) AS mean_ink, round(CAST(count(*) FILTER (WHERE style = 'line_minimal') AS DOUBLE) / count(*), 6) AS minimal_share FROM styled GROUP BY GROUPING SETS ((), (stratum), (stratum, slug)) HAVING count(*) >= 5",
)
# quantiles by floor index, as a sorted list would be read
plan("floor_quantiles", f"WITH {_PIECE}, k AS (SELECT stratum, glyphs, row_number() OVER (PARTITION BY stratum ORDER BY glyphs, piece) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS n FROM piece) SELECT stratum, max(CASE WHEN i = CAST(floor(n * 0.1) AS BIGINT) THEN glyphs END) AS q10, max(CASE WHEN i = CAST(floor(n * 0.5) AS BIGINT) THEN glyphs END) AS q50, max(CASE WHEN i = CAST(floor(n * 0.9) AS BIGINT) THEN glyphs END) AS q90 FROM k GROUP BY stratum")
# A sample that a hash decides, at a rate for each stratum
_U = ("CAST(conv(substr(sha2(concat('s', CAST(doc_id AS STRING)), 256), 1, 12), 16, 10) AS DOUBLE) / 281474976710656", "('0x' || substr(sha256(concat('s', doc_id::VARCHAR)), 1, 12))::BIGINT::DOUBLE / 281474976710656")


def _hashed(name: str, text: str) -> None:
    plan(name, text.replace("%U%", _U[0]), text.replace("%U%", _U[1]))


_SAMPLE = "n AS (SELECT lang, count(*) AS n FROM {documents} GROUP BY lang), u AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, n.n, %U% AS u FROM {documents} d JOIN n ON d.lang = n.lang), picked AS (SELECT * FROM u WHERE u < least(1.0, 2000.0 / n))"
_hashed("stratified_sample", f"WITH {_SAMPLE} SELECT doc_id, lang, round(u, 9) AS u FROM picked")
# Shares weighted back to the strata, their intervals, a grid of thresholds
_WEIGHT = f"{_SAMPLE}, w AS (SELECT p.*, CAST(p.n AS DOUBLE) / count(*) OVER (PARTITION BY p.lang) AS weight FROM picked p)"
_hashed("weighted_shares", f"WITH {_WEIGHT} SELECT round(sum(CASE WHEN n_chars > 2000 THEN weight ELSE 0 END) / sum(weight), 6) AS long_share, round(sum(weight * n_chars) / sum(weight), 4) AS mean_chars, count(*) AS sampled FROM w")
_hashed("threshold_grid", f"WITH {_WEIGHT}, g AS (SELECT a.t AS low, b.t AS high FROM (VALUES (500), (1000), (2000)) a(t) CROSS JOIN (VALUES (1500), (3000), (6000)) b(t)) SELECT low, high, round(sum(CASE WHEN n_chars BETWEEN low AND high THEN weight ELSE 0 END) / sum(weight), 6) AS share FROM w CROSS JOIN g GROUP BY low, high")
plan("wilson_interval", "WITH c AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE n_chars > 1500) AS DOUBLE) AS k FROM {documents} GROUP BY lang), s AS (SELECT lang, n, k / n AS p, 1.96 * 1.96 AS zz FROM c) SELECT lang, round(p, 6) AS share, round((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 6) AS low, round((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 6) AS high FROM s")
plan("group_tables", "WITH l AS (SELECT d.lang, d.source, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) SELECT lang AS subject, 'quality' AS measure, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS share FROM l GROUP BY lang UNION ALL SELECT source, 'toxic', count(*), round(avg(CAST(toxic AS DOUBLE)), 6) FROM l GROUP BY source")
# One exemplar for each class, and the best excerpt of three lines
_SHA = ("sha2(CAST(piece AS STRING), 256)", "sha256(piece::VARCHAR)")
_EX = f"WITH {_PIECE}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum, style ORDER BY round(ink, 6) DESC, %H%) AS rk FROM styled) SELECT stratum, style, piece, round(ink, 6) AS ink FROM k WHERE rk = 1"
plan("exemplars", _EX.replace("%H%", _SHA[0]), _EX.replace("%H%", _SHA[1]))
plan("excerpt_window", "WITH @lines, s AS (SELECT page, r, sum(length(line)) OVER (PARTITION BY page ORDER BY r ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS size, count(*) OVER (PARTITION BY page ORDER BY r ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM lines), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY size DESC, r) AS rk FROM s WHERE n = 3) SELECT page, r, CAST(size AS BIGINT) AS size FROM k WHERE rk = 1")
# Drift between two layouts, and quantiles of their ratio
plan("layout_drift", "WITH @lines, w AS (SELECT slug, page, r, length(line) * 8 AS flat, length(line) * 8 + length(line) - length(replace(line, ' ', '')) * 1 AS native FROM lines WHERE length(line) > 0) SELECT slug, count(*) AS n, round(CAST(median(native - flat) AS DOUBLE), 4) AS median_drift, CAST(max(native - flat) AS INT) AS most, round(avg(CAST(native AS DOUBLE) / flat), 6) AS ratio FROM w GROUP BY slug")
plan("indent_grid", "WITH @lines SELECT slug, count(*) AS n, count(*) FILTER (WHERE (length(line) - length(ltrim(line))) % 2 = 1) AS off_grid FROM lines GROUP BY slug")
# Digests of an input set
plan("input_set_hash", "SELECT source, sha2(listagg(concat(CAST(doc_id AS STRING), ' ', CAST(n_chars AS STRING)), '\\n') WITHIN GROUP (ORDER BY concat(CAST(doc_id AS STRING), ' ', CAST(n_chars AS STRING))), 256) AS digest FROM {documents} GROUP BY source", "SELECT source, sha256(string_agg(concat(doc_id::VARCHAR, ' ', n_chars::VARCHAR), chr(10) ORDER BY concat(doc_id::VARCHAR, ' ', n_chars::VARCHAR))) AS digest FROM {documents} GROUP BY source")
plan("canonical_hash", "SELECT s_suppkey, sha2(concat('{\"acctbal\":', CAST(CAST(floor(s_acctbal) AS BIGINT) AS STRING), ',\"name\":\"', s_name, '\"}'), 256) AS digest FROM {supplier}", "SELECT s_suppkey, sha256(concat('{\"acctbal\":', floor(s_acctbal)::BIGINT::VARCHAR, ',\"name\":\"', s_name, '\"}')) AS digest FROM {supplier}")
plan("hash_partitions", "SELECT CAST(conv(substr(sha2(CAST(doc_id AS STRING), 256), 1, 1), 16, 10) AS INT) % 8 AS part, count(*) AS n FROM {documents} GROUP BY 1", "SELECT (('0x' || substr(sha256(doc_id::VARCHAR), 1, 1))::INT % 8)::INT AS part, count(*) AS n FROM {documents} GROUP BY 1")
# Groups between markers, headings carried forward
plan("palette_sessions", "WITH s AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM {conversations}) SELECT conv_id, CAST(g AS BIGINT) AS session, count(*) AS entries, CAST(min(turn) AS BIGINT) AS first_turn, CAST(sum(length(text)) AS BIGINT) AS glyphs FROM s GROUP BY conv_id, g")
plan("section_carry", "WITH @lines, h AS (SELECT page, r, CASE WHEN length(line) < 30 AND line <> '' THEN line END AS heading, line FROM lines), c AS (SELECT page, r, last_value(heading) IGNORE NULLS OVER (PARTITION BY page ORDER BY r ROWS UNBOUNDED PRECEDING) AS section FROM h) SELECT section, count(*) AS n, count(DISTINCT page) AS pages FROM c GROUP BY section", "WITH @lines, h AS (SELECT page, r, CASE WHEN length(line) < 30 AND line <> '' THEN line END AS heading, line FROM lines), c AS (SELECT page, r, last_value(heading IGNORE NULLS) OVER (PARTITION BY page ORDER BY r ROWS UNBOUNDED PRECEDING) AS section FROM h) SELECT section, count(*) AS n, count(DISTINCT page) AS pages FROM c GROUP BY section")
# Widths, pens, slices
_LAID = "laid AS (SELECT item_id, r, p, ch, $adv(ch$) AS adv, CAST(sum($adv(ch$)) OVER (PARTITION BY item_id, r ORDER BY p ROWS UNBOUNDED PRECEDING) AS INT) - $adv(ch$) AS x FROM pchars)"
plan("row_widths", f"WITH @pchars, {_LAID} SELECT item_id, r, CAST(max(x + adv) AS INT) AS width, CAST(sum(adv) AS BIGINT) AS total FROM laid GROUP BY item_id, r")
plan("glyph_centres", f"WITH @pchars, {_LAID} SELECT item_id, r, p, round(x + adv / CAST(2 AS DOUBLE), 2) AS centre FROM laid WHERE ch <> ' '")
plan("row_slice", f"WITH @pchars, {_LAID} SELECT item_id, r, $cat(ch; ''; p$) AS slice FROM laid WHERE x >= 32 AND x < 160 GROUP BY item_id, r")
plan("fixed_width", "WITH @pchars SELECT item_id, r, CAST(sum(CASE WHEN $wide(ch$) THEN 2 ELSE 1 END) AS BIGINT) AS columns_used FROM pchars GROUP BY item_id, r")
# Widths made of 11 and 5 pixel spaces; a brush repeated to a width
plan("padding_unicode", "WITH @nums SELECT i AS width, CAST(floor(i / 11) AS INT) AS wide, CAST(i % 11 AS INT) AS rest FROM nums")
plan("padding_plain", "WITH @nums, c AS (SELECT w.i AS width, a.i AS wide, b.i AS narrow FROM nums w CROSS JOIN nums a CROSS JOIN nums b WHERE 11 * a.i + 5 * b.i = w.i), k AS (SELECT *, row_number() OVER (PARTITION BY width ORDER BY wide DESC) AS rk FROM c) SELECT width, wide, narrow FROM k WHERE rk = 1")
plan("brush_rows", "WITH b AS (SELECT n_nationkey, n_name, 8 * length(n_name) AS unit FROM {nation}) SELECT n_nationkey, repeat(n_name, CAST(floor(300 / unit) AS INT)) AS body, CAST(300 - unit * floor(300 / unit) AS INT) AS rest FROM b")
# A dense table over ids from 256
_LUT = "SELECT s.id, CAST(coalesce(idx % 16, 0) AS INT) AS cx, CAST(coalesce(floor(idx / 16), 0) AS INT) AS cy, CASE WHEN e.id IS NULL THEN 0 ELSE 255 END AS alpha FROM s LEFT JOIN e ON s.id = e.id"
query("lut_dense", f"WITH e AS (SELECT p_partkey * 2 + 256 AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part), s AS (SELECT unnest(range(256, (SELECT max(id) + 1 FROM e))) AS id) {_LUT}")(lambda spark, sf_dir: lut_dense(spark, table(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 256).alias("id"))))


def lut_dense(spark, ids):
    """A row for every id from 256 to the largest one; those that are given have their place in order, 16 to a line."""
    top = ids.agg(F.max("id")).first()[0]
    every = spark.range(256, top + 1) if top is not None else spark.range(0)
    out = every.join(numbered(ids, "id", "idx").withColumn("lit", F.lit(255)), "id", "left")
    return out.select("id", F.coalesce(F.col("idx") % 16, F.lit(0)).cast("int").alias("cx"), F.coalesce(F.floor(F.col("idx") / 16), F.lit(0)).cast("int").alias("cy"), F.coalesce("lit", F.lit(0)).alias("alpha"))


def numbered(rows, key: str, name: str, width: int = 1 << 16):
    """Places of distinct integer keys in their order, from 0: the keys before a stretch of ``width`` of them are counted, and only a stretch is sorted."""
    rows = rows.withColumn("stretch", F.floor(F.col(key) / width))
    sizes = rows.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("stretch").orderBy(key)) - 1
    return rows.withColumn("place", place).join(sizes.select("stretch", before.alias("before")), "stretch").select(*[c for c in rows.columns if c != "stretch"], (F.col("before") + F.col("place")).alias(name))


# Codepoints in blocks, as a range join
_BLOCKS = "blk AS (SELECT * FROM (VALUES (0, 127, 'Basic'), (128, 255, 'Supplement'), (256, 383, 'Extended A'), (384, 591, 'Extended B'), (8192, 8303, 'Punctuation')) t(lo, hi, name))"
plan("codepoint_blocks", f"WITH @chars, {_BLOCKS}, c AS (SELECT ascii(ch) AS cp, count(*) AS n FROM chars GROUP BY 1) SELECT coalesce(name, 'none') AS block, count(*) AS codepoints, CAST(sum(n) AS BIGINT) AS glyphs FROM c LEFT JOIN blk ON cp BETWEEN lo AND hi GROUP BY 1")
plan("select_by_block", f"WITH {_BLOCKS} SELECT name, cp FROM blk LATERAL VIEW explode(sequence(lo, hi)) t AS cp WHERE instr(upper(name), 'EXTENDED') > 0", f"WITH {_BLOCKS} SELECT name, unnest(range(lo, hi + 1))::INT AS cp FROM blk WHERE instr(upper(name), 'EXTENDED') > 0")
plan("block_steps", f"WITH @chars, {_BLOCKS}, c AS (SELECT DISTINCT ascii(ch) AS cp FROM chars), n AS (SELECT lo, name, count(cp) AS n FROM blk LEFT JOIN c ON cp BETWEEN lo AND hi GROUP BY lo, name) SELECT name, n, lead(name) OVER (ORDER BY lo) AS next_block FROM n WHERE n > 0")
# The first font that has a codepoint owns it
plan("font_owner", "WITH @chars, f AS (SELECT DISTINCT stratum AS font, ch, CASE stratum WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS place FROM chars), k AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY place, font) AS rk FROM f) SELECT ch, font FROM k WHERE rk = 1")
# sets and their differences
plan("coverage_sets", "WITH a AS (SELECT DISTINCT o_custkey AS id FROM {orders}), b AS (SELECT c_custkey AS id FROM {customer}) SELECT 'both' AS which, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM b) t UNION ALL SELECT 'only_a', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b) t UNION ALL SELECT 'only_b', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a) t")
plan("catalog_diff", "SELECT 'missing' AS finding, d.doc_id AS id FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL UNION ALL SELECT 'extra', l.doc_id FROM {labels} l LEFT JOIN {documents} d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL UNION ALL SELECT 'incomplete', doc_id FROM {labels} WHERE quality IS NULL OR toxic IS NULL")
plan("scoring_projection", "SELECT s_suppkey, s_name FROM {supplier} s LEFT JOIN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 0) x ON s.s_nationkey = x.n_nationkey WHERE x.n_nationkey IS NULL")
plan("manifest_rules", "WITH e AS (SELECT p_partkey AS id, p_name AS label, p_size AS coverage FROM {part}) SELECT 'label_repeats' AS rule, label AS subject, count(*) AS n FROM e GROUP BY label HAVING count(*) > 3 UNION ALL SELECT 'coverage_range', CAST(id AS VARCHAR(20)), 1 FROM e WHERE coverage > 45 UNION ALL SELECT 'label_blank', CAST(id AS VARCHAR(20)), 1 FROM e WHERE trim(label) = ''")
# No duplicate keys, complete cover
plan("partition_checks", "WITH k AS (SELECT o_orderkey AS id FROM {orders}), u AS (SELECT l_orderkey AS id, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) SELECT 'duplicates' AS finding, count(*) AS n FROM (SELECT id FROM k GROUP BY id HAVING count(*) > 1) t UNION ALL SELECT 'uncovered', count(*) FROM k LEFT JOIN u ON k.id = u.id WHERE u.id IS NULL UNION ALL SELECT 'orphans', count(*) FROM u LEFT JOIN k ON k.id = u.id WHERE k.id IS NULL")
# Families with any member missing are dropped, or lose the members
_FAM = "fam AS (SELECT label AS family, vec_id + CASE WHEN vec_id % 40 = 0 THEN 100000000 ELSE 0 END AS member FROM {embeddings}), j AS (SELECT family, member, e.vec_id IS NOT NULL AS found FROM fam LEFT JOIN {embeddings} e ON fam.member = e.vec_id)"
plan("saved_families", f"WITH {_FAM} SELECT family, count(*) AS size, min(member) AS first_member FROM j GROUP BY family HAVING bool_and(found) OR count(*) >= 8")
plan("trimmed_families", f"WITH {_FAM} SELECT family, count(*) FILTER (WHERE found) AS size, count(*) FILTER (WHERE NOT found) AS lost FROM j GROUP BY family HAVING count(*) FILTER (WHERE found) >= 2")
# Union of sources with their order, a limit for each shape
plan("review_union", "WITH u AS (SELECT 0 AS source_no, s_suppkey AS id, s_name AS name, s_nationkey AS kind FROM {supplier} UNION ALL SELECT 1, c_custkey, c_name, c_nationkey FROM {customer}), k AS (SELECT *, row_number() OVER (PARTITION BY source_no, kind ORDER BY id) AS rk FROM u) SELECT source_no, kind, id, name FROM k WHERE rk <= 3")
plan("nth_family", "WITH k AS (SELECT p_type AS mode, p_brand AS family, count(*) AS size, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS n FROM {part} GROUP BY p_type, p_brand) SELECT mode, family, size FROM k WHERE n = 2")
plan("mode_slice", "SELECT p_type AS mode, p_brand AS family, count(*) AS size FROM {part} GROUP BY p_type, p_brand HAVING count(*) BETWEEN 2 AND 16")
plan("section_filter", "SELECT p_partkey, p_name FROM {part} WHERE instr(lower(p_name), lower('WID')) > 0 AND p_name NOT LIKE '%blue%'")
# First record of a key wins, positions of equal texts
plan("role_merge", "WITH k AS (SELECT source AS src, lang AS role, doc_id AS id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rk, count(*) OVER (PARTITION BY source, lang) AS n FROM {documents}) SELECT src, role, id, n_chars, n FROM k WHERE rk = 1")
plan("duplicate_texts", "WITH d AS (SELECT sha2(trim(text), 256) AS h, doc_id FROM {documents}) SELECT h, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM d GROUP BY h HAVING count(*) > 1", "WITH d AS (SELECT sha256(trim(text)) AS h, doc_id FROM {documents}) SELECT h, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM d GROUP BY h HAVING count(*) > 1")
plan("snapshot_check", "WITH want AS (SELECT doc_id, sha2(text, 256) AS h FROM {documents}), have AS (SELECT doc_id, sha2(CASE WHEN doc_id % 9 = 0 THEN concat(text, ' ') ELSE text END, 256) AS h FROM {documents}) SELECT w.doc_id FROM want w LEFT JOIN have v ON w.doc_id = v.doc_id AND w.h = v.h WHERE v.doc_id IS NULL", "WITH want AS (SELECT doc_id, sha256(text) AS h FROM {documents}), have AS (SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN concat(text, ' ') ELSE text END) AS h FROM {documents}) SELECT w.doc_id FROM want w LEFT JOIN have v ON w.doc_id = v.doc_id AND w.h = v.h WHERE v.doc_id IS NULL")
# Ranges of rows; where a text stands, by line
plan("row_ranges", "WITH @lines SELECT page, $cat(line; '/'; r$) AS body FROM lines WHERE r BETWEEN 1 AND 2 GROUP BY page")
plan("locate_text", "WITH @lines SELECT page, r, CAST(instr(line, 'tion') AS INT) AS at FROM lines WHERE instr(line, 'tion') > 0")
plan("json_terms", "SELECT CAST(get_json_object(props, '$.k') AS INT) AS k, count(*) AS n FROM {events} GROUP BY 1", "SELECT (props::JSON->>'$.k')::INT AS k, count(*) AS n FROM {events} GROUP BY 1")
# Rates per thousand lines, keys of entries
plan("rate_per_1k", "WITH @bigr, n AS (SELECT slug, count(*) AS n_lines FROM lines GROUP BY slug), c AS (SELECT slug, count(*) AS n FROM bigr WHERE g = 'th' GROUP BY slug) SELECT c.slug, round(CAST(1000 AS DOUBLE) * c.n / n.n_lines, 4) AS rate FROM c JOIN n ON c.slug = n.slug")
# Numeric character references
# any code point, decimal or hexadecimal; what is no character (zero, surrogates, beyond the last one) becomes U+FFFD
_REFS = "r AS (SELECT page_id, ref, {number} AS cp FROM e), c AS (SELECT page_id, ref, CASE WHEN cp IS NULL OR cp <= 0 OR cp > 1114111 OR cp BETWEEN 55296 AND 57343 THEN 65533 ELSE cp END AS cp FROM r) SELECT ref, {char} AS ch, count(*) AS n, count(DISTINCT page_id) AS pages FROM c GROUP BY ref, cp"
plan(
    "numeric_entities",
    "WITH e AS (SELECT page_id, ref FROM {pages} LATERAL VIEW explode(regexp_extract_all(html, '&#([0-9]+|[xX][0-9A-Fa-f]+);', 0)) t AS ref), " + _REFS.replace("{number}", "CASE WHEN lower(substr(ref, 3, 1)) = 'x' THEN CASE WHEN length(ref) <= 15 THEN CAST(conv(substr(ref, 4, length(ref) - 4), 16, 10) AS BIGINT) END ELSE try_cast(substr(ref, 3, length(ref) - 3) AS BIGINT) END").replace("{char}", "decode(unhex(lpad(hex(cp), 8, '0')), 'UTF-32')"),
    "WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '&#([0-9]+|[xX][0-9A-Fa-f]+);')) AS ref FROM {pages}), " + _REFS.replace("{number}", "CASE WHEN lower(substr(ref, 3, 1)) = 'x' THEN CASE WHEN length(ref) <= 15 THEN TRY_CAST('0x' || substr(ref, 4, length(ref) - 4) AS BIGINT) END ELSE TRY_CAST(substr(ref, 3, length(ref) - 3) AS BIGINT) END").replace("{char}", "chr(cp::INT)"),
)
plan("named_entities", "WITH e AS (SELECT page_id, ref FROM {pages} LATERAL VIEW explode(regexp_extract_all(html, '&[a-z]+;', 0)) t AS ref) SELECT ref, count(*) AS n, count(DISTINCT page_id) AS pages FROM e GROUP BY ref", "WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '&[a-z]+;')) AS ref FROM {pages}) SELECT ref, count(*) AS n, count(DISTINCT page_id) AS pages FROM e GROUP BY ref")
# Template scores over slots, overview by pooling
plan("template_scores", "WITH @pix, t AS (SELECT vec_id AS slot, y, x, v AS m FROM pix WHERE vec_id < 10), s AS (SELECT p.vec_id, t.slot, sum(CASE WHEN v = 1 AND m = 1 THEN 18 WHEN v = 0 AND m = 0 THEN 3 WHEN v = 1 THEN -18 ELSE 6 END) AS score FROM pix p JOIN t ON p.y = t.y AND p.x = t.x GROUP BY p.vec_id, t.slot), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, slot) AS rk FROM s) SELECT vec_id, slot, CAST(score AS BIGINT) AS score FROM k WHERE rk = 1")
plan("pooled_overview", "WITH @pix, p AS (SELECT vec_id, floor(y / 2) AS py, floor(x / 2) AS px, max(v) AS v FROM pix GROUP BY vec_id, floor(y / 2), floor(x / 2)) SELECT vec_id, $cat(CAST(v AS VARCHAR(1)); ''; py * 4 + px$) AS overview FROM p GROUP BY vec_id")
plan("outline_mask", "WITH @vec, g AS (SELECT vec_id, k, e, lead(e) OVER (PARTITION BY vec_id, floor(k / 8) ORDER BY k) AS nx FROM vec) SELECT vec_id, count(*) FILTER (WHERE (e - nx) * (e - nx) > 1.5) AS outline FROM g GROUP BY vec_id")
