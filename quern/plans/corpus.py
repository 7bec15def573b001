"""Counting plans over a text corpus: a page is a document, its slug the source, its stratum the language.

Character classes are parameters of the corpus: here strokes are capitals, tone is ``%*#$&|!``.
"""

from quern.plans.dialect import plan

TONE = "[%*#$&|!]"
#: Pairs that mirror each other.
MIRROR_FROM, MIRROR_TO = "bdpq()<>[]{}", "dbqp)(><][}{"
IDIOMS = ("tion", "the ", "ing", "***", "re th", ". A")
_IDIOMS = ", ".join(f"('{x}')" for x in IDIOMS)

CLASS = """CASE WHEN ch = ' ' THEN 'space' WHEN regexp_like(ch, '^[%*#$&|!]$') THEN 'tone' WHEN regexp_like(ch, '^[A-Z]$') THEN 'stroke'
 WHEN regexp_like(ch, '^[a-z]$') THEN 'lower' WHEN regexp_like(ch, '^[0-9]$') THEN 'digit' WHEN regexp_like(ch, '^[.,;:?]$') THEN 'stop' WHEN regexp_like(ch, '^\\\\p{L}$') THEN 'letter' ELSE 'other' END"""
_CLASS_DUCK = CLASS.replace("regexp_like", "regexp_matches").replace("\\\\", "\\")


def _both(name: str, text: str) -> None:
    plan(name, text.replace("%CLASS%", CLASS), text.replace("%CLASS%", _CLASS_DUCK))


# Counts of glyphs, and of pages by mode
plan("glyph_counts", "WITH @chars, one AS (SELECT ch, page, count(*) AS n FROM chars GROUP BY ch, page) SELECT ch, CAST(sum(n) AS BIGINT) AS n, count(*) AS pages FROM one GROUP BY ch", "WITH @chars SELECT ch, count(*) AS n, count(DISTINCT page) AS pages FROM chars GROUP BY ch")
plan("page_counts", "SELECT source AS slug, lang AS stratum, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS glyphs FROM {documents} GROUP BY source, lang")
# Classes of glyphs and their shares
_both("glyph_class_shares", "WITH @chars, c AS (SELECT stratum, %CLASS% AS class, count(*) AS n FROM chars GROUP BY 1, 2) SELECT stratum, class, n, round(n / CAST(sum(n) OVER (PARTITION BY stratum) AS DOUBLE), 6) AS share FROM c")
# Touching pairs and triples within tokens, with their coverage
plan("bigrams", "WITH @bigr SELECT g, count(*) AS n FROM bigr GROUP BY g")
COVERAGE = "WITH @bigr, one AS (SELECT g, slug, page, count(*) AS n FROM bigr GROUP BY g, slug, page) SELECT g, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT page) AS pages, count(DISTINCT slug) AS slugs FROM one GROUP BY g"
TRIGRAMS = "WITH @trig SELECT g, count(*) AS n, count(DISTINCT page) AS pages FROM trig GROUP BY g"
# Runs of four tone glyphs and more, named by their shortest period
_UNIT = "CASE WHEN b = repeat(substr(b, 1, 1), length(b)) THEN substr(b, 1, 1) WHEN b = substr(repeat(substr(b, 1, 2), length(b)), 1, length(b)) THEN substr(b, 1, 2) WHEN b = substr(repeat(substr(b, 1, 3), length(b)), 1, length(b)) THEN substr(b, 1, 3) ELSE '(aperiodic)' END"
plan(
    "tone_bands",
    f"WITH @lines, bands AS (SELECT slug, page, b FROM lines LATERAL VIEW explode($all(line; '{TONE}{{4,}}'$)) t AS b) SELECT {_UNIT} AS unit, count(*) AS n, count(DISTINCT page) AS pages, CAST(max(length(b)) AS INT) AS longest FROM bands GROUP BY 1",
    f"WITH @lines, bands AS (SELECT slug, page, unnest($all(line; '{TONE}{{4,}}'$)) AS b FROM lines) SELECT {_UNIT} AS unit, count(*) AS n, count(DISTINCT page) AS pages, max(length(b))::INT AS longest FROM bands GROUP BY 1",
)
# Spellings of white space within lines, and its laws
plan(
    "space_spellings",
    "WITH @lines, gaps AS (SELECT page, g FROM lines LATERAL VIEW explode($all(trim(line); '[ .,]+'$)) t AS g), c AS (SELECT translate(g, ' .,', 'hpc') AS spelling, count(*) AS n, count(DISTINCT page) AS pages FROM gaps WHERE length(g) >= 2 GROUP BY 1) SELECT spelling, n, pages, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS ratio FROM c",
    "WITH @lines, gaps AS (SELECT page, unnest($all(trim(line); '[ .,]+'$)) AS g FROM lines), c AS (SELECT translate(g, ' .,', 'hpc') AS spelling, count(*) AS n, count(DISTINCT page) AS pages FROM gaps WHERE length(g) >= 2 GROUP BY 1) SELECT spelling, n, pages, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS ratio FROM c",
)
plan("whitespace_law", "WITH @lines SELECT slug, count(*) AS rows_read, CAST(sum(floor((length(line) - length(replace(line, '  ', ''))) / 2)) AS BIGINT) AS doubles, count(*) FILTER (WHERE substr(line, 1, 1) = ' ') AS leading, count(*) FILTER (WHERE line = '') AS blank FROM lines GROUP BY slug")
# Idioms by non-overlapping counts
plan("idiom_counts", f"WITH i AS (SELECT * FROM (VALUES {_IDIOMS}) v(idiom)), c AS (SELECT idiom, source AS slug, doc_id AS page, CAST((length(text) - length(replace(text, idiom, ''))) / length(idiom) AS BIGINT) AS n FROM {{documents}} CROSS JOIN i) SELECT idiom, CAST(sum(n) AS BIGINT) AS n, count(*) AS pages, count(DISTINCT slug) AS slugs FROM c WHERE n > 0 GROUP BY idiom")
plan(
    "idiom_strata",
    f"WITH i AS (SELECT * FROM (VALUES {_IDIOMS}) v(idiom)), c AS (SELECT idiom, lang AS stratum, CAST((length(text) - length(replace(text, idiom, ''))) / length(idiom) AS BIGINT) AS n FROM {{documents}} CROSS JOIN i), s AS (SELECT idiom, stratum, CAST(sum(n) AS BIGINT) AS n, count(*) AS pieces FROM c GROUP BY idiom, stratum HAVING count(*) >= 500), k AS (SELECT *, row_number() OVER (PARTITION BY idiom ORDER BY n * 1.0 / pieces DESC, stratum) AS rk FROM s) SELECT idiom, stratum, n, pieces, CAST(rk AS INT) AS rk FROM k WHERE rk <= 4",
)
# N-grams that hold an idiom, or are held by one, are none of their own
SUBTRACTION = f"WITH @trig, i AS (SELECT * FROM (VALUES {_IDIOMS}) v(idiom)), c AS (SELECT g, count(*) AS n FROM trig GROUP BY g) SELECT g, n FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE instr(g, idiom) > 0 OR instr(idiom, g) > 0)"
# Strokes over strokes in the next row, centres at most 3 pixels apart
_STACK = """laid AS (SELECT slug, page, r, p, ch, CAST($adv(ch$) AS DOUBLE) AS adv, sum(CAST($adv(ch$) AS DOUBLE)) OVER (PARTITION BY page, r ORDER BY p ROWS UNBOUNDED PRECEDING) AS pen FROM chars),
s AS (SELECT slug, page, r, ch, pen - adv / 2 AS c FROM laid WHERE ch >= 'A' AND ch <= 'Z' AND length(ch) = 1)"""
STACKS = f"WITH @chars, {_STACK} SELECT u.ch AS upper_ch, l.ch AS lower_ch, round_even(l.c - u.c, 0)::INT AS dx, count(*) AS n, count(DISTINCT u.page) AS pages FROM s u JOIN s l ON u.page = l.page AND l.r = u.r + 1 WHERE abs(l.c - u.c) <= 3 GROUP BY 1, 2, 3"
# Tag of a page by shares of at least 0.6, outline first
_TAG = "SELECT page, CASE WHEN ink = 0 THEN 'empty' WHEN outline >= 0.6 * ink THEN 'outline' WHEN tone >= 0.6 * ink THEN 'tone' ELSE 'mixed' END AS tag, ink, outline, tone FROM c"
plan(
    "page_tags",
    f"WITH c AS (SELECT doc_id AS page, CAST(length(regexp_replace(text, '[ \\n]', '')) AS BIGINT) AS ink, CAST(length(regexp_replace(text, '[^A-Za-z]', '')) AS BIGINT) AS outline, CAST(length(regexp_replace(text, '[^%*#$&|!]', '')) AS BIGINT) AS tone FROM {{documents}}) {_TAG}",
    f"WITH c AS (SELECT doc_id AS page, length(regexp_replace(text, '[ \\n]', '', 'g')) AS ink, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS outline, length(regexp_replace(text, '[^%*#$&|!]', '', 'g')) AS tone FROM {{documents}}) {_TAG}",
)
# Best of each slug, ranked list of a category
plan("per_slug_top", "WITH @bigr, c AS (SELECT slug, g, count(*) AS n FROM bigr GROUP BY slug, g), k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, g) AS rk FROM c) SELECT slug, g, n, CAST(rk AS INT) AS rk FROM k WHERE rk <= 8")
plan("ranked_top", "WITH @bigr, c AS (SELECT g, count(*) AS n, count(DISTINCT slug) AS slugs FROM bigr GROUP BY g), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, g) AS rk FROM (SELECT * FROM c ORDER BY n DESC, g LIMIT 300) t) SELECT g, n, slugs, CAST(rk AS INT) AS rk FROM k")
# Counts pooled with the mirror image
plan("pooled_mirror", f"WITH @bigr, c AS (SELECT g, translate(reverse(g), '{MIRROR_FROM}', '{MIRROR_TO}') AS m, count(*) AS n FROM bigr GROUP BY 1, 2) SELECT a.g, a.n, a.n + coalesce(CASE WHEN a.m <> a.g THEN b.n END, 0) AS pooled FROM c a LEFT JOIN c b ON a.m = b.g")
# A pair and its mirror are one class
plan("mirror_classes", f"WITH @bigr, c AS (SELECT g, least(g, translate(reverse(g), '{MIRROR_FROM}', '{MIRROR_TO}')) AS class, count(*) AS n FROM bigr GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, g) AS rk, sum(n) OVER (PARTITION BY class) AS total FROM c) SELECT class, g AS representative, CAST(total AS BIGINT) AS total FROM k WHERE rk = 1 AND total >= 3")
# N-grams of plates with their sources, stacked pairs and blocks of 2 by 2
plan(
    "plate_ngrams",
    "WITH @plate, g AS (SELECT item_id, n, substr(line, i, n) AS g FROM plate LATERAL VIEW explode(sequence(2, 6)) a AS n LATERAL VIEW explode(sequence(1, greatest(length(line), 1))) b AS i WHERE i + n - 1 <= length(line)) SELECT CAST(n AS INT) AS size, g, count(*) AS n, count(DISTINCT item_id) AS sources FROM g WHERE instr(g, ' ') = 0 AND instr(g, '#') = 0 GROUP BY 1, 2",
    "WITH @plate, s AS (SELECT *, unnest(range(2, 7)) AS n FROM plate), g AS (SELECT item_id, n, substr(line, i, n) AS g FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM s) t WHERE i + n - 1 <= length(line)) SELECT n::INT AS size, g, count(*) AS n, count(DISTINCT item_id) AS sources FROM g WHERE instr(g, ' ') = 0 AND instr(g, '#') = 0 GROUP BY 1, 2",
)
plan("plate_stacked", "WITH @pchars SELECT a.ch AS upper_ch, b.ch AS lower_ch, count(*) AS n, count(DISTINCT a.item_id) AS sources FROM pchars a JOIN pchars b ON a.item_id = b.item_id AND b.r = a.r + 1 AND b.p = a.p WHERE a.ch <> ' ' AND b.ch <> ' ' GROUP BY 1, 2")
plan("blocks_2x2", "WITH @pchars, w AS (SELECT item_id, r, p, concat(ch, lead(ch) OVER (PARTITION BY item_id, r ORDER BY p)) AS two FROM pchars) SELECT concat(a.two, '/', b.two) AS block, count(*) AS n, count(DISTINCT a.item_id) AS sources FROM w a JOIN w b ON a.item_id = b.item_id AND b.r = a.r + 1 AND b.p = a.p WHERE length(a.two) = 2 AND length(b.two) = 2 GROUP BY 1")
# Lattice cells of 16 pixels and windows of n by m cells, anchored on all borders
_CELLS = """laid AS (SELECT slug, page, r, p, ch, CAST(floor((sum($adv(ch$)) OVER (PARTITION BY page, r ORDER BY p ROWS UNBOUNDED PRECEDING) - $adv(ch$)) / 16) AS INT) AS c FROM chars),
cells AS (SELECT slug, page, r, c, $cat(ch; ''; p$) AS code, CAST(max(CASE WHEN ch <> ' ' THEN 1 ELSE 0 END) AS INT) AS ink FROM laid GROUP BY slug, page, r, c)"""
LATTICE = f"WITH @chars, {_CELLS} SELECT code, count(*) AS n, count(DISTINCT page) AS pages, count(DISTINCT slug) AS slugs FROM cells WHERE ink = 1 GROUP BY code HAVING count(*) >= 3"
WINDOWS = f"""WITH @chars, {_CELLS},
side AS (SELECT slug, page, r, c, code, ink, lead(c) OVER (PARTITION BY page, r ORDER BY c) AS c2, lead(code) OVER (PARTITION BY page, r ORDER BY c) AS code2, lead(ink) OVER (PARTITION BY page, r ORDER BY c) AS ink2 FROM cells),
two AS (SELECT * FROM side WHERE c2 = c + 1 AND ink + ink2 > 0),
w AS (SELECT a.slug, a.page, concat(a.code, '|', a.code2, '/', b.code, '|', b.code2) AS k FROM two a JOIN two b ON a.page = b.page AND b.r = a.r + 1 AND b.c = a.c WHERE a.ink + b.ink > 0 AND a.ink2 + b.ink2 > 0)
SELECT k, count(*) AS n, count(DISTINCT page) AS pages, count(DISTINCT slug) AS slugs FROM w GROUP BY k HAVING count(DISTINCT page) >= 2"""
# Windows of 2 to 12 by 2 to 12 cells of plates with ink on all four borders, and what is counted of each size. A cell goes to the
# strips of its row that have it, and an inked strip to the windows that have it, so blank cells and rows cost nothing
plan(
    "window_sizes",
    """WITH @pchars, @nums,
laid AS (SELECT item_id, r, p, ch, CAST(floor((sum($adv(ch$)) OVER (PARTITION BY item_id, r ORDER BY p ROWS UNBOUNDED PRECEDING) - $adv(ch$)) / 16) AS INT) AS c FROM pchars),
cells AS (SELECT item_id, r, c, $cat(ch; ''; p$) AS code, min(CASE WHEN ch <> ' ' THEN ascii(ch) END) AS lo, max(CASE WHEN ch <> ' ' THEN ascii(ch) END) AS hi FROM laid GROUP BY item_id, r, c HAVING max(CASE WHEN ch <> ' ' THEN 1 ELSE 0 END) = 1),
ends AS (SELECT item_id, max(r) AS last_r, max(c) AS last_c FROM cells GROUP BY item_id),
sz AS (SELECT a.i + 2 AS size, b.i AS back FROM nums a JOIN nums b ON b.i < a.i + 2 WHERE a.i <= 10),
strip AS (SELECT x.item_id, last_r, r, c - back AS c0, size AS width, $cat(concat(CAST(back AS VARCHAR(9)), ':', code); ' '; back$) AS code, min(lo) AS lo, max(hi) AS hi, max(CASE WHEN back = 0 THEN 1 ELSE 0 END) AS on_left, max(CASE WHEN back = size - 1 THEN 1 ELSE 0 END) AS on_right FROM cells x JOIN ends e ON x.item_id = e.item_id CROSS JOIN sz WHERE c - back >= 0 AND c - back + size - 1 <= last_c GROUP BY x.item_id, last_r, r, c - back, size),
win AS (SELECT item_id, width, c0, size AS height, r - back AS r0, $cat(concat(CAST(back AS VARCHAR(9)), '@', code); '/'; back$) AS k, min(lo) <> max(hi) AS outline FROM strip CROSS JOIN sz WHERE r - back >= 0 AND r - back + size - 1 <= last_r GROUP BY item_id, width, c0, size, r - back HAVING max(CASE WHEN back = 0 THEN 1 ELSE 0 END) + max(CASE WHEN back = size - 1 THEN 1 ELSE 0 END) + max(on_left) + max(on_right) = 4),
pat AS (SELECT height, width, k, outline, count(*) AS n, count(DISTINCT item_id) AS items FROM win GROUP BY height, width, k, outline)
SELECT height, width, CAST(sum(n) AS BIGINT) AS windows, count(*) AS patterns, count(*) FILTER (WHERE n = 1) AS singles, count(*) FILTER (WHERE items >= 2) AS in_two, count(*) FILTER (WHERE items >= 10) AS in_ten, count(*) FILTER (WHERE outline) AS outlines FROM pat GROUP BY height, width""",
)
# Glyphs whose extents overlap by a pixel and more in adjacent rows
plan(
    "vertical_continuation",
    """WITH @pchars, laid AS (SELECT item_id, r, p, ch, CAST(sum($adv(ch$)) OVER (PARTITION BY item_id, r ORDER BY p ROWS UNBOUNDED PRECEDING) AS INT) AS x1 FROM pchars),
e AS (SELECT *, x1 - CAST($adv(ch$) AS INT) AS x0 FROM laid WHERE ch <> ' '),
o AS (SELECT a.ch AS above, b.ch AS below, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS overlap FROM e a JOIN e b ON a.item_id = b.item_id AND b.r = a.r + 1 AND a.x0 < b.x1 AND b.x0 < a.x1)
SELECT above, below, count(*) AS n, round(avg(CAST(overlap AS DOUBLE)), 6) AS mean_overlap FROM o GROUP BY above, below HAVING count(*) >= 2""",
)
# Two corpora's ranks side by side, a missing rank is the list's length and one
_RANKS = "WITH @bigr, c AS (SELECT stratum, g, count(*) AS n FROM bigr WHERE stratum IN ('en', 'fr') GROUP BY stratum, g), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY stratum ORDER BY n DESC, g) AS INT) AS rk FROM c), a AS (SELECT g, n, rk FROM k WHERE stratum = 'en'), b AS (SELECT g, n, rk FROM k WHERE stratum = 'fr'), j AS (SELECT coalesce(a.g, b.g) AS g, a.n AS na, b.n AS nb, coalesce(a.rk, (SELECT CAST(count(*) AS INT) FROM a) + 1) AS ra, coalesce(b.rk, (SELECT CAST(count(*) AS INT) FROM a) + 1) AS rb FROM a FULL OUTER JOIN b ON a.g = b.g)"
plan("corpus_compare", f"{_RANKS} SELECT g, na, nb, ra, rb FROM j")
plan("rank_moves", f"{_RANKS} SELECT g, ra, rb, ra - rb AS move FROM j WHERE ra <= 50 OR rb <= 50 ORDER BY abs(ra - rb) DESC, g LIMIT 10")
# Held-out sources excluded, members of a former aggregate kept
plan("heldout_anti", "WITH h AS (SELECT DISTINCT source FROM {documents} WHERE source IN ('src1', 'src7')) SELECT d.doc_id, d.source, d.n_chars FROM {documents} d LEFT ANTI JOIN h ON d.source = h.source".replace("LEFT ANTI", "ANTI"))
plan("train_membership", "WITH t AS (SELECT source FROM {documents} GROUP BY source HAVING count(*) >= 20) SELECT d.source, count(*) AS n FROM {documents} d SEMI JOIN t ON d.source = t.source GROUP BY d.source".replace("SEMI", "LEFT SEMI"), "WITH t AS (SELECT source FROM {documents} GROUP BY source HAVING count(*) >= 20) SELECT d.source, count(*) AS n FROM {documents} d SEMI JOIN t ON d.source = t.source GROUP BY d.source")
# Shared substrings of at least two glyphs, containment, glyphs outside an alphabet
_SHARED = "o AS (SELECT n.n_name AS fragment, r.n_name AS candidate, s FROM sub n JOIN {nation} r ON r.n_name <> n.n_name AND instr(r.n_name, s) > 0), m AS (SELECT DISTINCT fragment, candidate, s FROM o) SELECT a.fragment, a.candidate, a.s FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.fragment = b.fragment AND a.candidate = b.candidate AND length(b.s) > length(a.s) AND instr(b.s, a.s) > 0)"
plan(
    "substring_overlaps",
    f"WITH sub AS (SELECT DISTINCT n_name, substr(n_name, i, l) AS s FROM {{nation}} LATERAL VIEW explode(sequence(1, length(n_name))) a AS i LATERAL VIEW explode(sequence(2, greatest(length(n_name), 2))) b AS l WHERE i + l - 1 <= length(n_name)), {_SHARED}",
    f"WITH i AS (SELECT n_name, unnest(range(1, length(n_name) + 1)) AS i FROM {{nation}}), l AS (SELECT *, unnest(range(2, length(n_name) + 1)) AS l FROM i), sub AS (SELECT DISTINCT n_name, substr(n_name, i, l) AS s FROM l WHERE i + l - 1 <= length(n_name)), {_SHARED}",
)
# a fragment's longest inner token stands in a text as a whole token, so it leads to the texts that can hold the fragment; the rest is
# held against all texts, which are few: fragments of one or two tokens
ANCHORED = """f AS (SELECT item_id, text AS fragment, regexp_extract_all(text, '[^ \\n]+', 0) AS ts FROM {benchmark} WHERE length(text) > 0),
a AS (SELECT item_id, fragment, array_max(transform(slice(ts, 2, size(ts) - 2), t -> struct(length(t) AS n, t AS t))).t AS anchor FROM f WHERE size(ts) > 2),
w AS (SELECT doc_id, t FROM {documents} LATERAL VIEW explode(array_distinct(regexp_extract_all(text, '[^ \\n]+', 0))) x AS t),
near AS (SELECT DISTINCT doc_id, item_id, fragment FROM w JOIN a ON w.t = a.anchor),
hits AS (SELECT d.doc_id, item_id, instr(d.text, fragment) AS place FROM near JOIN {documents} d ON near.doc_id = d.doc_id WHERE instr(d.text, fragment) > 0
 UNION ALL SELECT d.doc_id, item_id, instr(d.text, fragment) FROM f JOIN {documents} d ON instr(d.text, fragment) > 0 WHERE size(ts) <= 2)"""
_HITS = "hits AS (SELECT doc_id, item_id, instr(d.text, b.text) AS place FROM {documents} d JOIN {benchmark} b ON instr(d.text, b.text) > 0 WHERE length(b.text) > 0)"
plan("fragment_containment", f"WITH {ANCHORED} SELECT item_id, count(*) AS pages FROM hits GROUP BY item_id", f"WITH {_HITS} SELECT item_id, count(*) AS pages FROM hits GROUP BY item_id")
# where the whole text of an item stands
plan("slice_check", f"WITH {ANCHORED} SELECT doc_id, item_id, CAST(place AS INT) AS found_at FROM hits", f"WITH {_HITS} SELECT doc_id, item_id, CAST(place AS INT) AS found_at FROM hits")
plan("missing_from_alphabet", "WITH @pchars SELECT item_id, $cat(ch; ''; ch$) AS missing FROM (SELECT DISTINCT item_id, ch FROM pchars WHERE ch NOT IN ('a', 'e', 'i', 'o', 'u', 'n', 't', 'h', 's', 'r', 'd', 'l', ' ')) t GROUP BY item_id")
