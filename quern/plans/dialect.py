"""One plan text for Spark SQL and for the oracle's dialect.

``@name`` in a text stands for a base relation (a common table expression) that each dialect writes in its own
way; ``{table}`` stands for an input table; ``$cat(x; sep; order)`` joins strings of a group in order and ``$all(s; pattern)``
gives all matches; ``$each(low; high; k$)`` after a relation gives its rows once for each k from low to high (which isn't below it);
``$adv(ch$)`` is a character's advance and ``$wide(ch$)`` whether it takes two columns. The rest is ANSI SQL.
"""

from __future__ import annotations

import re

from quern.functions.advances import EM, WIDE, WIDTHS
from quern.registry import QUERIES, query
from quern.sources.tables import cells, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Tables that Spark makes per shape.
MADE = {"ncomp": lambda spark, sf_dir: QUERIES["ncomp"](spark, sf_dir), "cells": cells}

_IS_WIDE = " OR ".join(f"ascii(%s) BETWEEN {a} AND {b}" for a, b in WIDE)
_PIXELS = ", ".join(str(round(w * EM / 1000)) for w in WIDTHS)
#: A character's advance in pixels: from the table, a whole em for wide ones, a letter's for others.
_ADVANCE = (
    f"CASE WHEN ascii(%s) BETWEEN 32 AND 126 THEN get(array({_PIXELS}), ascii(%s) - 32) WHEN {_IS_WIDE} THEN {EM} ELSE 9 END",
    f"CASE WHEN ascii(%s) BETWEEN 32 AND 126 THEN ([{_PIXELS}])[ascii(%s) - 31] WHEN {_IS_WIDE} THEN {EM} ELSE 9 END",
)
#: Components by the spread of the smallest pixel number, as a recursive query.
_PARTS = "ink AS (SELECT vec_id, (k // 8)::INT AS y, (k % 8)::INT AS x FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS e FROM {embeddings}) WHERE e > 0), reach(vec_id, y, x, r) AS (SELECT vec_id, y, x, y * 8 + x FROM ink UNION SELECT p.vec_id, p.y, p.x, q.r FROM reach q JOIN ink p ON p.vec_id = q.vec_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 AND q.r < p.y * 8 + p.x), lows AS (SELECT vec_id, y, x, min(r) AS r FROM reach GROUP BY ALL), parts AS (SELECT v.vec_id, count(DISTINCT r) AS parts FROM {embeddings} v LEFT JOIN lows l ON v.vec_id = l.vec_id GROUP BY v.vec_id)"

#: Base relations: name -> (Spark, oracle).
BASE: dict[str, tuple[str, str]] = {
    # pixels of the 8 by 8 bitmaps
    "pix": (
        "pix AS (SELECT vec_id, label, CAST(floor(k / 8) AS INT) AS y, CAST(k % 8 AS INT) AS x, CASE WHEN e > 0 THEN 1 ELSE 0 END AS v FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS k, e)",
        "pix AS (SELECT vec_id, label, (k // 8)::INT AS y, (k % 8)::INT AS x, CASE WHEN e > 0 THEN 1 ELSE 0 END AS v FROM (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding) AS e FROM {embeddings}))",
    ),
    # rows of the bitmaps as integers, bit x is column x
    "rws": (
        "@pix, rws AS (SELECT vec_id, label, y, CAST(sum(v * shiftleft(1, x)) AS INT) AS bits FROM pix GROUP BY vec_id, label, y)",
        "@pix, rws AS (SELECT vec_id, label, y, sum(v * (1 << x))::INT AS bits FROM pix GROUP BY vec_id, label, y)",
    ),
    # components of the vectors
    "vec": (
        "vec AS (SELECT vec_id, label, CAST(k AS INT) AS k, CAST(e AS DOUBLE) AS e FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS k, e)",
        "vec AS (SELECT vec_id, label, k::INT AS k, e::DOUBLE AS e FROM (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding) AS e FROM {embeddings}))",
    ),
    # lines of pages: trailing newlines stripped
    "lines": (
        "lines AS (SELECT source AS slug, doc_id AS page, lang AS stratum, CAST(r AS INT) AS r, line FROM (SELECT *, rtrim('\\n', text) AS body FROM {documents}) LATERAL VIEW posexplode(split(body, '\\n')) t AS r, line)",
        "lines AS (SELECT source AS slug, doc_id AS page, lang AS stratum, unnest(range(len(ls)))::INT AS r, unnest(ls) AS line FROM (SELECT *, string_split(rtrim(text, chr(10)), chr(10)) AS ls FROM {documents}))",
    ),
    "chars": (
        "@lines, chars AS (SELECT slug, page, stratum, r, CAST(p + 1 AS INT) AS p, ch FROM lines LATERAL VIEW posexplode(split(line, '')) t AS p, ch WHERE length(line) > 0)",
        "@lines, chars AS (SELECT slug, page, stratum, r, p::INT AS p, substr(line, p, 1) AS ch FROM (SELECT *, unnest(range(1, length(line) + 1)) AS p FROM lines WHERE length(line) > 0))",
    ),
    # tokens between spaces
    "toks": (
        "@lines, toks AS (SELECT slug, page, stratum, r, tok FROM lines LATERAL VIEW explode(regexp_extract_all(line, '[^ ]+', 0)) t AS tok)",
        "@lines, toks AS (SELECT slug, page, stratum, r, unnest(regexp_extract_all(line, '[^ ]+')) AS tok FROM lines)",
    ),
    "bigr": (
        "@toks, bigr AS (SELECT slug, page, stratum, concat(a, b) AS g FROM (SELECT slug, page, stratum, split(tok, '') AS c FROM toks WHERE length(tok) >= 2) LATERAL VIEW inline(arrays_zip(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1))) t AS a, b)",
        "@toks, bigr AS (SELECT slug, page, stratum, substr(tok, i, 2) AS g FROM (SELECT *, unnest(range(1, length(tok))) AS i FROM toks WHERE length(tok) >= 2))",
    ),
    "trig": (
        "@toks, trig AS (SELECT slug, page, stratum, concat(a, b, d) AS g FROM (SELECT slug, page, stratum, split(tok, '') AS c FROM toks WHERE length(tok) >= 3) LATERAL VIEW inline(arrays_zip(slice(c, 1, size(c) - 2), slice(c, 2, size(c) - 2), slice(c, 3, size(c) - 2))) t AS a, b, d)",
        "@toks, trig AS (SELECT slug, page, stratum, substr(tok, i, 3) AS g FROM (SELECT *, unnest(range(1, length(tok) - 1)) AS i FROM toks WHERE length(tok) >= 3))",
    ),
    # edges and extents of inked shapes; Spark makes them row by row
    "cells": (
        "@pix, cells AS (SELECT * FROM {cells})",
        """@rws, col AS (SELECT vec_id, x, CAST(sum(v * power(2, y)) AS INT) AS bits FROM pix GROUP BY vec_id, x),
e AS (SELECT vec_id, CAST(sum(v) AS INT) AS ink, min(CASE WHEN v = 1 THEN y END) AS i_top, max(CASE WHEN v = 1 THEN y END) AS i_bottom, min(CASE WHEN v = 1 THEN x END) AS i_left, max(CASE WHEN v = 1 THEN x END) AS i_right, avg(CAST(CASE WHEN v = 1 THEN y END AS DOUBLE)) AS cen FROM pix GROUP BY vec_id),
rm AS (SELECT vec_id, label, max(CASE WHEN y = 0 THEN bits END) AS m_top, max(CASE WHEN y = 7 THEN bits END) AS m_bottom, bit_or(CASE WHEN y < 3 THEN bits ELSE 0 END) AS b_top, bit_or(CASE WHEN y > 4 THEN bits ELSE 0 END) AS b_bottom FROM rws GROUP BY vec_id, label),
cm AS (SELECT vec_id, max(CASE WHEN x = 0 THEN bits END) AS m_left, max(CASE WHEN x = 7 THEN bits END) AS m_right, bit_or(CASE WHEN x < 3 THEN bits ELSE 0 END) AS b_left, bit_or(CASE WHEN x > 4 THEN bits ELSE 0 END) AS b_right FROM col GROUP BY vec_id),
cells AS (SELECT rm.*, m_left, m_right, b_left, b_right, ink, i_top, i_bottom, i_left, i_right, cen FROM rm JOIN cm ON rm.vec_id = cm.vec_id JOIN e ON rm.vec_id = e.vec_id WHERE ink > 0)""",
    ),
    # marks: the direction of one is the axis of its ink, by second moments
    "node": (
        "node AS (SELECT vec_id AS id, label, i_left AS a0, i_right AS a1, i_top AS c0, i_bottom AS c1, i_bottom - i_top + 1 AS size, cen, b_right, b_left, CAST(round(degrees(0.5 * atan2(2.0 * sxy, sxx - syy)) + CASE WHEN round(2.0 * sxy, 9) < 0 THEN 180 ELSE 0 END, 9) AS DOUBLE) AS dom FROM {cells})",
        "@cells, axis AS (SELECT vec_id, sum((x - mx) * (x - mx)) AS sxx, sum((y - my) * (y - my)) AS syy, sum((x - mx) * (y - my)) AS sxy FROM pix JOIN (SELECT vec_id, avg(CAST(x AS DOUBLE)) AS mx, avg(CAST(y AS DOUBLE)) AS my FROM pix WHERE v = 1 GROUP BY vec_id) m USING (vec_id) WHERE v = 1 GROUP BY vec_id), node AS (SELECT vec_id AS id, label, i_left AS a0, i_right AS a1, i_top AS c0, i_bottom AS c1, i_bottom - i_top + 1 AS size, cen, b_right, b_left, CAST(round(degrees(0.5 * atan2(2.0 * sxy, sxx - syy)) + CASE WHEN round(2.0 * sxy, 9) < 0 THEN 180 ELSE 0 END, 9) AS DOUBLE) AS dom FROM cells JOIN axis USING (vec_id))",
    ),
    # small plates: benchmark texts, tabs as spaces
    "plate": (
        "plate AS (SELECT item_id, CAST(r AS INT) AS r, line FROM {benchmark} LATERAL VIEW posexplode(split(translate(text, '\\t', ' '), '\\n')) t AS r, line)",
        "plate AS (SELECT item_id, unnest(range(len(ls)))::INT AS r, unnest(ls) AS line FROM (SELECT item_id, string_split(replace(text, chr(9), ' '), chr(10)) AS ls FROM {benchmark}))",
    ),
    "pchars": (
        "@plate, pchars AS (SELECT item_id, r, CAST(p + 1 AS INT) AS p, ch FROM plate LATERAL VIEW posexplode(split(line, '')) t AS p, ch WHERE length(line) > 0)",
        "@plate, pchars AS (SELECT item_id, r, p::INT AS p, substr(line, p, 1) AS ch FROM (SELECT *, unnest(range(1, length(line) + 1)) AS p FROM plate WHERE length(line) > 0))",
    ),
    # parts of ink of each shape; Spark gets it as a table that is made per shape
    "parts": ("parts AS (SELECT vec_id, parts FROM {ncomp})", _PARTS),
    # pixels of plates: the shape whose id is a character's code point stands at the character's pen position
    "plated": (
        "@pchars, @pix, plated AS (SELECT DISTINCT item_id, r, x0 + x AS x, r * 8 + y AS y FROM (SELECT item_id, r, ch, CAST(sum($adv(ch$)) OVER (PARTITION BY item_id, r ORDER BY p ROWS UNBOUNDED PRECEDING) - $adv(ch$) AS INT) AS x0 FROM pchars) c JOIN pix ON vec_id = ascii(ch) AND v = 1)",
    )
    * 2,
    # one row per integer 0..63
    "nums": ("nums AS (SELECT CAST(id AS INT) AS i FROM range(64))", "nums AS (SELECT range::INT AS i FROM range(64))"),
}


def _text(body: str, which: int) -> str:
    recursive = which == 1 and "@parts" in body
    for _ in range(4):
        body = re.sub(r"@(\w+)", lambda m: BASE[m[1]][which], body)
    body = re.sub(r"\$adv\(([^$]*)\$\)", lambda m: "(" + _ADVANCE[which].replace("%s", m[1]) + ")", body)
    body = re.sub(r"\$wide\(([^$]*)\$\)", lambda m: "(" + _IS_WIDE.replace("%s", m[1]) + ")", body)
    if recursive:
        body = body.replace("WITH ", "WITH RECURSIVE ", 1)
    each = (r"LATERAL VIEW explode(sequence(CAST(\1 AS INT), CAST(\2 AS INT))) each_\3 AS \3", r", unnest(generate_series(CAST(\1 AS INT), CAST(\2 AS INT))) AS each_\3(\3)")[which]
    body = re.sub(r"\$each\(([^;]*); ([^;]*); (\w+)\$\)", each, body)
    if which == 0:
        body = re.sub(r"\$cat\(([^;]*); ([^;]*); ([^;]*)\$\)", r"listagg(\1, \2) WITHIN GROUP (ORDER BY \3)", body)
        body = re.sub(r"\$all\(([^;]*); ([^;]*)\$\)", r"regexp_extract_all(\1, \2, 0)", body)
        return body
    body = re.sub(r"\$cat\(([^;]*); ([^;]*); ([^;]*)\$\)", r"string_agg(\1, \2 ORDER BY \3)", body)
    return re.sub(r"\$all\(([^;]*); ([^;]*)\$\)", r"regexp_extract_all(\1, \2)", body)


def plan(name: str, body: str, oracle: str | None = None):
    """Registers a plan text under a name; ``oracle`` replaces the text for the oracle where the two must differ."""
    text = _text(body, 0)
    used = [t for t in (*TABLES, *MADE) if "{" + t + "}" in text]
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace("{{" + t + "}}", "{" + t + "}")

    def run(spark, sf_dir):
        return spark.sql(text, **{t: MADE[t](spark, sf_dir) if t in MADE else table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    run.__doc__ = f"The plan text ``{name}``."
    query(name, re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else m[0], _text(oracle or body, 1)))(run)
    return run
