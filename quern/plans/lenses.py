"""Searches by measure, rules over records in one scan, and terms at any depth of a JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.dialect import plan
from quern.plans import shapes  # noqa: F401  (its measures are searched here)
from quern.registry import ORACLE, QUERIES, query
from quern.sources.tables import table

# Nearest shapes by moments, zones (Euclidean) and directions (cosine)
_LENSES = """WITH m AS (SELECT 'hu' AS lens, vec_id, k, CASE k WHEN 1 THEN h1 WHEN 2 THEN h2 WHEN 3 THEN h3 WHEN 4 THEN h4 WHEN 5 THEN h5 WHEN 6 THEN h6 ELSE h7 END AS e FROM {hu} h %EACH%
UNION ALL SELECT 'zoning', vec_id, zone, density FROM {zones} UNION ALL SELECT 'orient', vec_id, bin, share FROM {bins}),
q AS (SELECT lens, k, e AS q FROM m WHERE vec_id = 0), size AS (SELECT lens, sqrt(sum(q * q)) AS size FROM q GROUP BY lens),
s AS (SELECT m.lens, vec_id, sqrt(sum((e - coalesce(q, 0)) * (e - coalesce(q, 0)))) AS apart, sum(e * coalesce(q, 0)) AS dot, sqrt(sum(e * e)) AS own FROM m LEFT JOIN q ON q.lens = m.lens AND q.k = m.k WHERE vec_id <> 0 GROUP BY m.lens, vec_id),
d AS (SELECT s.lens, vec_id, round(CASE WHEN s.lens = 'orient' THEN 1.0 - dot / (own * size + 1e-9) ELSE apart END, 5) AS distance FROM s JOIN size ON size.lens = s.lens),
k AS (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY distance, vec_id) AS place FROM d)
SELECT lens, CAST(place AS INT) AS place, vec_id, distance FROM k WHERE place <= 12"""
_SOURCES = {"hu": "hu_moments", "zones": "raster_zoning", "bins": "orient_hist"}


@query("similar_by_lens", _LENSES.replace("%EACH%", ", unnest(range(1, 8)) t(k)").format(**{k: f"({ORACLE[v]})" for k, v in _SOURCES.items()}))
def similar_by_lens(spark, sf_dir: str) -> DataFrame:
    """The 12 shapes nearest to the first one by each lens; ties by id. A search keeps 12 rows of a task before its shuffle."""
    return spark.sql(_LENSES.replace("%EACH%", "LATERAL VIEW explode(sequence(1, 7)) t AS k"), **{k: QUERIES[v](spark, sf_dir) for k, v in _SOURCES.items()})


@query("similar_iou_norm")
def similar_iou_norm(spark, sf_dir: str, seed: int = 0, k: int = 12) -> DataFrame:
    """The k shapes whose rasters, cropped to their ink and fitted into one square, overlap most with the seed's (one row, which goes to the tasks)."""
    fits = QUERIES["crop_fit"](spark, sf_dir).select("vec_id", F.split("grid", "").alias("g"))
    own = fits.filter(F.col("vec_id") == seed).select("g").first()
    lit = F.lit(own["g"] if own else ["."] * 256)
    count = lambda both: F.size(F.filter(both, lambda x: x))
    common = count(F.zip_with("g", lit, lambda a, b: (a == "#") & (b == "#")))
    union = count(F.zip_with("g", lit, lambda a, b: (a == "#") | (b == "#")))
    out = fits.filter(F.col("vec_id") != seed).select("vec_id", F.round(1 - F.when(union == 0, 0.0).otherwise(common / union), 6).alias("distance"))
    return out.orderBy("distance", "vec_id").limit(k)


def rules_plan(name: str, source: str, rules: dict[str, str]) -> None:
    """Registers a plan that evaluates all rules in one scan of ``source``: a row for each rule with how many records break it.

    A rule is a condition that holds for a broken record, or, if it begins with ``=``, an aggregate that counts what is broken.
    """
    made = [(r, x[1:] if x.startswith("=") else f"count(*) FILTER (WHERE {x})") for r, x in rules.items()]
    sums = ", ".join(f"CAST({x} AS BIGINT) AS r{k}" for k, (_, x) in enumerate(made, 1))
    names = " ".join(f"WHEN {k} THEN '{r}'" for k, (r, _) in enumerate(made, 1))
    values = " ".join(f"WHEN {k} THEN r{k}" for k in range(1, len(made) + 1))
    plan(name, f"WITH a AS (SELECT count(*) AS n, {sums} FROM {source}) SELECT CASE k {names} END AS rule, CASE k {values} END AS broken, n AS records FROM a $each(1; {len(made)}; k$)")


# required fields, types and bounds, known words, references, duplicates, agreement of derived fields
rules_plan(
    "record_rules",
    "{documents} d LEFT JOIN (SELECT doc_id AS labelled, quality, toxic FROM {labels}) l ON d.doc_id = l.labelled",
    {
        "id required": "doc_id IS NULL",
        "id not negative": "doc_id < 0",
        "id unique": "=count(doc_id) - count(DISTINCT doc_id)",
        "text required": "text IS NULL",
        "text not blank": "length(trim(text)) = 0",
        "text unique": "=count(text) - count(DISTINCT text)",
        "text not cut off": "text LIKE '%...'",
        "text begins with a letter": "NOT (upper(substr(text, 1, 1)) <> lower(substr(text, 1, 1)))",
        "text without tabs": "instr(text, chr(9)) > 0",
        "text without returns": "instr(text, chr(13)) > 0",
        "text without control characters": "instr(text, chr(1)) > 0 OR instr(text, chr(127)) > 0",
        "text without replacement characters": "instr(text, '�') > 0",
        "text ends a sentence": "NOT (text LIKE '%.' OR text LIKE '%!' OR text LIKE '%?')",
        "language required": "lang IS NULL",
        "language known": "lang NOT IN ('en', 'de', 'fr', 'es')",
        "language of two letters": "length(lang) <> 2",
        "language in small letters": "lang <> lower(lang)",
        "source required": "source IS NULL",
        "source not blank": "length(trim(source)) = 0",
        "source without spaces": "instr(source, ' ') > 0",
        "length required": "n_chars IS NULL",
        "length of the text": "n_chars <> length(text)",
        "quality known": "quality NOT IN (0, 1)",
        "toxic known": "toxic NOT IN (0, 1)",
        "label complete": "labelled IS NOT NULL AND (quality IS NULL OR toxic IS NULL)",
        "not good and toxic": "quality = 1 AND toxic = 1",
        "labelled once": "=count(labelled) - count(DISTINCT labelled)",
    },
)


def json_leaves(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """All scalars of a JSON text with their paths (``$.a[0].b``): the keys, path, value (as text; null for null).

    A round opens one level of all rows at once, by variants; there are as many rounds as the deepest text has levels. Keys
    that are no plain words stand in quotes. Texts that are no JSON give no rows.
    """
    spark, found = rows.sparkSession, None
    level = rows.select(*keys, F.lit("$").alias("path"), F.try_parse_json(json).alias("v")).filter("v IS NOT NULL")
    names = ", ".join(f"`{k}`" for k in keys)
    while True:
        kind = F.schema_of_variant("v")
        holds = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = level.filter(~holds).select(*keys, "path", F.col("v").cast("string").alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        inner = level.filter(holds)
        if inner.isEmpty():
            return found
        step = "CASE WHEN key IS NULL THEN concat('[', pos, ']') WHEN key RLIKE '^[A-Za-z_][A-Za-z0-9_]*$' THEN concat('.', key) ELSE concat('.\"', key, '\"') END"
        level = spark.sql(f"SELECT {names}, concat(path, {step}) AS path, value AS v FROM {{inner}}, LATERAL variant_explode(v)", inner=inner)


# Where a term stands in nested records: what a turn says, by sentences
@query(
    "json_term_paths",
    "WITH j AS (SELECT conv_id, turn, json_object('turn', turn, 'say', json_object('role', role, 'sentences', string_split(text, '. '))) AS j FROM conversations) SELECT j.conv_id, j.turn, t.fullkey AS path, (t.atom->>'$') AS value FROM j, json_tree(j.j) t WHERE t.type = 'VARCHAR' AND contains(t.atom->>'$', 'tion')",
)
def json_term_paths(spark, sf_dir: str, term: str = "tion") -> DataFrame:
    """Paths and values of the strings that hold a term, at any depth."""
    turns = table(spark, sf_dir, "conversations")
    nested = F.to_json(F.struct("turn", F.struct("role", F.split("text", r"\. ").alias("sentences")).alias("say")))
    return json_leaves(turns.select("conv_id", "turn", nested.alias("j")), ["conv_id", "turn"], "j").filter(F.instr("value", term) > 0)
