"""Readers of the library's own file formats; schemas are explicit and nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILY = "mode STRING, size INT, block STRING, cps ARRAY<INT>, chars STRING, role_hint STRING, note STRING"
COMBINATION = "id STRING, label STRING, note STRING, cols INT, rows INT, cells ARRAY<STRUCT<col: INT, row: INT, cp: INT, char: STRING>>"


def plates(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (file, r, line): tabs become spaces, newlines at the end go."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.translate(F.rtrim(F.col("value"), F.lit("\n")), "\t", " ").alias("body"))
    return whole.select("file", F.posexplode(F.split("body", "\n")).alias("r", "line"))


def families(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Saved families, one JSON object a line; malformed and blank lines are skipped.

    With a table of known codepoints (``cp``), a family of which any member is missing is dropped.
    """
    rows = spark.read.schema(FAMILY).option("mode", "DROPMALFORMED").json(path).filter("cps IS NOT NULL").withColumn("family", F.monotonically_increasing_id())
    if known is None:
        return rows
    members = rows.select("family", F.explode("cps").alias("cp"))
    broken = members.join(known.select("cp").distinct(), "cp", "left_anti").select("family").distinct()
    return rows.join(broken, "family", "left_anti")


def combinations(spark: SparkSession, path: str) -> DataFrame:
    """An authored dictionary {"combinations": [...]} as one row for each cell."""
    rows = spark.read.schema(f"combinations ARRAY<STRUCT<{COMBINATION}>>").option("multiLine", True).json(path)
    rows = rows.select(F.explode("combinations").alias("c")).select("c.*")
    return rows.select("id", "label", "cols", "rows", F.inline("cells"))


def discovered(files: DataFrame, prefix: str, pattern: str, without: str) -> DataFrame:
    """Paths below a prefix whose name matches and that don't hold an excluded part."""
    return files.filter(F.startswith("path", F.lit(prefix)) & F.col("path").rlike(pattern) & ~F.contains("path", F.lit(without)))


def entities(text: F.Column) -> F.Column:
    """Numeric character references of ASCII signs decoded; all others stay."""
    out = text
    for code in range(32, 127):
        if code != 38:
            out = F.replace(out, F.lit(f"&#{code};"), F.lit(chr(code)))
    return F.replace(out, F.lit("&#38;"), F.lit("&"))
