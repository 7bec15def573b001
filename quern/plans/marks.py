"""Marks dealt to tasks: each block goes to ``SALTS`` groups, which all hold its marks and each find the edges of their own share of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import edges
from quern.plans.dialect import _text
from quern.sources.scratch import written
from quern.sources.tables import cells

#: Groups of a block, and tasks of all groups.
SALTS, TASKS = 16, 96


def dealt(rows: DataFrame, key: str, salts: int = SALTS):
    """Rows grouped by label and salt: all rows of a block are in each of its groups, and ``own`` says which are the group's share by ``key``."""
    rows = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("own", F.col("salt") == F.pmod(F.xxhash64(key), F.lit(salts))).repartition(TASKS, "label", "salt").groupBy("label", "salt")


def marks(spark, sf_dir: str) -> DataFrame:
    return spark.sql(_text(f"WITH @node SELECT label, {', '.join(edges.COLUMNS)} FROM node", 0), cells=cells(spark, sf_dir))


def marks_written(spark, sf_dir: str) -> DataFrame:
    return written(marks(spark, sf_dir))


def kept(spark, sf_dir: str) -> DataFrame:
    """The kept edges of each mark with the heights of both ends, three a rule at most."""
    return dealt(marks(spark, sf_dir), "id").applyInArrow(edges.kept_of_group, "src long, dst long, rule string, cost double, z_src double, z_dst double")


def kept_written(spark, sf_dir: str) -> DataFrame:
    """The same for plans that join them with themselves."""
    return written(kept(spark, sf_dir))


def turn_sums(spark, sf_dir: str) -> DataFrame:
    """Number of turn edges with the least, the greatest and the sum of their costs, a row for each group."""
    return dealt(marks(spark, sf_dir), "id").applyInArrow(edges.turns_of_group, "n long, least double, most double, total double")
