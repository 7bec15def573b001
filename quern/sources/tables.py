"""Readers of the input tables and their first shape: bitmaps from embeddings, pages and lines from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.cells import SCHEMA, cell_batches

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, mask: pixel (y, x) is bit 8y + x of a 64-bit mask, lit where the component is positive."""
    e = F.col("embedding")
    bits = [F.when(e[k] > 0, F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for k in range(SIDE * SIDE)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", mask.alias("mask"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inked shapes with the masks of their edges and bands, extents, centroid and moments, each from its own row."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").mapInArrow(cell_batches, SCHEMA)
