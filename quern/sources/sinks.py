"""Writers: families, partitioned documents, and write-once documents with a content digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest(df: DataFrame) -> str:
    """SHA-256 over the sum and the exclusive or of row hashes: the same for any order of rows, with one small row to the driver."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)") for k in range(5)]
    found = df.select(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).agg(F.count(F.lit(1)), *[F.sum(f"p{k}") for k in range(5)])
    return found.select(F.sha2(F.concat_ws("-", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("0")) for c in found.columns]), 256)).first()[0]


def write_once(df: DataFrame, path: str) -> bool:
    """Writes a table unless it is there; equal content is left alone, other content is an error. True if it was written."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        if digest(spark.read.schema(df.schema).parquet(path)) != digest(df):
            raise FileExistsError(f"{path} has other content")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def write_families(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_patterns(df: DataFrame, path: str) -> None:
    """Window patterns by size, as compressed JSON."""
    df.write.mode("overwrite").partitionBy("n_cells", "m_cells").option("compression", "gzip").json(path)


def write_cells(df: DataFrame, path: str) -> None:
    """Cell features by cell width, so descriptors of one width are read alone."""
    df.write.mode("overwrite").partitionBy("cell_w").parquet(path)
