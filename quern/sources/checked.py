"""Parquet parts with a manifest: each part's hash, size and rows, and one hash of the whole set. Reading verifies and fails closed.

The reader parses the very bytes whose hash it has compared, so nothing can change in between. A missing part, one that the manifest doesn't
know, and a damaged one each end the read (``ValueError`` in the task). Parts are small (``rows_a_part``), as one is read into a task whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, sha256 string, size long, n long"


def _parts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/parts")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column("content").to_pylist()
        made = [batch.column("name"), pa.array([hashlib.sha256(x).hexdigest() for x in data]), pa.array([len(x) for x in data], pa.int64()), pa.array([pq.ParquetFile(pa.BufferReader(x)).metadata.num_rows for x in data], pa.int64())]
        yield pa.RecordBatch.from_arrays(made, ["name", "sha256", "size", "n"])


def write(df: DataFrame, path: str, rows_a_part: int = 1_000_000) -> DataFrame:
    """Writes the parts and their manifest, and returns the manifest. A folder that has parts already isn't written over."""
    df.write.option("maxRecordsPerFile", rows_a_part).mode("error").parquet(f"{path}/parts")
    _parts(df.sparkSession, path).mapInArrow(_weigh, MANIFEST).write.mode("error").parquet(f"{path}/manifest")
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def input_set(parts: DataFrame, block: int = 4096) -> str:
    """One hash of all parts in the order of their names: of the hashes of blocks of names, so no task has more than a block's lines."""
    slices = F.pmod(F.xxhash64("name"), F.lit(1 << 16))
    n = parts.count()
    blocks = max(1, -(-n // block))
    lines = parts.groupBy((slices % blocks).alias("block")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "sha256"))), "\n"), 256).alias("h"))
    whole = hashlib.sha256()
    for row in lines.orderBy("block").toLocalIterator():
        whole.update(f"{row['block']} {row['h']}\n".encode())
    return whole.hexdigest()


def _verified(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["content"] is None:
                    raise ValueError(f"part {row['name']} is missing")
                if row["sha256"] is None:
                    raise ValueError(f"part {row['name']} is not in the manifest")
                if len(row["content"]) != row["size"] or hashlib.sha256(row["content"]).hexdigest() != row["sha256"]:
                    raise ValueError(f"part {row['name']} is damaged")
                for part in pq.ParquetFile(pa.BufferReader(row["content"])).iter_batches(columns=names):
                    yield part.select(names)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all parts, each part verified by the task that reads it."""
    found = _parts(spark, path).join(manifest(spark, path), "name", "full")
    schema = spark.read.parquet(f"{path}/parts").schema
    return found.select("name", "content", "sha256", "size").mapInArrow(_verified(schema.names), schema)
