"""Files that every executor can see: raw blobs and Parquet tables under the shared folder.

The shared folder is ``spark.checkpoint.dir``; only where the session has none and is on one machine
(as in tests) is a temporary folder made.  Tasks write a blob under a private name and rename it, so a
task that runs twice leaves one whole file.
"""

from __future__ import annotations

import atexit
import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Blobs that a worker keeps: so many maps, and so many bytes of those that it had to read.
KEEP_MAPS, KEEP_BYTES = 4096, 256 << 20
_kept: OrderedDict[str, np.ndarray] = OrderedDict()


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _FALLBACK["dir"]


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder for one run of one operator; it goes when the driver ends."""
    path = f"{shared_root(spark)}/quern-{what}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, path)
    return path


def _local(path: str) -> str | None:
    """The plain path of a folder that is mounted on every machine, else None."""
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _drop(path: str) -> None:
    import shutil

    if plain := _local(path):
        shutil.rmtree(plain, ignore_errors=True)
    else:
        try:
            found, inner = _fs(path)
            found.delete_dir(inner)
        except (OSError, ImportError):
            return


def remove(path: str) -> None:
    """Takes away a folder whose content is no longer read."""
    _drop(path)


def table(df: DataFrame, path: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again; this cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(path: str, *parts: bytes) -> None:
    """Writes one blob whole or not at all."""
    tag = f".{uuid.uuid4().hex}"
    if plain := _local(path):
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        with open(plain + tag, "wb") as out:
            for part in parts:
                out.write(part)
        os.replace(plain + tag, plain)
        return
    found, inner = _fs(path)
    found.create_dir(inner.rpartition("/")[0], recursive=True)
    with found.open_output_stream(inner + tag) as out:
        for part in parts:
            out.write(part)
    found.move(inner + tag, inner)


@contextmanager
def writing(path: str):
    """An open file that becomes the blob when the block ends well."""
    tag = f".{uuid.uuid4().hex}"
    if plain := _local(path):
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        with open(plain + tag, "wb") as out:
            yield out
        os.replace(plain + tag, plain)
        return
    found, inner = _fs(path)
    found.create_dir(inner.rpartition("/")[0], recursive=True)
    with found.open_output_stream(inner + tag) as out:
        yield out
    found.move(inner + tag, inner)


@contextmanager
def reading(path: str):
    if plain := _local(path):
        with open(plain, "rb") as src:
            yield src
        return
    found, inner = _fs(path)
    with found.open_input_file(inner) as src:
        yield src


def remove_blob(path: str) -> None:
    if plain := _local(path):
        os.remove(plain)
        return
    found, inner = _fs(path)
    found.delete_file(inner)


def size(path: str) -> int:
    if plain := _local(path):
        return os.path.getsize(plain)
    found, inner = _fs(path)
    return found.get_file_info(inner).size


def get(path: str, start: int = 0, length: int | None = None) -> bytes:
    """A range of one blob."""
    if plain := _local(path):
        with open(plain, "rb") as src:
            src.seek(start)
            return src.read() if length is None else src.read(length)
    found, inner = _fs(path)
    with found.open_input_file(inner) as src:
        src.seek(start)
        return src.read() if length is None else src.read(length)


def mapped(path: str, dtype: str = "u1") -> np.ndarray:
    """A blob as an array: memory-mapped where the folder is mounted, else read. Missing: empty."""
    if plain := _local(path):
        try:
            with open(plain, "rb") as src:
                if not os.fstat(src.fileno()).st_size:
                    return np.empty(0, dtype)
                return np.frombuffer(mmap.mmap(src.fileno(), 0, access=mmap.ACCESS_READ), dtype)
        except FileNotFoundError:
            return np.empty(0, dtype)
    found, inner = _fs(path)
    if found.get_file_info(inner).size is None:
        return np.empty(0, dtype)
    return np.frombuffer(get(path), dtype)


def kept(path: str, dtype: str = "u1") -> np.ndarray:
    """A blob that this worker may ask for again. Maps need no memory of its own; of blobs that were read, the longest unused go first."""
    if path in _kept:
        _kept.move_to_end(path)
        return _kept[path]
    out = _kept[path] = mapped(path, dtype)
    plain = _local(path) is not None
    held = 0 if plain else sum(x.nbytes for x in _kept.values())
    while len(_kept) > KEEP_MAPS or held > KEEP_BYTES and len(_kept) > 1:
        held -= _kept.popitem(last=False)[1].nbytes
    return out


def input_bytes(df: DataFrame) -> int:
    """Bytes that the planner reckons a table has: files for a scan. It runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def slices_for(df: DataFrame, each: int) -> int:
    """So many slices that one has about ``each`` bytes of the input, and at least one for each shuffle partition.

    Where the planner doesn't know the size (it then gives an absurd one), the shuffle partitions alone decide.
    """
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return max(least, -(-size // each)) if size < 1 << 52 else least
