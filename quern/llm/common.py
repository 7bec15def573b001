"""What the training-data operators share: Arrow batches, words by their bytes, 128-bit hashes of words and shingles."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task takes into its numpy work at once.
SLICE_BYTES = 1 << 20
#: Bytes of a batch that goes to a worker, where the session names no limit of its own.
BATCH_BYTES = "4m"
_LIMIT, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "64m"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark) -> None:
    """Sets the session's limit of bytes a batch to ``BATCH_BYTES`` unless it has one: Spark's own 64 MB stand twice in a worker and in its executor."""
    if spark.conf.get(_LIMIT, _UNSET) == _UNSET:
        spark.conf.set(_LIMIT, BATCH_BYTES)


def narrow(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """The id and the text under the names that the operators use, and what the caller carries on. Batches of it are small."""
    small_batches(df.sparkSession)
    cols = [df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")]
    return df.select(*cols, *[df[c] for c in carry or [] if c not in ("doc_id", "text")])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def as_text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of text at most (one long text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a task, and the next one may be another operator's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


P = 0x9E3779B97F4A7C15
_GAP = re.compile(rb"[ \t\n\v\f\r]")


class Numbers(dict):
    """Numbers of words by their bytes, in the order in which they come: two words are one only if all bytes agree."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def stretches(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that end at white space, so that a very long text is not cut into words at once."""
    at = 0
    while len(text) - at > most:
        gap = _GAP.search(text, at + most)
        if gap is None:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:] if at else text


def words(texts: list[bytes], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, Numbers]:
    """Words of all texts, A-Z lower-cased: (number of each word, words of each text, the numbers by word).

    Words stand apart at ASCII white space; with ``table`` bytes are first translated by it.
    """
    known = Numbers()
    get, found = known.__getitem__, []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for part in stretches(text):
            own = (part.lower() if table is None else part.translate(table)).split()
            counts[k] += len(own)
            found.append(np.fromiter(map(get, own), np.int32, len(own)))
    return np.concatenate(found) if found else np.empty(0, np.int32), counts, known


def codes(known: Numbers) -> np.ndarray:
    """The 128-bit hash of each known word, as two lanes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), "<u8").astype(np.uint64).reshape(-1, 2)


def shingles(which: np.ndarray, counts: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of all windows of ``size`` words: (hash in two lanes, text number); a shorter text is one window."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(which)) - first[owner]
    at = np.flatnonzero(place + size <= counts[owner])
    short = np.flatnonzero((counts > 0) & (counts < size))
    out = np.zeros((2, len(at) + len(short)), np.uint64)
    for lane in (0, 1):
        own = np.ascontiguousarray(code[:, lane])[which]
        whole, lone = np.zeros(len(at), np.uint64), np.zeros(len(short), np.uint64)
        for k in range(size):
            whole = mix(whole * np.uint64(P) + own[at + k] + np.uint64(k + 1))
            live = counts[short] > k
            lone[live] = mix(lone[live] * np.uint64(P) + own[first[short[live]] + k] + np.uint64(k + 101))
        out[lane, : len(at)], out[lane, len(at) :] = whole, lone
    return out, np.concatenate([owner[at], short])


def sets(hashes: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text: (hash in two lanes, sorted within the text; number of each text)."""
    order = np.lexsort((hashes[0], owners))
    (one, two), own = hashes[:, order], owners[order]
    twin = (one[1:] == one[:-1]) & (own[1:] == own[:-1])
    if (two[1:] != two[:-1])[twin].any():  # equal in one lane only: the other one decides the order too
        order = np.lexsort((hashes[1], hashes[0], owners))
        (one, two), own = hashes[:, order], owners[order]
        twin = (one[1:] == one[:-1]) & (own[1:] == own[:-1])
    keep = np.ones(len(one), bool)
    keep[1:] = ~(twin & (two[1:] == two[:-1]))
    return np.stack([one[keep], two[keep]]), np.bincount(own[keep], minlength=n)


def find_pairs(high: np.ndarray, low: np.ndarray, want_high: np.ndarray, want_low: np.ndarray) -> np.ndarray:
    """Places of 128-bit keys in arrays sorted by their high lane, -1 for those that are not there.

    Keys that share a high lane stand in one run; it is searched to its end.
    """
    out = np.full(len(want_high), -1, np.int64)
    at, live = np.searchsorted(high, want_high), np.arange(len(want_high))
    while len(live):
        live = live[at[live] < len(high)]
        live = live[high[at[live]] == want_high[live]]
        hit = low[at[live]] == want_low[live]
        out[live[hit]] = at[live[hit]]
        live = live[~hit]
        at[live] += 1
    return out


def no_clash(carry: list[str] | None, made: tuple[str, ...]) -> None:
    """Carried columns may not have the names of the columns that an operator makes."""
    if clash := {c.lower() for c in carry or []} & set(made):
        raise ValueError(f"carried columns have names of results: {sorted(clash)}")


def whole_ids(df: DataFrame, id_col: str) -> None:
    """Ids must be integers, as the smallest one has a meaning."""
    if (kind := df.schema[id_col].dataType.typeName()) not in ("byte", "short", "integer", "long"):
        raise ValueError(f"the ids in {id_col} are no integers but of type {kind}")


def crc_text(col) -> "F.Column":
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))
