"""Bloom filters in files of the shared folder, by slices of the hash space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.common import mix

SLICE_KEYS = 1 << 20


def bloom_bits(n: int) -> int:
    """Bits of a filter for n prints: 12 to 24 a print, a power of two."""
    return max(10, int(12 * max(n, 1) - 1).bit_length())


def _places(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's four bit positions of each print, by double hashing."""
    x = prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    a, b = x, (x >> np.uint64(33)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    return [(a + np.uint64(k) * b) & mask for k in range(4)]


class Bloom:
    """A Bloom filter on a byte array; ``array`` may be mapped from a file."""

    def __init__(self, bits: int, array: np.ndarray | None = None):
        self.bits = bits
        self.array = np.zeros((1 << bits) // 8, np.uint8) if array is None else array

    def add(self, prints: np.ndarray) -> None:
        for at in _places(prints, self.bits):
            np.bitwise_or.at(self.array, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, prints: np.ndarray) -> np.ndarray:
        found = np.ones(len(prints), bool)
        for at in _places(prints, self.bits):
            found &= (self.array[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def sparse(prints: np.ndarray) -> bytes:
    """Sorted prints by their differences, byte by byte, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(prints, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes())


def dense(data: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(plain.reshape(4, -1).T).view(np.uint32).reshape(-1), dtype=np.uint32)


def _sliced(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = mix(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            part, prints = (code % np.uint64(slices)).astype(np.int64), (code >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((prints, part))
            part, prints = part[order], prints[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            rows = [(int(part[a]), sparse(prints[a:b])) for a, b in zip(cuts, [*cuts[1:], len(part)])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in ((0, pa.int32()), (1, pa.binary()))], ["slice", "seen"])

    return run


def _built(folder: str):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("slice")[0].as_py()
        prints = np.unique(np.concatenate([dense(x) for x in group.column("seen").to_pylist()]))
        own = Bloom(bloom_bits(len(prints)))
        own.add(prints)
        store.put(f"{folder}/sieve-{part}", own.array.tobytes())
        return pa.table({"slice": pa.array([part], pa.int32())})

    return run


def sieve(keys: DataFrame, folder: str):
    """Builds a filter over the whole numbers in ``key`` and gives a column function: whether a number may be among them.

    It never says no to one that is. So a table can be sifted where it stands, and only what may match goes to an exact join.
    """
    slices = max(1, -(-keys.count() // SLICE_KEYS))
    keys.select("key").mapInArrow(_sliced(slices), "slice int, seen binary").groupBy("slice").applyInArrow(_built(folder), "slice int").count()

    def may_have(key: pa.Array) -> pa.Array:
        code = mix(key.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        part, prints = (code % np.uint64(slices)).astype(np.int64), (code >> np.uint64(32)).astype(np.uint32)
        out = np.zeros(len(code), bool)
        for s in np.unique(part):
            array = store.kept(f"{folder}/sieve-{s}")
            if len(array):
                at = np.flatnonzero(part == s)
                out[at] = Bloom(len(array).bit_length() + 2, array).has(prints[at])
        return pa.array(out)

    return F.arrow_udf(may_have, "boolean")
