"""Line dedup with two Bloom filters, of once-seen and twice-seen line hashes.

1. Each task makes its own pair of filters over the keys of its lines (distinct within a document): the 32-bit prints that it has
   seen once and those that it has seen twice, by slices of the hash space. It sends them in sparse form, sorted and delta-coded, as a
   task sets few of all bits; no line and no whole hash goes out.
2. A task per slice merges them into two Bloom filters: what is in the once-seen filter already, or twice in a task, goes into the
   twice-seen filter. The twice-seen filters are files in the shared folder; there are as many slices as the input's bytes
   ask for, a filter's size follows the prints of its slice, and readers map them into memory.
3. A second scan tests its lines. Only suspected repeats are counted (in the task first) and shuffled, as
   128-bit hashes with their number of documents and smallest document: this confirms exactly which keys
   stand in ``min_docs`` documents and which document is the first.
4. A third scan drops lines of the confirmed keys, which are sorted arrays in the shared folder.

A filter's false positives only cost shuffle; it has no false negatives, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.bloom import Bloom, bloom_bits, dense, sparse
from quern.llm.common import as_bytes, as_text, documents, find_pairs, narrow, no_clash, whole_ids

SLICE_BYTES = 64 << 20  # of the input, for each slice of the hash space


def _digests(text: bytes, min_chars: int) -> tuple[list[bytes], list[int]]:
    """All lines of a text, and the 128-bit hash of each line's key or b"" if the key is too short."""
    out = []
    lines = text.split(b"\n")
    for line in lines:
        key = line.strip().lower()  # bytes: ASCII white space and A-Z only
        if not key or min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(b"")
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return lines, out


def _split(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _prints(slices: int, digests: Callable[[bytes], list[bytes]], flush: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[bytes]) -> pa.RecordBatch:
            hi, lo = _split(held)
            code = (hi % np.uint64(slices)) << np.uint64(32) | lo >> np.uint64(32)
            code, n = np.unique(code, return_counts=True)
            part, prints, twice = (code >> np.uint64(32)).astype(np.int64), code.astype(np.uint32), n > 1
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*cuts[1:], len(part)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cuts].astype(np.int32)),
                    pa.array([sparse(prints[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
                    pa.array([sparse(prints[a:b][twice[a:b]]) for a, b in zip(cuts, ends)], pa.binary()),
                ],
                ["slice", "seen", "twice"],
            )

        held: list[bytes] = []
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                found = set(digests(text))
                found.discard(b"")
                held.extend(found)
                if len(held) >= flush:
                    yield send(held)
                    held = []
        if held:
            yield send(held)

    return run


def _merge(folder: str):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("slice")[0].as_py()
        seen = [dense(x) for x in group.column("seen").to_pylist()]
        twice = [dense(x) for x in group.column("twice").to_pylist()]
        bits = bloom_bits(sum(map(len, seen)))
        first, second = Bloom(bits), Bloom(bits)
        for one, two in zip(seen, twice):
            again = first.has(one)
            second.add(one[again])
            second.add(two)
            first.add(one)
        store.put(f"{folder}/twice-{part}", second.array.tobytes())
        return pa.table({"slice": pa.array([part], pa.int32()), "prints": pa.array([sum(map(len, seen))], pa.int64())})

    return run


def _suspected(folder: str, slices: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    part, prints = (hi % np.uint64(slices)).astype(np.int64), (lo >> np.uint64(32)).astype(np.uint32)
    out = np.zeros(len(hi), bool)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        at = order[a:b]
        array = store.kept(f"{folder}/twice-{part[at[0]]}")
        if len(array):
            out[at] = Bloom(int(len(array) * 8).bit_length() - 1, array).has(prints[at])
    return out


def _count(folder: str, slices: int, min_chars: int, flush: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def send() -> pa.RecordBatch:
            hi, lo = _split(list(held))
            arrays = [hi.view(np.int64), lo.view(np.int64)]
            out = [pa.array(x) for x in arrays] + [pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(out, ["hi", "lo", "n", "first"])

        for batch in batches:
            keys, owner = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                found = set(_digests(text, min_chars)[1])
                found.discard(b"")
                keys.extend(found)
                owner.extend([i] * len(found))
            if not keys:
                continue
            for at in np.flatnonzero(_suspected(folder, slices, *_split(keys))):
                have = held.get(keys[at])
                if have is None:
                    held[keys[at]] = [1, owner[at]]
                else:
                    have[0] += 1
                    if have[1] is None or owner[at] is not None and owner[at] < have[1]:
                        have[1] = owner[at]
            if len(held) >= flush:
                yield send()
                held.clear()
        if held:
            yield send()

    return run


def _keys(folder: str):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        hi, lo, first = (group.column(c).combine_chunks().fill_null(-(1 << 63)).to_numpy() for c in ("hi", "lo", "first"))
        order = np.lexsort((lo.view(np.uint64), hi.view(np.uint64)))
        store.put(f"{folder}/keys-{part}", np.stack([hi[order], lo[order], first[order]]).tobytes())
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(lo)], pa.int64())})

    return run


def _confirmed(folder: str, slices: int, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is a confirmed one, and its first document."""
    found, first = np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
    part = (hi % np.uint64(slices)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        at = order[a:b]
        high, low, ids = store.kept(f"{folder}/keys-{part[at[0]]}", "u8").reshape(3, -1)
        i = find_pairs(high, low, hi[at], lo[at])
        found[at] = i >= 0
        first[at[i >= 0]] = ids.view(np.int64)[i[i >= 0]]
    return found, first


def _drop(folder: str, slices: int, min_chars: int, keep_first: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_pylist()
            every, keys, where = [], [], []
            for d, text in enumerate(as_bytes(batch.column("text"))):
                lines, found = _digests(text, min_chars)
                every.append(lines)
                for k, key in enumerate(found):
                    if key:
                        keys.append(key)
                        where.append((d, k))
            n_lines, gone = [len(x) for x in every], [0] * len(every)
            if keys:
                hit, first = _confirmed(folder, slices, *_split(keys))
                spared: set[tuple] = set()
                for at in np.flatnonzero(hit):
                    d, k = where[at]
                    if keep_first and ids[d] == first[at] and (d, keys[at]) not in spared:
                        spared.add((d, keys[at]))
                        continue
                    every[d][k] = None
                    gone[d] += 1
            kept = [b"\n".join(x) if not g else b"\n".join([y for y in x if y is not None]) for x, g in zip(every, gone)]
            made = {"doc_id": batch.column("doc_id"), "text": as_text(kept), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return run


def find_suspects(rows: DataFrame, digests: Callable[[bytes], list[bytes]], folder: str, slices: int) -> None:
    """Writes the twice-seen filters over the keys that ``digests`` gives for the texts of ``rows`` (b"": no key)."""
    prints = rows.select("text").mapInArrow(_prints(slices, digests), "slice int, seen binary, twice binary")
    prints.groupBy("slice").applyInArrow(_merge(folder), "slice int, prints long").agg(F.sum("prints")).collect()


def write_keys(keys: DataFrame, folder: str, slices: int) -> None:
    """Writes confirmed keys (hi, lo, first) as sorted arrays."""
    # the slice by the unsigned high half, as the readers take it
    part = F.pmod(F.shiftrightunsigned("hi", 32) * F.lit((1 << 32) % slices) + F.col("hi").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(slices)).cast("int")
    keys.withColumn("part", part).groupBy("part").applyInArrow(_keys(folder), "part int, n long").agg(F.sum("n")).collect()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, keep: str = "first", min_chars: int = 1, carry: list[str] | None = None) -> DataFrame:
    """Drops lines whose key stands in ``min_docs`` documents or more.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys under
    ``min_chars`` code points never count. ``keep="none"`` drops such lines everywhere, ``"first"``
    spares one in the document with the smallest id. Returns doc_id, text (the other lines joined by
    newlines), n_lines, n_dropped, and the carried columns, which may not have these names (``ValueError``). Ids must be integers.

    A null or empty text has one empty line. A null id is a document of its own; it is the first one
    only if no other document has the line, and then none is spared. Repeated rows count as documents of their own.
    An empty table gives an empty result.
    """
    no_clash(carry, ("doc_id", "text", "n_lines", "n_dropped"))
    whole_ids(docs, id_col)
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col, carry)
    slim = rows.select("doc_id", "text")
    folder = store.new_dir(spark, "lines")
    slices = max(64, 2 * store.slices_for(slim, SLICE_BYTES))
    find_suspects(slim, lambda text: _digests(text, min_chars)[1], folder, slices)
    counts = slim.mapInArrow(_count(folder, slices, min_chars), "hi long, lo long, n long, first long")
    counts = counts.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= min_docs)
    write_keys(counts, folder, slices)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*rows.columns, "n_lines", "n_dropped"]
    schema = ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in names)
    return rows.mapInArrow(_drop(folder, slices, min_chars, keep == "first", names), schema)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir), min_docs=10, keep="none", min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents),
lines AS (
  SELECT row_no, doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM docs) d,
       LATERAL (SELECT unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos) u),
hot AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT row_no) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN h.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM lines LEFT JOIN hot h ON lines.k = h.k GROUP BY row_no, doc_id
"""
