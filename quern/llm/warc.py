"""WARC archives in seekable Zstandard bundles.

A bundle holds WARC records in independent frames of about ``FRAME_BYTES``, one frame for a longer record.
A skippable frame at its end is the seek table of the public seekable format (a line for each frame: compressed
and decompressed size; number of frames, descriptor, magic number). An index table maps each record to its bundle,
frame and offset within the decompressed frame, so a record is read with the seek table and one frame.

Records with equal payloads: the smallest id stands as ``response``; the others are ``revisit`` records that refer to
it. Digests are computed in the JVM and the smallest id by digest is a grouped minimum (summed up before
the shuffle); the rows of a payload meet it by a salt too, so a payload with very many copies is no hot spot. Bundles are written under a private name and
renamed to the number of their partition.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.common import as_bytes, whole_ids

FRAME_BYTES = 256 << 10
SALTS = 8  # parts of the rows of one payload
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed values of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "page_id long, bundle string, frame int, at long, length long"


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC record; a revisit has no block of its own."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, block, end) of the record that begins at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    start = stop + 4
    end = start + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record without its end")
    return fields, data[start:end], end + 4


class Bundle:
    """Writes records into frames and the seek table behind them."""

    def __init__(self, out, level: int = 3):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset within it, length) of the record."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = self.size
        self.held.append(data)
        self.size += len(data)
        return len(self.frames), at, len(data)

    def flush(self) -> None:
        if self.size:
            packed = self.pack.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


def seek_table(path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the footer alone."""
    total = store.size(path)
    n, flags, magic = struct.unpack("<IBI", store.get(path, total - 9, 9))
    if magic != SEEKABLE:
        raise ValueError(f"{path} has no seek table")
    width = 12 if flags & 0x80 else 8
    rows = store.get(path, total - 9 - n * width, n * width)
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", rows, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(path: str, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle, by its place in the index."""
    start, packed, plain = seek_table(path)[frame]
    data = zstandard.ZstdDecompressor().decompress(store.get(path, start, packed), max_output_size=plain)
    return parse(data, at)[:2]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        rows = []
        with store.writing(name) as out:
            bundle = Bundle(out)
            for batch in batches:
                urls, digests, refers = (batch.column(c).to_pylist() for c in ("url", "digest", "refers_to"))
                for page, url, payload, digest, other in zip(batch.column("page_id").to_pylist(), urls, as_bytes(batch.column("html")), digests, refers):
                    rows.append((page, name, *bundle.add(record(page, url, payload, digest, other))))
            bundle.close()
        if rows:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "bundle", "frame", "at", "length"])
        else:
            store.remove_blob(name)

    return run


def write_archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Writes a record for each row and returns the index (page_id, bundle, frame, at, length).

    Of records with equal payloads of at least ``min_bytes`` bytes the smallest id is the response and the
    others, also those with a null id, revisit it; a row that repeats the smallest id is a response too, and so are all
    rows of a payload of which no row has an id. A null payload is empty. An empty table gives no bundle. Ids must be integers.
    """
    whole_ids(pages, id_col)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("html"))
    small = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n"))
    groups = small.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.bool_or(F.col("page_id").isNull()).alias("anon"))
    # copies only: few and narrow rows, whatever the payloads; the salt deals a payload of very many copies
    groups = groups.filter("low < high OR anon").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = small.filter(F.col("n") >= min_bytes).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    copies = salted.join(groups, ["digest", "salt"]).filter((F.col("page_id") > F.col("low")) | F.col("page_id").isNull() & F.col("low").isNotNull())
    copies = copies.select(F.col("page_id").alias("copy"), F.col("digest").alias("copied"), F.col("low").alias("refers_to")).distinct()
    # the digest decides too: a repeated id with another payload is no copy
    rows = rows.withColumn("digest", F.sha2("html", 256))
    rows = rows.join(copies, F.col("page_id").eqNullSafe(F.col("copy")) & (F.col("digest") == F.col("copied")), "left")
    index = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(folder), INDEX)
    return store.table(index, f"{folder}/index")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for name, frame, skip, packed, plain in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "skip", "packed", "plain"))):
            data, at, rows = unpack.decompress(store.get(name, skip, packed), max_output_size=plain), 0, []
            while at < len(data):
                fields, block, end = parse(data, at)
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != int(fields["WARC-Payload-Length"])):
                    raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
                page, other = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
                rows.append((page and int(page), fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), digest, kind, other and int(other), name, frame, at, block if kind == "response" else None))
                at = end
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in RECORDS.split(", ")])


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, at long, payload binary"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column("bundle").to_pylist():
            rows = [(name, k, *x) for k, x in enumerate(seek_table(name))]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bundle", "frame", "skip", "packed", "plain"])


def read_archive(index: DataFrame) -> DataFrame:
    """Reads every frame of the bundles back (dealt out by frame) and checks each response against its digest."""
    spark = index.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bundles = index.select("bundle").distinct()
    frames = bundles.mapInArrow(_tables, "bundle string, frame int, skip long, packed long, plain long")
    return frames.repartition(width, "bundle", "frame").mapInArrow(_frames, RECORDS)


def _drop_payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _frames(batches):
        yield batch.select(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archive(pages, store.new_dir(spark, "warc"), min_bytes=100)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames = index.select("bundle").distinct().mapInArrow(_tables, "bundle string, frame int, skip long, packed long, plain long")
    return frames.repartition(width, "bundle", "frame").mapInArrow(_drop_payload, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM d),
c AS (SELECT *, payload_bytes >= 100 AND low IS NOT NULL AND (page_id IS NULL OR page_id > low) AS copy FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN copy THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN copy THEN low END AS refers_to
FROM c
"""
