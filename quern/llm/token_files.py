"""Token ids in Parquet list columns, for selective reads of tokens and metadata.

Rows are dealt into ranges of (id, text hash) and sorted, so part files in order of their number hold the documents in
ascending order. A file has row groups of about ``GROUP_TOKENS`` ids (dictionary-encoded: the vocabulary is
bounded), delta-encoded metadata columns, small pages and page indexes; so a reader takes the ids of a few
documents, or no ids at all, without reading the rest. A manifest has a row for each row group.

A task writes under a private name and renames the file to the number of its partition when it is whole;
a task that runs again writes the same.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import bpe, store
from quern.llm.common import Numbers, as_bytes, documents, narrow, pieces, stretches, whole_ids

GROUP_TOKENS = 1 << 20
PAGE_BYTES = 64 << 10
TEXT_BYTES = 4 << 20  # of texts that are encoded at once
UNITS = 400_000  # units whose ids a worker keeps
#: Latin letters that the normaliser only lower-cases, each by itself. Anything else in a unit goes through the file's pre-tokeniser.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ž]+")
_encoders: dict = {}


def encoder(path: str) -> bpe.Known:
    """This worker's units and their ids, as the tokenizers library encodes them."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        own = bpe.codec(path)[0]
        model, letters = lib.model, own.letters

        def make(unit: bytes) -> bytes:
            if own.fast and unit.isalpha():  # ASCII letters: a word that the normaliser only lower-cases and the pre-tokeniser leaves whole
                ids = [t.id for t in model.tokenize(unit.lower().decode())]
            else:
                text = unit.decode("utf-8", "replace")
                if own.fast and _LETTERS.fullmatch(text):  # Latin letters alone are one word too
                    word = "".join(map(str.lower, text)).encode()
                    ids = [t.id for t in model.tokenize("".join([letters[b] for b in word]))]
                else:
                    ids = lib.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes()

        _encoders[path] = bpe.Known(make, UNITS)
    return _encoders[path]


def encode_slice(texts: list[bytes], path: str, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each text), with ``end`` after each text.

    The slice's different units are looked up once; the ids of all are then gathered by the units' numbers.
    """
    cache, known = encoder(path), Numbers()
    get, found = known.__getitem__, []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for part in stretches(text):
            own = bpe.units(part)
            counts[k] += len(own)
            found.append(np.fromiter(map(get, own), np.int64, len(own)))
        if end is not None:  # one more unit at the end of each text
            counts[k] += 1
            found.append(np.array([-1]))
    which = np.concatenate(found) if found else np.empty(0, np.int64)
    spelt = [cache[x] for x in known] + [b"" if end is None else array("I", [end]).tobytes()]  # the last one is the end
    size = np.fromiter(map(len, spelt), np.int64, len(spelt)) // 4
    pool, first, lengths = np.frombuffer(b"".join(spelt), "<u4"), np.cumsum(size) - size, size[which]
    stop = np.cumsum(lengths)
    where = np.repeat(first[which] - (stop - lengths), lengths) + np.arange(int(stop[-1]) if len(stop) else 0)
    return pool[where], np.diff(np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32(), False)))])
MANIFEST = "part int, path string, row_group int, n_docs long, n_tokens long, first_start long, min_id long, max_id long"


def _write(path: str, folder: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sink = None
        start, held, many = 0, [], 0
        out: list[tuple] = []

        def flush() -> None:
            nonlocal held, many
            table = pa.concat_tables(held)
            sink.write_table(table, row_group_size=table.num_rows)
            ids = pa.compute.min_max(table.column("doc_id")).as_py()
            out.append((len(out), table.num_rows, many, table.column("start_in_file")[0].as_py(), ids["min"], ids["max"]))
            held, many = [], 0

        name = f"{folder}/part-{part:06d}.parquet"
        with store.writing(name) as file:
            for batch in pieces(batches, most=TEXT_BYTES):
                ids, sizes = encode_slice(as_bytes(batch.column("text")), path, end)
                if sink is None:
                    sink = pq.ParquetWriter(file, _SCHEMA, compression="zstd", compression_level=1, use_dictionary=["ids.list.element"], column_encoding={"doc_id": "DELTA_BINARY_PACKED", "start_in_file": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, data_page_size=PAGE_BYTES, write_page_index=True, dictionary_pagesize_limit=4 << 20)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)), type=_SCHEMA.field("ids").type)
                table = pa.table([batch.column("doc_id"), pa.array(start + offsets[:-1]), pa.array(sizes), lists], schema=_SCHEMA)
                start += int(offsets[-1])
                # whole documents until a group is full
                at = 0
                while at < table.num_rows:
                    room = int(np.searchsorted(offsets, offsets[at] + max(GROUP_TOKENS - many, 1), "left"))
                    stop = min(max(room, at + 1), table.num_rows)
                    held.append(table.slice(at, stop - at))
                    many += int(offsets[stop] - offsets[at])
                    at = stop
                    if many >= GROUP_TOKENS:
                        flush()
            if sink is not None:
                if held:
                    flush()
                sink.close()
        if sink is None:
            store.remove_blob(name)
        rows = [(part, name, *x) for x in out]
        if rows:
            kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["part", "path", "row_group", "n_docs", "n_tokens", "first_start", "min_id", "max_id"])

    return run


def write_tokens(docs: DataFrame, path: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end: int | None = 2) -> DataFrame:
    """Encodes each text, appends ``end`` and writes the files; returns the manifest, a row for each row group.

    A null or empty text has the end id alone. Null ids come first; rows of the same id stand in the order of
    their texts' hashes. An empty table gives no file and an empty manifest. The ids must be integers (``ValueError``); other columns are not looked at.
    """
    bpe._require_spaces(path)
    whole_ids(docs, id_col)
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    # by the text's hash and the row too: one id, or one id and text, with very many rows goes to many files
    keys = ["doc_id", "tie", "row"]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    manifest = rows.select("doc_id", "text").mapInArrow(_write(path, folder, end), MANIFEST)
    return store.table(manifest, f"{folder}/manifest")


def _read(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, group, base in zip(*(batch.column(c).to_pylist() for c in ("path", "row_group", "base"))):
                with store.reading(name) as src:
                    table = pq.ParquetFile(src).read_row_group(group, columns=list(columns))
                n = table.column("n_tokens").combine_chunks()
                made = {"doc_id": table.column("doc_id").combine_chunks(), "n_tokens": n}
                made["start"] = pa.compute.add(table.column("start_in_file").combine_chunks(), base)
                if "ids" in columns:
                    made["ids"] = table.column("ids").combine_chunks().cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    return run


def _files(manifest: DataFrame) -> DataFrame:
    """Each file with the number of ids in the files before it. The window goes over one row a file."""
    files = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.select("part", F.coalesce(before, F.lit(0)).alias("base"))


def _located(manifest: DataFrame) -> DataFrame:
    """Row groups with the number of ids in the files before theirs."""
    files = _files(manifest)
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.join(files, "part").repartition(width, "path", "row_group").select("path", "row_group", "base")


def read_tokens(manifest: DataFrame, *, ids: bool = True, min_id: int | None = None, max_id: int | None = None) -> DataFrame:
    """Reads the files back: doc_id, n_tokens, start (ids of all documents before it), and ids unless only metadata is asked for.

    A range of ids opens only the row groups that can have it.
    """
    groups = _located(manifest)
    if min_id is not None or max_id is not None:
        low, high = F.lit(min_id if min_id is not None else -(1 << 63)), F.lit(max_id if max_id is not None else (1 << 63) - 1)
        keep = manifest.filter((F.col("max_id") >= low) & (F.col("min_id") <= high)).select("path", "row_group")
        groups = groups.join(keep, ["path", "row_group"], "left_semi")
    out = groups.mapInArrow(_read(["doc_id", "start_in_file", "n_tokens"] + ["ids"] * ids), "doc_id long, n_tokens long, start long" + ", ids array<int>" * ids)
    if min_id is not None or max_id is not None:
        out = out.filter(F.col("doc_id").between(low, high))
    return out


def pick_tokens(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """The documents with the given ids: doc_id, n_tokens, start, ids. The page indexes lead to the pages that have them.

    Files without such an id aren't opened; in the others Spark's reader takes the filter to the column index of ``doc_id``, and reads only
    those pages of the other columns that the rows found stand in. Rows that repeat an id all come; a null can't be asked for.
    """
    spark, one_of = manifest.sparkSession, F.col("doc_id").isin(wanted)
    asked = F.exists(F.lit(list(wanted)) if wanted else F.array().cast("array<long>"), lambda i: i.between(F.col("min_id"), F.col("max_id")))
    bases = _files(manifest)
    paths = [r["path"] for r in manifest.filter(asked).select("path").distinct().collect()]
    schema = "doc_id long, n_tokens long, start long, ids array<int>"
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema("doc_id long, start_in_file long, n_tokens long, ids array<int>").parquet(*paths)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = rows.filter(one_of).select(part.alias("part"), "doc_id", "n_tokens", "start_in_file", "ids")
    return rows.join(bases, "part").select("doc_id", "n_tokens", (F.col("base") + F.col("start_in_file")).alias("start"), "ids")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(["doc_id", "start_in_file", "n_tokens", "ids"])(batches):
        lists = batch.column("ids")
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        data = flat.astype("<u4").tobytes()
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op2_token_files(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    manifest = write_tokens(documents(spark, sf_dir), path or bpe.word_tokenizer(), store.new_dir(spark, "tokens"), end=2)
    return _located(manifest).mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
