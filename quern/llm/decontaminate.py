"""Benchmark decontamination by a distributed positional inverted index.

**Index.** Each task cuts its documents into blocks of about ``BLOCK_BYTES`` of text (a longer document is one block)
and stores for each block its terms as they are, sorted, and the postings of each: their places among the block's words,
delta-coded from the term's first place. A block is one row of packed arrays. So the index is partitioned by
document: no term gathers in one task, and a search needs no shuffle.

**Search.** Terms of the test items are counted over the whole index. A window of an item is filed under its rarest term:
a block takes only the windows whose rarest term it has. That term's postings are intersected with those of the
next rare ones, adjusted by their offsets, until nothing is left or the phrase stands. With ``slop`` above 0 the
same lists give proximity matches: all terms of the window in their order, with at most ``slop`` other words between neighbours.

Items are cut into parts of at most ``chunk`` windows on the workers, and go to the tasks in passes of about 8 x ``chunk`` bytes of
words: more of them mean more passes over the index, not a larger broadcast. Equal windows are one query however many items have them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.common import as_bytes, documents, narrow, no_clash, pieces, whole_ids, words

BLOCK_BYTES = 2 << 20
CHUNK = 50_000
#: A-Z lower-cased; ASCII signs and control characters, [\x00-\x2F\x3A-\x60\x7B-\x7F], become spaces, as they are in no word.
APART = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4").astype(np.int64)


_POSTINGS = {"block": "long", "terms": "binary", "counts": "binary", "places": "binary", "sizes": "binary"}


def _index(passed: list[str], kinds: list[pa.DataType]):
    names = [*_POSTINGS, "n_words", *passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33  # a block is named by the number of its first row
        for batch in pieces(batches, most=BLOCK_BYTES):
            which, counts, known = words(as_bytes(batch.column("text")), APART)
            n = batch.num_rows
            none = [pa.nulls(n, pa.binary())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), *none, pa.array(counts), *(batch.column(c) for c in passed)], names)
            if len(which):
                lexicon = sorted(known)
                rank = np.empty(len(lexicon), np.int32)
                rank[[known[w] for w in lexicon]] = np.arange(len(lexicon))
                term = rank[which]
                order = np.argsort(term, kind="stable")
                term = term[order]
                heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                step = np.diff(order, prepend=0)  # absolute at the first place of a term
                step[heads] = order[heads]
                terms = zstandard.ZstdCompressor(level=1).compress(b" ".join(lexicon))
                made = (terms, pack(np.diff(heads, append=len(term))), pack(step), pack(counts))
                none = [pa.nulls(1, k) for k in (pa.int64(), *kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([row]), *(pa.array([x], pa.binary()) for x in made), *none], names)
            row += n

    return run


def build_index(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row of postings for each block, a row for each document) of whole texts, written to the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = narrow(docs, id_col, text_col, carry).withColumn("doc_id", F.col("doc_id").cast("long"))
    passed = [c for c in rows.columns if c != "text"]
    kinds = _POSTINGS | {"n_words": "long"} | {c: rows.schema[c].dataType.simpleString() for c in passed}
    made = rows.mapInArrow(_index(passed, [to_arrow_type(rows.schema[c].dataType) for c in passed]), ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
    both = store.table(made, f"{folder}/index")
    return both.filter("terms is not null").select(*_POSTINGS), both.filter("terms is null").select(F.col("block").alias("row"), "n_words", *passed)


def lexicon_of(data: bytes) -> list[bytes]:
    """The terms of a block in their order."""
    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def _count(wanted: set[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for terms, n in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                n = unpack(n)
                for k, term in enumerate(lexicon_of(terms)):
                    if term in wanted:
                        total[term] = total.get(term, 0) + int(n[k])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return run


def _cut(size: int, chunk: int):
    """Items of very many words in parts of ``chunk`` windows: so no single row is long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text"))):
                own = text.translate(APART).split()
                starts = range(0, max(1, len(own) - size + 1), chunk) if own else ()
                parts = [b" ".join(own[a : a + chunk + size - 1]) for a in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.binary())], ["item", "words"])

    return run


class Windows:
    """Distinct windows of the test items by their words, and the items of each."""

    def __init__(self, items: list[tuple], size: int):
        self.items: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            own = text.split(b" ")
            for k in range(max(1, len(own) - size + 1)):
                self.items[tuple(own[k : k + size])].add(item)
        self.terms = {w for key in self.items for w in key}


def phrase(post, window: tuple[bytes, ...], order: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of all matches of a window in one block; ``post`` gives a term's places."""
    if not slop:
        start = None
        for k in order:
            places = post(window[k])
            if places is None:
                return _NONE, _NONE
            places = places - k
            if start is None:
                start = places
            else:
                at = np.minimum(np.searchsorted(places, start), len(places) - 1)
                start = start[places[at] == start]
            if not len(start):
                return _NONE, _NONE
        return start, start + len(window) - 1
    # proximity: chains that begin at each place of the first term, in order of the window, each step the nearest one
    lists = {}
    for k in order:
        lists[k] = post(window[k])
        if lists[k] is None:
            return _NONE, _NONE
    ends = [(p, p) for p in lists[0].tolist()]
    for k in range(1, len(window)):
        step, places = [], lists[k]
        for start, last in ends:
            a, b = np.searchsorted(places, last + 1), np.searchsorted(places, last + 1 + slop, "right")
            step.extend((start, int(p)) for p in places[a:b])
        ends = list(dict.fromkeys(step))
        if not ends:
            return _NONE, _NONE
    starts, lasts = zip(*ends)
    return np.array(starts), np.array(lasts)


_NONE = np.empty(0, np.int64)


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _search(windows: list[tuple[tuple[bytes, ...], list[int], list]], slop: int):
    wanted = {w for key, _, _ in windows for w in key}
    by_rarest: dict[bytes, list] = defaultdict(list)
    for window in windows:
        by_rarest[window[0][window[1][0]]].append(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, terms, counts, places, sizes in zip(*(batch.column(c).to_pylist() for c in _POSTINGS)):
                at = {w: k for k, w in enumerate(lexicon_of(terms)) if w in wanted}
                asked = [w for w in at if w in by_rarest]  # a window whose rarest term is not in the block is not looked at
                if not asked:
                    continue
                ends, steps, sizes = np.cumsum(unpack(counts)), unpack(places), unpack(sizes)
                lists: dict[bytes, np.ndarray] = {}

                def post(word: bytes) -> np.ndarray | None:
                    if word not in lists and word in at:
                        k = at[word]
                        lists[word] = np.cumsum(steps[ends[k - 1] if k else 0 : ends[k]])
                    return lists.get(word)

                stop = np.cumsum(sizes)
                first = stop - sizes
                out: dict[int, list] = {}
                for key, order, items in (x for w in asked for x in by_rarest[w]):
                    start, last = phrase(post, key, order, slop)
                    if not len(start):
                        continue
                    doc = np.searchsorted(stop, start, "right")
                    for d, a, b in zip(doc.tolist(), start.tolist(), last.tolist()):
                        if b < stop[d]:  # within one document
                            have = out.setdefault(d, [set(), set()])
                            have[0].update(items)
                            have[1].add((a - int(first[d]), b - int(first[d])))
                keep = sorted(out)
                if keep:
                    spans = [[{"first": a, "last": b} for a, b in sorted(out[d][1])] for d in keep]
                    yield pa.RecordBatch.from_arrays([pa.array([row + d for d in keep]), pa.array([sorted(out[d][0]) for d in keep], pa.list_(pa.string())), pa.array(spans, SPANS)], ["row", "items", "spans"])

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, slop: int = 0, chunk: int = CHUNK, carry: list[str] | None = None) -> DataFrame:
    """Finds every occurrence of windows of ``size`` words of the items in the documents.

    Words have letters a-z (A-Z lower-cased), digits and anything beyond ASCII; an item of fewer words, but not none, is one window.
    Returns per document: doc_id, row (a number of the row), n_words, n_hit (words inside any occurrence), items (sorted ids of the items
    found, as strings), spans (first and last word of each occurrence), and the carried columns, which may not have these names
    (``ValueError``). Documents without words, with null text or id, and repeated rows stay. The windows of an item with a null id hit
    words, but no id is listed for it. Items without words match nothing; empty tables give no match. Document ids must be integers.
    """
    no_clash(carry, ("doc_id", "text", "row", "n_hit", "items", "spans", "n_words", *_POSTINGS))
    whole_ids(docs, id_col)
    folder = store.new_dir(docs.sparkSession, "postings")
    index, rows = build_index(docs, folder, id_col=id_col, text_col=text_col, carry=carry)
    passed = ["doc_id", "row", "n_words"]
    test = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text].cast("string").alias("text"))
    test = store.table(test.mapInArrow(_cut(size, chunk), "item string, words binary").distinct(), f"{folder}/test")
    found = None
    # test items are read in parts of bounded size, so neither the driver nor a broadcast holds more than some chunk of windows
    parts = max(1, -(-int(test.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]) // (chunk * 8)))
    for part in range(parts):
        windows = Windows([(r["item"], bytes(r["words"])) for r in test.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).collect()], size)
        if not windows.items:
            continue
        counted = index.select("terms", "counts").mapInArrow(_count(windows.terms), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {bytes(r.term): r.n for r in counted.collect()}  # terms of this part only
        plan = []
        for key, items in windows.items.items():
            n = [counts.get(t, 0) for t in key]
            if all(n):
                plan.append((key, sorted(range(len(n)), key=n.__getitem__), sorted(i for i in items if i is not None)))
        if plan:
            hits = index.mapInArrow(_search(plan, slop), "row long, items array<string>, spans array<struct<first: long, last: long>>")
            found = hits if found is None else found.union(hits)
    if found is None:
        return rows.select(*passed, F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<first: long, last: long>>").alias("spans"), *(carry or []))
    if parts > 1:
        found = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    found = store.table(found, f"{folder}/found")
    # spans are sorted by their first word: words beyond the furthest end so far are new
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")), lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["last"] - F.greatest(s["first"] - F.lit(1), acc["end"]))).alias("n"), F.greatest(acc["end"], s["last"]).alias("end")), lambda acc: acc["n"])
    out = rows.join(found.withColumn("n_hit", covered), "row", "left")
    return out.select(*passed, F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<first: long, last: long>>")).alias("spans"), *(carry or []))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    out = find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN sizes ON len(ws) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM di),
m AS (SELECT doc_id, item_id, dw.i, n FROM dw JOIN bw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""
