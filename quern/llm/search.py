"""Ranked lexical search: documents in turn by a heap merge over the postings of each shard, then a merge of the shards' best.

**Index.** Each task cuts its documents into shards of about ``SHARD_BYTES`` of text (a longer document is one shard). A shard has its
documents sorted by id, its terms, and for each term the documents that hold it (delta-coded places in that order) with the
counts, compressed. So the index is partitioned by document: no term's postings gather in one task.

**Queries.** Document frequencies of the asked terms come from one scan of the index; they are joined to the queries' terms. Queries
with their weights go to the shared folder in files of about ``FILE_BYTES``, which workers read one at a time: more queries mean more files,
not more passes over the index nor a larger broadcast.

**Search.** A query's postings in a shard are merged by a heap of cursors keyed by document. A result heap of k entries, keyed by score
and then by id, gives the score that a document must reach. Terms whose largest scores together stay below it are not merged: they
are looked up for the documents that can still get there (bounds are sums of whole numbers, so nothing is lost). Within a task the
result heaps go on from shard to shard. The best k of all tasks are ranked by a window, which Spark cuts to k rows a query before its shuffle.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.common import as_bytes, documents, narrow, pieces, small_batches, whole_ids, words
from quern.llm.decontaminate import APART, pack, unpack

SHARD_BYTES = 4 << 20
FILE_BYTES = 4 << 20
#: Queries whose result heaps a task carries from shard to shard; where there are more, each shard gives its best of them.
CARRIED = 50_000
#: Fixed values of the score: thousandths of the weight and scale of a term's share.
THOUSAND, SCALE = 1000, 1_000_000_000
_LAST = 1 << 63  # a null id comes after all others

_SHARD = {"terms": "binary", "dfs": "binary", "places": "binary", "tfs": "binary", "ids": "binary", "sizes": "binary", "n_docs": "long", "n_terms": "long"}


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=SHARD_BYTES):
        which, counts, known = words(as_bytes(batch.column("text")), APART)
        if not len(which):
            continue
        ids, n = batch.column("doc_id"), batch.num_rows
        order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        key, tf = np.unique(which.astype(np.int64) * n + np.repeat(place, counts), return_counts=True)
        term, doc = key // n, key % n
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        step = np.diff(doc, prepend=0)
        step[heads] = doc[heads]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        made = [squeeze(b" ".join(known)), pack(np.diff(heads, append=len(term))), pack(step), pack(tf)]
        sorted_ids = ids.take(pa.array(order))
        held = pa.compute.fill_null(sorted_ids, 0).to_numpy()
        made += [squeeze(held.astype("<i8").tobytes() + sorted_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()), pack(counts[order])]
        cols = [*(pa.array([x], pa.binary()) for x in made), pa.array([int((counts > 0).sum())], pa.int64()), pa.array([int(counts.sum())], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, list(_SHARD))


def build_index(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard, written to the shared folder. Documents without terms are in no shard."""
    rows = narrow(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return store.table(rows.mapInArrow(_index, ", ".join(f"{c} {k}" for c, k in _SHARD.items())), f"{folder}/index")


def _lexicon(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different terms of each query."""
    for batch in batches:
        for query, text in zip(batch.column("query").to_pylist(), as_bytes(batch.column("text"))):
            own = list(dict.fromkeys(text.translate(APART).split()))
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(own), pa.string()), pa.array(own, pa.binary())], ["query", "term"])


def _prints(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms))


def _write_prints(folder: str):
    """Hashes of the asked terms, sorted, a blob for each task: what is in none of them needs no counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_prints(as_bytes(b.column("term"))) for b in batches if b.num_rows]
        if found:
            name = f"{folder}/prints-{TaskContext.get().partitionId():06d}"
            store.put(name, np.unique(np.concatenate(found)).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return run


def _frequencies(names: list[str]):
    """Documents of each shard that hold an asked term. Terms of one hash with an asked one are counted too, under their own names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [store.kept(n, "<u8") for n in names]
        for batch in batches:
            for data, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist()):
                lexicon = _lexicon(data)
                own = _prints(lexicon)
                hit = np.zeros(len(own), bool)
                for x in asked:
                    at = np.searchsorted(x, own)
                    hit |= x[np.minimum(at, len(x) - 1)] == own
                at = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array([lexicon[k] for k in at.tolist()], pa.binary()), pa.array(unpack(dfs)[at])], ["term", "df"])

    return run


def _write_queries(folder: str, n_docs: int):
    """Queries with the weights of their terms in files of bounded size (one query is never cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, held, size = TaskContext.get().partitionId(), [], [], 0
        counts: list[int] = []

        def flush() -> None:
            nonlocal held, size
            sink = pa.BufferOutputStream()
            table = pa.table({"query": [q for q, _, _ in held], "terms": pa.array([t for _, t, _ in held], pa.list_(pa.binary())), "weights": pa.array([w for _, _, w in held], pa.list_(pa.int64()))})
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            names.append(f"{folder}/queries-{part:06d}-{len(names):06d}")
            counts.append(len(held))
            store.put(names[-1], sink.getvalue().to_pybytes())
            held, size = [], 0

        for batch in batches:
            for query, terms in zip(batch.column("query").to_pylist(), batch.column("terms").to_pylist()):
                found = [(bytes(t["term"]), weight(n_docs, t["df"])) for t in terms]
                found = sorted((t, w) for t, w in found if w > 0)
                if found:
                    held.append((query, [t for t, _ in found], [w for _, w in found]))
                    size += sum(len(t) + 16 for t, _ in found)
                    if size >= FILE_BYTES:
                        flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "n"])

    return run


def weight(n_docs: int, df: int) -> int:
    """The whole weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(THOUSAND * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """One shard's postings, opened for the terms that are asked."""

    def __init__(self, row: dict, wanted, n_docs: int, n_terms: int, b: int, k1: int):
        self.at = {t: k for k, t in enumerate(_lexicon(row["terms"])) if t in wanted}
        if not self.at:
            return
        self.dfs, self.places, self.tfs = unpack(row["dfs"]), unpack(row["places"]), unpack(row["tfs"])
        self.ends = np.cumsum(self.dfs)
        data = zstandard.ZstdDecompressor().decompress(row["ids"])
        sizes = unpack(row["sizes"]).tolist()
        null = np.frombuffer(data, np.uint8, len(sizes), 8 * len(sizes))
        self.ids = [_LAST if gone else i for i, gone in zip(np.frombuffer(data, "<i8", len(sizes)).tolist(), null.tolist())]
        # whole numbers of any size: the product may be beyond 64 bits in a very large corpus
        self.norm = np.array([k1 * (100 - b + b * n * n_docs // n_terms) for n in sizes], np.int64)
        self.shares: dict[bytes, tuple[list[int], np.ndarray, int]] = {}
        self.maps: dict[bytes, dict[int, int]] = {}

    def share(self, term: bytes) -> tuple[list[int], np.ndarray, int]:
        """(documents, what the term adds to their scores before its weight, the most of it)."""
        if (found := self.shares.get(term)) is None:
            k = self.at[term]
            own = slice(self.ends[k] - self.dfs[k], self.ends[k])
            doc, tf = np.cumsum(self.places[own]), self.tfs[own]
            adds = (SCALE * tf) // (THOUSAND * tf + self.norm[doc])
            found = self.shares[term] = (doc.tolist(), adds.tolist(), int(adds.max()))
        return found

    def lookup(self, term: bytes) -> dict[int, int]:
        if (found := self.maps.get(term)) is None:
            docs, adds, _ = self.share(term)
            found = self.maps[term] = dict(zip(docs, adds))
        return found

    def search(self, terms: list[bytes], weights: list[int], best: list[tuple[int, int]], k: int) -> None:
        """Puts the shard's documents into ``best``, a heap of at most k (score, -id)."""
        lists = sorted(((w * self.share(t)[2], w, t) for t, w in zip(terms, weights) if t in self.at), key=lambda x: x[:2])
        upto = list(accumulate(x[0] for x in lists))  # the most that the first terms can add
        need = best[0][0] if len(best) == k else 1
        n, low = len(lists), 0
        while low < n and upto[low] < need:
            low += 1
        if low == n:
            return
        docs, adds, _ = zip(*(self.share(t) for _, _, t in lists))
        factor = [w for _, w, _ in lists]
        at = [0] * n
        cursors = [(docs[j][0], j) for j in range(low, n)]
        heapq.heapify(cursors)
        while cursors:
            doc, score = cursors[0][0], 0
            while cursors and cursors[0][0] == doc:
                j = cursors[0][1]
                i = at[j]
                score += factor[j] * adds[j][i]
                at[j] = i = i + 1
                if i < len(docs[j]):
                    heapq.heapreplace(cursors, (docs[j][i], j))
                else:
                    heapq.heappop(cursors)
            for j in range(low - 1, -1, -1):
                if score + upto[j] < need:
                    break
                score += factor[j] * self.lookup(lists[j][2]).get(doc, 0)
            if score < need:
                continue
            entry = (score, -self.ids[doc])
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == k and best[0][0] > need:
                need, before = best[0][0], low
                while low < n and upto[low] < need:
                    low += 1
                if low > before:  # cursors of terms that are only looked up from now on go
                    cursors = [(docs[j][at[j]], j) for j in range(low, n) if at[j] < len(docs[j])]
                    heapq.heapify(cursors)


def _search(names: list[str], carried: bool, n_docs: int, n_terms: int, k: int, b: int, k1: int):
    def read(name: str) -> tuple[list, set[bytes]]:
        table = pa.ipc.open_stream(store.get(name)).read_all()
        queries = list(zip(*(table.column(c).to_pylist() for c in ("query", "terms", "weights"))))
        return queries, {t for _, terms, _ in queries for t in terms}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[int, int]]] = {}
        only = read(names[0]) if len(names) == 1 else None

        def found() -> pa.RecordBatch:
            rows = [(q, None if i == -_LAST else -i, s) for q, heap in best.items() for s, i in heap]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                for name in names:
                    queries, wanted = only or read(name)
                    shard = Shard(row, wanted, n_docs, n_terms, b, k1)
                    if shard.at:
                        for query, terms, weights in queries:
                            shard.search(terms, weights, best.setdefault(query, []), k)
                    if not carried:
                        yield found()
        yield found()

    return run


def rank_documents(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text", k: int = 10, b: int = 90, k1: int = 8) -> DataFrame:
    """The k documents with the highest scores above 0 for each query.

    Terms are runs of letters, digits and anything beyond ASCII, A-Z lower-cased. ``b`` is the share of the length in per cent, ``k1`` in tenths.
    Returns query_col, rank (from 1), doc_id, score; equal scores stand by id, a null id last. Rows count as documents, also those that
    repeat an id. Rows of queries that repeat an id and its text are one query; one id with other texts has a ranking for each
    (null ids too). Null and empty texts have no terms, on either side; empty tables give an empty result. Other columns are not
    looked at. Ids of documents must be integers (``ValueError``).
    """
    whole_ids(docs, id_col)
    spark = docs.sparkSession
    small_batches(spark)
    folder = store.new_dir(spark, "search")
    index = build_index(docs, folder, id_col=id_col, text_col=text_col)
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    asked = queries.select(queries[query_col].alias("item"), queries[query_text].cast("string").alias("text"))
    asked = asked.withColumn("query", F.md5(F.to_json(F.struct(F.col("item").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t"))))).dropDuplicates(["query"])
    asked = store.table(asked, f"{folder}/asked")
    terms = store.table(asked.mapInArrow(_terms, "query string, term binary"), f"{folder}/terms")
    prints = [r["name"] for r in terms.select("term").distinct().mapInArrow(_write_prints(folder), "name string").collect()]
    df = index.select("terms", "dfs").mapInArrow(_frequencies(prints), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")) if prints else None
    files = []
    if df is not None and total["docs"]:
        weighted = terms.join(df, "term").groupBy("query").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
        # one task where the queries are few: they then make one file, which workers keep
        width = max(1, -(-store.input_bytes(terms) // FILE_BYTES))
        files = weighted.coalesce(min(width, 1 << 16)).mapInArrow(_write_queries(folder, total["docs"]), "name string, n long").collect()
    kind = queries.schema[query_col].dataType
    if not files:
        return spark.createDataFrame([], f"`{query_col}` {kind.simpleString()}, rank int, doc_id long, score long")
    carried = sum(r["n"] for r in files) <= CARRIED
    names = [r["name"] for r in files]
    hits = index.mapInArrow(_search(names, carried, total["docs"], total["terms"], k, b, k1), "query string, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("query", "item"), "query").select(F.col("item").alias(query_col), "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS d FROM documents),
held AS (SELECT doc_id, d, ws, len(ws)::BIGINT AS n FROM low WHERE len(ws) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM held),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ws) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
weighted AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term), total),
norm AS (SELECT d, doc_id, 100 - 90 + ((90 * n * docs) // terms) AS m FROM held, total),
scored AS (SELECT item_id, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM weighted JOIN tf USING (term) JOIN norm USING (d) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, d)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
