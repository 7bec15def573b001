"""Shared substrings of two tables by seeds, and idioms of the corpus by an automaton."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.registry import query
from quern.sources.tables import table

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Code points of a text that are hashed at once.
STRETCH = 1 << 20


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def seeds(points: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the k-grams that are the least of some w in a row (the last one of equals).

    Two texts that share k + w - 1 code points share the seeds of that stretch at the same places in it.
    """
    n = len(points) - k + 1
    if n < w:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.zeros(n, np.uint64)
    for j in range(k):
        code = code * _MIX + points[j : j + n] + np.uint64(1)
    code ^= code >> np.uint64(29)
    code *= _MIX
    code ^= code >> np.uint64(32)
    best = np.arange(n - w + 1)
    for j in range(1, w):
        here = np.arange(j, n - w + 1 + j)
        best = np.where(code[here] <= code[best], here, best)
    places = np.unique(best)
    return code[places], places


def _seeded(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                points = _points(text)
                # stretches overlap by all that one seed depends on
                for at in range(0, max(len(points), 1), STRETCH):
                    code, place = seeds(points[at : at + STRETCH + k + w - 2], k, w)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.int64()), pa.array(code.view(np.int64)), pa.array(place + at)], ["id", "seed", "place"])

    return run


def _extended(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "doc", "item_at", "doc_at", "size"]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, b = _points(row["fragment"]), _points(row["text"])
                for shift in row["shifts"]:  # the place in the document less that in the fragment
                    low, high = max(0, -shift), min(len(a), len(b) - shift)
                    same = np.concatenate([[False], a[low:high] == b[low + shift : high + shift], [False]])
                    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
                    out += [(row["item"], row["doc"], int(s) + low, int(s) + low + shift, int(e - s)) for s, e in edges if e - s >= least]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 5)], names)

    return run


def shared_substrings(fragments: DataFrame, docs: DataFrame, least: int = 24) -> DataFrame:
    """All maximal substrings of ``least`` code points and more that a fragment and a document share, by place: item, doc, item_at, doc_at, size.

    ``fragments`` and ``docs`` have id and text. Of all k-grams only the least ones of windows go to the join (two in ``w`` + 1 about), and a pair meets in
    it at a seed of every stretch that it shares. Each shift between the two texts that a seed gives is then compared whole. Ids that
    repeat must have one text. Null and short texts share nothing.
    """
    k = max(1, (least + 1) // 2)
    w = least - k + 1
    kind = "id long, seed long, place long"
    one, two = (df.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(_seeded(k, w), kind) for df in (fragments, docs))
    met = one.select(F.col("id").alias("item"), "seed", F.col("place").alias("at")).join(two.select(F.col("id").alias("doc"), "seed", "place"), "seed")
    shifts = met.groupBy("item", "doc").agg(F.collect_set(F.col("place") - F.col("at")).alias("shifts"))
    texts = lambda df, name, text: df.select(F.col("id").cast("long").alias(name), F.col("text").alias(text)).dropDuplicates([name])
    pairs = shifts.join(texts(fragments, "item", "fragment"), "item").join(texts(docs, "doc", "text"), "doc")
    return pairs.mapInArrow(_extended(least), "item long, doc long, item_at long, doc_at long, size long")


# J21
_GRAMS = "SELECT {id} AS id, i, substr(text, i, 24) AS g FROM (SELECT {id}, text, unnest(range(1, length(text) - 22)) AS i FROM {table} WHERE length(text) >= 24)"


@query(
    "shared_substrings",
    f"""WITH a AS ({_GRAMS.format(id="item_id", table="benchmark")}), b AS ({_GRAMS.format(id="doc_id", table="documents")}),
m AS (SELECT a.id AS item, b.id AS doc, a.i AS x, b.i - a.i AS shift FROM a JOIN b USING (g)), g AS (SELECT *, x - row_number() OVER (PARTITION BY item, doc, shift ORDER BY x) AS island FROM m)
SELECT item AS item_id, doc AS doc_id, min(x) - 1 AS item_at, min(x) + shift - 1 AS doc_at, count(*) + 23 AS size FROM g GROUP BY item, doc, shift, island""",
)
def shared_with_benchmark(spark, sf_dir: str, least: int = 24) -> DataFrame:
    """Maximal substrings of at least 24 characters that an item of the benchmark shares with a document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return shared_substrings(items, docs, least).withColumnsRenamed({"item": "item_id", "doc": "doc_id"})


def automaton(patterns: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        out.add_word(p, (k, len(p)))
    if patterns:
        out.make_automaton()
    return out


#: Rows of what is found that a task gathers before it hands them on.
FOUND = 1 << 16


def _counted(patterns: list[str]):
    names = pa.array(patterns, pa.string())

    def rows(batch: pa.RecordBatch, at: array, kinds: array, n: array) -> pa.RecordBatch:
        at = pa.array(np.frombuffer(at, np.int64))
        where = [batch.column(c).take(at) for c in ("doc_id", "source", "lang")]
        return pa.record_batch([names.take(pa.array(np.frombuffer(kinds, np.int64))), *where, pa.array(np.array(n))], ["idiom", "page", "slug", "lang", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(patterns)
        for batch in batches if patterns else ():
            found = [array("q") for _ in range(3)]  # a page's place in the batch, the pattern, how often
            for at, text in enumerate(batch.column("text")):
                ends: dict[int, int] = {}
                n: Counter = Counter()
                for end, (k, size) in machine.iter(text.as_py() or ""):
                    if end - size >= ends.get(k, -1):  # a pattern's occurrences don't overlap
                        ends[k] = end
                        n[k] += 1
                for out, more in zip(found, (repeat(at, len(n)), n.keys(), n.values())):
                    out.extend(more)
                if len(found[0]) >= FOUND:
                    yield rows(batch, *found)
                    found = [array("q") for _ in range(3)]
            yield rows(batch, *found)

    return run


def idiom_table(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """idiom, n (occurrences that don't overlap), pages, slugs, strata, inside (longer idioms of the table that hold it), in one scan for all patterns."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text").mapInArrow(_counted(patterns), "idiom string, page long, slug string, lang string, n long")
    out = found.groupBy("idiom").agg(F.sum("n").alias("n"), F.count_distinct("page").alias("pages"), F.count_distinct("slug").alias("slugs"), F.count_distinct("lang").alias("strata"))
    held: Counter = Counter()
    machine = automaton(patterns)
    for p in patterns:
        held.update({k for _, (k, size) in machine.iter(p) if size < len(p)})
    within = docs.sparkSession.createDataFrame([(p, held[k]) for k, p in enumerate(patterns)], "idiom string, inside long")
    return out.join(within, "idiom")


# Idioms are the tokens of 4 to 12 characters that stand most often (a report of the first 1,000)
_MINED = "SELECT tok FROM {tokens} WHERE length(tok) BETWEEN 4 AND 12 GROUP BY tok ORDER BY count(*) DESC, tok LIMIT {k}"


@query(
    "mined_idioms",
    f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[^ \\n]+')) AS tok FROM documents), p AS MATERIALIZED ({_MINED.format(tokens="t", k=1000)}),
c AS (SELECT tok, doc_id, source, lang, (length(text) - length(replace(text, tok, ''))) // length(tok) AS n FROM documents JOIN p ON contains(text, tok))
SELECT c.tok AS idiom, sum(n)::BIGINT AS n, count(DISTINCT doc_id) AS pages, count(DISTINCT source) AS slugs, count(DISTINCT lang) AS strata, (SELECT count(*) FROM p q WHERE q.tok <> c.tok AND contains(q.tok, c.tok)) AS inside FROM c GROUP BY c.tok""",
)
def mined_idioms(spark, sf_dir: str, k: int = 1000) -> DataFrame:
    """The k most frequent tokens as idioms: how often, on how many pages and sources, in how many languages, and in how many longer ones."""
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("tok"))
    found = tokens.filter(F.length("tok").between(4, 12)).groupBy("tok").count().orderBy(F.desc("count"), "tok").limit(k)
    return idiom_table(docs, [r["tok"] for r in found.collect()])
