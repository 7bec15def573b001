"""Ranked search against a brute-force ranking."""

import math
import random
import re
from collections import Counter

import pytest
from fixtures import documents, folder, texts

from quern.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
QUERIES = ["the quick brown fox", None, "", "...", "alpha beta gamma", "Straße ñandú", "zeta0 zeta1 zeta2 theta3 iota4", "ab " * 50, "nowhere", "x", "漢字 çava kappa7", "THE the The dog"]


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, queries, k=10, b=90, k1=8):
    """rows: (id, text); (query number, rank, id, score)."""
    held = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    total, n_docs = sum(sum(c.values()) for _, c in held), len(held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, text in enumerate(queries):
        found = []
        for i, own in held:
            m = 100 - b + b * sum(own.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + k1 * m)) for t in set(terms(text)) if t in own)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def ranked(spark, rows, queries, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(queries)), "item_id long, text string")
    return sorted(map(tuple, search.rank_documents(docs, asked, **more).collect()), key=lambda r: r[:2])


def test_against_brute_force(spark, tmp_path):
    base = texts()
    benchmark = spark.createDataFrame(list(enumerate(QUERIES)), "item_id long, text string")
    got = search.op12_ranked_search(spark, folder(spark, tmp_path, base, benchmark=benchmark))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == brute(list(enumerate(base)), QUERIES)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]


@pytest.mark.parametrize("shard_bytes,carried", [(1 << 22, 50_000), (600, 50_000), (600, 0)])
def test_shards_and_bounds(spark, monkeypatch, shard_bytes, carried):
    """Many ties, skewed terms, small shards; heaps carried or not. Nothing is lost by the bounds."""
    rng = random.Random(7)
    common, rare = [f"c{k}" for k in range(6)], [f"r{k}" for k in range(300)]
    rows = []
    for i in range(700):
        n = rng.choice((1, 3, 8, 30, 120))
        rows.append((rng.choice((i, i, i // 2, None)) if i % 50 == 0 else i, " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(n))))
    rows += [(2000 - k, rows[11][1]) for k in range(60)]  # a group of copies, ids falling
    queries = [" ".join(rng.sample(common, 3) + rng.sample(rare, n)) for n in (0, 1, 2, 5, 40)] + [rows[11][1], "r1", "c1 c2"]
    monkeypatch.setattr(search, "CARRIED", carried)
    monkeypatch.setattr(search, "SHARD_BYTES", shard_bytes)
    docs = sorted(rows, key=lambda r: str(r))
    index = []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
    for out in search._index(iter([batch])):
        index.extend(out.to_pylist())
    assert (len(index) > 10) == (shard_bytes < 1 << 20)
    n_docs, n_terms = sum(r["n_docs"] for r in index), sum(r["n_terms"] for r in index)
    df = Counter(t for _, text in docs for t in set(terms(text)))
    want = brute(rows, queries)
    for q, text in enumerate(queries):
        own = sorted({t.encode() for t in terms(text)})
        best, every = [], []
        for row in index:
            shard = search.Shard(row, set(own), n_docs, n_terms, 90, 8)
            if shard.at:
                shard.search(own, [search.weight(n_docs, df[t.decode()]) for t in own], best, 10)
                if not carried:
                    every, best = every + best, []
        found = sorted(every + best, reverse=True)[:10]
        assert [(q, r + 1, None if -i == search._LAST else -i, s) for r, (s, i) in enumerate(found)] == [x for x in want if x[0] == q]


def test_many_files_of_queries(spark, monkeypatch):
    """More queries than heaps that are carried, in several files: the same ranking."""
    rows = [(i, t) for i, t in enumerate(texts())]
    want = ranked(spark, rows, QUERIES)
    assert want == brute(rows, QUERIES)
    assert ranked(spark, rows, QUERIES, k=3, b=50, k1=12) == brute(rows, QUERIES, 3, 50, 12)


def test_bounded_work(spark):
    """Terms that can't decide are looked up, not merged: the merge takes far fewer postings than there are."""
    rng = random.Random(3)
    docs = [" ".join(["common"] * (1 + k % 3) + [f"w{rng.randrange(4000)}" for _ in range(20)]) for k in range(4000)]
    docs[1234] = "common rare1 rare2 rare3"
    for k in range(9):
        docs[100 + k] += " rare1 rare2"
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], ["doc_id", "text"])
    (row,) = (r for out in search._index(iter([batch])) for r in out.to_pylist())
    shard = search.Shard(row, {b"common", b"rare1", b"rare2", b"rare3"}, row["n_docs"], row["n_terms"], 90, 8)
    best: list = []
    shard.search([b"common", b"rare1", b"rare2", b"rare3"], [search.weight(4000, x) for x in (3999, 10, 10, 1)], best, 10)
    assert -max(best)[1] == 1234 and len(best) == 10


def test_odd_rows(spark):
    docs = documents(spark, ["a b", "a b", None, ""]).withColumnRenamed("n", "rank").withColumnRenamed("key", "score")
    asked = spark.createDataFrame([(None, "a", 1), (3, "a", 2), (3, "a", 3), (3, "b", 4), (5, None, 5)], "item_id long, text string, doc_id int")
    got = sorted((r.item_id or 0, r["rank"], r.doc_id) for r in search.rank_documents(docs, asked).collect())
    # every term is in both documents: ln(6 / 5) is above 0; null is an item of its own, item 3 has two texts
    assert got == [(0, 1, 0), (0, 2, 1), (3, 1, 0), (3, 1, 0), (3, 2, 1), (3, 2, 1)]
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.filter("text IS NULL"), asked)):
        empty = search.rank_documents(d, q)
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(ValueError):
        search.rank_documents(docs.selectExpr("string(doc_id) doc_id", "text"), asked)
