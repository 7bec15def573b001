import random
import re
from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, folder, texts

from quern.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, num, den):
    def shingle_set(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    own = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for k, s in enumerate(own):
        for x in s:
            inverted[x].append(k)
    pairs = {(a, b) for v in inverted.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in pairs:
        if den * len(own[a] & own[b]) >= num * len(own[a] | own[b]):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return {i: (len(own[k]), least[top(k)]) for k, (i, _) in enumerate(rows)}


def near(seed=3, n=260):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 12, 25, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = rng.choice([["x"], [], [f"v{rng.randrange(9)}"]])
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 8, 10), (3, 6, 10)])
def test_against_brute_force(spark, size, num, den, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 8)
    rows = list(enumerate(near() + texts()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.similar_documents(documents(spark, [t for _, t in rows]), shingle=size, num=num, den=den).collect()}
    assert got == brute(rows, size, num, den)


def test_op7(spark, tmp_path):
    rows = list(enumerate(texts()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.op7_jaccard_join(spark, folder(spark, tmp_path)).collect()}
    assert got == brute(rows, 3, 90, 100)
    assert jj.op7_jaccard_join(spark, folder(spark, tmp_path / "e", [])).count() == 0
    assert jj.op7_jaccard_join(spark, folder(spark, tmp_path / "n", [None, ""])).count() == 2


def test_odd_rows(spark):
    """Links run through rows without an id; repeated ids with other texts are told apart; an id's repeated rows stay."""
    w = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(w), " ".join([*w[:59], "x"]), " ".join([*w[:57], "y", "z", "x"])
    rows = [(1, a), (None, b), (2, c), (2, "other words stand here"), (None, None), (None, "lone row"), (None, "lone row"), (7, "lone row"), (1, a)]
    got = jj.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, num=90, den=100).collect()
    want = brute([(10**6 + k if i is None else i, t) for k, (i, t) in enumerate(rows)], 3, 90, 100)
    assert want[2][1] != 1  # a and c are no link by themselves, or the case would test nothing
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == sorted([(1, 58, 1), (0, 58, 1), (2, 58, 1), (2, 2, 2), (0, 0, 0), (0, 1, 7), (0, 1, 7), (7, 1, 7), (1, 58, 1)])


def test_words_of_one_polynomial_hash(spark):
    """Thue-Morse words and their complements agree under any polynomial modulo 2 ** 64."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    rows = [word, word.translate({97: 98, 98: 97}), word]
    got = {r.doc_id: r.component_id for r in jj.similar_documents(documents(spark, rows), shingle=3, num=90, den=100).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_wrong_columns_are_refused(spark):
    rows = spark.createDataFrame([("a", "b", 1)], "doc_id string, text string, n_shingles long")
    with pytest.raises(ValueError):
        jj.similar_documents(rows)
    with pytest.raises(ValueError):
        jj.similar_documents(documents(spark).withColumnRenamed("n", "map"), carry=["map"])


@pytest.mark.parametrize("kind", ["plain", "many sets", "spare", "deletions"])
def test_signatures_lose_no_link(kind):
    """Linked pairs share a signature, by every kind of allocation."""
    rng = np.random.default_rng(6)
    for num, den in ((9, 10), (8, 10), (6, 10)):
        bands = jj.Bands(num, den, 2000, {10: 10**9, 100: 10**9, 1000: 10**9} if kind == "many sets" else None)
        need = [bands.differ(b) + 1 for b in range(len(bands.top))]
        if kind == "spare":
            bands.plan = [(2 * n, 0, n) if n > 1 else (0, 0, 0) for n in need]
        if kind == "deletions":
            bands.plan = [(n % 2, n // 2, 0) if n > 1 else (0, 0, 0) for n in need]
        for _ in range(150):
            n = int(rng.integers(2, 300))
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            drop = int(rng.integers(0, max(1, n * (den - num) // den) + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, 3))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if not len(b) or den * common < num * (len(a) + len(b) - common) or np.array_equal(a, b):
                continue
            sizes_ = np.array([len(a), len(b)])
            sig, who = bands.signatures(np.concatenate([a, b]), np.repeat([0, 1], sizes_), sizes_)
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_parity_maps_lose_no_link():
    rng = np.random.default_rng(8)
    for num, den in ((9, 10), (8, 10)):
        rows = []
        for _ in range(60):
            base = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 400))).astype(np.uint64))
            for drop in (0, 1, 3, 10, len(base) // 8):
                rows.append(np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 62, drop % 3).astype(np.uint64)])))
        rows = [r for r in rows if len(r)]
        sizes = np.array([len(r) for r in rows])
        maps = jj.parity_maps(np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes), sizes)
        near = set(jj.near_maps(list(zip(sizes.tolist(), maps)), None, num, den))
        linked = {(i, j) for i, j, _ in jj.links(rows, None, num, den)}
        assert linked and linked <= near


def test_components(spark):
    from quern.llm import store

    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    got = {r.node: r.root for r in jj.components(spark.createDataFrame(edges, "a long, b long"), store.new_dir(spark, "test")).collect()}
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    assert got == {x: top(x) for x in root if top(x) != x}
