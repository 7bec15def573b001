"""Words, neighbours and groups of spellings against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, folder, texts

from quern.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows, min_letters=5, min_count=3, slip=97):
    total = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if n >= min_count and len(w) >= min_letters}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    near = defaultdict(list)
    names = sorted(words)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in names:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w in names:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def spellings():
    """Texts in which words vary: chains of forms, ties, letters beyond ASCII."""
    rng = random.Random(11)
    base = ["banana", "straße", "élève", "mississippi", "aaaaa", "abababab", "counterclockwise", "ÀÉÎÕÜ", "naïveté"]
    out = []
    for word in base:
        for k in range(6):
            w = list(word)
            for _ in range(k % 3):
                at = rng.randrange(len(w))
                op = rng.randrange(3)
                if op == 0:
                    w[at] = rng.choice("abcé")
                elif op == 1:
                    w.insert(at, rng.choice("abcé"))
                elif len(w) > 1:
                    del w[at]
            out += ["".join(w)] * rng.choice((3, 3, 4, 6, 8, 12, 25))
    rng.shuffle(out)
    return [" ".join(out[k : k + 40]) for k in range(0, len(out), 40)] + ["aaaaaa aaaaaaa aaaaaaaa " * 9, "planets " * 3 + "planet " * 7 + "plane " * 20]


def test_query_by_brute_force(spark, tmp_path):
    base = [*texts(), *spellings()]
    got = sp.op13_spelling_variants(spark, folder(spark, tmp_path, base)).collect()
    assert got and sorted(map(tuple, got)) == brute(brute_words(list(enumerate(base))))
    assert any(r.form and r.root != r.form for r in got)  # a chain


@pytest.mark.parametrize("shard", [8192, 4])
def test_blocks_of_hot_shards(spark, monkeypatch, tmp_path, shard):
    """Words of few grams, all in the same shards: whole or in cells of blocks, each pair once."""
    from quern.llm import store

    monkeypatch.setattr(sp, "SHARD", shard)
    rng = random.Random(5)
    words = {"".join(rng.choices("abé", k=rng.randrange(5, 9))): rng.randrange(3, 60) for _ in range(400)}
    table = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form_n, r.form) for r in sp.near_words(table, store.new_dir(spark, "test")).collect()}
    want = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-words[x], x))
            want[w] = (len(near), words[best], best)
    assert got == want


def test_bound_on_common_grams():
    """A word and its neighbour share all grams but three at the same place or one further, and one of the first ones in any order."""
    rng = random.Random(6)
    ranks = [np.random.default_rng(k).permutation(sp.ALPHABET**sp.Q) for k in range(9)]
    for _ in range(2000):
        a = "".join(rng.choices("abc", k=rng.randrange(5, 12)))
        at, c = rng.randrange(len(a)), rng.choice("abc")
        b = rng.choice((a[:at] + c + a[at + 1 :], a[:at] + c + a[at:]))
        if a == b:
            continue
        short, long = ([*x] for x in np.split(sp.grams_of([a.encode(), b.encode()])[0], [len(a) + sp.Q - 1]))
        shared = sum(any(long[k] == short[j] for j in ((k, k - 1) if len(b) > len(a) else (k,)) if 0 <= j < len(short)) for k in range(len(long)))
        assert shared >= len(long) - sp.Q
        x, y = sp.first_grams([a.encode(), b.encode()], rng.choice(ranks))
        assert set(x.tolist()) & set(y.tolist())


def test_runs():
    text = "Ab×c÷ Éa漢字b’s don't\x1cÿÀ ¿Qué? áb naïve_x9y Ω"
    assert [x.decode() for x in sp.runs(text.encode())] == ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in RUN.findall(text)]


def test_long_words_and_slices(spark, monkeypatch):
    monkeypatch.setattr(sp, "HELD", 3)  # counts go out often
    long = "ab" * 4000
    rows = [(i, t) for i, t in enumerate([long, long, long + "c", long + "c", long + "c", long, "word " * 30_000, "other Other OTHER"])]
    got = sorted(map(tuple, sp.group_spellings(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(brute_words(rows, slip=None)) and len(got) == 3


def test_roots_of_long_chains(spark):
    from quern.llm import store

    edges = spark.createDataFrame([(f"w{k:03d}", f"w{k + 1:03d}") for k in range(70)] + [("x", "y")], "word string, form string")
    got = {r.word: r.root for r in sp.roots(edges, store.new_dir(spark, "test")).collect()}
    assert got == {f"w{k:03d}": "w070" for k in range(70)} | {"x": "y"}


def test_odd_rows(spark):
    rows = [(None, "houses houses"), (None, "houses"), (1, "house house house house house house"), (1, "house"), (2, None), (2, ""), (2, "a b c d")]
    got = sorted(map(tuple, sp.group_spellings(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [("house", None, "house", 7, 1, None), ("houses", "house", "house", 3, 1, 7)]
    clash = documents(spark, ["words words words"]).withColumnRenamed("key", "word").withColumnRenamed("n_lines", "form")
    assert sp.group_spellings(clash).count() == 1
    assert sp.group_spellings(clash.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sp.group_spellings(clash.selectExpr("string(doc_id) doc_id", "text"))
    with pytest.raises(ValueError):
        sp.group_spellings(clash, times=1)
