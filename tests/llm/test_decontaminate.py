import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import documents, folder, texts

from quern.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, items, size):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for i, text in rows:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def items():
    base = [t for t in texts() if t]
    return [(1, base[6]), (12, " ".join(base[-1].split()[5:30])), (2, "one"), (3, None), (4, ""), (5, "... !!"), (6, "Quick,brown FOX"), (7, "unseen words that stand nowhere at all in any of these documents, surely not"), (8, base[13]), (8, base[13]), (9, " ".join(base[-2].split()[60:75]))]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("chunk", [dc.CHUNK, 4])
def test_exact(spark, chunk):
    rows = list(enumerate(texts()))
    out = dc.find_items(documents(spark), bench(spark, items()), chunk=chunk).collect()
    want = brute(rows, items(), 10)
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in out} == want
    assert sum(x[4] for x in want.values()) > 5


def test_op8(spark, tmp_path):
    at = folder(spark, tmp_path, benchmark=bench(spark, items()))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.op8_decontamination(spark, at).collect()}
    assert got == brute(list(enumerate(texts())), items(), 10)


def test_empty(spark):
    assert dc.find_items(documents(spark, []), bench(spark, items())).count() == 0
    assert {r.n_hit for r in dc.find_items(documents(spark), bench(spark, [])).collect()} == {0}


def test_repeated_words_overlap(spark):
    rows = ["a a a a a a a a a a a a", "a b a b a b a b a b a b a b a"]
    want = brute(list(enumerate(rows)), [(1, "a " * 10), (2, "a b " * 5)], 10)
    out = dc.find_items(documents(spark, rows), bench(spark, [(1, "a " * 10), (2, "a b " * 5)])).collect()
    assert {r.doc_id: (r.n_words, r.n_hit) for r in out} == {i: x[:2] for i, x in want.items()}


def test_proximity(spark):
    rows = ["one x two y y three", "one two three", "three two one", "one x x x two three", "one one two three"]
    out = dc.find_items(documents(spark, rows), bench(spark, [(1, "one two three")]), slop=2).collect()
    spans = {r.doc_id: [(s["first"], s["last"]) for s in r.spans] for r in out}
    assert spans == {0: [(0, 5)], 1: [(0, 2)], 2: [], 3: [], 4: [(0, 3), (1, 3)]}
    # against brute force over all chains
    rng = random.Random(2)
    rows = [" ".join(rng.choice("abcd") for _ in range(30)) for _ in range(12)]
    out = dc.find_items(documents(spark, rows), bench(spark, [(1, "a b c a")]), slop=1).collect()
    for r in out:
        w, want = rows[r.doc_id].split(), set()
        for start in range(len(w)):
            live = {start} if w[start] == "a" else set()
            for t in "bca":
                live = {q for p in live for q in (p + 1, p + 2) if q < len(w) and w[q] == t}
            want |= {(start, e) for e in live}
        assert {(s["first"], s["last"]) for s in r.spans} == want


def test_odd_rows(spark):
    """Rows without an id and repeated rows stay; items without an id hit words; words that a polynomial hash confuses are apart."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    other = word.translate({97: 98, 98: 97})
    rows = spark.createDataFrame([(1, word), (2, other), (None, word), (3, "x y"), (3, "x y"), (None, None)], "doc_id long, text string")
    found = dc.find_items(rows, bench(spark, [(5, word), (None, "x y")])).collect()
    got = [(r.doc_id or 0, r.n_words, r.n_hit, list(r["items"])) for r in found]
    assert sorted(got) == [(0, 0, 0, []), (0, 1, 1, ["5"]), (1, 1, 1, ["5"]), (2, 1, 0, []), (3, 2, 2, []), (3, 2, 2, [])]
    with pytest.raises(ValueError):
        dc.find_items(rows.withColumn("spans", rows.text), bench(spark, []), carry=["spans"])


def test_long_item(spark):
    """An item of many windows goes in parts, and each window of it is found."""
    w = [f"w{k}" for k in range(500)]
    out = dc.find_items(documents(spark, [" ".join(w[k : k + 10]) for k in range(491)]), bench(spark, [(1, " ".join(w))]), chunk=37).collect()
    assert all(r.n_hit == 10 and list(r["items"]) == ["1"] for r in out)


def test_pack():
    x = np.array([5, 0, 7, 1 << 20])
    assert (dc.unpack(dc.pack(x)) == x).all()
