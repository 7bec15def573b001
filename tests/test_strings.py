"""Shared substrings and idioms against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.plans import strings


def maximal(a, b, least):
    out = set()
    for shift in range(-len(a) + 1, len(b)):
        i = max(0, -shift)
        while i < len(a) and i + shift < len(b):
            n = 0
            while i + n < len(a) and i + shift + n < len(b) and a[i + n] == b[i + shift + n]:
                n += 1
            if n >= least:
                out.add((i, i + shift, n))
            i += n + 1
    return out


@pytest.mark.parametrize("least,stretch", [(2, 1 << 20), (5, 1 << 20), (8, 16)])
def test_shared_substrings_by_brute_force(spark, monkeypatch, least, stretch):
    monkeypatch.setattr(strings, "STRETCH", stretch)
    rng = random.Random(least)
    texts = lambda n, size: ["".join(rng.choice("ab漢😀 ") for _ in range(rng.randrange(size))) for _ in range(n)]
    items, docs = [*texts(9, 40), None, "", "aaaaaaaaaaaa", "a"], [*texts(12, 90), None, "", "aaaaaaaaaaaaaaa"]
    docs += [docs[0] + items[0] + docs[1], items[1][::-1] + (items[1] or "")]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(3)
    got = {(x.item, x.doc, x.item_at, x.doc_at, x["size"]) for x in strings.shared_substrings(frame(items), frame(docs), least).collect()}
    assert got == {(i, d, *m) for i, a in enumerate(items) for d, b in enumerate(docs) for m in maximal(a or "", b or "", least)}


def test_seeds_are_few_and_shared():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 26, 20_000).astype(np.uint32), rng.integers(0, 26, 20_000).astype(np.uint32)
    b[500:524] = a[9000:9024]
    (ca, pa_), (cb, pb) = strings.seeds(a, 12, 13), strings.seeds(b, 12, 13)
    assert len(pa_) < 0.2 * len(a)
    met = {(int(x), int(y)) for h, x in zip(ca, pa_) for y in pb[cb == h]}
    assert any(y - x == 500 - 9000 for x, y in met)


def test_ten_thousand_patterns_in_one_scan(spark):
    rng = random.Random(1)
    patterns = sorted({"".join(rng.choices("abcd", k=rng.randrange(2, 9))) for _ in range(40_000)})[:10_000]
    docs = ["".join(rng.choices("abcd ", k=400)) for _ in range(30)] + [None, "", "aaaaaaa"]
    rows = [(k, t, "en" if k % 2 else "de", f"s{k % 3}") for k, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    got = {x.idiom: (x.n, x.pages, x.slugs, x.strata) for x in strings.idiom_table(frame, patterns).collect()}
    want = {}
    for p in patterns:
        hits = [(k, (t or "").count(p)) for k, t in enumerate(docs) if p in (t or "")]
        if hits:
            want[p] = (sum(n for _, n in hits), len(hits), len({k % 3 for k, _ in hits}), len({k % 2 for k, _ in hits}))
    assert len(patterns) == 10_000 and got == want
    assert strings.idiom_table(frame, []).count() == 0
    inside = {x.idiom: x.inside for x in strings.idiom_table(frame, ["ab", "abc", "cab", "zz"]).collect()}
    assert inside == {"ab": 2, "abc": 0, "cab": 0}


def test_idioms_found_are_handed_on_in_parts():
    """A batch of many pages gives no batch of all that is found in it, and no row is lost between two parts."""
    patterns = [f"{a}{b}" for a in "abcd" for b in "abcd"]
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcd", k=120)) for _ in range(20_000)] + [None, ""]
    size = len(texts)
    batch = pa.record_batch([pa.array(range(size)), pa.array([f"s{k % 3}" for k in range(size)]), pa.array([None] * size, pa.string()), pa.array(texts)], ["doc_id", "source", "lang", "text"])
    parts = list(strings._counted(patterns)(iter([batch])))
    assert max(x.num_rows for x in parts) < strings.FOUND + len(patterns) < sum(x.num_rows for x in parts)
    got = sorted((x["page"], x["idiom"], x["slug"], x["n"]) for p in parts for x in p.to_pylist())
    assert got == sorted((k, p, f"s{k % 3}", t.count(p)) for k, t in enumerate(texts) if t for p in patterns if p in t)
