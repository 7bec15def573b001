import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, folder, texts

from quern.llm import kneser_ney as kn
from quern.llm import store

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    uni, pairs = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            seq = tokens(t)
            uni.update(seq)
            pairs.update(zip(["<s>", *seq], seq))
    n, v = sum(uni.values()), len(uni)
    total, kinds, after = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (h, w), c in pairs.items():
        total[h] += c
        kinds[h][min(c, 3) - 1] += 1
        after[w] += 1
    d2 = [0, *kn.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])]
    d1 = [0, *kn.discounts([sum(c == k for c in after.values()) for k in (1, 2, 3, 4)])]
    left = sum(d1[min(c, 3)] for c in after.values())

    def word(w):
        return max(after[w] - d1[min(after[w], 3)], 0) / len(pairs) + left / len(pairs) / (v + 1)

    def prob(h, w):
        if not total[h]:
            return word(w)
        c = pairs[h, w]
        return max(c - d2[min(c, 3)], 0) / total[h] + sum(d * k for d, k in zip(d2[1:], kinds[h])) / total[h] * word(w)

    out = {}
    for i, t in rows:
        seq = tokens(t)
        out[i] = (held[i], len(seq), sum(uni[w] > 0 for w in seq), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq), sum(math.log10(prob(h, w)) for h, w in zip(["<s>", *seq], seq)))
    return out, prob, uni


def test_op10(spark, tmp_path):
    rows = list(enumerate(texts() * 3))
    want, prob, uni = brute(rows)
    got = {r.doc_id: r for r in kn.op10_lm_scoring(spark, folder(spark, tmp_path, [t for _, t in rows])).collect()}
    assert len(got) == len(rows)
    for i, x in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4], i
        assert r.base_score == pytest.approx(x[4], rel=1e-9) and r.score == pytest.approx(x[5], rel=1e-9), i
    # probabilities over all words and one unknown sum to one
    for h in ("<s>", "alpha", "the", "nowhere"):
        assert sum(prob(h, w) for w in uni) + prob(h, "\0") == pytest.approx(1.0, rel=1e-6)


def test_held_out_texts_score_better_than_base(spark):
    rows = kn.op10_lm_scoring(spark, "/root/testdata/sf0.1").filter("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum()


def test_empty_and_flush(spark, monkeypatch):
    assert kn.score_documents(documents(spark, [])).count() == 0
    assert np.isfinite(kn.score_documents(documents(spark, [None])).first().score)
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert kn.score_documents(odd).filter("held_out").count() == 1


def test_words_of_one_polynomial_hash(spark):
    word = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    trained, held = (next(i for i in range(1, 99) if (zlib.crc32(str(i).encode()) % 10 == 0) is h) for h in (False, True))
    rows = spark.createDataFrame([(trained, word), (held, word.translate({97: 98, 98: 97}))], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in kn.score_documents(rows).collect()} == {trained: 2, held: 1}


def test_pair_keys_are_unique():
    """Every (context, token) has a shard and key of its own, from which both come back, whatever the number of words."""
    rng = np.random.default_rng(4)
    for shards, size in ((3, 50), (1000, 1 << 34)):
        hot = np.array([0, 7, 11], np.int64)
        keys = kn.PairKeys(shards, size, hot)
        context, token = (np.append(rng.integers(0, min(size, 1 << 40), 4000), rng.choice(12, 4000)) for _ in range(2))
        shard, key = keys.split(context, token)
        assert len(set(zip(shard.tolist(), key.tolist()))) == len(set(zip(context.tolist(), token.tolist())))
        for s in np.unique(shard)[:50]:
            at = shard == s
            back = keys.parts(int(s), key[at])
            assert (back[0] == context[at]).all() and (back[1] == token[at]).all()
    with pytest.raises(ValueError):
        kn.PairKeys(2, 1 << 40, hot)


def test_arrays_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (kn._unpack(kn._pack(x)) == x).all() and (kn._expand(kn._squeeze(x.view(np.int64))) == x.view(np.int64)).all()
    assert store.mapped("/nowhere/at/all").size == 0
