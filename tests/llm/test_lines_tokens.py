import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import documents, folder, texts

from quern.llm import bpe, common, line_dedup, store, token_files

SPACE = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def dedup(rows, min_docs, keep):
    found, first = Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            found[k] += 1
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        lines, kept, spared = (t or "").split("\n"), [], set()
        for x in lines:
            k = key(x)
            if k and found[k] >= min_docs:
                if keep == "first" and first[k] == i and k not in spared:
                    spared.add(k)
                    kept.append(x)
                continue
            kept.append(x)
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_op1(spark, tmp_path):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op1_line_dedup(spark, folder(spark, tmp_path)).collect()}
    want = {i: (a, b, hashlib.sha256(t.encode()).hexdigest()) for i, (a, b, t) in dedup(list(enumerate(texts())), 10, "none").items()}
    assert got == want and any(x[1] for x in want.values())


@pytest.mark.parametrize("min_docs,keep", [(2, "first"), (2, "none"), (3, "first")])
def test_dedup_lines(spark, min_docs, keep):
    out = line_dedup.dedup_lines(documents(spark), min_docs=min_docs, keep=keep, carry=["lang", "source"]).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out} == dedup(list(enumerate(texts())), min_docs, keep)
    assert line_dedup.dedup_lines(documents(spark, []), min_docs=min_docs).count() == 0


def test_sieve(spark):
    from quern.llm.bloom import sieve

    folder_ = store.new_dir(spark, "test")
    asked = sieve(spark.range(0, 30_000, 3).selectExpr("id * 7919 - 5000 AS key"), folder_)
    found = spark.range(30_000).selectExpr("id", "id * 7919 - 5000 AS key").withColumn("hit", asked("key")).groupBy("hit", "id").count().collect()
    hits = {r.id for r in found if r.hit}
    assert hits >= set(range(0, 30_000, 3)) and len(hits) < 10_400
    none = sieve(spark.range(0).selectExpr("id AS key"), store.new_dir(spark, "test"))
    assert spark.range(9).filter(none("id")).count() == 0


def test_bloom_has_no_false_negatives():
    prints = np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint32)
    bloom = line_dedup.Bloom(line_dedup.bloom_bits(5000))
    bloom.add(prints)
    assert bloom.has(prints).all()
    assert bloom.has(np.random.default_rng(2).integers(0, 1 << 32, 20000, dtype=np.uint32)).mean() < 0.02


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(bpe.word_tokenizer())
    made.no_padding()
    made.no_truncation()
    return made


def test_op9_and_op2(spark, tmp_path, library):
    at = folder(spark, tmp_path)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts())}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_bpe(spark, at).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {i: (len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in want.items()}
    start, expected = 0, {}
    for i, x in sorted(want.items()):
        expected[i] = (start, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))
        start += len(x) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op2_token_files(spark, at).collect()} == expected


def test_selective_token_reads(spark, library, monkeypatch):
    folder_ = store.new_dir(spark, "test")
    manifest = token_files.write_tokens(documents(spark), bpe.word_tokenizer(), folder_)
    some = token_files.read_tokens(manifest, min_id=5, max_id=9).collect()
    assert sorted(r.doc_id for r in some) == [5, 6, 7, 8, 9]
    assert all(r.ids == [*library.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids, 2] for r in some)
    assert "ids" not in token_files.read_tokens(manifest, ids=False).columns
    empty = token_files.write_tokens(documents(spark, []), bpe.word_tokenizer(), store.new_dir(spark, "test"))
    assert empty.count() == 0 and token_files.read_tokens(empty).count() == 0


def test_long_words_stream(library):
    import random

    rng, own = random.Random(4), bpe.codec(bpe.word_tokenizer())[0]
    for letters in ("a", "ab", "thean", "inger", "lo", "!?", "=", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(rng.choice(letters) for _ in range(4000))
        assert own.encode(word) == library.encode(word, add_special_tokens=False).ids
    # tokens go out before the word ends
    feed = own.merges.stream("the" * 2000)
    assert next(feed) is not None


def test_words_of_one_polynomial_hash(spark, library):
    word = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    rows = [word, word.translate({97: 98, 98: 97})]
    want = [library.encode(x, add_special_tokens=False).ids for x in rows]
    got = {r.doc_id: r for r in bpe.encode_documents(documents(spark, rows).coalesce(1), bpe.word_tokenizer()).collect()}
    assert [list(map(int, got[k].ids.split())) for k in (0, 1)] == want and want[0] != want[1]
    assert [got[k].decoded for k in (0, 1)] == [library.decode(x, skip_special_tokens=False) for x in want]
    files = token_files.write_tokens(documents(spark, rows), bpe.word_tokenizer(), store.new_dir(spark, "test"))
    assert {r.doc_id: r.ids for r in token_files.read_tokens(files).collect()} == {k: [*want[k], 2] for k in (0, 1)}


def test_every_word_streams(library):
    """Short words and long ones, symbol by symbol and whole, give what the library gives; entries stay bounded."""
    import random

    rng, own = random.Random(9), bpe.codec(bpe.word_tokenizer())[0]
    for n in [*range(1, 40), 570, 571, 572, 573, 574, 1300, 9000]:
        for letters in ("thean", "ab", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(rng.choice(letters) for _ in range(n))
            want = library.encode(word, add_special_tokens=False).ids
            assert own.merges.word(word) == want and list(own.merges.stream(word)) == want
    run = bpe.Transducer(own.merges)
    most = own.merges.lookahead + own.merges.longest
    for _ in range(60):
        run.push([own.merges.symbol[c] for c in rng.choices("thean", k=most)])
        assert len(run.last) <= 3 * most


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe.encode_documents(rows, bpe.word_tokenizer()).collect()) == [0, 1, 2, 2, 2]
    files = token_files.write_tokens(rows, bpe.word_tokenizer(), store.new_dir(spark, "test"))
    assert sorted(r.n_tokens for r in token_files.read_tokens(files).collect()) == [1, 2, 3, 3, 3]
    out = line_dedup.dedup_lines(rows, min_docs=3, keep="none").collect()
    assert sorted((r.doc_id or 0, r.n_dropped, r.text) for r in out) == [(0, 0, ""), (0, 1, ""), (1, 0, "c"), (1, 1, ""), (1, 1, "")]
    out = line_dedup.dedup_lines(rows, min_docs=3, keep="first").collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, ""), (0, ""), (1, "a b"), (1, "a b"), (1, "c")]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(rows.withColumn("n_lines", rows.doc_id), carry=["n_lines"])
    with pytest.raises(ValueError):
        bpe.encode_documents(rows.withColumn("ids", rows.doc_id), bpe.word_tokenizer(), carry=["ids"])
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(rows.selectExpr("string(doc_id) doc_id", "text"))


def test_keys_that_share_a_half():
    """A run of keys with one high lane is searched to its end."""
    from quern.llm.common import find_pairs

    high, low = np.repeat(np.array([3, 5, 9], np.uint64), 40), np.tile(np.arange(40, dtype=np.uint64) * 2, 3)
    want = np.arange(100, dtype=np.uint64)
    found = find_pairs(high, low, np.full(100, 5, np.uint64), want)
    assert [int(x) for x in found] == [40 + k // 2 if k < 80 and k % 2 == 0 else -1 for k in range(100)]


def test_decoder_holds_back_unfinished_characters():
    state = bpe.ByteToText({1: "é".encode()[:1], 2: "é".encode()[1:], 3: b"x"})
    assert state.feed([3, 1]) == "x" and state.feed([2]) == "é" and state.end() == ""


def test_any_text_as_the_library(library):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    own = bpe.codec(bpe.word_tokenizer())[0]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
    def same(many):
        many = [x.encode("utf-8", "replace").decode() for x in many]
        for text in many:
            cut = bpe.units(text.encode())
            assert [i for x in cut for i in own.encode(x.decode())] == library.encode(text, add_special_tokens=False).ids

    same()


def test_any_slice_as_the_library(library):
    """What op2 encodes with, over Latin-1 signs next to letters and digits, and over any text."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    path = bpe.word_tokenizer()
    latin = st.text(st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=30)

    @settings(max_examples=600, deadline=None)
    @given(st.lists(latin | st.text(max_size=30), min_size=1, max_size=4))
    def same(many):
        many = [x.encode("utf-8", "replace").decode() for x in many]
        ids, sizes = token_files.encode_slice([x.encode() for x in many], path, 2)
        want = [[*library.encode(x, add_special_tokens=False).ids, 2] for x in many]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]

    same()


def test_pages_of_one_document(spark, library):
    """One document is read by its pages: a small part of its file's bytes."""
    import glob
    import os
    import random

    rng = random.Random(8)
    base = [" ".join(rng.choices(["alpha", "beta", "river", "the", "and", "zebra", "stone"], k=400)) for _ in range(1500)]
    folder_ = store.new_dir(spark, "test")
    manifest = token_files.write_tokens(documents(spark, base).coalesce(1), bpe.word_tokenizer(), folder_)
    whole = sum(os.path.getsize(x) for x in glob.glob(folder_.removeprefix("file://") + "/part-*.parquet"))
    stats = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = stats()
    (got,) = token_files.pick_tokens(manifest, [777]).collect()
    read = stats() - before
    assert got.ids == [*library.encode(base[777], add_special_tokens=False).ids, 2] and got.n_tokens == len(got.ids)
    assert got.start == sum(len(library.encode(x, add_special_tokens=False).ids) + 1 for x in base[:777])
    assert read < whole / 4, (read, whole)
    assert sorted(r.doc_id for r in token_files.pick_tokens(manifest, [3, 1400, 99_999]).collect()) == [3, 1400]
    assert token_files.pick_tokens(manifest, [99_999]).count() == token_files.pick_tokens(manifest, []).count() == 0


def test_ids_of_other_kinds(spark):
    rows = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    with pytest.raises(ValueError):
        token_files.write_tokens(rows, bpe.word_tokenizer(), store.new_dir(spark, "test"))
    assert [r.doc_id for r in bpe.encode_digests(rows, bpe.word_tokenizer()).collect()] == ["x"]


def test_batches_are_bounded_unless_the_session_says_so(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    try:
        spark.conf.unset(limit)
        common.small_batches(spark)
        assert spark.conf.get(limit) == common.BATCH_BYTES
        spark.conf.set(limit, "8m")
        common.small_batches(spark)
        assert spark.conf.get(limit) == "8m"
    finally:
        spark.conf.set(limit, before)
