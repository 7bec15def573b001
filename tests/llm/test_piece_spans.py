"""Pieces, spans and decoding against the library that the model file is for."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import documents, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import piece_spans as ps

SIGNS = [*"abcdefghij eatr  \n\n.,!?'éèçñ漢字😀▁⁇\t0123456789<>sABC’“— ́\x00", " the ", " and", "<s>", "</s>", "<unk>", "<0x0A>", "    "]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=ps.piece_model())


def spans(own, text):
    (found,) = ps.encoded(own, [text.encode()])
    ids, starts, ends = (np.concatenate(x) for x in zip(*found, (np.empty(0, np.int64),) * 3))
    return ids.tolist(), list(zip(starts.tolist(), ends.tolist()))


def same(own, library, text):
    want = library.encode(text, return_type="proto").pieces
    ids, places = spans(own, text)
    assert ids == [p.id for p in want] and places == [(p.begin, p.end) for p in want]
    assert own.decode(ids) == library.decode(ids)


def test_texts_as_the_library(library):
    own, rng = ps.model(ps.piece_model()), random.Random(1)
    for _ in range(3000):
        same(own, library, "".join(rng.choices(SIGNS, k=rng.randrange(60))))
    for text in ("ab" * 4000, "x " * 3000, " " * 900, "\n" * 70, "漢" * 200, "a" * 65, *(t or "" for t in texts())):
        same(own, library, text)


def test_any_text_as_the_library(library):
    own = ps.model(ps.piece_model())

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        same(own, library, text.encode("utf-8", "replace").decode())

    check()


def test_any_ids_decode_as_the_library(library):
    own, rng = ps.model(ps.piece_model()), random.Random(2)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(259, 400), rng.randrange(1, 32000))) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_parts_of_long_texts(library, monkeypatch):
    """A text beyond the slice is cut at borders: same pieces, same spans, bounded parts."""
    own, text = ps.model(ps.piece_model()), "some words, and more of them.\n" * 500
    cut = list(own.parts(b" " + text.encode(), 1000))
    assert b"".join(u for units in cut for u in units) == b" " + text.encode() and len(cut) > 10
    assert max(sum(map(len, units)) for units in cut) <= 1000
    assert [u for units in own.parts(b"a" * 5000 + b" b", 1000) for u in units] == [b"a" * 5000, b" b"]  # no border within
    rows = np.concatenate(list(own.encode(b" " + text.encode())))
    assert rows[:, 0].tolist() == library.encode(text)


def test_cache_turns_over(library, monkeypatch):
    monkeypatch.setattr(ps, "KEEP", 7)
    own, rng = ps.Pieces(ps.piece_model()), random.Random(3)
    for _ in range(60):
        text = " ".join("".join(rng.choices("aeinrst", k=rng.randrange(1, 9))) for _ in range(12))
        assert spans(own, text)[0] == library.encode(text)
        assert len(own.cache) <= 7


@pytest.fixture(scope="module")
def folded(tmp_path_factory):
    """The model file with a compiled map, as the library ships it, in its normaliser's place."""
    import sentencepiece

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()
    with open(ps.piece_model(), "rb") as src:
        data = src.read()
    out = b"".join(bytes([k << 3 | 2]) + number(len(v)) + v for k, v in ps._fields(data) if k in (1, 2))
    path = tmp_path_factory.mktemp("model") / "folded.model"
    path.write_bytes(out + b"\x1a" + number(len(rules)) + rules)
    return str(path)


def test_compiled_map_as_the_library(folded):
    import sentencepiece

    own, library, rng = ps.Pieces(folded), sentencepiece.SentencePieceProcessor(model_file=folded), random.Random(4)
    assert len(own.map.cells) > 1000 and own.squeeze
    signs = [*"abcé漢ｱ㌔½ﬁÅ①⑳ﾞｶ \t\n\r​　 ́ê̂각ᄀ​…№™Ⅷ", "  ", "ｶﾞ", "é", "가", "ﷺ", "­", "\x00", "▁"]
    for _ in range(3000):
        same(own, library, "".join(rng.choices(signs, k=rng.randrange(30))))
    assert spans(own, "  ①  ｶﾞ ")[0] == library.encode("  ①  ｶﾞ ")


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        ps.Pieces(str(path))


def test_rows(spark, library):
    base = texts()
    got = {r.doc_id: r for r in ps.encode_spans(documents(spark, base), ps.piece_model(), carry=["lang", "key", "n"]).collect()}
    assert sorted(got) == list(range(len(base)))
    for i, text in enumerate(base):
        want = library.encode(text or "", return_type="proto").pieces
        r = got[i]
        assert r.ids == [p.id for p in want] and list(zip(r.starts, r.ends)) == [(p.begin, p.end) for p in want]
        assert r.n_tokens == len(want) and r.decoded == library.decode(r.ids) and (r.lang, r.key, r.n) == ("en", "k", 7)
        data = (text or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends)) == data


def test_query_rows(spark, library, tmp_path):
    from fixtures import folder

    base = [*texts(), "long text of words\n" * 90_000]  # more than a slice
    got = {r.doc_id: r for r in ps.op11_sentencepiece(spark, folder(spark, tmp_path, base)).collect()}
    for i, text in enumerate(base):
        pieces = library.encode(text or "", return_type="proto").pieces
        ids, places = [p.id for p in pieces], np.array([(p.begin, p.end) for p in pieces], "<u8")
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert tuple(got[i]) == (i, len(ids), *hashes, len((text or "").encode()), zlib.crc32(places.tobytes()))


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in ps.encode_spans(rows, ps.piece_model()).collect()) == [(0, 0), (0, 2), (1, 2), (1, 2)]
    assert ps.encode_spans(rows.limit(0), ps.piece_model()).count() == 0
    names = rows.selectExpr("concat('x', doc_id) AS doc_id", "text")
    assert sorted(str(r.doc_id) for r in ps.encode_digests(names, ps.piece_model()).collect()) == ["None", "None", "x1", "x1"]
    with pytest.raises(ValueError):
        ps.encode_spans(rows.withColumn("ids", rows.doc_id), ps.piece_model(), carry=["ids"])
