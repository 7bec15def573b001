"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

**Encoding.** For every prefix of a word there is one last token of its encoding: the token t that ends
there such that (last token of what is before t, t) is a pair which BPE itself would leave standing. An automaton over the
vocabulary gives the tokens that end at a symbol, the longest first; so reading one symbol adds one entry (``last token``), and an
encoding is a walk back through the entries.
A later symbol can only undo a merge by a chain of merges of falling rank; ``Merges.lookahead`` is the
length of the longest such chain of the merge list, in symbols. Tokens that end before the
lookahead are stable: they are emitted, and their entries go. So memory doesn't grow with a word. (Before emitting, the
walks of all live entries are held against each other; were the bound too small, tokens would wait.) Every word goes this way,
whatever its length; the end of a word makes all its tokens stable.

**Decoding.** A state machine takes a document's tokens in order, some at a time: their bytes go through an incremental UTF-8
decoder, which holds back at most three bytes of an unfinished character.

Texts are cut into units (words, digits, runs of signs) by the file's word pattern. A unit's tokens are kept in a bounded
cache under its bytes, as natural text repeats its words.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, as_text, documents, narrow, no_clash, pieces, stretches

CACHE = 100_000  # words whose tokens a worker keeps


class Merges:
    """A merge list: tokens by name, the two parts of each merged token, and its sufficient lookahead.

    A symbol is a character; with a ``suffix``, the last one of a word is another symbol than the same character within it.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "", first: list[str] = ()):
        """``first``: symbols that have the numbers from 0, in this order."""
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}  # the rank of the merge that makes a token; -1: a single symbol
        for rank, (a, b) in enumerate(pairs):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            if both in self.born:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[left, right], self.parts[both], self.born[both] = rank, (left, right), rank
        # tokens that BPE can reach, by their symbols
        spelt = {i: self._symbols(name) for name, i in vocab.items()}
        spelt = {i: x for i, x in spelt.items() if i in self.born or len(x) == 1}
        self.symbol = {x[0]: k for k, x in enumerate(dict.fromkeys([*((c,) for c in first), *((x[0],) for x in spelt.values() if len(x) == 1)]))}
        self.length = [0] * (max(vocab.values(), default=0) + 1)
        for i, x in spelt.items():
            self.length[i] = len(x)
        self.longest = max(map(len, spelt.values()), default=1)
        self._automaton(spelt)
        self._fits: dict[int, bool] = {}
        self.lookahead = self._lookahead(pairs)

    def _symbols(self, name: str) -> list[str]:
        base = name.removesuffix(self.suffix) if self.suffix else name
        return list(name) if base == name or not base else [*base[:-1], base[-1] + self.suffix]

    def _automaton(self, spelt: dict[int, list[str]]) -> None:
        """States are beginnings of tokens; ``ending`` is the longest token that ends in a state, ``shorter`` the next one that ends with a token."""
        self.width = len(self.symbol)
        self.trie: dict[int, int] = {}
        own, back = [-1], [0]
        edges: list[list[tuple[int, int, int]]] = [[] for _ in range(self.longest)]
        for i, x in spelt.items():
            state = 0
            for depth, c in enumerate(x):
                key = state * self.width + self.symbol[c]
                if key not in self.trie:
                    self.trie[key] = len(own)
                    edges[depth].append((state, self.symbol[c], len(own)))
                    own.append(-1)
                    back.append(0)
                state = self.trie[key]
            own[state] = i
        self.back, self.ending, self.shorter = back, own, [-1] * len(self.length)
        self.jump: dict[int, int] = {}
        for level in edges:
            for state, c, here in level:
                back[here] = self.step(back[state], c) if state else 0
                before = self.ending[back[here]]
                if own[here] >= 0:
                    self.shorter[own[here]] = before
                else:
                    own[here] = before
        self.jump.clear()

    def step(self, state: int, symbol: int) -> int:
        """The longest beginning of a token that the text then ends with."""
        key = state * self.width + symbol
        if (out := self.jump.get(key)) is None:
            at = state
            while (out := self.trie.get(at * self.width + symbol)) is None and at:
                at = self.back[at]
            if len(self.jump) > 500_000:
                self.jump.clear()
            out = self.jump[key] = out or 0
        return out

    def _lookahead(self, pairs: list) -> int:
        """Symbols beyond a token's end that can still change it.

        A merge (a, b) is undone from the right only if an earlier merge takes a token which is b or ends
        b; that merge hangs on another one to its right in the same way, of an earlier rank again. ``far``
        is the length of the longest chain that starts with a merge whose left part is the given token.
        """
        far: dict[int, int] = {}
        most = 0
        for a, b in pairs:
            left, right = self.vocab[a], self.vocab[b]
            x, reach = right, 0
            while True:
                reach = max(reach, far.get(x, 0))
                if x not in self.parts:
                    break
                x = self.parts[x][1]
            reach += self.length[right]
            far[left] = max(far.get(left, 0), reach)
            most = max(most, reach)
        return most + self.longest

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b as they are when their texts stand side by side."""
        key = a << 32 | b
        if (known := self._fits.get(key)) is not None:
            return known
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        limit, x, y, out = 1 << 60, a, b, True
        while True:
            # a merge across the border that comes before the step which made a part here
            if (rank := self.rank.get((x, y))) is not None and rank < limit:
                out = False
                break
            bx, by = self.born.get(x, -1), self.born.get(y, -1)
            if bx < 0 and by < 0:
                break
            # take back the later of the two merges; at the same rank the left one came first
            if bx > by:
                limit, x = bx, self.parts[x][1]
            else:
                limit, y = by + 1, self.parts[y][0]
        self._fits[key] = out
        return out

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Tokens of one word, each as soon as no later symbol can change it. Symbols outside the vocabulary are passed over."""
        run, held = Transducer(self), None
        for symbol in symbols:
            if held is not None and (known := self.symbol.get(held)) is not None:
                yield from run.push((known,))
            held = symbol
        if held is not None and (known := self.symbol.get(held + self.suffix)) is not None:
            yield from run.push((known,))
        yield from run.finish()

    def word(self, text: str) -> list[int]:
        """As ``stream``, for a word that is there whole; it is taken a lookahead's length at a time."""
        get = self.symbol.get
        symbols = list(map(get, text))
        if symbols:
            symbols[-1] = get(text[-1] + self.suffix)
        return self.numbered([x for x in symbols if x is not None])

    def numbered(self, symbols: list[int]) -> list[int]:
        """Tokens of a word whose symbols are given by their numbers."""
        run, most = Transducer(self), self.lookahead
        if len(symbols) <= most:
            return run.push(symbols) + run.finish()
        out = [i for at in range(0, len(symbols), most) for i in run.push(symbols[at : at + most])]
        return out + run.finish()


class Transducer:
    """Takes the symbols of one word and gives tokens that no later symbol can change."""

    __slots__ = ("merges", "last", "before", "state")

    def __init__(self, merges: Merges):
        # the last token of each prefix that is not out yet, the token before these, and the automaton's state
        self.merges, self.last, self.before, self.state = merges, [], -1, 0

    def push(self, symbols: Iterable[int]) -> list[int]:
        m, last, before, state = self.merges, self.last, self.before, self.state
        jump, width, ending, length, shorter, known = m.jump.get, m.width, m.ending, m.length, m.shorter, m._fits.get
        i = len(last)
        for c in symbols:
            if (to := jump(state * width + c)) is None:
                to = m.step(state, c)
            state = to
            t = ending[to]
            while True:
                j = i - length[t]
                prior = last[j] if j >= 0 else before
                if prior < 0:
                    break
                if (fits := known(prior << 32 | t)) is None:
                    fits = m.fits(prior, t)
                if fits:
                    break
                t = shorter[t]
            last.append(t)
            i += 1
        self.state = state
        return self._stable() if i > 2 * (m.lookahead + m.longest) else []

    def _walk(self, end: int) -> list[int]:
        last, length, out = self.last, self.merges.length, []
        while end > 0:
            out.append(last[end - 1])
            end -= length[out[-1]]
        return out[::-1]

    def _stable(self) -> list[int]:
        m, last = self.merges, self.last
        paths = [self._walk(len(last) - k) for k in range(m.longest)]
        same = 0
        while all(len(p) > same and p[same] == paths[0][same] for p in paths):
            same += 1
        out, gone, free = [], 0, len(last) - m.lookahead - m.longest
        for t in paths[0][:same]:
            if gone + m.length[t] > free:
                break
            gone += m.length[t]
            out.append(t)
        if out:
            self.before = out[-1]
            del last[:gone]
        return out

    def finish(self) -> list[int]:
        return self._walk(len(self.last))


class ByteToText:
    """Turns tokens into text step by step; ``join`` stands between tokens."""

    def __init__(self, spell: dict[int, bytes], join: bytes = b""):
        self.spell, self.join, self.begun = spell, join, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.bytes([self.spell.get(i, b"") for i in ids])

    def bytes(self, spelt: list[bytes]) -> str:
        """As ``feed``, of tokens that are spelt already."""
        data = self.join.join(spelt)
        if self.begun and spelt:
            data = self.join + data
        self.begun = self.begun or bool(spelt)
        return self.state.decode(data)

    def end(self) -> str:
        """What is left; the machine then begins anew."""
        rest, self.begun = self.state.decode(b"", True), False
        self.state.reset()
        return rest


def byte_letters() -> dict[int, str]:
    """The usual letters for bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the tokenizer file says, by the transducer.

    The file's own normaliser and pre-tokeniser cut texts into words; for common Latin letters the same is done here faster, if the
    file has the pattern that is known here.
    """

    #: The word pattern of the file that the fast path is for.
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    LATIN = regex.compile(r"[!-~¡-įı-ž]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as src:
            spec = json.load(src)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain BPE files are supported")
        self.lib = Tokenizer.from_file(path)
        self.letters, suffix = byte_letters(), model.get("end_of_word_suffix") or ""
        # a byte within a word has its own value as number, one at the end 256 more
        ends = [self.letters[b] + tail for tail in dict.fromkeys(("", suffix)) for b in range(256)]
        self.bytewise = all(x in model["vocab"] for x in ends)
        self.merges = Merges(model["vocab"], model["merges"], suffix, ends if self.bytewise else ())
        self.at_end = 256 if suffix else 0
        self.names = {i: name for name, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: name for name, i in self.added.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        text = json.dumps(spec.get("pre_tokenizer"))
        self.fast = json.dumps(self.PATTERN)[1:-1] in text and [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.words = regex.compile(self.PATTERN)
        if spec.get("decoder") is None:
            self.spell, self.join = {i: name.encode() for i, name in self.names.items()}, b" "
        elif spec["decoder"]["type"] == "ByteLevel":
            back = {c: b for b, c in self.letters.items()}
            self.spell, self.join = {i: bytes(back[c] for c in name) if all(c in back for c in name) else name.encode() for i, name in self.names.items()}, b""
        else:
            raise ValueError(f"unknown decoder {spec['decoder']['type']}")

    def plain(self, text: str) -> list[int]:
        """Tokens of a text without special tokens."""
        out: list[int] = []
        if self.fast and self.LATIN.fullmatch(text):
            table = self.letters
            for word in self.words.findall("".join(map(str.lower, text)) if not text.isascii() else text.lower()):
                out.extend(self.merges.word(word if word.isascii() else "".join([table[b] for b in word.encode()])))
        else:
            text = self.lib.normalizer.normalize_str(text) if self.lib.normalizer else text
            for word, _ in self.lib.pre_tokenizer.pre_tokenize_str(text):
                out.extend(self.merges.word(word))
        return out

    def unit(self, unit: bytes) -> tuple[int, ...]:
        """Tokens of a unit as ``units`` gives it."""
        if self.fast and self.bytewise and unit.isalpha():  # ASCII letters: one word, which is only lower-cased
            symbols = list(unit.lower())
            symbols[-1] += self.at_end
            return tuple(self.merges.numbered(symbols))
        return tuple(self.encode(unit.decode("utf-8", "replace")))

    def encode(self, text: str) -> list[int]:
        if self.marks is None or "<" not in text and not any(x in text for x in self.added):
            return self.plain(text)
        out: list[int] = []
        for k, part in enumerate(self.marks.split(text)):
            out.extend([self.added[part]] if k % 2 else self.plain(part) if part else [])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        state = ByteToText(self.spell, self.join)
        return state.feed(list(ids)) + state.end()


#: Signs that stand apart from letters and digits; what is in none of the classes makes a stretch that is left whole.
_ODD = bytes([*range(9), *range(14, 32), 127, ord("'"), ord("<"), *range(0xC0, 0xC3), *range(0xC6, 256)])
_PLAIN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
_MIXED = re.compile(rb"[^ \t-\r]*(?:[\x00-\x08\x0e-\x1f\x7f'<\xc0-\xc2\xc6-\xff]|\xc3[\x97\xb7])[^ \t-\r]*|" + _PLAIN.pattern)


def units(text: bytes) -> list[bytes]:
    """Cuts a text into units as the known pattern does: a run of letters, a digit, or a run of other signs; A-Z may be lower-cased.

    A stretch between white space with anything but ASCII and Latin letters (or with a quote or a possible
    special token) stays whole and as it is, for the slow path.
    """
    odd = len(text.translate(None, _ODD)) < len(text) or b"\xc3\x97" in text or b"\xc3\xb7" in text
    return _MIXED.findall(text) if odd else _PLAIN.findall(text.lower())


class Known(dict):
    """What units give; when it is full, it becomes the older one, from which live units come back."""

    def __init__(self, make, most: int = CACHE):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, unit: bytes):
        if (out := self.older.get(unit)) is None:
            out = self.make(unit)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(unit) < 200:
            self[unit] = out
        return out


def ids_of(text: bytes, cache: Known) -> np.ndarray:
    """All ids of a text, by its units; of a very long text a part at a time."""
    get, out = cache.__getitem__, []
    for part in stretches(text):
        out.append(np.array(list(chain.from_iterable(map(get, units(part)))), np.int64))
    return out[0] if len(out) == 1 else np.concatenate(out)


_codecs: dict[str, tuple[Codec, Known, np.ndarray, np.ndarray]] = {}


def codec(path: str) -> tuple[Codec, Known, np.ndarray, np.ndarray]:
    """This worker's codec, its units' ids, and the decimals and spellings of ids."""
    if path not in _codecs:
        own = Codec(path)
        size = max(own.names) + 1
        decimal, spelt = np.empty(size, object), np.empty(size, object)
        decimal[:] = [b"%d" % i for i in range(size)]
        spelt[:] = [own.spell.get(i, b"") for i in range(size)]
        gc.set_threshold(1_000_000, 100, 100)  # the cache holds many tuples, none in a cycle
        _codecs[path] = own, Known(own.unit), decimal, spelt
    return _codecs[path]


FEED = 1 << 16  # ids that the decoder takes at a time


def _encode(path: str, names: list[str], decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache, decimal, spelt = codec(path)
        for batch in pieces(batches):
            sizes, joined, decoded = [], [], []
            for text in as_bytes(batch.column("text")):
                ids = ids_of(text, cache)
                sizes.append(len(ids))
                joined.append(b" ".join(decimal[ids].tolist()))
                if decode:
                    state = ByteToText({}, own.join)
                    parts = [state.bytes(spelt[ids[at : at + FEED]].tolist()) for at in range(0, len(ids), FEED)]
                    decoded.append("".join([*parts, state.end()]).encode())
            made = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()), "ids": as_text(joined)} | ({"decoded": as_text(decoded)} if decode else {})
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return run


def _require_spaces(path: str) -> None:
    """Texts are cut by a known pattern only."""
    if not codec(path)[0].fast:
        raise ValueError("the file's normaliser or word pattern is not the known one")


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Encodes each text and decodes the tokens again.

    Returns doc_id, n_tokens, ids (decimal, joined by one space), decoded, and the carried columns, which
    may not have these names (``ValueError``). Special tokens' strings in a text become their ids; truncation and
    padding of the file are not used. A null or empty text has no tokens and decodes to an empty text. Rows stand for
    themselves: null ids, ties and repeated rows stay as they are; an empty table gives an empty result.
    """
    no_clash(carry, ("doc_id", "text", "n_tokens", "ids", "decoded"))
    _require_spaces(path)
    rows = narrow(docs, id_col, text_col, carry)
    names = ["doc_id", *[c for c in rows.columns if c not in ("doc_id", "text")], "n_tokens", "ids", *["decoded"] * decode]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"n_tokens": "long", "ids": "string", "decoded": "string"}
    return rows.mapInArrow(_encode(path, names, decode), ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _digests(path: str):
    inner = _encode(path, ["doc_id", "n_tokens", "ids", "decoded"], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            made = [batch.column("doc_id"), batch.column("n_tokens")]
            made += [pa.array([hashlib.sha256(x).hexdigest() for x in as_bytes(batch.column(c))]) for c in ("ids", "decoded")]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with SHA-256 in place of ids and decoded text. The id keeps its type."""
    _require_spaces(path)
    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(_digests(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return encode_digests(documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long")), path or word_tokenizer())
