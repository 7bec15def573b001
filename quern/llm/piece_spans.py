"""SentencePiece encoding that keeps offsets: every piece is projected to a span of the original bytes.

**Normalisation.** A step takes the longest prefix that the model's compiled character map knows (a double-array trie over UTF-8
bytes, walked here as it is stored), or one character, and gives its replacement; each byte that comes out remembers where its
step began. A model with an empty map takes every character as it is. A space stands for the visible space of the pieces.

**Pieces.** The normalised text is cut where no piece of the vocabulary can reach across (two bytes that stand side by side in
no piece): merges left and right of such a place don't meet. The parts that a worker hasn't seen yet are merged
together in stacked arrays: in each round every part makes its merge of best score, the leftmost one of several. Characters that no
piece has are written as byte pieces.

**Spans.** Pieces follow each other without gaps in the normalised text, so their ends are running sums; the remembered starts
turn them into spans of the original bytes. Of the byte pieces of one character the last one has its span, the others are empty.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SLICE_BYTES, Numbers, as_bytes, as_text, documents, narrow, no_clash, pieces

#: Parts whose pieces a worker keeps, and the longest one that is merged in stacked arrays.
KEEP, STACKED = 200_000, 64
#: The visible space of the pieces, types of pieces, the number of the model type.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
_WIDE = 1 << 21  # above all numbers of symbols: the vocabulary's and one for each other character


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialised message: (number, value)."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = data[at]
            out |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: the size of the trie, the trie's cells, then the replacements, each ended by a zero byte."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.cells = np.frombuffer(data, "<u4", size // 4, 4).tolist() if data else []
        self.out = data[4 + size :]
        self._known: dict[tuple[int, str], tuple[int | None, bytes | None]] = {}

    def _children(self, node: int) -> int:
        cell = self.cells[node]
        return node ^ ((cell >> 10) << ((cell & 512) >> 6))

    def _walk(self, node: int, char: str) -> tuple[int | None, bytes | None]:
        """The node after one more character, and the replacement of the key that ends there. ``node`` is where children begin."""
        leaf = False
        for byte in char.encode():
            at = node ^ byte
            if at >= len(self.cells) or self.cells[at] & 0x800000FF != byte:
                return None, None
            leaf, node = bool(self.cells[at] & 256), self._children(at)
        if not leaf:
            return node, None
        start = self.cells[node] & 0x7FFFFFFF
        return node, self.out[start : self.out.index(b"\0", start)]

    def steps(self, text: str) -> Iterator[tuple[bytes, int]]:
        """(what comes out, bytes taken) for the longest known prefix at each place, else for one character."""
        at, known, size = 0, self._known, len(text)
        root = self._children(0) if self.cells else None
        while at < size:
            node, end, out, i = root, at + 1, None, at
            while node is not None and i < size:
                if (step := known.get((node, text[i]))) is None:
                    if len(known) > 500_000:
                        known.clear()
                    step = known[node, text[i]] = self._walk(node, text[i])
                node, found = step
                i += 1
                if found is not None:
                    out, end = found, i
            taken = text[at:end].encode()
            yield (taken if out is None else out), len(taken)
            at = end


class Pieces:
    """A model file: normalises, encodes with spans and decodes.

    Only BPE models with byte pieces, visible spaces before words and no pieces of the user's own are taken (``ValueError``).
    """

    def __init__(self, path: str):
        with open(path, "rb") as src:
            spec = list(_fields(src.read()))
        trainer, rules = (dict(_fields(next((v for n, v in spec if n == k), b""))) for k in (2, 3))
        rows = [dict(_fields(v)) for n, v in spec if n == 1]
        kinds = [r.get(3, NORMAL) for r in rows]
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or not rules.get(5, 1) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte pieces and visible spaces before words are supported")
        self.map, self.prefix, self.squeeze = CharacterMap(rules.get(2, b"")), bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.names = [r[1].decode().replace(SPACE, " ") for r in rows]
        scores = np.array([struct.unpack("<f", r.get(2, bytes(4)))[0] for r in rows])
        self.byte_ids = {int(r[1][3:5], 16): i for i, r in enumerate(rows) if kinds[i] == BYTE}
        #: What each id is spelt as, in bytes; control pieces as nothing.
        self.spell = [bytes([int(n[3:5], 16)]) if k == BYTE else n.encode() if k == NORMAL else " ⁇ ".encode() if k == UNKNOWN else b"" for n, k in zip(self.names, kinds)]
        self.kinds = kinds
        # symbols: the normal pieces by their ids, then characters that stand in pieces only, then any other character as it comes
        self.piece = {n: i for i, n in enumerate(self.names) if kinds[i] == NORMAL}
        self.rows: list[bytes] = [struct.pack("<II", i, len(n.encode())) for i, n in enumerate(self.names)]
        self.symbol = np.full(0x110000, -1, np.int32)
        for c in {c for n in self.piece for c in n}:
            self.symbol[ord(c)] = self.piece[c] if c in self.piece else self._spelt(c)
        self._merges(scores)
        self._borders()
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _spelt(self, char: str) -> int:
        """A new symbol for a character without a piece: its byte pieces, of which the last one has the character's length."""
        data = char.encode("utf-8", "surrogatepass")
        self.rows.append(b"".join(struct.pack("<II", self.byte_ids[b], len(data) if k == len(data) - 1 else 0) for k, b in enumerate(data)))
        return len(self.rows) - 1

    def _merges(self, scores: np.ndarray) -> None:
        """All pairs of symbols that make a piece, by their key; better scores have smaller ranks, equal scores equal ones."""
        number = lambda s: int(self.symbol[ord(s)]) if len(s) == 1 else self.piece.get(s, -1)
        found = {number(n[:k]) * _WIDE + number(n[k:]): i for n, i in self.piece.items() for k in range(1, len(n)) if number(n[:k]) >= 0 and number(n[k:]) >= 0}
        self.pair = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.pair.tolist()] + [-1], np.int32)
        levels = np.unique(-scores, return_inverse=True)[1]
        self.rank = np.append(levels[self.made[:-1]], np.iinfo(np.int32).max).astype(np.int32)

    def _borders(self) -> None:
        """For two bytes side by side whether a character begins between them and no piece has them so."""
        free = np.ones((256, 256), bool)
        free[:, 0x80:0xC0] = False
        for n in self.piece:
            data = np.frombuffer(n.encode(), np.uint8)
            free[data[:-1], data[1:]] = False
        self.free = free.ravel()

    # normalisation

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """(normalised bytes, for each of them and for the end its place in the text).

        No places are given where all is as it was, one byte further because of the space before it.
        """
        if not self.map.cells and self.prefix and not self.squeeze and SPACE.encode() not in text:
            return b" " + text if text else b"", None
        out, size, first, at, ended = [], [], [], 0, self.squeeze
        lead = None
        for step, taken in self.map.steps(text.decode("utf-8", "replace")):
            if lead is None and not (self.squeeze and step == b" "):
                lead = at
            step = step.lstrip(b" ") if ended else step
            if step:
                ended = self.squeeze and step.endswith(b" ")
                # a space that is visible in the text already has one byte here too
                step = step.replace(SPACE.encode(), b" ")
                out.append(step)
                size.append(len(step))
                first.append(at)
            at += taken
        if lead is None:
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            out, size, first = [b" ", *out], [1, *size], [lead, *first]
        place = np.append(np.repeat(np.array(first, np.int64), size), at)
        joined = b"".join(out)
        if self.squeeze:
            joined = joined.rstrip(b" ")
        return joined, place[: len(joined) + 1]

    # pieces

    def parts(self, text: bytes, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
        """The normalised text cut at its borders, about ``most`` bytes at a time."""
        at, reach = 0, most
        while at < len(text):
            own = np.frombuffer(text, np.uint8, min(reach, len(text) - at), at).astype(np.uint16)
            cuts = np.flatnonzero(self.free[own[:-1] << 8 | own[1:]]) + 1
            whole = at + len(own) == len(text)
            if not whole and not len(cuts):  # one part is longer than that
                reach *= 2
                continue
            ends = [*(cuts + at).tolist(), *[len(text)] * whole]
            yield [text[a:b] for a, b in zip([at, *ends], ends)]
            at, reach = ends[-1], most

    def learn(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Pieces of parts, as packed (id, bytes of the normalised text)."""
        out = {}
        fresh = []
        for u in units:
            if (known := self.cache.get(u)) is None and (known := self.older.get(u)) is None:
                fresh.append(u)
            else:
                out[u] = known
        if fresh:
            made = dict(zip(fresh, self._encode(fresh)))
            out |= made
            if len(self.cache) + len(made) > KEEP:
                self.older, self.cache = self.cache, {}
            self.cache |= {u: made[u] for u in fresh[:KEEP] if len(u) < 200}
        return out

    def _encode(self, units: list[bytes]) -> list[bytes]:
        texts = [u.decode("utf-8", "replace") for u in units]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        for c in np.unique(points[self.symbol[points] < 0]).tolist():
            self.symbol[c] = self._spelt(chr(c))
        symbols, first = self.symbol[points], np.cumsum(lengths) - lengths
        done: list = [None] * len(units)
        low = 0
        for high in (8, 16, 32, STACKED):
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for at in range(0, len(chosen), 1 << 14):
                some = chosen[at : at + (1 << 14)]
                cols = np.arange(int(lengths[some].max()))
                grid = np.where(cols < lengths[some][:, None], symbols[np.minimum(first[some][:, None] + cols, len(symbols) - 1)], -1)
                for k, row in self._stacked(some, grid):
                    done[k] = row
        for k in np.flatnonzero(lengths > STACKED).tolist():
            done[k] = self._long(symbols[first[k] : first[k] + lengths[k]].tolist())
        get = self.rows.__getitem__
        return [b"".join(map(get, row)) if row else b"" for row in done]

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs in the table of merges; the place after the last one for those that don't merge."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * _WIDE + b, -1)
        at = np.searchsorted(self.pair, key)
        if not len(self.pair):
            return at
        return np.where(self.pair[np.minimum(at, len(self.pair) - 1)] == key, at, len(self.pair))

    def _stacked(self, names: np.ndarray, grid: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Merges rows of symbols (padded by -1) in rounds; a row that has no merge left goes out."""
        none, pairs = len(self.pair), self._find(grid[:, :-1], grid[:, 1:])
        while len(names):
            if pairs.shape[1]:
                ranks = self.rank[pairs]
                best = ranks.argmin(1)
                which = pairs[np.arange(len(names)), best]
            else:
                which = np.full(len(names), none)
            over = which == none
            if over.any():
                for k, row in zip(names[over].tolist(), grid[over].tolist()):
                    yield k, [s for s in row if s >= 0]
                names, grid, pairs, which = names[~over], grid[~over], pairs[~over], which[~over]
                if not len(names):
                    return
                best = best[~over]
            rows, cols = np.arange(len(names)), np.arange(grid.shape[1] - 1)
            later = cols > best[:, None]
            grid = np.take_along_axis(grid, cols + later, 1)
            grid[rows, best] = self.made[which]
            pairs = np.take_along_axis(pairs, cols[:-1] + later[:, :-1], 1)
            left, right = rows[best > 0], rows[best < pairs.shape[1]]
            pairs[left, best[left] - 1] = self._find(grid[left, best[left] - 1], grid[left, best[left]])
            pairs[right, best[right]] = self._find(grid[right, best[right]], grid[right, best[right] + 1])

    def _long(self, symbols: list[int]) -> list[int]:
        """As ``_stacked`` for one long part, with a heap of merges and links between neighbours."""
        n = len(symbols)
        own, after, before = np.array(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._find(own[:-1], own[1:])
        heap = [(int(self.rank[p]), k, int(self.made[p]), symbols[k], symbols[k + 1]) for k, p in enumerate(first.tolist()) if p < len(self.pair)]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(k: int, j: int) -> None:
            a, b = symbols[k], symbols[j]
            if (found := memo.get((a, b))) is None:
                p = int(self._find(np.array([a]), np.array([b]))[0])
                found = memo[a, b] = (int(self.rank[p]), int(self.made[p]))
            if found[1] >= 0:
                heapq.heappush(heap, (found[0], k, found[1], a, b))

        while heap:
            _, k, made, a, b = heapq.heappop(heap)
            if symbols[k] != a or (j := after[k]) >= n or symbols[j] != b:
                continue
            symbols[k], symbols[j] = made, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
                offer(k, after[k])
            if before[k] >= 0:
                offer(before[k], k)
        return [s for s in symbols if s >= 0]

    def encode(self, text: bytes) -> Iterator[np.ndarray]:
        """(id, start, end) of all pieces, some at a time; starts and ends are places in the normalised text."""
        at = 0
        for units in self.parts(text):
            known = Numbers()
            which = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
            pool, first, size = packed(self, known)
            rows = pool[gather(first[which], size[which])]
            ends = np.cumsum(rows[:, 1]) + at
            yield np.stack([rows[:, 0], ends - rows[:, 1], ends], 1)
            at = int(ends[-1]) if len(ends) else at

    def decode(self, ids: list[int]) -> str:
        """Text of ids. A space that begins it is taken away where encoding put one there; bytes that are no character become U+FFFD, one each."""
        out, held, begun = [], b"", False
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                held, begun = held + self.spell[i], True
                continue
            if held:
                out.append(_characters(held))
                held = b""
            if i is None or self.kinds[i] == CONTROL:
                continue
            text = self.spell[i].decode()
            if not begun and (self.prefix or self.squeeze) and self.kinds[i] == NORMAL and text.startswith(" "):
                text = text.lstrip(" ") if self.squeeze else text[1:]
                begun = bool(text) or not self.squeeze
            else:
                begun = True
            out.append(text)
        return "".join(out)


def _characters(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + _characters(data[e.start + 1 :])


def packed(own: Pieces, known: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the numbered parts: (rows of (id, bytes) of all, first row of each part, rows of each part)."""
    found = own.learn(list(known))
    values = [found[u] for u in known]
    size = np.fromiter(map(len, values), np.int64, len(values)) // 8
    return np.frombuffer(b"".join(values), "<u4").reshape(-1, 2).astype(np.int64), np.cumsum(size) - size, size


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Row numbers of stretches that begin at ``first`` and have ``size`` rows, one after another."""
    stop = np.cumsum(size)
    return np.repeat(first - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """This worker's model."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encoded(own: Pieces, texts: list[bytes]) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each text its (ids, starts, ends) in original bytes, some at a time.

    Texts of a slice are looked up together; one that is longer than a slice goes through in parts.
    """
    normal = [own.normalise(t) for t in texts]

    def project(rows: np.ndarray, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, start, end = rows[:, 0], rows[:, 1], rows[:, 2]
        return (ids, np.maximum(start - 1, 0), end - 1) if place is None else (ids, place[start], place[end])

    if len(texts) == 1:
        yield (project(rows, normal[0][1]) for rows in own.encode(normal[0][0]))
        return
    known, found, counts = Numbers(), [], []
    for data, _ in normal:
        counts.append(0)
        for units in own.parts(data):
            counts[-1] += len(units)
            found.append(np.fromiter(map(known.__getitem__, units), np.int64, len(units)))
    which = np.concatenate(found) if found else np.empty(0, np.int64)
    pool, first, size = packed(own, known)
    rows = pool[gather(first[which], size[which])]
    stop = np.concatenate([[0], np.cumsum(size[which])])[np.concatenate([[0], np.cumsum(counts)])]
    for k, (_, place) in enumerate(normal):
        mine = rows[stop[k] : stop[k + 1]]
        ends = np.cumsum(mine[:, 1])
        yield iter([project(np.stack([mine[:, 0], ends - mine[:, 1], ends], 1), place)] if len(mine) else [])


def _spans(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in pieces(batches):
            made: dict[str, list] = {"n_tokens": [], "ids": [], "starts": [], "ends": [], "decoded": []}
            for found in encoded(own, as_bytes(batch.column("text"))):
                ids, starts, ends = (np.concatenate(x) for x in zip(*found, (np.empty(0, np.int64),) * 3))
                made["n_tokens"].append(len(ids))
                made["ids"].append(ids.astype(np.int32))
                made["starts"].append(starts)
                made["ends"].append(ends)
                made["decoded"].append(own.decode(ids.tolist()).encode())
            cols = {"n_tokens": pa.array(made["n_tokens"], pa.int64()), "ids": pa.array(made["ids"], pa.list_(pa.int32())), "decoded": as_text(made["decoded"])}
            cols |= {c: pa.array(made[c], pa.list_(pa.int64())) for c in ("starts", "ends")}
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else batch.column(c) for c in names], names)

    return run


def encode_spans(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Encodes each text with the spans of its pieces in the text's bytes (UTF-8), and decodes the ids again.

    Returns doc_id, the carried columns, n_tokens, ids, starts, ends (a place each, ends are open) and decoded. Carried columns may not have
    these names (``ValueError``); other columns of the table are not looked at. A null or empty text has no pieces and decodes to an empty
    text. Rows stand for themselves: null ids, ties and repeated rows stay as they are; an empty table gives an empty result.
    """
    no_clash(carry, ("doc_id", "text", "n_tokens", "ids", "starts", "ends", "decoded"))
    rows = narrow(docs, id_col, text_col, carry)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "text"}
    kinds |= {"n_tokens": "long", "ids": "array<int>", "starts": "array<long>", "ends": "array<long>", "decoded": "string"}
    return rows.mapInArrow(_spans(path, list(kinds)), ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        decimal, spelt = np.empty(len(own.spell), object), np.empty(len(own.spell), object)
        decimal[:], spelt[:] = [b",%d" % i for i in range(len(own.spell))], own.spell
        for batch in pieces(batches):
            made = []
            for found in encoded(own, as_bytes(batch.column("text"))):
                n, end, crc, joined, text = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for ids, starts, ends in found:
                    written, data = b"".join(decimal[ids].tolist()), b"".join(spelt[ids].tolist())
                    joined.update(written if n else written[1:])
                    text.update(data if n or not own.prefix else data[1:])
                    crc = zlib.crc32(np.stack([starts, ends], 1).astype("<u8").tobytes(), crc)
                    n, end = n + len(ids), int(ends[-1])
                made.append((n, joined.hexdigest(), text.hexdigest(), end, crc))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            cols = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_crc32"])

    return run


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_spans``, with digests: SHA-256 of the ids (decimal, joined by commas) and of the decoded text.

    Added are n_bytes (the end of the last span) and spans_crc32 (starts and ends as little-endian 64-bit numbers, a pair for each piece).
    A long text goes through in parts; only its digests grow. The id keeps its type. Models that squeeze spaces are refused (``ValueError``).
    """
    if model(path).squeeze:
        raise ValueError("digests are made for models that keep all spaces")
    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(_digests(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_crc32 long")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return encode_digests(documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long")), path or piece_model())
