"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark and memory-mapped for scoring.

1. Words are counted by the 128-bit hash of their bytes: each task sums up, sends sorted arrays by hash range, and a task per range
   writes sorted arrays of hashes with counts. The rank of a word's hash in the whole order is its number.
2. Pairs of numbers (context, word) are counted likewise, dealt by context; a context with more than a fourth of a
   shard's share of tokens is dealt by the word too, so no shard is hot. A shard is a sorted array of pairs with counts. There are as
   many shards as the input's bytes ask for.
3. From the pairs come, by ranges of numbers again, each context's total and how many of its words were seen
   once, twice, more often, and each word's number of different contexts (its continuation count).
4. Discounts are the usual ones from counts of counts. Workers map the arrays and score texts:

   p(w | h) = max(c(h w) - D(c(h w)), 0) / c(h) + g(h) p(w),   p(w) = max(k(w) - D'(k(w)), 0) / K + g' / (V + 1)

   with the contexts' count k(w), K all pairs, V different tokens; after an unseen context p(w) alone holds.

What is gathered grows with the corpus and stays in files of the shared folder; the driver gets a row for each shard
and the hot contexts (at most four for each shard).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.common import P, as_bytes, codes, documents, find_pairs, mix, narrow, pieces, words

BEGIN, END, FIRST = 0, 1, 2  # numbers of the beginning, the end token and the first word
FLUSH = 3_000_000
SMOOTH = 0.1
SHARD_BYTES = 64 << 20  # of the input, for each shard of the model


def _pack(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(plain.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _expand(data: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(plain.reshape(8, -1).T).view("<i8").reshape(-1)


def summed(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys of two lanes and the sums of their counts."""
    order = np.lexsort((low, high))
    high, low, n = high[order], low[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(n) else np.empty(0, np.int64)
    return high[head], low[head], np.add.reduceat(n, head) if len(head) else n


def _send(high: np.ndarray, low: np.ndarray, n: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of sorted keys by shard; the shard rises with the high lane."""
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(cuts[1:], len(shard))
    rows = [(int(shard[a]), _pack(high[a:b]), _pack(low[a:b]), _squeeze(n[a:b])) for a, b in zip(cuts, ends)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "high", "low", "n"])


_SENT = "shard int, high binary, low binary, n binary"


def _counting(slices, shard_of):
    """A task that sums up the keys of two lanes that ``slices`` gives for each slice of texts, and sends them when much is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def merged():
            return summed(*(np.concatenate([x[k] for x in held]) for k in range(3)))

        for batch in pieces(batches):
            held.append(slices(as_bytes(batch.column("text"))))
            many += len(held[-1][0])
            if many >= FLUSH:
                held = [merged()]
                many = len(held[0][0])
                if many >= FLUSH // 2:
                    yield from _send(*held[0], shard_of(held[0][0]))
                    held, many = [], 0
        if held:
            out = merged()
            yield from _send(*out, shard_of(out[0]))

    return run


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(_unpack(h), _unpack(k), _expand(n)) for h, k, n in zip(*(group.column(c).to_pylist() for c in ("high", "low", "n")))]
    return summed(*(np.concatenate([x[k] for x in parts]) for k in range(3)))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    which, _, known = words(texts)
    code = codes(known)
    return code[:, 0], code[:, 1], np.bincount(which, minlength=len(known))


def hash_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _vocabulary(folder: str):
    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        high, low, n = _gathered(group)
        store.put(f"{folder}/words-{shard}", high.tobytes(), low.tobytes(), n.astype("<i8").tobytes())
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(n)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64())})

    return run


class Vocabulary:
    """Numbers and counts of words, over the mapped arrays. ``base``: words in the ranges before each."""

    def __init__(self, folder: str, base: list[int], docs: int):
        self.folder, self.base, self.docs = folder, np.array(base, np.int64), docs
        self.shards, self.size = len(base) - 1, base[-1]

    def _arrays(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        high, low, n = store.kept(f"{self.folder}/words-{shard}", "u8").reshape(3, -1)
        return high, low, n.view(np.int64)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each hash."""
        number, count = np.full(len(code), -1, np.int64), np.zeros(len(code), np.int64)
        order = np.argsort(code[:, 0])
        cuts = np.searchsorted(hash_shard(code[order, 0], self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[s] : cuts[s + 1]]
            high, low, n = self._arrays(int(s))
            i = find_pairs(high, low, code[at, 0], code[at, 1])
            hit = i >= 0
            number[at[hit]] = FIRST + self.base[s] + i[hit]
            count[at[hit]] = n[i[hit]]
        return number, count

    def read(self, texts: list[bytes]):
        """(numbers, counts) of the slice's different tokens; each token and its context among these; tokens of each text, whose last one is the end."""
        which, counts, known = words(texts)
        number, count = self.find(codes(known))
        here = len(known)  # the end has this place, the beginning the next one
        number, count = np.append(number, [END, BEGIN]), np.append(count, [self.docs, 0])
        token = np.insert(which.astype(np.int64), np.cumsum(counts), here)
        n = counts + 1
        context = np.empty(len(token), np.int64)
        context[1:] = token[:-1]
        context[np.cumsum(n) - n] = here + 1
        return number, count, token, context, n


class PairKeys:
    """Shards and keys of (context, token). The shard takes a part of the context's number, and the rest and the token are the key.

    A hot context is dealt by its tokens; its key has the context's place in the list of hot ones instead, and the highest bit.
    """

    def __init__(self, shards: int, size: int, hot: np.ndarray):
        self.shards, self.hot, self.bits = shards, hot, int(size + FIRST).bit_length()
        if self.bits + max(((size + FIRST) // shards).bit_length(), len(hot).bit_length()) > 63:
            raise ValueError(f"{size} different words need more than {shards} shards")

    def split(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, key) of each pair."""
        shard, rest = context % self.shards, context // self.shards
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            hot = self.hot[place] == context
            spread = (mix(token.astype(np.uint64) + context.astype(np.uint64) * np.uint64(P)) >> np.uint64(33)).astype(np.int64) % self.shards
            shard, rest = np.where(hot, spread, shard), np.where(hot, place + (1 << 63 - self.bits), rest)
        return shard.astype(np.uint64), rest.astype(np.uint64) << np.uint64(self.bits) | token.astype(np.uint64)

    def parts(self, shard: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, token) of the keys of a shard."""
        rest, token = (key >> np.uint64(self.bits)).astype(np.int64), (key & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        context = rest * self.shards + shard
        hot = rest >= 1 << 63 - self.bits
        context[hot] = self.hot[rest[hot] - (1 << 63 - self.bits)]
        return context, token


def _pairs(vocabulary: Vocabulary, keys: PairKeys):
    def slices(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number, _, token, context, _ = vocabulary.read(texts)
        both, n = np.unique(context << 32 | token, return_counts=True)  # by their places in the slice
        return *keys.split(number[both >> 32], number[both & 0xFFFFFFFF]), n

    return slices


_STATS = "part int, kind int, ids binary, stats binary, c1 long, c2 long, c3 long, c4 long, pairs long"


def _pair_arrays(folder: str, width: int, pairs: PairKeys):
    """Writes a shard of pairs, and sends on what it adds to contexts (kind 0) and to words (kind 1), by range of numbers."""

    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        _, keys, n = _gathered(group)
        store.put(f"{folder}/pairs-{shard}", keys.tobytes(), n.astype("<i8").tobytes())
        context, word = pairs.parts(shard, keys)
        rows = []

        def send(kind: int, ids: np.ndarray, stats: np.ndarray) -> None:
            part = ids // width
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
                rows.append((int(part[a]), kind, _pack(ids[a:b].astype(np.uint64)), _squeeze(np.ascontiguousarray(stats[:, a:b]).reshape(-1)), 0, 0, 0, 0, 0))

        head = np.flatnonzero(np.diff(context, prepend=-1))  # in order of their numbers, and then those of the hot list
        send(0, context[head], np.stack([np.add.reduceat(x, head) for x in (n, n == 1, n == 2, n > 2)]).astype(np.int64))
        ids, k = np.unique(word, return_counts=True)
        send(1, ids, k.reshape(1, -1))
        rows.append((-1, -1, b"", b"", *(int((n == c).sum()) for c in (1, 2, 3, 4)), len(keys)))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in _STATS.split(", ")])

    return run


def _stat_arrays(folder: str, width: int):
    """Arrays of contexts (total, once, twice, more often) or of words (contexts), dense over a range of numbers."""

    def run(group: pa.Table) -> pa.Table:
        part, kind = group.column("part")[0].as_py(), group.column("kind")[0].as_py()
        lines = 4 if kind == 0 else 1
        out = np.zeros((lines, width), np.int64)
        for ids, stats in zip(group.column("ids").to_pylist(), group.column("stats").to_pylist()):
            out[:, _unpack(ids).astype(np.int64) - part * width] += _expand(stats).reshape(lines, -1)
        store.put(f"{folder}/{('contexts', 'words-after')[kind]}-{part}", out.astype("<i8").tobytes())
        k = out[0] if kind else np.empty(0, np.int64)
        return pa.table({f"c{c}": pa.array([int((k == c).sum())], pa.int64()) for c in (1, 2, 3, 4)} | {"more": pa.array([int((k > 2).sum())], pa.int64())})

    return run


def discounts(c: list[int]) -> tuple[float, float, float]:
    """The three discounts from counts of counts; where one is missing, its share is the one that is known, or a half."""
    n1, n2, n3, n4 = c
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [k - (k + 1) * y * b / a if a and b else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


class Model:
    """What a worker needs to score texts; arrays are mapped from the folder when they are first used."""

    def __init__(self, folder, vocabulary, keys, width, total, types, pairs, pair_discounts, word_discounts, word_kinds):
        self.folder, self.vocabulary, self.keys, self.width = folder, vocabulary, keys, width
        self.total, self.types, self.pairs = total, types, pairs
        self.pair_discounts, self.word_discounts = np.array([0.0, *pair_discounts]), np.array([0.0, *word_discounts])
        self.left = sum(d * n for d, n in zip(word_discounts, word_kinds))  # what the words' discounts leave

    def _dense(self, name: str, ids: np.ndarray, lines: int) -> np.ndarray:
        out = np.zeros((lines, len(ids)), np.int64)
        part = np.where(ids >= 0, ids // self.width, -1)
        for p in np.unique(part[part >= 0]):
            at = np.flatnonzero(part == p)
            data = store.kept(f"{self.folder}/{name}-{p}", "<i8")
            if len(data):
                out[:, at] = data.reshape(lines, -1)[:, ids[at] - p * self.width]
        return out

    def count(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), np.int64)
        shard, keys = self.keys.split(context, token)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.keys.shards + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[s] : cuts[s + 1]]
            data = store.kept(f"{self.folder}/pairs-{s}", "u8")
            have, n = data[: len(data) // 2], data[len(data) // 2 :].view(np.int64)
            if len(have):
                i = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
                out[at] = np.where(have[i] == keys[at], n[i], 0)
        return out

    def word(self, ids: np.ndarray) -> np.ndarray:
        """Probability of words without a context; -1 is any unknown word."""
        flat = 1.0 / (self.types + 1)
        if not self.pairs:
            return np.full(len(ids), flat)
        k = self._dense("words-after", ids, 1)[0]
        return np.maximum(k - self.word_discounts[np.minimum(k, 3)], 0.0) / self.pairs + self.left / self.pairs * flat

    def score(self, texts: list[bytes]):
        """(tokens, known tokens, base score, score) of each text, scores as log10."""
        number, seen, token, context, n = self.vocabulary.read(texts)
        owner = np.repeat(np.arange(len(n)), n)
        base = np.log10((seen + SMOOTH) / (self.total + SMOOTH * (self.types + 1)))[token]
        plain = self.word(number)[token]
        each, where = np.unique(context << 32 | token, return_inverse=True)  # pairs by their places in the slice
        before, after = number[each >> 32], number[each & 0xFFFFFFFF]
        c = np.zeros(len(each), np.int64)
        both = (before >= 0) & (after >= 0)
        c[both] = self.count(before[both], after[both])
        c = c[where]
        total, *kinds = self._dense("contexts", number, 4)
        d = self.pair_discounts
        rest = (d[1] * kinds[0] + d[2] * kinds[1] + d[3] * kinds[2])[context]
        total = total[context]
        some = np.maximum(total, 1)
        p = np.where(total > 0, np.maximum(c - d[np.minimum(c, 3)], 0.0) / some + rest / some * plain, plain)
        # a context whose counts lose nothing leaves nothing: the plain probability then keeps the sum finite
        p = np.where(p > 0, p, plain / (some + 1))
        sums = [np.bincount(owner, x, len(n)) for x in (base, np.log10(p))]
        return n, np.bincount(owner, (seen > 0)[token], len(n)).astype(np.int64), *sums


def train(docs: DataFrame, folder: str, *, text_col: str = "text") -> Model:
    """Counts the model over whole texts. A null or empty text has the end token alone; an empty table gives a model without counts."""
    spark = docs.sparkSession
    shards = store.slices_for(docs, SHARD_BYTES)
    rows = docs.select(docs[text_col].cast("string").alias("text"))
    sent = rows.mapInArrow(_counting(_words, lambda high: hash_shard(high, shards)), _SENT)
    found = {r["shard"]: r for r in sent.groupBy("shard").applyInArrow(_vocabulary(folder), "shard int, n long, total long").collect()}  # a row for each shard
    n_docs = rows.count()
    base = [0]
    for s in range(shards):
        base.append(base[-1] + (found[s]["n"] if s in found else 0))
    total = sum(r["total"] for r in found.values()) + n_docs
    types = base[-1] + (n_docs > 0)
    vocabulary = Vocabulary(folder, base, n_docs)

    most = max(1, total // (4 * shards))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("id").to_pylist():
                n = vocabulary._arrays(s)[2]
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n > most) + vocabulary.base[s] + FIRST)], ["id"])

    hot = [r["id"] for r in spark.range(shards, numPartitions=min(shards, 64)).mapInArrow(frequent, "id long").collect()]  # fewer than 4 x shards
    keys = PairKeys(shards, base[-1], np.array(sorted({*hot, *([BEGIN] if n_docs > most else [])}), np.int64))

    sent = rows.mapInArrow(_counting(_pairs(vocabulary, keys), lambda high: high.astype(np.int64)), _SENT)
    width = max(1 << 10, -(-(base[-1] + FIRST) // shards))
    stats = store.table(sent.groupBy("shard").applyInArrow(_pair_arrays(folder, width, keys), _STATS), f"{folder}/stats")
    c = stats.filter("kind = -1").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c1", "c2", "c3", "c4", "pairs")]).first()
    arrays = stats.filter("kind >= 0").groupBy("part", "kind").applyInArrow(_stat_arrays(folder, width), "c1 long, c2 long, c3 long, c4 long, more long")
    k = arrays.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c1", "c2", "c3", "c4", "more")]).first()
    store.remove(f"{folder}/stats")
    word_discounts = discounts([k.c1, k.c2, k.c3, k.c4])
    return Model(folder, vocabulary, keys, width, total, types, c.pairs, discounts([c.c1, c.c2, c.c3, c.c4]), word_discounts, (k.c1, k.c2, k.more))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, known, base, score = model.score(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Trains on the documents whose crc32(id as text) mod ``folds`` is not 0 and scores all.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score, score (log10) and
    perplexity. A null or empty text has the end token alone. A null id is held out. Repeated rows
    count and are scored as rows of their own. An empty table gives an empty result; a table without training documents gives even scores.
    """
    rows = narrow(docs, id_col, text_col)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = rows.select("doc_id", "text", ((fold == 0) | F.col("doc_id").isNull()).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")), store.new_dir(docs.sparkSession, "ngrams"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.total).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
