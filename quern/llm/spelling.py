"""Spelling variants: words of the corpus that one edit makes of each other, by an inverted index of positional q-grams.

**Words** are counted within slices of the texts and then over all documents.

**Candidates.** A word of n letters, with q - 1 marks before and after it, has n + q - 1 q-grams. Two words that one inserted, deleted or
replaced letter parts share at least T = max(n) - 1 of them at the same place, or one further after the edit. So in any order of the grams
that is the same everywhere they share one of their first q + 1 (rarest first here). Words therefore meet in shards of (one of these grams,
the length of the shorter word). The order is a table over all grams that the alphabet allows (``ALPHABET`` ** 3 numbers), and nothing else goes to
all workers. Shards of a gram with more than ``SHARD`` words are cut into blocks, and every two blocks meet in a cell of their own.

**Merge.** A shard has postings by (gram, place). A word of which fewer than T grams have postings has no neighbour. Else the T - 1 longest
lists are set aside; a heap merges the others and counts. The lists set aside are then looked up until a word has T or can't get
there. What has T is verified letter by letter. A pair is given in the shard of the first gram that both begin with, so once.

**Groups.** A word's form is its most frequent neighbour, if that is ``times`` as frequent; forms are followed to the last by doubling pointers.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.common import as_bytes, documents, mix, narrow, pieces, stretches, whole_ids

Q = 3
#: Letters that words can have (a-z, U+00C0 to U+00FF), the marks before and after a word.
ALPHABET = 26 + 64 + 2
#: Words of a shard beyond which it is cut into blocks, and words whose counts a task holds.
SHARD, HELD = 8192, 300_000
#: Fixed value: of the runs of a document, one in so many loses a letter.
SLIP = 97

_OTHER = re.compile(rb"[\xc0-\xc2\xc4-\xff][\x80-\xbf]*")  # characters beyond U+00FF, and U+0080 to U+00BF
_LEADS = bytes([*range(0xC0, 0xC3), *range(0xC4, 256)])
#: a-z and the bytes of U+00C0 to U+00FF stay, A-Z become a-z, all other bytes spaces.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))


def runs(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lower-cased."""
    if len(text.translate(None, _LEADS)) < len(text):
        text = _OTHER.sub(b" ", text)
    return text.translate(_RUNS).split()


def slipped(word: bytes, crc: int) -> bytes:
    """The word without the letter that the number points at."""
    letters = word.decode()
    at = crc % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counts(min_letters: int, slip: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            kept = [w for w in total if len(w) >= min_letters and (w.isascii() or len(w) - w.count(b"\xc3") >= min_letters)]
            out = pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array([total[w] for w in kept], pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in pieces(batches):
            for i, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                own: Counter = Counter()
                for part in stretches(text):
                    own.update(runs(part))
                start = zlib.crc32(b":" if i is None else b"%d:" % i)
                for word, n in own.items():
                    if slip and not (crc := zlib.crc32(word, start)) % slip:
                        word = slipped(word, crc)
                    total[word] += n
            if len(total) > HELD:
                yield flush()
        yield flush()

    return run


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 5, min_count: int = 3, slip: int | None = None) -> DataFrame:
    """(word, n): words of at least ``min_letters`` letters that stand at least ``min_count`` times in all texts.

    With ``slip``, a run whose crc32 of ``id:run`` that number divides loses a letter first; a null id is written as nothing there.
    """
    rows = narrow(docs, id_col, text_col)
    counted = rows.mapInArrow(_counts(min_letters, slip), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


_NUMBER = np.zeros(256, np.int32)  # of a letter in Latin-1
_NUMBER[97:123], _NUMBER[0xC0:256] = np.arange(26), np.arange(26, 90)


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all q-grams, number of each word's) at once."""
    pad = bytes([1] * (Q - 1))
    joined = np.frombuffer(b"".join(x for w in words for x in (pad, w, b"\2\2")), np.uint8)
    own = np.where(joined == 1, 90, np.where(joined == 2, 91, _NUMBER[joined]))
    every = (own[:-2] * ALPHABET + own[1:-1]) * ALPHABET + own[2:] if len(own) > 2 else np.empty(0, np.int32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + Q - 1
    first = np.cumsum(size + Q - 1) - (size + Q - 1)
    stop = np.cumsum(size)
    return every[np.repeat(first - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)], size


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _gram_counts(rank_file: str | None):
    """How many words have each gram, or (with the order of the grams) have it among their first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ALPHABET**Q, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _latin(batch.column("word"))
            if rank_file is None:
                n += np.bincount(grams_of(words)[0], minlength=len(n))
            else:
                n += np.bincount(np.concatenate(first_grams(words, store.kept(rank_file, "<i4"))), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["gram", "n"])

    return run


def first_grams(words: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The different ones of each word's first q + 1 grams, rarest first. A gram that a word has twice counts twice."""
    every, size = grams_of(words)
    owner = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((rank[every], owner))
    every, place = every[order], np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
    keep = place <= Q
    every, owner = every[keep], owner[keep]
    new = np.concatenate([[True], (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])])
    every, owner = every[new], owner[new]
    return np.split(every, np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])


def _dense(counted: DataFrame) -> np.ndarray:
    """Counts by gram. There are at most ``ALPHABET`` ** 3 rows, whatever the corpus."""
    out, rows = np.zeros(ALPHABET**Q, np.int64), counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return out


_MEMBER = "gram int, size int, low int, high int, block int, long boolean, word string, n long, first binary"


def _members(rank_file: str, blocks_file: str):
    """A word's rows: for each of its first grams in the shard of its own length and in that of one letter less, and in each cell of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, blocks = store.kept(rank_file, "<i4"), store.kept(blocks_file, "<i4")
        for batch in batches:
            if not batch.num_rows:
                continue
            words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            out = []
            for word, count, first in zip(words, n, first_grams(_latin(batch.column("word")), rank)):
                seed, begins = None, first.astype("<i4").tobytes()
                for g in first.tolist():
                    own, many = 0, int(blocks[g])
                    if many > 1:
                        seed = zlib.crc32(word.encode()) if seed is None else seed
                        own = int(mix(np.array([seed], np.uint64))[0] % np.uint64(many))
                    for other in range(many):
                        for longer in (False, True):
                            out.append((g, len(word) - longer, min(own, other), max(own, other), own, longer, word, count, begins))
            kinds = [*[pa.int32()] * 5, pa.bool_(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["gram", "size", "low", "high", "block", "long", "word", "n", "first"])

    return run


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes b of a, which is not longer."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if n == len(b) else a[i:] == b[i + 1 :])


def merged(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """(member, in how many lists it is) by a heap over sorted lists."""
    heads = [[own[0], k, 0] for k, own in enumerate(lists)]
    heapify(heads)
    while heads:
        member, count = heads[0][0], 0
        while heads and heads[0][0] == member:
            _, k, at = heads[0]
            count += 1
            if at + 1 < len(lists[k]):
                heapreplace(heads, [lists[k][at + 1], k, at + 1])
            else:
                heappop(heads)
        yield member, count


def near_in_shard(words: list[bytes], longer: list[bool]) -> Iterator[tuple[int, int]]:
    """Pairs of a shard that one edit parts, as places (shorter or earlier word, other). Shorter words come before the longer ones."""
    every, size = grams_of(words)
    stop = np.cumsum(size)
    keys = (every.astype(np.int64) << 32 | np.arange(len(every)) - np.repeat(stop - size, size)).tolist()
    index: dict[int, list[int]] = {}
    get = index.get
    for i, (end, many, extra) in enumerate(zip(stop.tolist(), size.tolist(), longer)):
        own, need = keys[end - many : end], many - Q  # of n + q - 1 grams all but q are shared
        if extra:  # the same place, or one further than in the shorter word
            posts = [x for k in own if (x := [p for p in (get(k), get(k - 1)) if p])]
        else:
            posts = [[p] for k in own if (p := get(k))]
        if len(posts) >= need:
            posts.sort(key=lambda x: sum(map(len, x)))
            free = len(posts) - need + 1  # who is in none of so many lists can't be in enough of them
            aside = posts[free:]
            for member, count in merged([p for post in posts[:free] for p in post]):
                for k, post in enumerate(aside):
                    if count >= need or count + len(aside) - k < need:
                        break
                    for p in post:
                        at = bisect_left(p, member)
                        if at < len(p) and p[at] == member:
                            count += 1
                            break
                if count >= need and one_edit(words[member], words[i]):
                    yield member, i
        if not extra:
            for k in own:
                if k in index:
                    index[k].append(i)
                else:
                    index[k] = [i]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of the words of sorted shards: how many, and the best one, for each word and shard. A shard's shorter words come first."""
    held, name = [], None

    def close() -> pa.RecordBatch:
        found: dict[str, list] = {}
        for i, j in near_in_shard([r[2].encode("latin-1") for r in held], [r[1] for r in held]):
            a, b = held[i], held[j]
            if name[2] != name[3] and a[0] == b[0]:  # two words of one block meet in the block's own cell
                continue
            there = set(np.frombuffer(b[4], "<i4").tolist())
            if next(g for g in np.frombuffer(a[4], "<i4").tolist() if g in there) != name[0]:  # they meet before this shard
                continue
            for x, y in ((a, b), (b, a)):
                best = found.setdefault(x[2], [0, (0, "")])
                best[0] += 1
                best[1] = min(best[1], (-y[3], y[2]))
        out = [(w, c, -m, f) for w, (c, (m, f)) in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "form_n", "form"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("gram", "size", "low", "high")))
        for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in ("block", "long", "word", "n", "first")))):
            if key != name:
                if len(held) > 1 and not held[0][1]:
                    yield close()
                held, name = [], key
            held.append(row)
    if len(held) > 1 and not held[0][1]:
        yield close()


def near_words(words: DataFrame, folder: str) -> DataFrame:
    """(word, n_near, form_n, form): how many words are one edit away, and the most frequent of them (ties: the smallest)."""
    rank = np.empty(ALPHABET**Q, np.int32)
    rank[np.argsort(_dense(words.mapInArrow(_gram_counts(None), "gram int, n long")), kind="stable")] = np.arange(len(rank))
    store.put(f"{folder}/rank", rank.astype("<i4").tobytes())
    size = _dense(words.mapInArrow(_gram_counts(f"{folder}/rank"), "gram int, n long"))
    store.put(f"{folder}/blocks", (-(-size // SHARD)).astype("<i4").tobytes())
    members = words.mapInArrow(_members(f"{folder}/rank", f"{folder}/blocks"), _MEMBER)
    width = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = ["gram", "size", "low", "high"]
    found = members.repartition(width, *shard).sortWithinPartitions(*shard, "long", "word").mapInArrow(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def roots(edges: DataFrame, folder: str) -> DataFrame:
    """(word, root) for (word, form) without cycles: each round doubles how far a pointer reaches."""
    at, k = store.table(edges.select("word", F.col("form").alias("root")), f"{folder}/roots-0"), 0
    while True:
        k += 1
        far = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = at.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        at = store.table(at, f"{folder}/roots-{k}")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def group_spellings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 5, min_count: int = 3, times: int = 2, slip: int | None = None) -> DataFrame:
    """Every word with its form and root: word, form, root, n, n_near, form_n.

    Words are runs of a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``min_letters`` letters (3 and more) and ``min_count`` occurrences. The form is the
    near word (one edit away) of largest n, ties to the smallest, if its n is at least ``times`` (2 and more) the word's; else null. The root
    is the last form, the word itself if it has none. Null and empty texts have no words; null ids, ties and repeated rows count
    as they stand; empty tables give an empty result. Other columns are not looked at. Ids must be integers (``ValueError``).
    """
    whole_ids(docs, id_col)
    if times < 2 or min_letters < Q:
        raise ValueError("times must be 2 at least, so that forms end, and min_letters 3")
    folder = store.new_dir(docs.sparkSession, "spelling")
    words = store.table(count_words(docs, id_col=id_col, text_col=text_col, min_letters=min_letters, min_count=min_count, slip=slip), f"{folder}/words")
    near = near_words(words, folder)
    has = F.col("form_n") >= times * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    out = store.table(out, f"{folder}/forms")
    last = roots(out.filter("form IS NOT NULL").select("word", "form"), folder)
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_spellings(documents(spark, sf_dir), slip=SLIP)


#: crc32 by its table of 256 steps, which the text makes first.
OP13_SQL = r"""
WITH RECURSIVE steps(i, t, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, k + 1 FROM steps WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(t ORDER BY i) AS ts FROM steps WHERE k = 8),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL),
spelt AS (SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bs FROM runs),
crc AS (SELECT w, n, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || bs, lambda c, b: xor(c >> 8, ts[xor(c & 255, b) + 1]))) AS h FROM spelt, crcs),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM crc),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
best AS (SELECT p.word, min(p.other) AS other FROM pairs p JOIN near USING (word) WHERE p.m = near.m GROUP BY p.word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
chain(word, root, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.form = f.word)
SELECT f.word, f.form, c.root AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
