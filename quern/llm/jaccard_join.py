"""N-gram Jaccard join by partitioning the universe of tokens, and its connected components.

**Bound.** Two sets of sizes a <= b with Jaccard similarity of at least t differ in at most
H = floor((1 - t) / (1 + t) * (a + b)) tokens. Set sizes are cut into bands; a set meets sets of its own band and of the
bands that a partner may lie in. For each pair of bands the universe of tokens is hashed into segments. A segment is
given an allowance: 0 (the two subsets must be equal) or 1 (they may differ in one token, found over the subset and
its one-deletion neighbourhood). If the allowances plus one sum to more than H, one segment of every linked
pair keeps within its allowance (pigeonhole): so the signatures lose no link.

**Allocation.** How many segments of either kind a band gets follows from costs: signatures that all its sets send,
and sets that meet strangers by subsets of no or one token. The sizes are counted over all documents
first. More segments than H + 1 may be cut at no more signatures: each set then leaves out those of its smallest subsets,
as many as there are segments to spare (see ``_segments``), so empty subsets, which all share, are not sent.

**Stars.** A signature's sets meet in a star: all with the smallest of them (as a window minimum, no pairs within a
group). A pair that shares a signature lies in the star of its smallest set. A star's sets are compared
in blocks: a star of at most ``BLOCK`` sets is one task's group; a larger one is dealt into blocks, and each two
blocks meet in a group of their own. First by parity maps of a bit or two a token, whose distance never exceeds the sets'
difference; what remains is verified exactly on the whole sets. Within a group all links are found by counting common tokens over postings; what
goes out is a spanning forest, so never more rows than sets. Tokens are 128-bit hashes of the words' bytes, and equal sets are one
class throughout, under a 128-bit hash of their tokens.

**Components** are found over the forests by alternating large and small stars, each round written
to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.bloom import sieve
from quern.llm.common import as_bytes, codes, documents, mix, narrow, no_clash, pieces, sets, shingles, whole_ids, words

GROWTH = 1.5  # from one band's largest size to the next one's
SIG_BYTES, SET_BYTES = 14, 24  # shuffled for a signature, and for a token of a set that is in a star
BLOCK = 512  # sets of a verified block
SLICE = 1 << 20  # bytes of text at once
BLOCK_TOKENS = 1_000_000  # and tokens that a group may have before it is dealt into blocks
SALTS = 16  # parts of a large star's rows


class Bands:
    """Bands of set sizes and the segments of each, for a similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int, largest: int, sizes: dict[int, int] | None = None):
        self.num, self.den = num, den
        self.top = [1]
        while self.top[-1] < largest:
            self.top.append(max(self.top[-1] + 1, int(self.top[-1] * GROWTH)))
        count = [0] * len(self.top)
        for size, n in (sizes or {}).items():
            count[self.band(size)] += n
        self.plan = [self._plan(b, count) for b in range(len(self.top))]

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.top, size))

    def partner(self, size: int) -> int:
        """The largest size that a set may have to be linked with one of ``size``."""
        return size * self.den // self.num

    def differ(self, b: int) -> int:
        """Tokens in which a set of band b and a set at least as large may differ."""
        t = Fraction(self.num, self.den)
        high = self.top[b]
        return math.floor((1 - t) / (1 + t) * (high + self.partner(high)))

    def _plan(self, b: int, count: list[int]) -> tuple[int, int, int]:
        """(segments with allowance 0, segments with allowance 1, signatures of the first that each set leaves out) of least cost.

        Costs are bytes shuffled: signatures that all sets of the band send, and the sets themselves
        where a subset so small that strangers share it (empty, or one token less) brings them into a star.
        """
        need = self.differ(b) + 1
        if need <= 1:
            return 0, 0, 0  # only equal sets are linked
        n = count[b] + sum(c for k, c in enumerate(count[b + 1 :], b + 1) if self.top[k - 1] < self.partner(self.top[b]))
        size = self.top[b] / math.sqrt(GROWTH)
        met = lambda p: 1 - math.exp(-n * p)  # noqa: E731  whether any other set has the same small subset
        options = []
        for part in (0, 5, 10, 15, 20, 30, 40, 60):
            zeros = need + need * part // 100
            none = math.exp(-size / zeros)
            weak = max(0.0, zeros * none - (zeros - need)) * met(none)
            options.append((need * SIG_BYTES + size * SET_BYTES * min(1.0, weak), zeros, 0, zeros - need))
        for ones in range(1, need // 2 + 1, max(1, need // 16)):
            zeros = need - 2 * ones
            per = size / (zeros + ones)
            none = math.exp(-per)
            weak = zeros * none * met(none) + ones * none * (1 + per) * met(none * (1 + per))
            options.append(((zeros + ones * (1 + per)) * SIG_BYTES + size * SET_BYTES * min(1.0, weak), zeros, ones, 0))
        return min(options)[1:]

    def signatures(self, tokens: np.ndarray, owners: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, set number) of all sets given as sorted runs of tokens."""
        out, who = [], []
        own = np.searchsorted(self.top, sizes)
        # as the smaller set of a pair in its own band, as the larger one also in the bands of smaller partners
        low = np.searchsorted(self.top, -(-sizes * self.num // self.den))
        most = int((own - low).max()) if len(sizes) else 0
        for back in range(most + 1):
            chosen = np.flatnonzero((sizes > 0) & (own - back >= low))
            if not len(chosen):
                continue
            at = np.zeros(len(sizes), bool)
            at[chosen] = True
            live = at[owners]
            sig, by = self._segments(tokens[live], owners[live], own - back, chosen)
            out.append(sig)
            who.append(by)
        return (np.concatenate(out), np.concatenate(who)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def _segments(self, tokens, owners, bands, chosen):
        plan = np.array(self.plan, np.int64).reshape(-1, 3)
        zeros, ones, spare = plan[bands, 0], plan[bands, 1], plan[bands, 2]
        total = zeros + ones
        use = chosen[total[chosen] > 0]
        live = total[owners] > 0
        tokens, owners = tokens[live], owners[live]
        if not len(use):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        segment = ((mix(tokens + np.uint64(0x51)) >> np.uint64(32)) * total[owners].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        first = np.zeros(len(bands) + 1, np.int64)  # where each set's segments begin
        n = np.zeros(len(bands), np.int64)
        n[use] = total[use]
        first[1:] = np.cumsum(n)
        where = first[owners] + segment
        # a subset's hash is a sum over its tokens, so taking one out is a subtraction
        value = mix(tokens ^ np.uint64(0xA5A5_5A5A_1234_9876))
        subset = np.zeros(int(first[-1]), np.uint64)
        np.add.at(subset, where, value)
        by = np.repeat(np.arange(len(bands)), n)
        number = np.arange(len(by)) - first[by]
        salt = mix((bands[by].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(77))
        whole = mix(subset + salt)
        # Each set leaves out as many signatures as there are segments to spare, those of its smallest subsets (ties by
        # hash). Of the signatures that two linked sets share, more than that, the one that comes last in
        # this order has the others before it in both sets, so neither leaves it out.
        filled = np.bincount(where, minlength=len(subset))
        order = np.lexsort((whole, filled, by))
        place = np.empty(len(by), np.int64)
        place[order] = np.arange(len(by)) - first[by]
        stay = place >= spare[by]
        out, who = [whole[stay]], [by[stay]]
        gone = segment >= zeros[owners]  # segments with allowance 1 come last; their subsets with one token out
        if gone.any():
            at = where[gone]
            out.append(mix(subset[at] - value[gone] + salt[at]))
            who.append(owners[gone])
        return np.concatenate(out), np.concatenate(who)


def token_sets(texts: list[bytes], size: int):
    """(tokens in two lanes, sorted in each set; set number of each; size of each set)."""
    which, counts, known = words(texts)
    tokens, n = sets(*shingles(which, counts, codes(known), size), len(texts))
    return tokens, np.repeat(np.arange(len(texts)), n), n


def set_names(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each set, as two rows of signed numbers; it is 0, 0 for the empty set."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    data = np.ascontiguousarray(tokens.T).tobytes()
    out = [xxhash.xxh3_128_digest(data[16 * a : 16 * b]) if b > a else bytes(16) for a, b in zip(ends, ends[1:])]
    return np.ascontiguousarray(np.frombuffer(b"".join(out), "<i8").reshape(-1, 2).T)


def parity_maps(tokens: np.ndarray, owners: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bitmap of each set, of 64 bits or its size rounded up to a power of two: bit b is the parity of the tokens whose hash ends in b.

    Each token in which two sets differ turns one bit, so the Hamming distance of their maps is no larger than
    the number of those tokens. A map folds to half its length by exclusive or.
    """
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    start = np.cumsum(bits) - bits
    cell = start[owners] + (mix(tokens ^ np.uint64(0x3C6E_F372)) & (bits[owners] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(bits.sum()) // 8, np.uint8)
    np.bitwise_xor.at(out, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
    data = out.tobytes()
    return [data[a // 8 : (a + n) // 8] for a, n in zip(start.tolist(), bits.tolist())]


_SIZED = {"n_shingles": "long", "class": "long", "twin": "long", "map": "binary"}


_GROUP = "struct<linked: boolean, one: bigint, two: bigint>"


def _sizes(shingle: int, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=SLICE):
            tokens, owners, n = token_sets(as_bytes(batch.column("text")), shingle)
            names = set_names(tokens, n)
            made = [pa.array(n.astype(np.int64)), pa.array(names[0]), pa.array(names[1]), pa.array(parity_maps(tokens[0], owners, n), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *made], [*passed, *_SIZED])

    return run


def _signatures(shingle: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # classes that this task has sent already: copies go no further
        for batch in pieces(batches, most=SLICE):
            tokens, owners, n = token_sets(as_bytes(batch.column("text")), shingle)
            names = set_names(tokens, n)[0]
            fresh = np.zeros(len(n), bool)
            for k, name in enumerate(names.tolist()):
                if n[k] and name not in sent:
                    sent.add(name)
                    fresh[k] = True
            if len(sent) > 2_000_000:
                sent.clear()
            live = fresh[owners]
            sig, who = bands.signatures(tokens[0][live], owners[live], np.where(fresh, n, 0))
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(names[who])], ["sig", "class"])

    return run


def _set_rows(shingle: int):
    keys = ["star", "x", "y", "sub", "node", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()  # rows that repeat wholly go no further
        for batch in pieces(batches, most=SLICE):
            tokens, _, n = token_sets(as_bytes(batch.column("text")), shingle)
            # another row of the same id may have another text: the class says which one is meant
            names = set_names(tokens, n)
            same = (names[0] == batch.column("class").to_numpy()) & (names[1] == batch.column("twin").to_numpy())
            who = list(zip(*(batch.column(c).to_pylist() for c in ("star", "x", "y", "node", "side"))))
            for k in np.flatnonzero(same):
                same[k] = who[k] not in done
                done.add(who[k])
            ends = np.concatenate([[0], np.cumsum(n)])
            data = np.ascontiguousarray(tokens.T).tobytes()
            made = [batch.column(c) for c in keys] + [pa.array([data[16 * a : 16 * b] for a, b in zip(ends, ends[1:])], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, [*keys, "tokens"]).filter(pa.array(same))

    return run


class Roots:
    """Union-find over names; the smallest name is the root."""

    def __init__(self, names):
        self.up = {n: n for n in names}

    def top(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y) -> bool:
        """Whether the two were apart."""
        p, q = self.top(x), self.top(y)
        self.up[max(p, q)] = min(p, q)
        return p != q


def near_maps(left: list[tuple[int, bytes]], right: list[tuple[int, bytes]] | None, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of (size, parity map) that may be linked: no linked pair is left out."""
    other = left if right is None else right
    width = min(len(m) for _, m in [*left, *other]) // 8

    def folded(rows):
        out = np.empty((len(rows), width), np.uint64)
        for k, (_, m) in enumerate(rows):
            out[k] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, width))
        return out

    maps, sizes = folded(other), np.array([n for n, _ in other])
    for i, ((n, _), own) in enumerate(zip(left, maps if right is None else folded(left))):
        most = (den - num) * (n + sizes) // (den + num)
        ok = (num * np.maximum(n, sizes) <= den * np.minimum(n, sizes)) & (np.bitwise_count(maps ^ own).sum(1) <= most)
        hit = np.flatnonzero(ok)
        for j in hit[hit > i] if right is None else hit:
            yield i, int(j)


def _sift(num: int, den: int):
    """Of a group, the sets that may be linked with another one, in the parts that such pairs make."""

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_pylist()
        rows = list(zip(group.column("n").to_pylist(), group.column("map").to_pylist()))
        first, second = ([k for k, s in enumerate(side) if s == which] for which in (0, 1))
        within = group.column("x")[0].as_py() == group.column("y")[0].as_py()
        roots, live = Roots(range(len(rows))), set()
        if first and (within or second):
            for i, j in near_maps([rows[k] for k in first], None if within else [rows[k] for k in second], num, den):
                a, b = first[i], first[j] if within else second[j]
                roots.join(a, b)
                live.update((a, b))
        keep = sorted(live)
        return group.select(["star", "x", "y", "node", "side", "class", "twin", "anon", "key"]).take(pa.array(keep, pa.int64())).append_column("sub", pa.array([roots.top(k) for k in keep], pa.int32()))

    return run


def links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> Iterator[tuple[int, int, int]]:
    """All linked pairs (i, j, common tokens) between two lists of sorted token arrays (or within one), by postings."""
    other = left if right is None else right
    size = np.fromiter(map(len, other), np.int64, len(other))
    tokens = np.concatenate(other) if len(other) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(other)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for i, mine in enumerate(left):
        a, b = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        n = b - a
        if not n.any():
            continue
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[at], minlength=len(other))
        union = len(mine) + size - common
        hit = np.flatnonzero((den * common >= num * union) & (common > 0))
        for j in hit[hit > i] if right is None else hit:
            yield i, int(j), int(common[j])


def numbered(data: list[bytes]) -> list[np.ndarray]:
    """Numbers for the 128-bit tokens of a group's sets: equal tokens have one number, sorted within each set."""
    both = np.frombuffer(b"".join(data), "<u8").reshape(-1, 2)
    order = np.lexsort((both[:, 1], both[:, 0]))
    both = both[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(np.concatenate([[0], (both[1:] != both[:-1]).any(1)])) if len(order) else 0
    ends = np.cumsum([len(x) // 16 for x in data])
    return [number[a:b] for a, b in zip([0, *ends], ends)]


def _verify(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        # a set stands once in a group, also where the rows of one id were dealt to two tasks
        first_of = {(n, s): k for k, (n, s) in reversed(list(enumerate(zip(group.column("node").to_pylist(), group.column("side").to_pylist()))))}
        rows = sorted(first_of.values())
        name, side = ([group.column(c)[k].as_py() for k in rows] for c in ("node", "side"))
        tokens = numbered([group.column("tokens")[k].as_py() for k in rows])
        first, second = ([k for k, s in enumerate(side) if s == which] for which in (0, 1))
        within = group.column("x")[0].as_py() == group.column("y")[0].as_py()
        roots = Roots(name)
        a, b = [], []
        if first and (within or second):
            for i, j, _ in links([tokens[k] for k in first], None if within else [tokens[k] for k in second], num, den):
                x, y = name[first[i]], name[first[j] if within else second[j]]
                if roots.join(x, y):
                    a.append(x)
                    b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root): the smallest node that each node with an edge reaches, by alternating large and small stars."""
    now = store.table(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), f"{folder}/round-0")
    for step in range(1, 100):
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select("v", F.col("m").alias("u")).union(small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        after = store.table(small, f"{folder}/round-{step}")
        # done when no node is both below one and above another
        if after.join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0 and after.groupBy("v").count().filter("count > 1").limit(1).count() == 0:
            return after.select(F.col("v").alias("node"), F.col("u").alias("root"))
        now = after
    raise RuntimeError("components did not settle")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 8, den: int = 10, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, group and the carried columns: the smallest doc_id that links of a Jaccard similarity of at least num / den reach.

    A set has the distinct windows of ``shingle`` words (A-Z lower-cased, words apart at ASCII white space) of the whole text;
    a shorter text is one window; a null or empty text has none and links with nothing. Documents with equal
    sets are linked. A row with a null id links as any other and has its component's smallest id, which is null if none of its rows
    has an id; ``group`` is a name of the component whatever its ids (null for a row without words). Repeated rows are rows of their own with the same component. An empty table gives an empty result. Ids must be
    integers; carried columns may not have the names of results (``ValueError``).
    """
    no_clash(carry, ("doc_id", "text", "anon", "key", "component_id", "group", *_SIZED))
    whole_ids(docs, id_col)
    spark = docs.sparkSession
    folder = store.new_dir(spark, "jaccard")
    # a row is found again by its id; one without an id by its text
    rows = narrow(docs, id_col, text_col, carry).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("anon", F.col("doc_id").isNull()).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    passed = [c for c in rows.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | _SIZED
    sized = store.table(rows.mapInArrow(_sizes(shingle, passed), ", ".join(f"`{c}` {kinds[c]}" for c in [*passed, *_SIZED])), f"{folder}/sizes")
    # sizes that differ by little share a row: the histogram has a bounded number of rows
    scale = F.floor(F.log(F.col("n_shingles").cast("double")) * 20)
    spread = sized.filter("n_shingles > 0").groupBy(scale.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("most")).collect()
    if not spread:
        return sized.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast(_GROUP).alias("group"), *(carry or []))
    bands = Bands(num, den, max(r.most for r in spread), {max(1, round(math.exp(r["size"] / 20))): r.n for r in spread})

    # a signature goes with the first half of its set's name: sets that share it meet in the same stars, so no link is lost
    sent = rows.select("text").mapInArrow(_signatures(shingle, bands), "sig long, class long")
    low = F.min("class").over(Window.partitionBy("sig"))
    stars = sent.withColumn("star", low).filter(F.col("class") != F.col("star")).select("star", "class").distinct()
    stars = store.table(stars, f"{folder}/stars")
    # each class by one row of its own: of the copies, the one with the smallest id; its number is fixed as the table is written
    heads = sized.filter("n_shingles > 0").groupBy("class", "twin").agg(F.min(F.struct("anon", "key")).alias("who"), F.first("n_shingles").alias("n"), F.first("map").alias("map"))
    heads = store.table(heads.select("class", "twin", "who.anon", "who.key", "n", "map", F.monotonically_increasing_id().alias("node")), f"{folder}/heads")
    shared = heads.groupBy("class").count().filter("count > 1").select(F.col("class").alias("star"), "class")
    members = stars.union(stars.select("star", F.col("star").alias("class")).distinct()).union(shared)
    full = members.distinct().join(heads, "class")
    total = full.groupBy("star").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("sets") / F.lit(BLOCK)), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS))).cast("int")
    # stars of several blocks are few; their rows meet the number of blocks by a salt too, so no star is one task's
    large = total.select("star", blocks.alias("blocks")).filter("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    full = full.withColumn("salt", F.pmod(F.col("node"), F.lit(SALTS)).cast("int")).join(large, ["star", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    full = full.withColumn("block", F.pmod(F.xxhash64("node", "star"), F.col("blocks")).cast("int"))
    # block x meets itself and all others, once each: group (x, y), side 0 for the lower one
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))
    dealt = full.withColumn("m", F.explode(meets)).select("star", "m.x", "m.y", "node", F.col("m.side").alias("side"), "class", "twin", "anon", "key", "n", "map")
    # first by their parity maps, which are small; whole sets go only where a pair may be linked
    found = "star long, x int, y int, node long, side int, class long, twin long, anon boolean, key long, sub int"
    dealt = store.table(dealt.groupBy("star", "x", "y").applyInArrow(_sift(num, den), found), f"{folder}/dealt")
    # a filter over the keys keeps all other texts where they are
    asked = sieve(dealt.select("key").distinct(), folder)
    rows = rows.select("anon", "key", "text").filter(asked(F.col("key")))
    texts = rows.filter("NOT anon").union(rows.filter("anon").distinct())
    groups = texts.join(dealt.hint("shuffle_hash"), ["anon", "key"]).select("star", "x", "y", "sub", "node", "side", "class", "twin", "text")
    groups = groups.mapInArrow(_set_rows(shingle), "star long, x int, y int, sub int, node long, side int, tokens binary")
    forest = groups.groupBy("star", "x", "y", "sub").applyInArrow(_verify(num, den), "a long, b long")
    found = components(forest, folder)

    # classes to components, then a component's smallest document
    found = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    found = heads.select("class", "twin", "node").join(found, "node").select("class", "twin", F.lit(True).alias("linked"), "root")
    name = F.struct(F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("root", "class").alias("one"), F.when(F.col("linked"), F.lit(0).cast("long")).otherwise(F.col("twin")).alias("two"))
    roots = sized.join(found, ["class", "twin"], "left").select("doc_id", "n_shingles", name.alias("root"), *(carry or []))
    roots = store.table(roots, f"{folder}/roots")
    least = roots.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    least = store.table(least, f"{folder}/least")  # both sides are then dealt anew, and a component with very many rows is split
    out = roots.join(least, "root", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("root")).alias("group"), *(carry or []))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir), shingle=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id AND r.root < l.y),
g AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN g USING (doc_id)
"""
