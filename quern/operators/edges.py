"""Run edges between the marks of a block, without a row for each pair: equal marks stand for each other, and directions are searched in order.

A mark's edges are taken by cost and id from three of each whole cost at most, so of equal partners the ``LEAST`` smallest ids are enough:
three, and one more as a mark is no partner of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PER_RULE, LEAST = 3, 4
#: A mark: its id, extents along and across, size across, centroid, bands and direction.
COLUMNS = ("id", "a0", "a1", "c0", "c1", "size", "cen", "b_right", "b_left", "dom")
#: Directions have nine decimals: as whole numbers they are compared exactly. The most that a turn may turn, and half a circle of axes.
UNIT = 10**9
MOST, HALF = 45 * UNIT, 180 * UNIT
#: Entries of a table of costs at a time.
CHUNK = 1 << 18

Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def places(*keys: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal keys, from 0."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the places first[k] to first[k] + n[k] - 1, and k beside each."""
    which = np.repeat(np.arange(len(n)), n)
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(which)), which


def alike(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys; the ids in the order of keys; where a key's ids begin there and how many of them count, ``LEAST`` at most."""
    order = np.lexsort((ids, key))
    key = key[order]
    first = np.flatnonzero(places(key) == 0)
    return key[first], ids[order], first, np.minimum(np.diff(np.append(first, len(key))), LEAST)


def joined(ids: np.ndarray, exits: np.ndarray, to: np.ndarray, entries: np.ndarray, cost: Callable) -> Iterator[Edges]:
    """Edges from marks of an exit to marks of an entry; ``cost`` gives a table over distinct exits and entries, not a number where no edge is."""
    if not len(ids) or not len(to):
        return
    out, source = np.unique(exits, return_inverse=True)
    keys, sorted_to, first, n = alike(entries, to)
    step = max(1, CHUNK // len(keys))
    for k in range(0, len(out), step):
        costs = cost(out[k : k + step], keys)
        x, y = np.nonzero(~np.isnan(costs))
        at, pair = spread(first[y], n[y])
        x, c, dst = x[pair], costs[x, y][pair], sorted_to[at]
        order = np.lexsort((dst, c, x))
        x, c, dst = x[order], c[order], dst[order]
        few = places(x, np.floor(c)) < LEAST
        x, c, dst = x[few], c[few], dst[few]
        here = np.flatnonzero((source >= k) & (source < k + step))
        count = np.bincount(x, minlength=min(step, len(out) - k))
        mine = source[here] - k
        at, which = spread((np.cumsum(count) - count)[mine], count[mine])
        src, dst, c = ids[here][which], dst[at], c[at]
        yield src[src != dst], dst[src != dst], c[src != dst]


def shared(m: dict, c0: int, c1: int) -> np.ndarray:
    return np.minimum(m["c1"], c1) >= np.maximum(m["c0"], c0)


def extents(m: dict, of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """The distinct extents across, 36 at most, and which of the marks ``of`` have them."""
    key = m["c0"] * 8 + m["c1"]
    for k in np.unique(key[of]):
        yield *divmod(int(k), 8), of & (key == k)


def contacts(m: dict, own: np.ndarray) -> Iterator[Edges]:
    def cost(exits, entries):
        (a1, right), (a0, left) = np.divmod(exits[:, None], 256), np.divmod(entries[None, :], 256)
        gap, both = 7 - a1 + a0, (right != 0) & (left != 0)
        j = np.where(both, np.bitwise_count(right & left).astype(float) / np.maximum(np.bitwise_count(right | left), 1), 0.0)
        return np.where(gap <= 4, gap.astype(float) + 1.0 - j, np.nan)

    for c0, c1, here in extents(m, own & (m["a1"] >= 3)):
        near = shared(m, c0, c1)
        yield from joined(m["id"][here], (m["a1"] * 256 + m["b_right"])[here], m["id"][near], (m["a0"] * 256 + m["b_left"])[near], cost)


def steps(m: dict, own: np.ndarray) -> Iterator[Edges]:
    low = m["size"] <= 5
    yield from joined(m["id"][own & low], m["cen"][own & low], m["id"][low], m["cen"][low], lambda x, y: np.where(np.abs(x[:, None] - y[None, :]) <= 1, 0.5, np.nan))


def ends(m: dict, own: np.ndarray) -> Iterator[Edges]:
    def cost(x, y):
        (p0, p1), (q0, q1) = np.divmod(x[:, None], 8), np.divmod(y[None, :], 8)
        far = np.minimum(np.minimum(abs(p0 - q0), abs(p1 - q1)), np.minimum(abs(p0 - q1), abs(p1 - q0)))
        parted = (np.minimum(p1, q1) < np.maximum(p0, q0)) & (np.maximum(p1 - p0, q1 - q0) + 1 > 5) & (far <= 4)
        return np.where(parted, 1.0 + far / 4.0, np.nan)

    key = m["c0"] * 8 + m["c1"]
    yield from joined(m["id"][own], key[own], m["id"], key, cost)


def turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = np.abs(a - b)
    return np.minimum(apart, 180 - apart)


def bins(dom: np.ndarray) -> np.ndarray:
    """Bins of 15 degrees; those of directions below 0 (an upright mark's may be -90) are below 0 too, and nothing turns to them."""
    return np.fmod(np.floor(dom / 15), 12)


def odd_costs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Costs of turns by the rule as it is written, bins and all: for directions that aren't from 0 to 180."""
    x, y = x[:, None], y[None, :]
    way = np.fmod(bins(y) - bins(x) + 24, 12)
    goes = (bins(y) >= 0) & ((way <= 3) | (way >= 9)) & (turned(x, y) <= 45)
    return np.where(goes, 1.0 + turned(x, y) / 45, np.nan)


def facing(m: dict, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By extent: which marks turn, which of them have directions from 0 to 180 as all their partners do, and which are partners."""
    tall = m["size"] >= 4
    for c0, c1, here in extents(m, own & tall):
        near = tall & shared(m, c0, c1) & (m["dom"] >= 0)
        even = here & (m["dom"] >= 0) & (m["dom"] < 180) & ~(m["dom"][near] >= 180).any()
        yield here, even, near


def whole(dom: np.ndarray) -> np.ndarray:
    return np.rint(dom * UNIT).astype(np.int64)


def turns(m: dict, own: np.ndarray) -> Iterator[Edges]:
    """Partners are next to a direction on either side of the circle, or exactly at the most that a turn may turn (of a whole cost of its own)."""
    for here, even, near in facing(m, own):
        odd = here & ~even
        yield from joined(m["id"][odd], m["dom"][odd], m["id"][near], m["dom"][near], odd_costs)
        if not even.any():
            continue
        ids, dom = m["id"][even], m["dom"][even]
        keys, to, first, n = alike(m["dom"][near], m["id"][near])
        at, d = whole(keys), whole(dom)
        if len(keys) <= 2 * LEAST + 1:
            x, y = (v.ravel() for v in np.meshgrid(np.arange(len(ids)), np.arange(len(keys)), indexing="ij"))
        else:
            low = np.searchsorted(at, d) - LEAST
            x, y = np.repeat(np.arange(len(ids)), 2 * LEAST + 1), ((low[:, None] + np.arange(2 * LEAST + 1)) % len(keys)).ravel()
            for far in ((d + MOST) % HALF, (d - MOST) % HALF):
                k = np.minimum(np.searchsorted(at, far), len(keys) - 1)
                more = np.flatnonzero((at[k] == far) & ((k - low) % len(keys) > 2 * LEAST))
                x, y = np.append(x, more), np.append(y, k[more])
        by = turned(dom[x], keys[y])
        x, y, c = x[by <= 45], y[by <= 45], 1.0 + by[by <= 45] / 45
        place, pair = spread(first[y], n[y])
        src, dst, c = ids[x][pair], to[place], c[pair]
        yield src[src != dst], dst[src != dst], c[src != dst]


def quota(src: np.ndarray, dst: np.ndarray, cost: np.ndarray) -> Edges:
    """Of each mark's edges a share for every whole cost, then the cheapest of the others, ``PER_RULE`` in all."""
    order = np.lexsort((dst, cost, src))
    src, dst, cost = src[order], dst[order], cost[order]
    bucket, rank = np.floor(cost), places(src)
    own = places(src, bucket)
    starts = np.flatnonzero(rank == 0)
    buckets = np.add.reduceat(own == 0, starts) if len(starts) else starts
    share = np.repeat(np.maximum(1, PER_RULE // np.maximum(buckets, 1)), np.diff(np.append(starts, len(src))))
    order = np.lexsort((rank, own >= share, src))
    order = order[places(src[order]) < PER_RULE]
    return src[order], dst[order], cost[order]


RULES = {"contact": contacts, "step": steps, "turn": turns, "end": ends}


def kept(m: dict, own: np.ndarray, block: bool = True) -> dict[str, Edges]:
    """The kept edges of a block's marks ``own`` by rule; marks without a block have none but their repeats."""
    ids = m["id"][own]
    out = {"repeat": (ids, ids, np.full(len(ids), 0.5))}
    for rule, made in RULES.items() if block else ():
        if parts := list(made(m, own)):
            out[rule] = quota(*(np.concatenate(v) for v in zip(*parts)))
    return out


def turn_sums(m: dict, own: np.ndarray) -> tuple[int, float, float, float]:
    """Turns from a block's marks ``own``: how many, the least, the greatest and the sum of their costs; sums of directions in order, no pair is made."""
    n, total, most = 0, 0.0, -np.inf
    least = min((float(c.min()) for *_, c in turns(m, own) if len(c)), default=np.inf)
    for here, even, near in facing(m, own):
        if (odd := here & ~even).any():
            x, times = np.unique(m["dom"][odd], return_counts=True)
            y, many = np.unique(m["dom"][near], return_counts=True)
            for a, k in zip(x, times):
                c = odd_costs(np.array([a]), y)[0]
                goes = ~np.isnan(c)
                if goes.any():
                    n, total, most = n + int(k * many[goes].sum()), total + float(k * (c[goes] * many[goes]).sum()), max(most, float(c[goes].max()))
            # one that is its own partner is no pair
            own_ = m["dom"][odd & near]
            self_ = ~np.isnan(np.array([odd_costs(np.array([a]), np.array([a]))[0, 0] for a in own_]))
            n, total = n - int(self_.sum()), total - float((1.0 + turned(own_[self_], own_[self_]) / 45).sum())
        if not even.any():
            continue
        dom, to = m["dom"][even], np.sort(m["dom"][near])
        d, at = whole(dom), whole(to)
        sums = np.concatenate([[0], np.cumsum(at)])
        count, apart, far = np.full(len(d), -1), np.zeros(len(d), np.int64), np.zeros(len(d))  # a mark is among its own partners
        for lap in (-HALF, 0, HALF):
            mid = d - lap
            lo, hi = np.searchsorted(at, mid - MOST, "right"), np.searchsorted(at, mid + MOST, "left")
            centre = np.searchsorted(at, mid)
            count += hi - lo
            apart += mid * (centre - lo) - (sums[centre] - sums[lo]) + (sums[hi] - sums[centre]) - mid * (hi - centre)
            some = np.flatnonzero(hi > lo)
            for k in (lo, hi - 1):
                far[some] = np.maximum(far[some], turned(dom[some], to[k[some]]))
            for edge in (mid - MOST, mid + MOST):  # exactly at the most: rounding says whether it is beyond
                a, b = np.searchsorted(at, edge, "left"), np.searchsorted(at, edge, "right")
                some = np.flatnonzero(b > a)
                by = turned(dom[some], to[a[some]])
                some, by = some[by <= 45], by[by <= 45]
                count[some] += (b - a)[some]
                apart[some] += MOST * (b - a)[some]
                far[some] = np.maximum(far[some], by)
        if (count > 0).any():
            n, most = n + int(count.sum()), max(most, float((1.0 + far[count > 0] / 45).max()))
            total += float(count.sum()) + float((apart / MOST).sum())
    return n, least, most, total


def arrays(group: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    out = {c: group[c].to_numpy() for c in names}
    return {c: v.astype(np.int64) if v.dtype == np.int32 else v for c, v in out.items()}


def kept_of_group(key: tuple, group: pa.Table) -> pa.Table:
    m = arrays(group, COLUMNS)
    found = kept(m, group["own"].to_numpy(), key[0].as_py() is not None)
    src, dst, cost = (np.concatenate(v) for v in zip(*found.values()))
    rules = np.repeat(list(found), [len(v[0]) for v in found.values()])
    order = np.argsort(m["id"])
    height = lambda ids: m["cen"][order[np.searchsorted(m["id"], ids, sorter=order)]]
    return pa.table({"src": src, "dst": dst, "rule": pa.array(rules, pa.string()), "cost": cost, "z_src": height(src), "z_dst": height(dst)})


def turns_of_group(key: tuple, group: pa.Table) -> pa.Table:
    n, *costs = turn_sums(arrays(group, COLUMNS), group["own"].to_numpy()) if key[0].as_py() is not None else (0,)
    return pa.table({"n": pa.array([n] if n else [], pa.int64()), **{c: pa.array([v] if n else [], pa.float64()) for c, v in zip(("least", "most", "total"), costs or (0.0,) * 3)}})
