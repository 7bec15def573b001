"""Walks over the edges of a block, some starts at a time: each start's paths stay in arrays, and only those that are chosen leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quern.operators.edges import arrays, places, spread

#: What an edge has (its rule as a place in ``names``), and paths tried at a time.
COLUMNS = ("src", "dst", "rule", "cost", "at", "rise", "sense", "turned", "gap")
PATHS = 1 << 17
#: What a path has besides its marks and rules.
KEPT = ("total", "heading", "first", "changes", "rough", "turns", "worst")


def grown(edges: dict, first: np.ndarray, many: np.ndarray, starts: np.ndarray, length: int, budget: int, most_turn: float, repeat: int) -> Iterator[dict]:
    """Coherent paths of 2 to ``length`` marks from each start, by length: ``own`` is the place of the start, ``nodes`` and ``rules`` are tables.

    Edges lie by src and ``at``; those of the mark k are ``many[k]`` from ``first[k]``, and marks are places. As in ``runs.walk``, steps are counted
    breadth-first, and those beyond the budget aren't taken.
    """
    n = len(starts)
    p = {"own": np.arange(n), "nodes": starts[:, None], "rules": np.empty((n, 0), np.int64), "rose": np.full(n, np.nan), **{c: np.zeros(n) if c in ("total", "rough", "turns") else np.zeros(n, np.int64) for c in KEPT}}
    spent = np.zeros(n, np.int64)
    for _ in range(length - 1):
        last = p["nodes"][:, -1]
        e, which = spread(first[last], many[last])
        step = spent[p["own"][which]] + places(p["own"][which]) + 1
        e, which = e[step <= budget], which[step <= budget]
        spent += np.bincount(p["own"][which], minlength=n)
        sense, heading = edges["sense"][e], p["heading"][which]
        changes = p["changes"][which] + ((sense != 0) & (heading != 0) & (sense != heading))
        rule, turned = edges["rule"][e], edges["turned"][e]
        goes = ((edges["src"][e] != edges["dst"][e]) | (rule == repeat)) & ((edges["turn"][e] == 0) | (np.nan_to_num(turned) <= most_turn)) & (changes <= 1)
        e, which, sense, heading, changes = e[goes], which[goes], sense[goes], heading[goes], changes[goes]
        rise = edges["rise"][e]
        p = {
            "own": p["own"][which],
            "nodes": np.column_stack([p["nodes"][which], edges["dst"][e]]),
            "rules": np.column_stack([p["rules"][which], edges["rule"][e]]),
            "rose": rise,
            "total": p["total"][which] + edges["cost"][e],
            "heading": np.where(sense != 0, sense, heading),
            "first": np.where(p["first"][which] != 0, p["first"][which], sense),
            "changes": changes,
            "rough": p["rough"][which] + np.nan_to_num(np.abs(rise - p["rose"][which])),
            "turns": p["turns"][which] + np.nan_to_num(edges["turned"][e]),
            "worst": np.maximum(p["worst"][which], edges["gap"][e]),
        }
        yield p


def picked(parts: list[dict], ids: np.ndarray, per_start: int) -> dict:
    """Of each start's paths a share for every mix of rules, then the best of the others, as ``runs.chosen``; rules are places in the order of their names."""
    width = parts[-1]["nodes"].shape[1]
    wide = lambda v, k: np.pad(v, ((0, 0), (0, k - v.shape[1])), constant_values=-1)
    p = {c: np.concatenate([x[c] for x in parts]) for c in ("own", *KEPT)}
    p |= {"nodes": np.concatenate([wide(x["nodes"], width) for x in parts]), "rules": np.concatenate([wide(x["rules"], width - 1) for x in parts])}
    p["size"] = (p["nodes"] >= 0).sum(1)
    p["mean"] = p["total"] / (p["size"] - 1)
    mix = np.bitwise_or.reduce(np.where(p["rules"] >= 0, 1 << np.maximum(p["rules"], 0), 0), axis=1)
    marks = np.where(p["nodes"] >= 0, ids[p["nodes"]], 0)
    best = [*p["rules"].T[::-1], *marks.T[::-1], -p["size"], p["mean"]]  # the last counts first
    order = np.lexsort((*best, mix, p["own"]))
    rank = np.empty(len(order), np.int64)
    rank[order] = places(p["own"][order], mix[order])
    mixes = np.bincount(p["own"][rank == 0], minlength=1)
    sure = rank < np.maximum(1, per_start // np.maximum(mixes, 1))[p["own"]]
    order = np.lexsort((*best, ~sure, p["own"]))
    order = order[(places(p["own"][order]) < per_start) | sure[order]]
    return {c: v[order] for c, v in (p | {"marks": marks}).items()}


def lists(table: np.ndarray, n: np.ndarray, values: np.ndarray | None = None) -> pa.ListArray:
    """The first n[k] of each row; with ``values`` these are places in it."""
    flat = table[np.arange(table.shape[1]) < n[:, None]]
    offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(flat if values is None else values[flat]))


def walks_of_group(names: tuple[str, ...], length: int, per_start: int, budget: int, most_turn: float):
    """The chosen paths of a group's own starts; ``names`` are the rules in the order in which their names compare."""

    def walked(group: pa.Table) -> Iterator[pa.RecordBatch]:
        e = arrays(group, COLUMNS)
        order = np.lexsort((e["at"], e["src"]))
        e = {c: v[order] for c, v in e.items()}
        ids = np.unique(np.concatenate([e["src"], e["dst"]]))
        e["src"], e["dst"] = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"])
        e["turn"] = e["rule"] == names.index("turn")
        e["gap"] = np.nan_to_num(e["gap"].astype(float)).astype(np.int64)
        many = np.bincount(e["src"], minlength=len(ids))
        first = np.cumsum(many) - many
        starts = np.unique(e["src"][group["own"].to_numpy()[order]])
        # a start has as many paths at most as the widest marks give, or as its budget
        wide = int(many.max(initial=1))
        step = max(1, PATHS // max(1, min(budget, sum(wide**k for k in range(1, length)))))
        for k in range(0, len(starts), step):
            parts = list(grown(e, first, many, starts[k : k + step], length, budget, most_turn, names.index("repeat")))
            if not sum(len(x["own"]) for x in parts):
                continue
            p = picked(parts, ids, per_start)
            cols = {"start": ids[starts[k : k + step]][p["own"]], "nodes": lists(p["marks"], p["size"]), "rules": lists(p["rules"], p["size"] - 1, np.array(names, object))}
            cols |= {c: pa.array(p[c], pa.float64()) for c in ("mean", "rough", "turns")} | {c: pa.array(p[c].astype(np.int32)) for c in ("first", "changes", "worst")}
            yield pa.RecordBatch.from_pydict(cols)

    def of_group(group: pa.Table) -> pa.Table:
        found = list(walked(group))
        return pa.Table.from_batches(found, SCHEMA)

    return of_group


SCHEMA = pa.schema([("start", pa.int64()), ("nodes", pa.list_(pa.int64())), ("rules", pa.list_(pa.string())), *[(c, pa.float64()) for c in ("mean", "rough", "turns")], *[(c, pa.int32()) for c in ("first", "changes", "worst")]])
