"""Run edges over their bands, and walks against a breadth-first search."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_objects import number, shapes

from quern import registry
from quern.operators import raster as r
from quern.operators import walks
from quern.plans import runs

EDGES = "src long, dst long, rule string, cost double, at int, rise double, sense int, turned double, gap int"


def by_search(edges, starts, length, budget):
    after = defaultdict(list)
    for e in sorted(edges, key=lambda e: (e[0], e[4])):
        after[e[0]].append(e)
    out = set()
    for start in starts:
        front, spent = [((start,), (), 0)], 0
        while front and spent < budget:
            grown = []
            for nodes, rules, senses in front:
                if len(nodes) >= length:
                    continue
                for _, dst, rule, _, _, _, sense, turned, _ in after[nodes[-1]]:
                    spent += 1
                    if spent > budget:
                        break
                    if dst == nodes[-1] and rule != "repeat" or rule == "turn" and (turned or 0) > 60:
                        continue
                    own = ((senses,) if isinstance(senses, int) else senses) + ((sense,) if sense else ())
                    own = tuple(x for x in own if x)
                    if sum(a != b for a, b in zip(own, own[1:])) > 1:
                        continue
                    grown.append((nodes + (dst,), rules + (rule,), own or 0))
            out |= {(n, u) for n, u, _ in grown}
            front = grown
    return out


@pytest.mark.parametrize("length,budget", [(2, 4000), (3, 4000), (4, 4000), (4, 9)])
def test_walks_by_search(spark, length, budget):
    rng = random.Random(length)
    rows = []
    for src in range(7):
        rows.append((src, src, "repeat", 0.5, 9, 0.0, 0, 0.0, 1))
        for at, dst in enumerate(rng.sample(range(7), 3)):
            rise = rng.choice((-2.0, -0.5, 0.0, 1.0, 3.0))
            rows.append((src, dst, rng.choice(("contact", "turn", "step")), rng.random(), at, rise, 0 if abs(rise) < 0.75 else int(np.sign(rise)), rng.choice((10.0, 80.0, None)), rng.choice((0, 2, None))))
    got = runs.walk(spark.createDataFrame(rows, EDGES), spark.createDataFrame([(k,) for k in range(7)], "start long"), length, budget).collect()
    assert {(tuple(x.nodes), tuple(x.rules)) for x in got} == by_search(rows, range(7), length, budget) and got
    ways = {(x[0], x[1], x[2]): x for x in rows}
    for x in got:  # running values are those of the whole path
        path = [ways[a, b, u] for a, b, u in zip(x.nodes, x.nodes[1:], x.rules)]
        assert x.total == pytest.approx(sum(p[3] for p in path)) and x.worst == max(0, *(p[8] or 0 for p in path))
        assert x.rough == pytest.approx(sum(abs(b[5] - a[5]) for a, b in zip(path, path[1:])))


def test_shares_of_mixes(spark):
    """Cheap paths of one mix don't take all places."""
    rows = [(1, [1, k], ["step"], 0.1 * k, 0, 0, 0, 0.0, 0.0, 0) for k in range(2, 9)] + [(1, [1, 20], ["turn"], 9.0, 0, 1, 0, 4.0, 45.0, 2)]
    paths = spark.createDataFrame(rows, "start long, nodes array<long>, rules array<string>, total double, heading int, first int, changes int, rough double, turns double, worst int")
    got = runs.chosen(paths, 3).collect()
    assert sorted(x.nodes for x in got) == ["1 2", "1 20", "1 3"]
    turn = next(x for x in got if x.rules == "turn")
    assert (turn.score, turn.worst_gap, turn.profile) == (2 + 1 + 0.5, 2, "falling")


@pytest.mark.parametrize("length,budget,paths", [(2, 4000, 1 << 17), (3, 4000, 1), (4, 4000, 50), (4, 9, 50), (4, 30, 1 << 17), (3, 0, 1)])
def test_walks_of_a_group(spark, monkeypatch, length, budget, paths):
    """In arrays, some starts at a time, the chosen paths are those of the rounds of joins."""
    monkeypatch.setattr(walks, "PATHS", paths)
    names, rng, rows = tuple(sorted(runs.RULES)), random.Random(length + budget), []
    for src in range(10, 90, 10):  # the last has no edges
        for at, (rule, dst) in enumerate(rng.sample([(u, d) for u in ("contact", "turn", "step", "end") for d in range(10, 100, 10)], rng.randint(1, 6)) + [("repeat", src)]):
            rise = rng.choice((-2.0, -0.5, 0.0, 1.0, 3.0))
            rows.append((src, dst, rule, rng.choice((0.5, 1.0, rng.random())), at, rise, 0 if abs(rise) < 0.75 else int(np.sign(rise)), rng.choice((10.0, 80.0, None)), rng.choice((0, 2, None))))
    rng.shuffle(rows)
    starts = {10, 20, 40, 80}
    edges = spark.createDataFrame(rows, EDGES)
    want = runs.chosen(runs.walk(edges, spark.createDataFrame([(k,) for k in starts], "start long"), length, budget), 5).collect()
    group = pa.table({c: list(v) for c, v in zip(walks.COLUMNS, zip(*[(*x[:2], names.index(x[2]), *x[3:]) for x in rows]))} | {"own": [x[0] in starts for x in rows]})
    found = walks.walks_of_group(names, length, 5, budget, runs.MOST_TURN)(group)
    got = runs.described(spark.createDataFrame(found)).collect() if len(found) else []
    assert sorted(got) == sorted(want) and bool(got) == bool(budget)


def test_no_path_leaves_its_task(spark):
    """Only chosen paths are rows: no window over paths and no round of joins."""
    plan = registry.QUERIES["run_walks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Window" not in above and "Join" not in above and "Relation" not in above


def test_turns_over_the_seam(spark, tmp_path):
    """Directions just above 0 and just below 180 degrees are neighbours on the circle of bins."""
    rise = ["........", "........", ".......#", "########", "########", "#.......", "........", "........"]
    post = ["...#...."] * 8
    sf = shapes(spark, tmp_path, [(k, number(r.from_rows(x)), 0) for k, x in enumerate([rise, rise[::-1], post])])
    edges = {(x.src, x.dst): x.cost for x in registry.QUERIES["run_edge_quota"](spark, sf).collect() if x.rule == "turn"}
    assert (0, 1) in edges and (1, 0) in edges and 1 < edges[0, 1] < 2
    assert edges[0, 1] == edges[1, 0] and (0, 2) not in edges and (2, 1) not in edges


def test_no_join_on_the_block_alone(spark):
    plan = registry.QUERIES["run_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line and "label#" in line]
    assert joins and all(line.count("label#") < 2 or line.split("Join Inner")[1].count("=") >= 2 for line in joins)
