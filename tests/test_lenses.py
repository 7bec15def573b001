"""Searches on fitted rasters, rules, JSON paths."""

import json

import pytest
from test_goldens import documents
from test_objects import number, shapes

from quern import registry
from quern.operators import raster as r
from quern.plans import lenses


def test_fitted_search(spark, tmp_path):
    small = r.from_rows(["........", "..##....", "..#.....", "........", "........", "........", "........", "........"])
    large = r.from_rows(["######..", "######..", "######..", "###.....", "###.....", "###.....", "........", "........"])
    bar = r.from_rows(["########"] + ["........"] * 7)
    sf = shapes(spark, tmp_path, [(0, number(small), 0), (1, number(bar), 0), (2, number(large), 0)])
    got = [(x.vec_id, x.distance) for x in registry.QUERIES["similar_iou_norm"](spark, sf).collect()]
    assert got[0] == (2, 0.0) and got[1][0] == 1 and got[1][1] > 0.5


def test_rules_count_broken_records(spark, tmp_path):
    sf = documents(spark, tmp_path, ["One sentence.", "no end", "", "tab\there.", "One sentence.", "...", "bad �."])
    spark.createDataFrame([(0, 1, 1), (1, 2, 0), (1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = {x.rule: x.broken for x in registry.QUERIES["record_rules"](spark, sf).collect()}
    want = {"text unique": 2, "text not blank": 1, "text without tabs": 1, "text without replacement characters": 1, "text not cut off": 1, "quality known": 1, "not good and toxic": 1, "label complete": 1, "labelled once": 1, "id unique": 1, "length of the text": 0, "language known": 0}
    assert {k: got[k] for k in want} == want and len(got) >= 20


def walk(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if k.isidentifier() and k.isascii() else f'{path}."{k}"')
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from walk(v, f"{path}[{k}]")
    else:
        yield path, value


@pytest.mark.parametrize("value", [{"a": [1, {"b": [[], {}, ["x", None, True]]}], "c d": {"e": "y"}}, [], "lone", None, {"a": {"a": {"a": {"a": [[[["deep"]]]]}}}}])
def test_json_of_any_depth(spark, value):
    rows = spark.createDataFrame([(1, json.dumps(value)), (2, "{broken"), (3, None)], "id long, j string")
    got = {(x.path, x.value) for x in lenses.json_leaves(rows, ["id"], "j").collect()}
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    assert got == {(p, text(v)) for p, v in walk(value)}
