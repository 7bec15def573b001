import json

import pytest
from pyspark.sql import functions as F

from quern.sources import readers, sinks


def test_plates_and_families(spark, tmp_path):
    (tmp_path / "01.txt").write_text("a\tb\nc\n\n")
    assert [(r.r, r.line) for r in readers.plates(spark, str(tmp_path / "0*.txt")).collect()] == [(0, "a b"), (1, "c")]
    lines = ["", json.dumps({"mode": "ramp", "size": 2, "block": "x", "cps": [1, 2], "chars": "ab"}), "{broken", json.dumps({"mode": "spin", "size": 2, "block": "x", "cps": [1, 9], "chars": "ac"})]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    assert readers.families(spark, str(tmp_path / "f.jsonl")).count() == 2
    known = spark.createDataFrame([(1,), (2,)], "cp int")
    assert [r.mode for r in readers.families(spark, str(tmp_path / "f.jsonl"), known).collect()] == ["ramp"]


def test_combinations_and_entities(spark, tmp_path):
    doc = {"combinations": [{"id": "a", "label": "l", "note": "", "cols": 2, "rows": 1, "cells": [{"col": 0, "row": 0, "cp": 47, "char": "/"}, {"col": 1, "row": 0, "cp": 92, "char": "\\"}]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    assert [(r.id, r.col, r.cp) for r in readers.combinations(spark, str(tmp_path / "c.json")).collect()] == [("a", 0, 47), ("a", 1, 92)]
    got = spark.createDataFrame([("&#47;&#x2588;&amp;&#38;#47;",)], "t string").select(readers.entities(F.col("t"))).first()[0]
    assert got == "/&#x2588;&amp;&#47;"
    files = spark.createDataFrame([("lib/a.mlt",), ("lib/old/a.mlt",), ("x/a.mlt",)], "path string")
    assert [r.path for r in readers.discovered(files, "lib/", r"\.mlt$", "/old/").collect()] == ["lib/a.mlt"]


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    path = str(tmp_path / "once")
    assert sinks.write_once(df, path) and not sinks.write_once(df.orderBy("t"), path)
    with pytest.raises(FileExistsError):
        sinks.write_once(df.limit(1), path)
    sinks.write_cells(df.selectExpr("k", "t", "8 as cell_w"), str(tmp_path / "cells"))
    assert (tmp_path / "cells" / "cell_w=8").is_dir()
    sinks.write_patterns(df.selectExpr("k", "2 as n_cells", "3 as m_cells"), str(tmp_path / "patterns"))
    sinks.write_families(df, str(tmp_path / "families"))
    assert spark.read.json(str(tmp_path / "patterns")).count() == 2
