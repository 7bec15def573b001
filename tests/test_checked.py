"""Checked parts: whole sets are read, damaged, missing and unknown parts end the read. Former cuts of plans, with planted rows."""

import glob
import os

import pytest
from test_goldens import documents
from test_objects import number, shapes

from quern import registry
from quern.operators import raster as r
from quern.sources import checked


@pytest.fixture
def folder(spark, tmp_path):
    path = f"{tmp_path}/set"
    rows = spark.createDataFrame([(k, f"text {k}", None if k % 3 else 0.5) for k in range(50)], "id long, text string, x double").repartition(2)
    made = checked.write(rows, path, rows_a_part=10)
    assert made.count() >= 6 and sum(m.n for m in made.collect()) == 50
    return path


def test_whole_set(spark, folder):
    got = checked.read(spark, folder)
    assert sorted(map(tuple, got.select("id", "text").collect())) == [(k, f"text {k}") for k in range(50)]
    one = checked.input_set(checked.manifest(spark, folder))
    assert one == checked.input_set(checked.manifest(spark, folder).repartition(3)) and len(one) == 64
    assert one != checked.input_set(checked.manifest(spark, folder).limit(3))
    with pytest.raises(Exception, match="exists"):
        checked.write(got, folder)


@pytest.mark.parametrize("harm,said", [("damage", "damaged"), ("cut", "damaged"), ("lose", "missing"), ("add", "not in the manifest")])
def test_fails_closed(spark, folder, harm, said):
    part = sorted(glob.glob(f"{folder}/parts/*.parquet"))[1]
    data = bytearray(open(part, "rb").read())
    if harm == "damage":
        data[20] ^= 1
    name = part if harm != "add" else part.replace("part-", "part-9")
    if harm == "lose":
        os.remove(part)
    else:
        with open(name, "wb") as out:
            out.write(bytes(data[:-1] if harm == "cut" else data))
    for crc in glob.glob(f"{folder}/parts/.*.crc"):  # the file system's own sums would notice first
        os.remove(crc)
    with pytest.raises(Exception, match=said):
        checked.read(spark, folder).collect()


def test_references_of_any_number(spark, tmp_path):
    html = "&#233; &#65; &#8364; &#x20AC; &#X1f600; &#0; &#55296; &#1114112; &#99999999999999999999; &#xFFFFFFFFFFFFFFFFF; &eacute; &#12"
    spark.createDataFrame([(1, "u", html), (2, "u", "&#233;&#233;")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.ref: (x.ch, x.n, x.pages) for x in registry.QUERIES["numeric_entities"](spark, str(tmp_path)).collect()}
    want = {"&#233;": ("é", 3, 2)} | {k: (v, 1, 1) for k, v in {"&#65;": "A", "&#8364;": "€", "&#x20AC;": "€", "&#X1f600;": "😀"}.items()}
    want |= {k: ("\ufffd", 1, 1) for k in ("&#0;", "&#55296;", "&#1114112;", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFF;")}
    assert got == want
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rows = con.execute(registry.ORACLE["numeric_entities"])
    names = [c[0] for c in rows.description]
    assert {x[names.index("ref")]: (x[names.index("ch")], x[names.index("n")], x[names.index("pages")]) for x in rows.fetchall()} == want


def test_last_tile_is_whole(spark, tmp_path):
    dot = r.from_rows(["#......."] + ["........"] * 7)
    sf = shapes(spark, tmp_path, [(k, number(dot), 0) for k in range(6)])
    got = {x.tile: x.grid for x in registry.QUERIES["lattice_composite"](spark, sf).collect()}
    ink = lambda g: [k for k, v in enumerate(g) if v == "1"]
    assert set(got) == {0, 1} and all(len(g) == 256 for g in got.values())
    assert ink(got[0]) == [0, 8, 128, 136] and ink(got[1]) == [0, 8]


def test_profile_of_all_rows(spark, tmp_path):
    rows = ["#" * k + "." * (8 - k) for k in (1, 1, 1, 1, 3, 5, 7, 8)]
    sf = shapes(spark, tmp_path, [(1, number(r.from_rows(rows)), 0), (2, number(r.from_rows([*rows[4:], *rows[:4]])), 0)])
    assert {x.vec_id: x.profile for x in registry.QUERIES["profile_class"](spark, sf).collect()} == {1: "falling", 2: "cup"}
