"""Directed families and outline-fill pairs: groups that are found by equality joins on cells, keys and bins, never by holding a whole group."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import raster
from quern.registry import QUERIES, query
from quern.sources.scratch import written
from quern.sources.tables import table

#: The share of ink of a sparse mark, the least heading, how far moments of one shape lie apart, frames of a turn.
SPARSE, LEAST_HEADING, MOMENTS_APART, FRAMES = (0.04, 0.34), 0.12, 0.22, 4
#: How much of an outline stands in its fill, how much of its inside is filled, how much ink the fill has at least.
COVER, FILL, RATIO = 0.70, 0.45, 1.0
#: Parts that the outlines of one silhouette are dealt to.
SALTS = 8


def silhouettes(spark, sf_dir: str) -> DataFrame:
    """vec_id, mask, inside (ground that the border's doesn't reach), solid (the least of the eight turns and mirror images of ink and inside, as text), crc, solid_crc.

    A batch is one stack of rasters, so the ground grows and the images turn for all shapes at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            g = np.array([raster.from_vector(e) for e in batch["embedding"]], bool).reshape(-1, 8, 8)
            inside = raster.insides(g)
            number = lambda x: np.packbits(x.reshape(-1, 64), axis=1, bitorder="little").view("<i8").ravel()
            least = lambda x: np.stack([np.packbits(np.rot90(m, k, (1, 2)).reshape(-1, 64), axis=1).view(">u8").ravel() for m in (x, x[:, :, ::-1]) for k in range(4)]).astype(np.uint64).min(0)
            # a byte for each pixel, as the checksum is defined
            crc = lambda x: [zlib.crc32(np.unpackbits(np.frombuffer(v.to_bytes(8, "big"), np.uint8)).tobytes()) for v in x.tolist()]
            own, solid = least(g), least(g | inside)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "mask": number(g), "inside": number(inside), "solid": [f"{v:064b}" for v in solid.tolist()], "crc": crc(own), "solid_crc": crc(solid)})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, mask long, inside long, solid string, crc long, solid_crc long")


# crc32 of the least image's pixels, a byte each
@query("symmetry_crc")
def symmetry_crc(spark, sf_dir: str) -> DataFrame:
    """The crc32 of a raster's canonical image: equal for all its turns and mirror images, and for those of its filled form."""
    return silhouettes(spark, sf_dir).select("vec_id", "crc", "solid_crc")


_FILLED = """WITH RECURSIVE pix AS (SELECT vec_id, (k // 8)::INT AS y, (k % 8)::INT AS x, CASE WHEN e > 0 THEN 1 ELSE 0 END AS v FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS e FROM embeddings)),
out AS (SELECT vec_id, y, x FROM pix WHERE v = 0 AND (y IN (0, 7) OR x IN (0, 7)) UNION SELECT p.vec_id, p.y, p.x FROM out o JOIN pix p ON p.vec_id = o.vec_id AND p.v = 0 AND abs(p.y - o.y) + abs(p.x - o.x) = 1),
px AS MATERIALIZED (SELECT pix.*, CASE WHEN v = 0 AND out.vec_id IS NULL THEN 1 ELSE 0 END AS inside FROM pix LEFT JOIN out USING (vec_id, y, x)),
im AS (SELECT vec_id, k, y, x, CASE k WHEN 0 THEN y * 8 + x WHEN 1 THEN y * 8 + 7 - x WHEN 2 THEN (7 - y) * 8 + x WHEN 3 THEN (7 - y) * 8 + 7 - x WHEN 4 THEN x * 8 + y WHEN 5 THEN x * 8 + 7 - y WHEN 6 THEN (7 - x) * 8 + y ELSE (7 - x) * 8 + 7 - y END AS place, v + inside AS s FROM px, range(8) t(k)),
solid AS (SELECT vec_id, min(grid) AS solid FROM (SELECT vec_id, k, string_agg(s::VARCHAR, '' ORDER BY place) AS grid FROM im GROUP BY vec_id, k) GROUP BY vec_id),
shape AS (SELECT vec_id, solid, sum(v) AS ink, sum(inside) AS n FROM px JOIN solid USING (vec_id) GROUP BY vec_id, solid),
pair AS (SELECT a.vec_id AS outline, b.vec_id AS fill, a.ink, a.n FROM shape a JOIN shape b ON a.solid = b.solid AND a.vec_id <> b.vec_id WHERE a.n > 0 AND a.ink > 0 AND b.ink >= a.ink * {ratio} AND b.n < a.n),
m AS (SELECT outline, fill, sum(p.v * q.v)::DOUBLE / max(ink) AS cover, sum(p.inside * q.v)::DOUBLE / max(n) AS filled FROM pair JOIN px p ON p.vec_id = outline JOIN px q ON q.vec_id = fill AND q.y = p.y AND q.x = p.x GROUP BY outline, fill)
SELECT outline, fill, round(cover, 6) AS cover, round(filled, 6) AS filled FROM m WHERE cover >= {cover} AND filled >= {fill}"""


# A5, J15
@query("fill_pairs", _FILLED.format(ratio=RATIO, cover=COVER, fill=FILL))
def fill_pairs(spark, sf_dir: str) -> DataFrame:
    """Outlines and the shapes of the same silhouette that stand over them and fill their inside; no silhouette is left out.

    Shapes meet by their silhouette in whatever turn. A silhouette that very many have is dealt to ``SALTS`` parts, each with all of
    its outlines that differ: equal rasters are one until pairs are found.
    """
    rows = silhouettes(spark, sf_dir)
    size = lambda c: F.bit_count(c)
    kinds = rows.groupBy("mask", "inside", "solid").agg(F.count(F.lit(1)).alias("copies"))
    salt = F.pmod(F.xxhash64("mask"), F.lit(SALTS))
    outlines = kinds.filter(size("inside") > 0).filter(size("mask") > 0).select("solid", F.col("mask").alias("a"), F.col("inside").alias("hole"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    fills = kinds.select("solid", F.col("mask").alias("b"), size("inside").alias("n"), salt.cast("int").alias("salt"))
    cover, filled = (size(F.col("b").bitwiseAND(F.col(c))) / size(F.col(c)) for c in ("a", "hole"))
    pairs = outlines.join(fills, ["solid", "salt"]).filter((size("b") >= size("a") * RATIO) & (F.col("n") < size("hole")))
    pairs = pairs.select("a", "b", cover.alias("cover"), filled.alias("filled")).filter((F.col("cover") >= COVER) & (F.col("filled") >= FILL))
    one, two = (rows.select(F.col("vec_id").alias(name), F.col("mask").alias(c)) for name, c in (("outline", "a"), ("fill", "b")))
    return pairs.join(one, "a").join(two, "b").select("outline", "fill", F.round("cover", 6).alias("cover"), F.round("filled", 6).alias("filled"))


def radius_clusters(points: DataFrame, dims: list[str], radius: float, within: list[str]) -> DataFrame:
    """(id, seed): greedy clusters in the order of ids. A point that no earlier seed is near to (``radius`` and less) is a seed; others go to the first near one.

    ``points`` has id, the columns ``within`` (clusters don't cross them) and the coordinates. Near points meet in neighbouring cells
    of a grid over the first two coordinates. Equal points are one until the end. A round makes seeds of all points whose earlier
    neighbours are decided, so rounds are as many as the longest chain of neighbours.
    """
    kinds = written(points.groupBy(*within, *dims).agg(F.min("id").alias("id")))
    cell = [F.floor(F.col(d) / radius) for d in dims[:2]]
    around = lambda c: F.explode(F.sequence(c - 1, c + 1))
    left = kinds.select("*", around(cell[0]).alias("cx")).select("*", around(cell[1]).alias("cy"))
    right = kinds.select(*within, F.col("id").alias("later"), *[F.col(d).alias(f"l_{d}") for d in dims], cell[0].alias("cx"), cell[1].alias("cy"))
    far = sum(((F.col(d) - F.col(f"l_{d}")) ** 2 for d in dims[1:]), (F.col(dims[0]) - F.col(f"l_{dims[0]}")) ** 2)
    edges = written(left.join(right, [*within, "cx", "cy"]).filter(F.col("id") < F.col("later")).filter(F.sqrt(far) <= radius).select(F.col("id").alias("earlier"), "later"))
    undecided, live, seeds = kinds.select("id"), edges, None
    while True:
        new = written(undecided.join(live.select(F.col("later").alias("id")).distinct(), "id", "left_anti"))
        seeds = new if seeds is None else seeds.union(new)
        taken = live.join(new.select(F.col("id").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("id")).distinct()
        undecided = written(undecided.join(new, "id", "left_anti").join(taken, "id", "left_anti"))
        if undecided.isEmpty():
            break
        live = written(live.join(undecided.select(F.col("id").alias("earlier")), "earlier", "left_semi").join(undecided.select(F.col("id").alias("later")), "later", "left_semi"))
    first = edges.join(seeds.select(F.col("id").alias("earlier")), "earlier", "left_semi").groupBy("later").agg(F.min("earlier").alias("seed"))
    owned = kinds.join(first.withColumnRenamed("later", "id"), "id", "left").select(*within, *dims, F.coalesce("seed", "id").alias("seed"))
    same = [points[c].eqNullSafe(owned[c]) for c in (*within, *dims)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return points.join(owned, on).select(points["id"], owned["seed"])


# A6
@query("directed_families")
def directed_families(spark, sf_dir: str) -> DataFrame:
    """Turns of one shape by heading: sparse marks of one radial profile whose moments lie near a seed's, the clearest one for each of 8 headings.

    Returns seed, size (4 headings at least), members (from north on, clockwise, joined by spaces). Of equally clear shapes the smallest id stays.
    """
    low, high = (64 * x for x in SPARSE)
    heads = QUERIES["heading8"](spark, sf_dir).filter(F.col("ink").between(low, high) & (F.col("magnitude") >= LEAST_HEADING))
    moments = QUERIES["hu_moments"](spark, sf_dir)
    dims = [c for c in moments.columns if c != "vec_id"]
    points = written(heads.join(QUERIES["radial_profile"](spark, sf_dir), "vec_id").join(moments, "vec_id").withColumnRenamed("vec_id", "id"))
    clusters = radius_clusters(points.select("id", "profile", *dims), dims, MOMENTS_APART, ["profile"])
    best = F.min(F.struct(-F.col("magnitude"), F.col("id"))).alias("best")
    frames = clusters.join(points.select("id", "bin", "magnitude"), "id").groupBy("seed", "bin").agg(best)
    found = frames.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("bin", F.col("best.id").alias("id")))).alias("f")).filter(F.size("f") >= FRAMES)
    return found.select("seed", F.size("f").alias("size"), F.array_join(F.transform("f", lambda x: x["id"].cast("string")), " ").alias("members"))
