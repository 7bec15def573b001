"""Queries whose work is per shape or per bounded group: Arrow batches go to numpy, and nothing else does."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import raster
from quern.registry import QUERIES, query
from quern.sources.tables import table


def _each(columns, make):
    """A map over batches: ``make`` gives the values of a bitmap's row, or several rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, label, e in zip(batch["vec_id"], batch["label"], batch["embedding"]):
                found = make(raster.from_vector(e))
                rows.extend((i, label, *x) for x in (found if isinstance(found, list) else [found]))
            yield pd.DataFrame(rows, columns=columns)

    return run


def _shapes(name: str, schema: str, make) -> None:
    columns = ["vec_id", "label", *[c.strip().split(" ")[0] for c in schema.split(",")]]

    def run(spark, sf_dir: str):
        rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
        return rows.mapInPandas(_each(columns, make), "vec_id long, label int, " + schema)

    query(name, ORACLES.get(name))(run)


#: Components by the spread of the smallest pixel number, as a recursive query.
_SPREAD = "WITH RECURSIVE pix AS (SELECT vec_id, label, (k // 8)::INT AS y, (k % 8)::INT AS x FROM (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding) AS e FROM embeddings) WHERE {keep}), reach(vec_id, label, y, x, r) AS (SELECT vec_id, label, y, x, y * 8 + x FROM pix UNION SELECT p.vec_id, p.label, p.y, p.x, q.r FROM reach q JOIN pix p ON p.vec_id = q.vec_id AND {near} AND q.r < p.y * 8 + p.x), low AS (SELECT vec_id, label, y, x, min(r) AS r FROM reach GROUP BY ALL)"
_INK = _SPREAD.format(keep="e > 0", near="abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1")
_GROUND = _SPREAD.format(keep="NOT e > 0", near="abs(p.y - q.y) + abs(p.x - q.x) = 1")
ORACLES = {
    "ncomp": f"{_INK} SELECT v.vec_id, v.label, count(DISTINCT r) AS parts FROM embeddings v LEFT JOIN low l ON v.vec_id = l.vec_id GROUP BY v.vec_id, v.label",
    "enclosed_parts": f"{_GROUND}, g AS (SELECT vec_id, r FROM low GROUP BY vec_id, r HAVING NOT bool_or(y IN (0, 7) OR x IN (0, 7))) SELECT v.vec_id, v.label, count(r) AS holes FROM embeddings v LEFT JOIN g ON v.vec_id = g.vec_id GROUP BY v.vec_id, v.label",
    "interior_area": f"{_GROUND}, g AS (SELECT vec_id, r, count(*) AS n FROM low GROUP BY vec_id, r HAVING NOT bool_or(y IN (0, 7) OR x IN (0, 7))) SELECT v.vec_id, v.label, coalesce(sum(n), 0)::BIGINT AS area FROM embeddings v LEFT JOIN g ON v.vec_id = g.vec_id GROUP BY v.vec_id, v.label",
    "part_records": f"{_INK} SELECT vec_id, label, count(*) AS size, round(avg(y), 6) AS row_centroid, round(avg(x), 6) AS col_centroid, concat_ws(',', CASE WHEN max(y) = 7 THEN 'bottom' END, CASE WHEN min(x) = 0 THEN 'left' END, CASE WHEN max(x) = 7 THEN 'right' END, CASE WHEN min(y) = 0 THEN 'top' END) AS sides FROM low GROUP BY vec_id, label, r",
}
_shapes("ncomp", "parts long", lambda m: (raster.count_parts(m),))
_shapes("enclosed_parts", "holes long", lambda m: (raster.topology(m)[1],))
_shapes("interior_area", "area long", lambda m: (int(raster.interior(m).sum()),))
_shapes("part_records", "size long, row_centroid double, col_centroid double, sides string", lambda m: [(p["size"], round(p["row"], 6), round(p["col"], 6), ",".join(p["sides"])) for p in raster.parts(m)])
_shapes("crop_fit", "grid string", lambda m: ("".join("#" if v else "." for v in raster.crop_fit(m, 16).ravel()),))
_shapes("log_polar", "points int, mass double", lambda m: (lambda d: (len(d), round(float(d.sum()), 6)))(raster.log_polar(m)))
_shapes("stroke_orientation", "degrees double, shares array<double>", lambda m: (raster.dominant_degrees(m), raster.orientation_shares(m).round(6).tolist()))
_shapes("thinned", "pixels int, ends int, branches int", lambda m: (lambda s, c: (int(s.sum()), int((c == 1).sum()), int((c >= 3).sum())))(raster.thin(m), raster.crossings(raster.thin(m))))
_shapes("despurred", "pixels int, removed int", lambda m: (lambda s, d: (int(d.sum()), int(s.sum() - d.sum())))(raster.thin(m), raster.despur(raster.thin(m))))
_shapes("stability", "marks array<string>", lambda m: (raster.stability_marks(m),))
_PRINT = ("ends", "branches", "parts", "pixels", "length", "straight", "aspect", "winding", "net", "peak")
_shapes("fingerprints", "ends int, branches int, parts int, pixels int, length double, straight double, aspect double, winding double, net double, peak double, softness double, turn array<double>", lambda m: (lambda f: (*[f[k] for k in _PRINT], raster.softness(f["turn"]), f["turn"].tolist()))(raster.fingerprint(m)))
_shapes("continuity", "distance double", lambda m: (raster.structure_distance(m, raster.straight_stroke(8, 8, 3.5, 3.5, raster.dominant_degrees(m) or 0.0)),))


@query("topology_delta")
def topology_delta(spark, sf_dir: str):
    """Parts and holes of two shapes stacked, less those of the shapes: each with the next one of its block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, e, j, f in zip(batch["a"], batch["e"], batch["b"], batch["f"]):
                a, b = raster.from_vector(e), raster.from_vector(f)
                whole, own = raster.topology(raster.stacked(a, b)), [raster.topology(x) for x in (a, b)]
                rows.append((i, j, *(w - sum(o[k] for o in own) for k, w in enumerate(whole)), raster.emptiness_matters([a, b], 1), raster.structure_distance(a, b)))
            yield pd.DataFrame(rows, columns=["a", "b", "parts", "holes", "second_matters", "distance"])

    shape = F.struct("vec_id", "embedding").alias("shape")
    rows = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 256).alias("stretch"), shape)
    # blocks are dealt by stretches of ids, so a block of very many shapes is many groups; each takes over the first shape of the block's next one
    heads = rows.groupBy("label", "stretch").agg(F.min("shape").alias("shape"))
    carried = heads.withColumn("shape", F.lead("shape").over(Window.partitionBy("label").orderBy("stretch"))).filter("shape IS NOT NULL")
    following = F.lead("shape").over(Window.partitionBy("label", "stretch").orderBy("shape"))
    pairs = rows.unionByName(carried).withColumn("next", following).filter("next IS NOT NULL")
    pairs = pairs.selectExpr("shape.vec_id AS a", "shape.embedding AS e", "next.vec_id AS b", "next.embedding AS f")
    return pairs.mapInPandas(run, "a long, b long, parts int, holes int, second_matters boolean, distance double")


@query("ramp_families")
def ramp_families(spark, sf_dir: str):
    """Ramps of ink within a block and a leading direction; none is skipped, whatever its size."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        columns = ["label", "direction", "family", "members", "skipped"]
        found = raster.ramps(group["vec_id"].tolist(), [raster.from_vector(e) for e in group["embedding"]], 0.55)
        return pd.DataFrame([(key[0], key[1], k, m, 0) for k, m in enumerate(found)], columns=columns)

    return _directed(spark, sf_dir).groupBy("label", "direction").applyInPandas(run, "label int, direction int, family int, members array<long>, skipped int")


def _directed(spark, sf_dir: str):
    @F.pandas_udf("int")
    def direction(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda e: int(np.argmax(raster.orientation_shares(raster.from_vector(e)))))

    return table(spark, sf_dir, "embeddings").withColumn("direction", direction("embedding"))


@query("topo_families")
def topo_families(spark, sf_dir: str):
    """Skeletons alike at every pair, within buckets of their counts and proportions, from sharp to soft; no bucket is left out.

    Families of over 16 are no sequences and are dropped, as the operator is defined.
    """

    @F.pandas_udf("string")
    def signature(vectors: pd.Series) -> pd.Series:
        def one(e):
            f = raster.fingerprint(raster.from_vector(e))
            if not f["ok"]:
                return None
            return f"{f['ends']}-{f['branches']}-{f['parts']}-{min(3, int(f['aspect'] * 1.5))}-{min(4, int(f['straight'] * 5))}-{min(4, int(f['winding'] / 1.5))}-{min(3, int(f['peak'] * 4))}"

        return vectors.map(one)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        columns = ["signature", "family", "members", "spread", "skipped"]
        prints = {i: raster.fingerprint(raster.from_vector(e)) for i, e in zip(group["vec_id"], group["embedding"])}
        soft = {i: raster.softness(f["turn"]) for i, f in prints.items()}
        order = sorted(prints, key=lambda i: (soft[i], i))
        found = [[order[k] for k in c] for c in raster.alike_prints([prints[i] for i in order]) if len(c) > 1]
        rows = [(key[0], k, m, soft[m[-1]] - soft[m[0]], 0) for k, m in enumerate(sorted(c, key=lambda i: (soft[i], i)) for c in found) if len(m) <= 16]
        return pd.DataFrame(rows, columns=columns)

    rows = table(spark, sf_dir, "embeddings").withColumn("signature", signature("embedding")).filter("signature IS NOT NULL")
    return rows.groupBy("signature").applyInPandas(run, "signature string, family int, members array<long>, spread double, skipped int")


def _rasters(spark, sf_dir: str):
    """Each shape's whole raster as a number, its left-right image, the least of its quarter turns with the turns to it, and its 16 quantised zones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            g = np.array([raster.from_vector(e) for e in batch["embedding"]], bool).reshape(-1, 8, 8)
            number = lambda a, order="little": np.packbits(a.reshape(-1, 64), axis=1, bitorder=order)
            turns = np.stack([number(np.rot90(g, k, (1, 2)), "big").view(">u8").ravel() for k in range(4)]).astype(np.uint64)
            zones = np.minimum(2, g.reshape(-1, 4, 2, 4, 2).sum((2, 4)) * 3 // 4).reshape(-1, 16)
            own, image = (number(a).view("<i8").ravel() for a in (g, g[:, :, ::-1]))
            buckets = ["".join(map(str, z)) for z in zones.tolist()]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "mask": own, "image": image, "key": [f"{v:064b}" for v in turns.min(0).tolist()], "phase": turns.argmin(0).astype(np.int32), "bucket": buckets})

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.mapInPandas(run, "vec_id long, mask long, image long, key string, phase int, bucket string")


_GRID = "pix AS (SELECT vec_id, (k // 8)::INT AS y, (k % 8)::INT AS x, CASE WHEN e > 0 THEN '1' ELSE '0' END AS v FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS e FROM embeddings))"
_TURNED = "t AS (SELECT vec_id, 0 AS k, y, x, v FROM pix UNION ALL SELECT vec_id, 1, 7 - x, y, v FROM pix UNION ALL SELECT vec_id, 2, 7 - y, 7 - x, v FROM pix UNION ALL SELECT vec_id, 3, x, 7 - y, v FROM pix), s AS (SELECT vec_id, k, string_agg(v, '' ORDER BY y, x) AS grid FROM t GROUP BY vec_id, k)"


@query("raster_orbits", f"WITH {_GRID}, {_TURNED}, m AS (SELECT vec_id, min(grid) AS key FROM s GROUP BY vec_id), p AS (SELECT m.vec_id, key, min(k)::INT AS phase FROM m JOIN s ON m.vec_id = s.vec_id AND s.grid = m.key GROUP BY m.vec_id, key), o AS (SELECT p.vec_id, key, phase, min(p.vec_id) OVER (PARTITION BY s.grid) AS least FROM p JOIN s ON p.vec_id = s.vec_id AND s.k = 0), f AS (SELECT key, phase, vec_id, count(*) OVER (PARTITION BY key) AS size FROM o WHERE vec_id = least) SELECT key, phase, vec_id, size FROM f WHERE size >= 3")
def raster_orbits(spark, sf_dir: str):
    """Exact quarter turns of one raster over the whole table: at least 3 different frames, the first shape of each, by phase."""
    frames = _rasters(spark, sf_dir).groupBy("key", "phase", "mask").agg(F.min("vec_id").alias("vec_id"))
    found = frames.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("phase", "vec_id"))).alias("frames")).filter(F.size("frames") >= 3)
    return found.select("key", F.size("frames").alias("size"), F.explode("frames").alias("f")).select("key", "f.phase", "f.vec_id", "size")


@query("raster_mirrors", f"WITH {_GRID}, g AS (SELECT vec_id, string_agg(v, '' ORDER BY y, x) AS own, string_agg(v, '' ORDER BY y, 7 - x) AS image FROM pix GROUP BY vec_id), f AS (SELECT own, min(vec_id) AS first FROM g WHERE own <> image GROUP BY own) SELECT DISTINCT least(vec_id, first) AS lo, greatest(vec_id, first) AS hi FROM g JOIN f ON g.image = f.own")
def raster_mirrors(spark, sf_dir: str):
    """Each shape with the first one that is its exact left-right image, over the whole table; symmetric shapes have none."""
    rows = _rasters(spark, sf_dir).filter("mask <> image").select("vec_id", "mask", "image")
    first = rows.groupBy(F.col("mask").alias("image")).agg(F.min("vec_id").alias("first"))
    return rows.join(first, "image").select(F.least("vec_id", "first").alias("lo"), F.greatest("vec_id", "first").alias("hi")).distinct()


@query("cycle_components", f"WITH RECURSIVE {_GRID}, z AS (SELECT vec_id, y // 2 AS zy, x // 2 AS zx, least(2, sum(v::INT) * 3 // 4) AS q FROM pix GROUP BY ALL), b AS (SELECT vec_id, string_agg(q::VARCHAR, '' ORDER BY zy, zx) AS bucket FROM z GROUP BY vec_id), n AS (SELECT vec_id, bucket, y, x, v::INT AS v FROM b JOIN pix USING (vec_id)), pr AS (SELECT p.vec_id AS i, q.vec_id AS j FROM n p JOIN n q ON p.bucket = q.bucket AND p.y = q.y AND p.x = q.x GROUP BY p.vec_id, q.vec_id HAVING sum(greatest(p.v, q.v)) > 0 AND sum(p.v * q.v)::DOUBLE / sum(greatest(p.v, q.v)) >= 0.78), r(vec_id, root) AS (SELECT i, j FROM pr UNION SELECT pr.i, r.root FROM r JOIN pr ON pr.j = r.vec_id AND r.root < pr.i), c AS (SELECT vec_id, min(root) AS component FROM r GROUP BY vec_id) SELECT component, vec_id, count(*) OVER (PARTITION BY component) AS size FROM c QUALIFY size >= 2")
def cycle_components(spark, sf_dir: str, least_iou: float = 0.78, least: int = 2):
    """Single linkage on IoU within buckets of 16 quantised zones: each shape with the smallest id and the size of its component.

    Different rasters of a bucket are linked, and copies follow theirs; blank shapes have no link. No bucket is left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rasters in batch["rasters"]:
                masks = np.array([r["mask"] for r in rasters], np.int64).view(np.uint64)
                first, copies = (np.array([r[k] for r in rasters], np.int64) for k in ("first", "copies"))
                left = np.arange(len(masks))
                while len(left):
                    own, todo, left = [left[0]], [left[0]], left[1:]
                    while todo:
                        m = masks[todo.pop()]
                        near = np.bitwise_count(masks[left] & m) / np.bitwise_count(masks[left] | m) >= least_iou
                        own.extend(left[near])
                        todo.extend(left[near])
                        left = left[~near]
                    if (size := int(copies[own].sum())) >= least:
                        out.extend((int(masks[k].astype(np.int64)), int(first[own].min()), size) for k in own)
            yield pd.DataFrame(out, columns=["mask", "component", "size"]).astype("int64")

    rows = _rasters(spark, sf_dir).filter("mask <> 0").select("vec_id", "mask", "bucket")
    rasters = rows.groupBy("bucket", "mask").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    buckets = rasters.groupBy("bucket").agg(F.collect_list(F.struct("mask", "first", "copies")).alias("rasters"))
    found = buckets.select("rasters").mapInPandas(run, "mask long, component long, size long")
    return rows.join(found, "mask").select("component", "vec_id", "size")


_RECORD = ("kind string", "heading int", "hand string", "stable boolean", "symmetry string", "softness double", "density double", "fill string", "ends int", "branches int", "strokes int", "bends int", "inflections int")
_shapes("stroke_records", ", ".join(_RECORD), lambda m: tuple(raster.stroke_record(raster.crop_fit(m, 48)).values()))
_shapes("part_axes", "size long, degrees double, ratio double", lambda m: [(n, d, r) for n, d, r in raster.part_axes(m)])


@query("topo_search")
def topo_search(spark, sf_dir: str, seed: int = 0, pool: int = 400, k: int = 24):
    """The shapes whose skeletons are nearest to a seed's: a pool of the nearest by moments, ranked anew by fingerprints.

    The seed is one row, and its measures go to the tasks. Without a usable skeleton of it nothing is near.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = rows.filter(F.col("vec_id") == seed).first()
    mask = raster.from_vector(own.embedding if own else np.zeros(64))
    moments, print_ = raster.log_moments(mask), raster.fingerprint(mask)

    def by_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = [float(np.linalg.norm(raster.log_moments(raster.from_vector(e)) - moments)) for e in batch["embedding"]]
            yield batch.assign(moments=far)

    def by_print(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, h, raster.fingerprint(raster.from_vector(e))) for i, e, h in zip(batch["vec_id"], batch["embedding"], batch["moments"])]
            found = [(i, h, raster.fingerprint_distance(print_, f)) for i, h, f in found if f["ok"] and print_["ok"]]
            yield pd.DataFrame(found, columns=["vec_id", "moments", "distance"]).astype({"vec_id": "int64", "moments": float, "distance": float})

    near = rows.filter(F.col("vec_id") != seed).mapInPandas(by_moments, "vec_id long, embedding array<float>, moments double").orderBy("moments", "vec_id").limit(pool)
    return near.mapInPandas(by_print, "vec_id long, moments double, distance double").orderBy("distance", "vec_id").limit(k)


@query("all_families")
def all_families(spark, sf_dir: str, per_mode: int = 600, largest: int = 16):
    """Families of every mode in one table: 2 to ``largest`` members, none a control character, at most ``per_mode`` of a mode."""
    members = lambda df, keys, mode, order="vec_id": df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "vec_id"))).alias("m")).select(F.lit(mode).alias("mode"), F.col("m.vec_id").alias("members"))
    found = [
        members(raster_orbits(spark, sf_dir), ["key"], "spin", "phase"),
        raster_mirrors(spark, sf_dir).select(F.lit("mirror").alias("mode"), F.array("lo", "hi").alias("members")),
        members(cycle_components(spark, sf_dir, 0.72, 4).filter(F.col("size") <= largest), ["component"], "cycle"),
        ramp_families(spark, sf_dir).select(F.lit("ramp").alias("mode"), "members"),
        topo_families(spark, sf_dir).select(F.lit("topo").alias("mode"), "members"),
        QUERIES["fill_pairs"](spark, sf_dir).select(F.lit("fill").alias("mode"), F.array("outline", "fill").alias("members")),
        QUERIES["directed_families"](spark, sf_dir).select(F.lit("dir8").alias("mode"), F.split("members", " ").cast("array<long>").alias("members")),
    ]
    every = reduce(lambda a, b: a.unionByName(b), found).withColumn("size", F.size("members").cast("int")).filter(F.col("size").between(2, largest))
    every = every.filter(~F.exists("members", lambda i: (i < 32) | i.between(127, 159) | (i == 173)))
    # ramps and skeletons with few frames first, the others with many; a mode has a bounded number of families after its limit
    first = F.when(F.col("mode") == "ramp", F.col("size")).otherwise(-F.col("size"))
    place = F.row_number().over(Window.partitionBy("mode").orderBy(first, F.col("members")[0], F.col("members")[1]))
    return every.withColumn("place", place).filter(F.col("place") <= per_mode).select("mode", "place", "size", "members")


@query("consumed_families")
def consumed_families(spark, sf_dir: str):
    """Families with only the members that are admitted, at least two, each with its weight: its share of the raster."""
    admitted = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id")), "vec_id", "left_semi")
    weight = F.aggregate("embedding", F.lit(0.0), lambda a, e: a + F.when(e > 0, 1.0).otherwise(0.0)) / 64
    rows = all_families(spark, sf_dir).select("mode", "place", F.posexplode("members").alias("at", "vec_id")).join(admitted.select("vec_id", F.round(weight, 6).alias("weight")), "vec_id")
    out = rows.groupBy("mode", "place").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "weight"))).alias("m")).filter(F.size("m") >= 2)
    return out.select("mode", "place", F.col("m.vec_id").alias("members"), F.col("m.weight").alias("weights"))


@query("pair_records")
def pair_records(spark, sf_dir: str):
    """All that is measured of a shape over the next one of its block: gaps, port, topology, distance, and the slope of the composite."""
    gaps, ports = (QUERIES[n](spark, sf_dir) for n in ("seam_gap_profile", "port_overlap"))

    @F.pandas_udf("double")
    def slope(upper: pd.Series, lower: pd.Series) -> pd.Series:
        return pd.Series([raster.dominant_degrees(raster.stacked(raster.from_vector(a), raster.from_vector(b))) for a, b in zip(upper, lower)], dtype=float)

    shapes = table(spark, sf_dir, "embeddings")
    named = lambda i, e: shapes.select(F.col("vec_id").alias(i), F.col("embedding").alias(e))
    out = topology_delta(spark, sf_dir).join(ports, ["a", "b"], "left").join(gaps, ["a", "b"], "left")
    return out.join(named("a", "upper"), "a").join(named("b", "lower"), "b").withColumn("slope", slope("upper", "lower")).drop("upper", "lower")


@query("page_texts")
def page_texts(spark, sf_dir: str):
    """Text of web pages: scripts and styles dropped, blocks broken into lines, links counted."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.links, self.off = [], 0, 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.off += 1
            elif tag in ("p", "br", "div", "li", "h1", "h2", "h3", "tr", "article", "nav"):
                self.out.append("\n")
            self.links += tag == "a"

        def handle_endtag(self, tag):
            if tag in ("script", "style") and self.off:
                self.off -= 1

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"]):
                reader = Text()
                reader.feed(html or "")
                reader.close()
                lines = [x.strip() for x in "".join(reader.out).split("\n")]
                rows.append((page, "\n".join(x for x in lines if x), reader.links))
            yield pd.DataFrame(rows, columns=["page_id", "body", "links"])

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id long, body string, links int")


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir: str, rounds: int = 300):
    """Percentile interval of the mean page length by language, over resamples of whole sources.

    A source is drawn Poisson(1) times in each round, decided by a hash: no draw depends on another row, so one grouped
    sum gives all rounds.
    """
    pages = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("s"))
    u = F.pmod(F.xxhash64("lang", "source", "round"), F.lit(1_000_003)) / 1_000_003.0
    times = sum(F.when(u >= c, 1).otherwise(0) for c in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340))
    drawn = pages.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("times", times)
    means = drawn.groupBy("lang", "round").agg(F.try_divide(F.sum(F.col("s") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("mean")).filter("mean IS NOT NULL")
    low, high = int(rounds * 0.025), int(rounds * 0.975)
    sorted_means = F.sort_array(F.collect_list("mean"))
    return means.groupBy("lang").agg(F.get(sorted_means, F.lit(low)).alias("low"), F.get(sorted_means, F.least(F.lit(high), F.count(F.lit(1)) - 1).cast("int")).alias("high"))
