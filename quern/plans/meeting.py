"""Pairs of shapes whose edges meet, without a row for each pair where only counts or a quota of pairs are asked for.

An edge has 255 masks: pairs of masks stand for pairs of shapes, and each stands for as many as its masks have shapes. A draw by a hash
of the pair has to hash every pair, but keeps only those below a bound that leaves about ``SPARE`` of a shape's; what is left is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import written
from quern.sources.tables import cells

#: How often rows of the right side are repeated, so that equal masks meet in as many tasks; tasks of such a join; pairs left of a shape's.
SALTS, TASKS, SPARE = 32, 240, 40

_LIKE = "2 * bit_count(ma & mb) >= bit_count(ma | mb)"
#: Similarity in parts of 840, which the number of pixels of any two masks divides: sums are whole numbers.
_PARTS = "840 * bit_count(ma & mb) DIV bit_count(ma | mb)"
_MEAN = "round(CAST(sum(n * k) AS DOUBLE) / (840 * sum(n)), 6)"


def classes(a: str, b: str, end: str, start: str, where: str = "TRUE") -> str:
    """``met``: classes of shapes by exit mask (ma) and extent (at), with the classes of entry masks they meet: n shapes, k, gap."""
    return f"""@cells, met AS (SELECT ma, at, na, n, {_PARTS} AS k, 7 - at + sb AS gap
FROM (SELECT {a} AS ma, {end} AS at, count(*) AS na FROM cells WHERE {a} <> 0 GROUP BY 1, 2) JOIN (SELECT {b} AS mb, {start} AS sb, count(*) AS n FROM cells WHERE {b} <> 0 GROUP BY 1, 2) ON {_LIKE} WHERE {where})"""


def partners(a: str, b: str, end: str, start: str, more: str = "") -> str:
    """A row for each shape with an exit: it has what its class has, 2,040 rows at most."""
    return f"""WITH {classes(a, b, end, start)}, g AS (SELECT ma, at, CAST(sum(n) AS BIGINT) AS partners, round(max(k) / 840, 6) AS best, {_MEAN} AS mean, CAST(min(gap) AS INT) AS least_gap FROM met GROUP BY ma, at)
SELECT /*+ BROADCAST(g) */ vec_id AS ia, partners, {more} mean FROM cells JOIN g ON {a} = ma AND {end} = at"""


def gaps(a: str, b: str, end: str, start: str, where: str) -> str:
    return f"""WITH {classes(a, b, end, start, where)}, p AS (SELECT gap, na * n AS n, k FROM met) SELECT CAST(gap AS INT) AS gap, CAST(sum(n) AS BIGINT) AS n, {_MEAN} AS mean FROM p GROUP BY gap"""


def _meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Equality join of many tasks, however few keys there are: left rows are dealt, right ones repeated."""
    dealt = a.withColumn("salt", F.pmod(F.xxhash64("ia"), F.lit(SALTS)).cast("int")).repartition(TASKS, *keys, "salt")
    again = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(TASKS, *keys, "salt")
    return dealt.join(again.hint("shuffle_hash"), [*keys, "salt"]).drop("salt")


def _hash() -> F.Column:
    return F.sha2(F.concat(F.col("ia").cast("string"), F.lit("-"), F.col("ib").cast("string")), 256)


def capped(spark, sf_dir: str, half: int = 6) -> DataFrame:
    """Of each shape's partners below it ``half`` by similarity and id, then ``half`` of the others by a hash of the pair.

    A port mask is the last row and the first one, so both touch the border and every gap is 0.
    """
    shapes = written(cells(spark, sf_dir).select("vec_id", F.col("m_bottom").alias("ma"), F.col("m_top").alias("mb")))
    exits, entries = shapes.filter("ma <> 0").select(F.col("vec_id").alias("ia"), "ma"), shapes.filter("mb <> 0").select(F.col("vec_id").alias("ib"), "mb")
    like = exits.select("ma").distinct().join(entries.groupBy("mb").agg(F.count(F.lit(1)).alias("n")), F.expr(_LIKE))
    like = written(like.withColumn("j", F.expr("CAST(bit_count(ma & mb) AS DOUBLE) / bit_count(ma | mb)")))  # pairs of masks
    # the first by id of each mask, of which a class takes its own
    firsts = entries.withColumn("rank", F.row_number().over(Window.partitionBy("mb").orderBy("ib"))).filter(F.col("rank") <= half).drop("rank")
    place = F.row_number().over(Window.partitionBy("ma").orderBy(F.desc("j"), "ib"))
    head = written(like.join(firsts, "mb").withColumn("place", place).filter(F.col("place") <= half).select("ma", "ib", "j"))
    total = like.groupBy("ma").agg(F.sum("n").alias("partners"))
    bound = F.lpad(F.lower(F.hex((F.lit(float(SPARE)) / F.col("partners") * (1 << 48)).cast("long"))), 12, "0")
    total = total.withColumn("bound", F.when(F.col("partners") <= SPARE, F.lit("g")).otherwise(bound)).filter(F.col("partners") > half)
    asked = exits.join(F.broadcast(total), "ma")

    def drawn(some: DataFrame) -> DataFrame:
        pairs = _meet(some.join(F.broadcast(like.select("ma", "mb", "j")), "ma"), entries, ["mb"]).withColumn("hash", _hash()).filter("hash < bound")
        return pairs.join(F.broadcast(head.select("ma", "ib")), ["ma", "ib"], "left_anti").select("ia", "ib", "j", "hash")

    left = written(drawn(asked))
    # where the bound left too few, all pairs are taken
    some = left.groupBy("ia").agg(F.count(F.lit(1)).alias("left"))
    short = written(asked.join(some, "ia", "left").filter(F.coalesce("left", F.lit(0)) < F.least(F.lit(half), F.col("partners") - half)).drop("left"))
    if not short.isEmpty():
        left = left.join(short.select("ia"), "ia", "left_anti").unionByName(drawn(short.withColumn("bound", F.lit("g"))))
    rank = F.row_number().over(Window.partitionBy("ia").orderBy("hash", "ib"))
    tail = left.withColumn("rank", rank).filter(F.col("rank") <= half).select("ia", "ib", "j", F.lit(False).alias("best"))
    first = exits.join(F.broadcast(head), "ma").select("ia", "ib", "j", F.lit(True).alias("best"))
    return first.unionByName(tail).select("ia", "ib", F.round("j", 6).alias("j"), F.lit(0).alias("gap"), "best")


def merged(spark, sf_dir: str, half: int = 150) -> DataFrame:
    """Pairs by port or, within a block, by band with a similarity of at least 0.9; port goes before band.

    Masks of eight pixels are as similar only if they are equal, so similarity is 1 and a pair has one row as it is made.
    """
    shapes = written(cells(spark, sf_dir).select("vec_id", "label", "m_bottom", "m_top", "b_bottom", "b_top", "i_bottom", "i_top"))
    a = shapes.select(F.col("vec_id").alias("ia"), "label", F.col("m_bottom").alias("port"), F.col("b_bottom").alias("band"), F.col("i_bottom").alias("end"))
    b = shapes.select(F.col("vec_id").alias("ib"), "label", F.col("m_top").alias("port"), F.col("b_top").alias("band"), F.col("i_top").alias("start"))
    ports = _meet(a.filter("port <> 0").select("ia", "port"), b.filter("port <> 0").select("ib", "port"), ["port"])
    near = _meet(a.filter("band <> 0"), b.filter("band <> 0").withColumnRenamed("port", "other"), ["label", "band"])
    near = near.withColumn("gap", F.expr("7 - end + start")).filter("gap <= 1 AND NOT (port <> 0 AND port = other)")
    pairs = ports.select("ia", "ib", F.lit(0).alias("gap"), F.lit("port").alias("kind")).unionByName(near.select("ia", "ib", "gap", F.lit("band").alias("kind")))
    head = written(pairs.orderBy("gap", "ia", "ib").limit(half))
    # the least hashes that are none of the head's are among twice as many of all
    least = written(pairs.withColumn("hash", _hash()).orderBy("hash", "ia", "ib").limit(2 * half))
    tail = least.join(head, ["ia", "ib"], "left_anti").orderBy("hash", "ia", "ib").limit(half)
    both = head.select("ia", "ib", "kind", F.lit(True).alias("best")).unionByName(tail.select("ia", "ib", "kind", F.lit(False).alias("best")))
    return both.select("ia", "ib", F.lit(1.0).alias("j"), "kind", "best")
