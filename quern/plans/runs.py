"""Walks over run edges: coherent runs of several lengths, a frontier that grows by one mark in each round.

An edge carries all that a step adds (height, turn, gap), so a path holds running values only: the sense of its height, its changes, its
roughness and its worst gap. Edges stay within a block, so ``run_walks`` walks in tasks that have a block's edges, and no path leaves one
but the chosen; ``walk`` has a round as one equality join of the frontier with any edges.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.walks import walks_of_group
from quern.plans import seams  # noqa: F401  (registers the edges)
from quern.plans.dialect import _text
from quern.plans.marks import dealt
from quern.registry import ORACLE, QUERIES, query
from quern.sources.scratch import written
from quern.sources.tables import cells, table

#: What counts as a change of height, the most that a turn may turn, and in a score the parts of height and of direction.
LEVEL, MOST_TURN, HEIGHT_PART, TURN_PART = 0.75, 60.0, 4.0, 90.0
#: Rules in the order in which a mark's edges are taken.
RULES = ("contact", "step", "turn", "end", "repeat")
#: Groups that a block's starts are dealt to, each with all edges of the block, and what a chosen path has.
SALTS = 8
KEPT = "start long, nodes array<long>, rules array<string>, mean double, rough double, turns double, first int, changes int, worst int"


def steps(spark, sf_dir: str) -> DataFrame:
    """The kept edges with what each adds: src, dst, rule, cost, at (place among the edges of its mark), rise, sense, turned, gap."""
    shapes = table(spark, sf_dir, "embeddings")
    lit = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.slice("embedding", y * 8 + 1, 8), lambda e: e > 0))
    place = lambda row: F.nullif(F.array_position(row, True), F.lit(0))
    margins = shapes.select(F.col("vec_id").alias("id"), lit.alias("rows")).select("id", F.transform("rows", lambda r: 8 - place(F.reverse(r))).alias("last"), F.transform("rows", lambda r: place(r) - 1).alias("first"))
    own = spark.sql(_text("WITH @node SELECT id, cen, dom FROM node", 0), cells=cells(spark, sf_dir)).join(margins, "id")
    a, b = (own.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("cen", "dom", "last", "first")]) for k in ("src", "dst"))
    edges = QUERIES["run_edge_quota"](spark, sf_dir).join(a, "src").join(b, "dst")
    rise, apart = F.col("dst_cen") - F.col("src_cen"), F.abs(F.col("dst_dom") - F.col("src_dom"))
    sense = F.when(F.abs(rise) < LEVEL, 0).otherwise(F.signum(rise)).cast("int")
    gap = F.array_min(F.zip_with("src_last", "dst_first", lambda x, y: 7 - x + y)).cast("int")
    order = Window.partitionBy("src").orderBy(F.array_position(F.array(*map(F.lit, RULES)), F.col("rule")), "cost", "dst")
    return edges.select("src", "dst", "rule", "cost", F.row_number().over(order).alias("at"), rise.alias("rise"), sense.alias("sense"), F.least(apart, 180 - apart).alias("turned"), gap.alias("gap"))


def walk(edges: DataFrame, starts: DataFrame, length: int = 4, budget: int = 4000) -> DataFrame:
    """All coherent paths of 2 to ``length`` marks from each start (column ``start``).

    A path changes its sense at most once and doesn't turn by more than ``MOST_TURN`` over a turn edge; a mark follows itself only by a repeat.
    A start's steps are counted breadth-first, in the order of paths and of their edges, and steps beyond the budget aren't taken.
    """
    empty = lambda kind: F.array().cast(kind)
    zero, none = F.lit(0.0), F.lit(0)
    front = starts.select("start", F.array("start").alias("nodes"), empty("array<string>").alias("rules"), zero.alias("total"), none.alias("heading"), none.alias("first"), none.alias("changes"), F.lit(None).cast("double").alias("rose"), zero.alias("rough"), zero.alias("turns"), none.alias("worst"), F.lit(1).cast("long").alias("no"), F.lit(0).cast("long").alias("spent"))
    found = None
    for _ in range(length - 1):
        tried = front.join(edges, F.element_at("nodes", -1) == F.col("src"))
        tried = tried.withColumn("step", F.col("spent") + F.row_number().over(Window.partitionBy("start").orderBy("no", "at"))).filter(F.col("step") <= budget)
        change = ((F.col("sense") != 0) & (F.col("heading") != 0) & (F.col("sense") != F.col("heading"))).cast("int")
        spent = F.max("step").over(Window.partitionBy("start"))
        grown = tried.select(
            "start",
            F.concat("nodes", F.array("dst")).alias("nodes"),
            F.concat("rules", F.array("rule")).alias("rules"),
            (F.col("total") + F.col("cost")).alias("total"),
            F.when(F.col("sense") != 0, F.col("sense")).otherwise(F.col("heading")).alias("heading"),
            F.when(F.col("first") != 0, F.col("first")).otherwise(F.col("sense")).alias("first"),
            (F.col("changes") + change).alias("changes"),
            F.col("rise").alias("rose"),
            (F.col("rough") + F.coalesce(F.abs(F.col("rise") - F.col("rose")), zero)).alias("rough"),
            (F.col("turns") + F.coalesce("turned", zero)).alias("turns"),
            F.greatest("worst", F.coalesce("gap", none)).alias("worst"),
            F.col("step").alias("no"),
            spent.alias("spent"),
            ((F.col("src") != F.col("dst")) | (F.col("rule") == "repeat")).alias("goes"),
            ((F.col("rule") != "turn") | (F.coalesce("turned", zero) <= MOST_TURN)).alias("bears"),
        )
        front = written(grown.filter("goes AND bears AND changes <= 1").drop("goes", "bears"))
        found = front if found is None else found.unionByName(front)
    return found


def chosen(paths: DataFrame, per_start: int = 8) -> DataFrame:
    """Of each start's paths a share for every mix of rules, then the best of the others, up to ``per_start`` of them."""
    size = F.size("nodes") - 1
    paths = paths.withColumn("mean", F.col("total") / size).withColumn("mix", F.array_join(F.array_sort(F.array_distinct("rules")), "+"))
    best = [F.col("mean"), F.desc(F.size("nodes")), F.col("nodes"), F.col("rules")]
    own = Window.partitionBy("start", "mix").orderBy(*best)
    mixes = F.size(F.collect_set("mix").over(Window.partitionBy("start")))
    ranked = paths.withColumn("rank", F.row_number().over(own)).withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(per_start) / mixes)))
    sure = F.col("rank") <= F.col("quota")
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.when(sure, 0).otherwise(1), *best))
    return described(ranked.withColumn("sure", sure).withColumn("place", place).filter((F.col("place") <= per_start) | F.col("sure")))


def described(picked: DataFrame) -> DataFrame:
    """Chosen paths with their score and their profile of height."""
    profile = F.when(F.col("first") == 0, "flat").when(F.col("changes") == 0, F.when(F.col("first") > 0, "falling").otherwise("rising")).when(F.col("first") > 0, "cup").otherwise("cap")
    score = F.col("worst") + F.col("rough") / HEIGHT_PART + F.col("turns") / TURN_PART
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return picked.select("start", text("nodes").alias("nodes"), text("rules").alias("rules"), F.size("nodes").alias("length"), F.round("mean", 6).alias("mean"), F.col("worst").alias("worst_gap"), F.round(score, 6).alias("score"), profile.alias("profile"))


def _oracle(length: int, per_start: int) -> str:
    return f"""WITH RECURSIVE {_text("@node", 1).replace("{embeddings}", "embeddings")}, edges AS ({ORACLE["run_edge_quota"]}),
ext AS (SELECT vec_id, y, min(x) AS first, max(x) AS last FROM pix WHERE v = 1 GROUP BY vec_id, y),
gaps AS (SELECT src, dst, min(7 - a.last + b.first) AS gap FROM (SELECT DISTINCT src, dst FROM edges) JOIN ext a ON a.vec_id = src JOIN ext b ON b.vec_id = dst AND b.y = a.y GROUP BY src, dst),
went AS MATERIALIZED (SELECT edges.*, y.cen - x.cen AS rise, CASE WHEN abs(y.cen - x.cen) < {LEVEL} THEN 0 ELSE sign(y.cen - x.cen)::INT END AS sense, least(abs(y.dom - x.dom), 180 - abs(y.dom - x.dom)) AS turned, gap FROM edges JOIN node x ON x.id = edges.src JOIN node y ON y.id = edges.dst LEFT JOIN gaps USING (src, dst)),
walked(start, nodes, rules, total, heading, first, changes, rose, rough, turns, worst) AS (SELECT id, [id], []::VARCHAR[], 0.0::DOUBLE, 0, 0, 0, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM node
UNION ALL SELECT start, list_append(nodes, dst), list_append(rules, rule), total + cost, CASE WHEN sense <> 0 THEN sense ELSE heading END, CASE WHEN first <> 0 THEN first ELSE sense END, changes + CASE WHEN sense <> 0 AND heading <> 0 AND sense <> heading THEN 1 ELSE 0 END, rise, rough + coalesce(abs(rise - rose), 0.0), turns + coalesce(turned, 0.0), greatest(worst, coalesce(gap, 0))::INT
FROM walked p JOIN went ON went.src = nodes[-1] WHERE len(nodes) < {length} AND (src <> dst OR rule = 'repeat') AND (rule <> 'turn' OR coalesce(turned, 0) <= {MOST_TURN}) AND changes + CASE WHEN sense <> 0 AND heading <> 0 AND sense <> heading THEN 1 ELSE 0 END <= 1),
m AS (SELECT *, total / (len(nodes) - 1) AS mean, array_to_string(list_sort(list_distinct(rules)), '+') AS mix FROM walked WHERE len(nodes) > 1),
r AS (SELECT m.*, row_number() OVER (PARTITION BY start, mix ORDER BY mean, len(nodes) DESC, nodes, rules) <= greatest(1, floor({per_start} / mixes)) AS sure FROM m JOIN (SELECT start, count(DISTINCT mix) AS mixes FROM m GROUP BY start) USING (start)),
k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY CASE WHEN sure THEN 0 ELSE 1 END, mean, len(nodes) DESC, nodes, rules) AS place FROM r)
SELECT start, array_to_string(nodes, ' ') AS nodes, array_to_string(rules, ' ') AS rules, len(nodes)::INT AS length, round(mean, 6) AS mean, worst AS worst_gap, round(worst + rough / {HEIGHT_PART} + turns / {TURN_PART}, 6) AS score, CASE WHEN first = 0 THEN 'flat' WHEN changes = 0 THEN CASE WHEN first > 0 THEN 'falling' ELSE 'rising' END WHEN first > 0 THEN 'cup' ELSE 'cap' END AS profile FROM k WHERE place <= {per_start} OR sure"""


# Runs of two to four marks with their score (the budget is never reached by three edges a rule: 13 + 13^2 + 13^3 steps)
@query("run_walks", _oracle(4, 8))
def run_walks(spark, sf_dir: str, length: int = 4, per_start: int = 8, budget: int = 4000) -> DataFrame:
    """The chosen runs of each shape: their marks, rules, mean cost, worst gap, score (worst gap and roughness) and profile of height."""
    edges = steps(spark, sf_dir).withColumn("rule", F.array_position(F.array(*map(F.lit, sorted(RULES))), F.col("rule")).cast("int") - 1)
    blocks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), "label")
    found = dealt(edges.join(blocks, "src"), "src", SALTS).applyInArrow(walks_of_group(tuple(sorted(RULES)), length, per_start, budget, MOST_TURN), KEPT)
    return described(found)
