"""URL filters: rule lists first, then a tree of path templates for each host. DataFrame functions only.

The tree is grown level by level over distinct (host, path segments) with their counts of pages and of labels:

1. Digits within a segment are generalised first (``item-42.html`` is ``item-#.html``), so an id is no branch.
2. Of a node with more than ``fan`` branches, those with less than a ``fan``-th of its pages are variable
   segments: they become one wildcard ``*``.
3. Of the other branches, those with at least ``min_labels`` labels whose rate of bad labels lies within ``z`` standard errors
   of the rate of all labelled branches of the node are statistically similar: they merge into ``+``. A branch that differs, or
   about which nothing is known, keeps its name.

A template's purity is its rate of bad labels, smoothed by ``weight`` labels at the host's rate, which
itself is smoothed by the rate of all; a template is rejected at ``threshold`` and more, given ``min_labels`` labels.

All steps are grouped counts and equi-joins on counts; each level is written to the shared folder, so a plan has one
level only. Pages meet the tree's leaves by (host, segments), which have one row each there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: F.Column, path: F.Column, rules) -> F.Column:
    """The longest rule that fits the host (or a parent domain of it) and the path's beginning, else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest comes last and so is asked first
        name, _, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def segments(path: F.Column, depth: int) -> F.Column:
    """Segments with their digits generalised; what lies deeper than ``depth`` is one last segment."""
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    tail = F.array_join(F.slice(parts, depth, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(F.size(parts) <= depth, parts).otherwise(F.concat(F.slice(parts, 1, depth - 1), F.array(tail)))


def grow(leaves: DataFrame, folder: str, *, depth: int, fan: int, min_labels: int, z: float) -> DataFrame:
    """Adds ``template`` to (host, parts, n, labels, bad), level by level."""
    tree = leaves.withColumn("template", F.lit("").cast("string"))
    levels = leaves.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(min(levels, depth)):
        here = tree.withColumn("child", F.get("parts", F.lit(level)))
        kids = here.filter(F.col("child").isNotNull()).groupBy("host", "template", "child").agg(F.sum("n").alias("c"), F.sum("labels").alias("l"), F.sum("bad").alias("b"))
        known = F.col("l") >= min_labels
        nodes = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("all_c"), F.sum(F.when(known, F.col("l")).otherwise(0)).alias("all_l"), F.sum(F.when(known, F.col("b")).otherwise(0)).alias("all_b"))
        rate = F.col("all_b") / F.col("all_l")
        near = F.abs(F.col("b") / F.col("l") - rate) <= F.lit(z) * F.sqrt(rate * (F.lit(1.0) - rate) / F.col("l"))
        name = F.when((F.col("k") > fan) & (F.col("c") * fan < F.col("all_c")), F.lit("*")).when(known & near, F.lit("+")).otherwise(F.col("child"))
        names = kids.join(nodes, ["host", "template"]).select("host", "template", "child", name.alias("name"))
        grown = here.join(names, ["host", "template", "child"], "left")
        longer = F.when(F.col("child").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("name", "child")))
        tree = store.table(grown.select("host", "parts", "n", "labels", "bad", longer.alias("template")), f"{folder}/level-{level}")
    return tree


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, bad: F.Column | None = None, depth: int = 8, fan: int = 20, min_labels: int = 5, z: float = 2.0, weight: float = 4.0, threshold: float = 0.5) -> DataFrame:
    """Judges every url: page_id, host, path, rule, template, labels, purity, verdict (``allow`` or ``block``).

    ``bad`` is a column of ``pages`` with labels (1 bad, 0 good, null none), which count whether a rule decides the url or not;
    without it, the urls that a rule decides are the labelled ones. A null url, or one without ``://``, has empty host and path; they form a template of their own. A template
    without enough labels is allowed. Null ids, ties and repeated rows stay rows of their own; an empty table gives an empty result.
    """
    folder = store.new_dir(pages.sparkSession, "urls")
    host, path = host_and_path(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(None).cast("int") if bad is None else bad.cast("int")).alias("label"))
    blocked = [r for how, r in rules if how == "block"]
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocked), F.lit("block")).otherwise(F.lit("allow"))) if rules else F.lit(None).cast("string")
    rows = rows.withColumn("by_rule", by_rule).withColumn("parts", segments(F.col("path"), depth))
    label = F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "block").cast("int")) if bad is None else F.col("label")
    leaves = rows.withColumn("label", label).groupBy("host", "parts").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("bad"))
    tree = grow(store.table(leaves, f"{folder}/leaves"), folder, depth=depth, fan=fan, min_labels=min_labels, z=z)

    total = tree.agg(((F.sum("bad") + 1) / (F.sum("labels") + 2)).alias("everywhere"))
    hosts = tree.groupBy("host").agg(F.sum("labels").alias("hl"), F.sum("bad").alias("hb")).crossJoin(F.broadcast(total))  # one row
    hosts = hosts.select("host", ((F.col("hb") + weight * F.col("everywhere")) / (F.col("hl") + weight)).alias("usual"))
    found = tree.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")).join(hosts, "host")
    found = found.select("host", "template", "labels", ((F.col("bad") + weight * F.col("usual")) / (F.col("labels") + weight)).alias("purity"))
    found = tree.select("host", "parts", "template").join(found, ["host", "template"])
    out = rows.join(found, ["host", "parts"], "left")
    reject = (F.col("labels") >= min_labels) & (F.col("purity") >= threshold)
    verdict = F.coalesce("by_rule", F.when(reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", "template", "labels", "purity", verdict.alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``bad`` to pages: 1 if the document whose id is the first number of the url's path is labelled as toxic or of low quality, 0 if it has
    other labels, null if it has none. A document with several labels is bad by any of them."""
    path = host_and_path(F.col("url").cast("string"))[1]
    number = F.regexp_extract(path, "([0-9]{1,18})", 1)
    # urls without a number get keys of their own below 0, so they are not one key of the join
    number = F.when(number != "", number.cast("long")).otherwise(F.lit(-1) - F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)))
    known = labels.filter("doc_id >= 0").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return pages.withColumn("doc_no", number).join(known, F.col("doc_no") == known["doc_id"], "left").select(*pages.columns, "bad")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rows = labelled_pages(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_urls(rows, bad=F.col("bad")).select("page_id", "host", "path", "rule", "verdict")
