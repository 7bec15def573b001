import random
import re

from pyspark.sql import functions as F

from quern.llm import url_filter

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x=/de/", "http://example.net/en/", "http://example.net/EN/", "http://net/", "http://net", "http://planet/x", "http://b.example.com/de/2#top", "http://b.example.com/de", "https://x.org/fr/9", "x://y://z/a", "http://h?q/p", "http://h#f/p", "http://É.ORG/fr/ü", "http://h/a\nb/c"]


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path, rules=url_filter.RULES):
    fit = [r for _, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fit, key=len, default=None)


def test_hosts_paths_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, None)], "page_id long, url string")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = brute(URLS[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == {x: how for how, x in url_filter.RULES}[rule]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_tree_rejects_labelled_templates(spark):
    rows = []
    for k in range(300):
        rows.append((k, f"http://shop.test/tag/w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvw'[k // 100]}/{k}", 1 if k % 3 == 0 else None))
        rows.append((1000 + k, f"http://shop.test/item/{k}.html", 0 if k % 3 == 0 else None))
        rows.append((2000 + k, f"http://shop.test/new/{k}", None))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    out = url_filter.judge_urls(df, rules=(), bad=F.col("bad"))
    got = {(r.template, r.verdict): r["count"] for r in out.groupBy("template", "verdict").count().collect()}
    assert sum(n for (t, v), n in got.items() if v == "block") == 300
    assert all(t.startswith("/tag/") for t, v in got if v == "block") and any(t == "/tag/*/+" or t == "/tag/*/#" for t, _ in got)
    assert got["/new/#", "allow"] == 300


def test_similar_branches_merge(spark):
    rows = [(k, f"http://h/{'abc'[k % 3]}/x", int(k % 10 == 0)) for k in range(300)] + [(900 + k, "http://h/d/x", 1) for k in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    out = url_filter.judge_urls(df, rules=(), bad=F.col("bad"), z=3.0).select("path", "template", "verdict").distinct().collect()
    by = {r.path: (r.template, r.verdict) for r in out}
    assert by["/d/x"][1] == "block" and by["/a/x"][1] == by["/b/x"][1] == "allow"


def brute_tree(rows, fan=20, min_labels=5, z=2.0, weight=4.0, threshold=0.5):
    """Templates and verdicts of (host, path, label) rows, level by level over plain lists."""
    def parts_of(path):
        parts = [x for x in re.sub("[0-9]+", "#", path).split("/") if x]
        return parts if len(parts) <= 8 else [*parts[:7], "/".join(parts[7:])]

    parts, template = [parts_of(p) for _, p, _ in rows], [""] * len(rows)
    for level in range(8):
        kids: dict = {}
        for k, (host, _, label) in enumerate(rows):
            if level < len(parts[k]):
                own = kids.setdefault((host, template[k]), {}).setdefault(parts[k][level], [0, 0, 0])
                own[0] += 1
                own[1] += label is not None
                own[2] += label or 0
        names = {}
        for node, branches in kids.items():
            known = [b for b in branches.values() if b[1] >= min_labels]
            labels, bad, pages = (sum(b[c] for b in x) for x, c in ((known, 1), (known, 2), (branches.values(), 0)))
            for child, (n, l, b) in branches.items():
                rate = bad / labels if labels else 0
                if len(branches) > fan and n * fan < pages:
                    names[node, child] = "*"
                elif l >= min_labels and abs(b / l - rate) <= z * (rate * (1 - rate) / l) ** 0.5:
                    names[node, child] = "+"
                else:
                    names[node, child] = child
        template = [t + "/" + names[(rows[k][0], t), parts[k][level]] if level < len(parts[k]) else t for k, t in enumerate(template)]
    every = (sum(r[2] or 0 for r in rows) + 1) / (sum(r[2] is not None for r in rows) + 2)
    out = []
    for k, (host, _, _) in enumerate(rows):
        of_host = [r[2] for r in rows if r[0] == host and r[2] is not None]
        own = [r[2] for r, t in zip(rows, template) if r[0] == host and t == template[k] and r[2] is not None]
        usual = (sum(of_host) + weight * every) / (len(of_host) + weight)
        out.append((template[k], "block" if len(own) >= min_labels and (sum(own) + weight * usual) / (len(own) + weight) >= threshold else "allow"))
    return out


def test_tree_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for k in range(900):
        host, kind = rng.choice(["a.x", "b.x", "b.x", ""]), rng.randrange(6)
        path = ["/tag/" + "".join(rng.choices("abcdefgh", k=3)) + f"/{k}", f"/item/{k}.html", "/" + "/".join(rng.choices("pq", k=rng.randrange(11))), "", f"/en/{k}/", f"/{rng.choice('uvw')}/x"][kind]
        rows.append((host, path, rng.choice([None, int(rng.random() < (0.8, 0.1, 0.5, 0.5, 0.2, 0.9)[kind])])))
    df = spark.createDataFrame([(k, f"http://{h}{p}", label) for k, (h, p, label) in enumerate(rows)], "page_id long, url string, bad int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.judge_urls(df, rules=(), bad=F.col("bad")).collect()}
    want = brute_tree(rows)
    assert [got[k] for k in range(len(rows))] == want and {v for _, v in want} == {"allow", "block"}


def test_op4_rejects_by_labels(spark, tmp_path):
    """Labels of the documents that urls name reject a template, beside the rules; urls without a number, nulls and repeated labels stay harmless."""
    urls = [(k, f"http://a.test/{'spam' if k % 2 else 'news'}/{k}") for k in range(60)] + [(None, None), (70, "http://a.test/spam/none"), (71, "http://x.net/spam/3"), (70, "http://a.test/spam/none")]
    labels = [(k, 0 if k % 2 else 1, 0) for k in range(40)] + [(1, 1, 0), (2, None, None), (None, 0, 1)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = url_filter.op4_url_filter(spark, str(tmp_path)).collect()
    assert len(out) == len(urls)
    assert all((r.verdict == "block") == (bool(r.page_id % 2)) for r in out if r.page_id is not None and r.page_id < 60)
    assert {r.verdict for r in out if r.page_id is None} == {"allow"} and {(r.rule, r.verdict) for r in out if r.page_id == 71} == {("net/", "block")}
