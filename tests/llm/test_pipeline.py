import hashlib

import corpus_pipeline as cp
import test_decontaminate
import test_jaccard
import test_lines_tokens
import test_quality
from fixtures import documents, folder, texts
from pyspark.sql import functions as F

from quern.llm import bpe, quality


def base():
    clean = [f"{'. '.join(' '.join(f'word{(k * 7 + j * 13 + s) % 997}' for j in range(11)) for s in range(7))}." for k in range(12)]
    footer = "This footer stands in very many documents of the crawl."
    out = [f"{t}\n{footer}" for t in clean]
    out += [out[0], out[0], out[1].replace("word7 ", "other "), *texts()]
    out.append(clean[3].replace("word", "text") + " " + " ".join(f"bench{k}" for k in range(14)) + ".")
    out.append("| ".join(["menu"] * 80))
    return out


def test_stages(spark, tmp_path):
    rows = base()
    bench = test_decontaminate.bench(spark, [(1, " ".join(f"bench{k}" for k in range(14))), (2, "one two")])
    at = folder(spark, tmp_path, rows, benchmark=bench)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    docs = docs.union(docs.filter("doc_id = 2")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.union(docs.filter("doc_id = 5").withColumn("text", F.lit("another text under the id of the fifth, which stays too, as it is like no other.")))
    as_list = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())
    lone = docs.filter("doc_id is null").first().text

    one = cp.quality_rules(spark, docs, at)
    want = []
    every = [*enumerate(rows), (2, rows[2]), (-1, lone), (5, "another text under the id of the fifth, which stays too, as it is like no other.")]
    frequent = test_quality.brute_kept(every)[1]
    for i, t in every:
        data = (t or "").encode()
        n, chars, _, _, repeat = quality.base_stats(data)
        text, _, gone, _ = quality.clean(data, 0.25, [test_quality.lower(x) in frequent for x in (t or "").split("\n")])
        if n >= cp.MIN_WORDS and 100 * repeat <= 50 * n and gone <= 0.5 * chars:
            want.append((i, text))
    assert as_list(one) == sorted(want) and {i for i, _ in want} >= set(range(12))
    assert tuple(one.columns) == cp.COLUMNS and one.filter("n_chars <> length(text)").count() == 0

    two = cp.drop_repeated_lines(spark, one, at)
    counts, spared = {}, {}
    for i, t in want:
        for k in {test_lines_tokens.key(x) for x in t.split("\n")} - {""}:
            counts[k] = counts.get(k, 0) + 1
            spared[k] = min(spared.get(k, i), i, key=lambda x: (x < 0, x))
    left = []
    for i, t in want:
        seen, kept = set(), []
        for x in t.split("\n"):
            k = test_lines_tokens.key(x)
            if k and counts[k] >= 10 and (spared[k] != i or k in seen):
                continue
            seen.add(k)
            kept.append(x)
        if "\n".join(kept).strip(" \t\n\v\f\r"):
            left.append((i, "\n".join(kept)))
    assert as_list(two) == sorted(left)

    three = cp.near_duplicates(spark, two, at)
    order = sorted(left, key=lambda x: (x[0] < 0, x[0], hashlib.md5(x[1].encode()).hexdigest()))
    groups = test_jaccard.brute([(k, t) for k, (_, t) in enumerate(order)], 5, 8, 10)
    left = [x for k, x in enumerate(order) if groups[k][1] == k]
    assert len([i for i, _ in left if i == 5]) == 2 and [i for i, _ in left].count(2) == 1
    assert as_list(three) == sorted(left)

    four = cp.decontamination(spark, three, at)
    hit = test_decontaminate.brute([(k, t) for k, (_, t) in enumerate(left)], [(1, " ".join(f"bench{k}" for k in range(14))), (2, "one two")], 10)
    left = [x for k, x in enumerate(left) if not hit[k][4]]
    assert as_list(four) == sorted(left) and any(x[4] for x in hit.values())

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_tokenizer())
    out = cp.encoding(spark, four, at).collect()
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in left]
    want = sorted((i, len(x), x, library.decode(x, skip_special_tokens=False)) for i, x in ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids, r.decoded) for r in out) == want


def test_rows_without_ids(spark, tmp_path):
    """Rows whose ids are null or repeat are judged by themselves in every stage."""
    w = [" ".join(f"{c}{k}" for k in range(30)) + "." for c in "abcd"]
    rows = [(None, w[0]), (None, w[0]), (None, w[1]), (1, w[2]), (1, w[3]), (1, w[3]), (2, w[3] + " tail."), (None, w[2] + " tail.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars")
    test_decontaminate.bench(spark, [(1, " ".join(w[1].split()[3:20]))]).write.parquet(f"{tmp_path}/benchmark.parquet")
    name = lambda df: sorted((r.doc_id or 0, r.text) for r in df.collect())
    near = cp.near_duplicates(spark, docs, str(tmp_path))
    assert name(near) == sorted([(0, w[0]), (0, w[1]), (1, w[2]), (1, w[3])])
    assert name(cp.decontamination(spark, near, str(tmp_path))) == sorted([(0, w[0]), (1, w[2]), (1, w[3])])


def test_run_and_empty(spark, tmp_path):
    bench = test_decontaminate.bench(spark, [(1, "x y")])
    assert cp.run(spark, folder(spark, tmp_path, base(), benchmark=bench)).count() > 10
    assert cp.run(spark, folder(spark, tmp_path / "none", [], benchmark=bench)).count() == 0
    assert len(documents(spark, []).columns) == 8
