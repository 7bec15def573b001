import re
from collections import Counter

import duckdb
import pytest
from fixtures import documents, folder, texts

from quern.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    spans = Counter(zip(words, words[1:], words[2:]))
    hit = {at + k for at in range(len(words) - 2) if spans[tuple(words[at : at + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_op3(spark, tmp_path):
    got = {r.doc_id: r for r in quality.op3_quality_rules(spark, folder(spark, tmp_path)).collect()}
    for i, t in enumerate(texts()):
        n, chars, symbols, dup, repeat = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), i
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)


def test_lines_go_by_reason():
    good = "This line is a sentence that anyone may keep."
    for line, why in (("Home | About | Contact", "navigation"), ("see http://a.b and www.c.d", "navigation"), ("Wow$$$ that### is*** a&&& lot%%% of*** signs.", "symbols"), ("LOOK!! AT!! THIS!! GREAT!! OFFER!! NOW!!", "shouting"), ("one two one two one two one two one two one two.", "repeats"), ("a line that just stops without an end", "punctuation")):
        text, lost, _, reasons = quality.clean(f"{good}\n{line}\n".encode(), 0.25)
        assert (lost, reasons, text) == (1, {why: 1}, f"{good}\n")
    assert quality.clean(f"{good}\n{good}".encode(), 0.25)[3] == {"repeats": 1}
    assert quality.clean(f"{good}\nA footer.".encode(), 0.25, [False, True])[::3] == (good, {"boilerplate": 1})


def words_of(line):
    return WORD.findall(line)


def fails(line, earlier):
    """The rules of a line, written anew from their description."""
    w = words_of(line)
    n, text = len(w), " ".join(w)
    between = [x for x in w if x in quality.SEPARATORS or "://" in x or x[:4] == "www."]
    cased = [x for x in w if x.upper() != x.lower()]
    loud = [x for x in cased if x.upper() == x]
    pairs = {(w[k], w[k + 1]) for k in range(n - 1)}
    tail = line.strip(" \t\v\f\r").rstrip(quality.CLOSING)
    return any([
        n > 1 and line in earlier,
        between and (len(between) > n / 5 or len(between) > 1 and n < 13),
        sum(text.count(c) for c in "#*$%&|<>") > n / 4,
        n > 2 and len(cased) > 2 and len(loud) > 0.7 * len(cased) and sum(len(x) for x in cased) > 2 * len(cased),
        n > 7 and 2 * len(pairs) < n - 1,
        n > 3 and (not tail or tail[-1] not in ".!?…。！？:;"),
    ])


def lower(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\v\f\r"))


def brute_kept(rows, min_docs=10):
    """Judges whole documents; boilerplate counted with plain dictionaries."""
    key = lower
    seen: dict = {}
    for i, t in rows:
        last, done = None, set()
        for line in (t or "").split("\n"):
            n, k = len(words_of(line)), key(line)
            if 1 < n < 26 and k not in done:
                done.add(k)
                seen.setdefault(k, []).append(last)
            if n:
                last = k
    frequent = {k for k, v in seen.items() if len(v) >= min_docs and len(set(v)) >= len(v) / 2}
    out = {}
    for i, t in rows:
        n, chars, _, _, repeat = brute(t)
        earlier, gone = set(), 0
        for line in (t or "").split("\n"):
            if words_of(line):
                if key(line) in frequent or fails(line, earlier):
                    gone += sum(map(len, words_of(line)))
                earlier.add(line)
        out[i] = n >= 50 and 100 * repeat <= 50 * n and 2 * gone <= chars
    return out, frequent


def planted():
    """Documents with footers amid other text, copies whose lines stand in many documents, and lists of footers."""
    body = [". ".join(f"Word{k}x{j} and word{j}y{k} stand here" for j in range(12)) + "." for k in range(40)]
    footers = [f"Footer number {f} of every site on the web." for f in range(9)]
    out = [f"{b}\n{footers[k % 3]}\n{b[::-1]}." for k, b in enumerate(body)]
    copy = "\n".join(" ".join(f"copied{j}{c}" for c in "abcdefgh") + "." for j in range(9))
    out += [copy] * 25
    out += ["\n".join([f"Own start {k} of this one.", *(x for f in footers for x in (f, f"{k} own words {f}."))]) for k in range(14)]
    out += [f"Top {k}.\n" + "\n".join(footers[(k + j) % 9] for j in range(9)) for k in range(14)]
    return out + texts()


def test_kept_against_brute_force(spark, tmp_path):
    rows = list(enumerate(planted()))
    want, frequent = brute_kept(rows)
    got = {r.doc_id: r.kept for r in quality.op3_quality_rules(spark, folder(spark, tmp_path, [t for _, t in rows])).collect()}
    assert got == want and len(frequent) >= 9 and not any("copied" in x for x in frequent)
    assert all(got[i] for i in range(65)) and not any(got[i] for i in range(79, 93))
    few = quality.judge_documents(documents(spark, planted()), min_docs=1000).collect()
    assert {r.doc_id: r.kept for r in few} == brute_kept(rows, 1000)[0]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_words for r in quality.clean_documents(rows).collect()) == [0, 2, 2, 2]
    with pytest.raises(ValueError):
        quality.clean_documents(rows.withColumn("kept", rows.doc_id), carry=["kept"])


def test_kept_on_labels(spark):
    """Clean documents are kept, most of the labelled junk goes."""
    at = "/root/testdata/sf0.1"
    kept = quality.op3_quality_rules(spark, at).filter("not base_failed").select("doc_id", "kept", "n_words").toPandas()
    seen = duckdb.sql(f"SELECT kept, n_words, quality FROM kept JOIN '{at}/labels.parquet' USING (doc_id)").df()
    assert seen[seen.quality == 1].kept.mean() > 0.995
    assert seen[seen.quality == 0].kept.mean() < 0.25


def test_empty(spark):
    assert quality.clean_documents(documents(spark, []), carry=["lang"]).count() == 0
