"""Strokes over strokes and windows of cells, by loops over the characters."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern import registry
from quern.functions.advances import EM, WIDTHS
from quern.operators.pages import COUNTED, Page, dealt, summed
from quern.plans import laid as laid_plans


def advance(ch):
    return round(WIDTHS[ord(ch) - 32] * EM / 1000) if " " <= ch <= "~" else EM if ch in "漢ｗ😀" else 9


def laid(text):
    for r, line in enumerate(text.rstrip("\n").split("\n")):
        pen = 0
        for ch in line:
            yield r, ch, pen, pen + advance(ch)
            pen += advance(ch)


def test_pages_by_loops(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("AIWil .漢😀é\n\n") for _ in range(rng.randrange(120))) for _ in range(25)]
    texts += [texts[0], "", None, "\n\n", "\nA\nA\n", "W" * 3000 + "\n" + "I" * 9000]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stacks, windows = defaultdict(list), defaultdict(list)
    for k, text in enumerate(texts):
        marks = [(r, ch, (a + b) / 2) for r, ch, a, b in laid(text or "") if "A" <= ch <= "Z"]
        by = defaultdict(list)
        for r, ch, c in marks:
            by[r].append((ch, c))
        for r, ch, c in marks:
            for low, d in by[r + 1]:
                if abs(d - c) <= 3:
                    stacks[ch, low, int(np.rint(d - c))].append(k)
        cells = defaultdict(str)
        for r, ch, a, _ in laid(text or ""):
            cells[r, a // 16] += ch
        ink = {at: bool(code.strip(" ")) for at, code in cells.items()}
        for r, c in cells:
            at = [(r, c), (r, c + 1), (r + 1, c), (r + 1, c + 1)]
            if all(x in cells for x in at) and all(ink[at[i]] or ink[at[j]] for i, j in ((0, 1), (2, 3), (0, 2), (1, 3))):
                windows["{}|{}/{}|{}".format(*(cells[x] for x in at))].append(k)
    got = {(x.upper_ch, x.lower_ch, x.dx): (x.n, x.pages) for x in registry.QUERIES["stacks"](spark, str(tmp_path)).collect()}
    assert got == {key: (len(v), len(set(v))) for key, v in stacks.items()} and len(got) > 5
    got = {x.k: (x.n, x.pages, x.slugs) for x in registry.QUERIES["window_patterns"](spark, str(tmp_path)).collect()}
    assert got == {key: (len(v), len(set(v)), len({i % 3 for i in v})) for key, v in windows.items() if len(set(v)) >= 2} and got


def test_empty_pages():
    for text in ("", "\n", "   ", "a"):
        page = Page(text)
        assert not len(page.strokes()) and not page.windows()


def test_windows_are_dealt_by_the_sheet(spark, tmp_path, monkeypatch):
    """What goes to the shuffle are counts of many pages together: a row for a bucket and no row for each window; and nothing spans two pages."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("AIl .|/漢é\n") for _ in range(400)) for _ in range(40)] * 2 + [None, "", "\n\nab\n"]
    rows = [(k, t, None if k % 5 == 4 else f"s{k % 3}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    want = defaultdict(list)
    for k, text, slug in rows:
        found = Page(text or "").windows()
        for w in found.column("k").to_pylist() if len(found) else ():
            want[w].append((k, slug))
    want = {w: (len(v), len({k for k, _ in v}), len({s for _, s in v if s})) for w, v in want.items() if len({k for k, _ in v}) >= 2}
    for sheet, bucket in ((1, 1 << 23), (1 << 20, 1 << 23), (700, 50)):
        monkeypatch.setattr(laid_plans, "SHEET", sheet)
        monkeypatch.setattr(laid_plans, "BUCKET", bucket)
        df = registry.QUERIES["window_patterns"](spark, str(tmp_path))
        assert {x.k: (x.n, x.pages, x.slugs) for x in df.collect()} == want and len(want) > 1000
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Aggregate" not in plan


def test_buckets_are_even_and_by_the_text_alone():
    texts = [f"{a}{b}" for a in "abé漢😀" for b in ["", *(str(x) for x in range(4000))]]
    rows = counted_rows(texts)
    parts = dealt(rows, 50)
    by = {b: summed(pa.Table.from_batches([parts]).filter(pc.field("bucket") == b), lambda n, pages: n > 0).column("k").to_pylist() for b in range(50)}
    assert sorted(x for v in by.values() for x in v) == sorted(texts)
    assert max(map(len, by.values())) < 1.5 * len(texts) / 50
    again = dealt(counted_rows(texts[::-3]), 50)  # another sheet deals the same texts to the same buckets
    for b in again.column("bucket").to_pylist():
        got = summed(pa.Table.from_batches([again]).filter(pc.field("bucket") == b), lambda n, pages: n > 0).column("k").to_pylist()
        assert set(got) <= set(by[b])


def counted_rows(texts):
    return pa.record_batch([pa.array(texts), pa.array([None] * len(texts), pa.string()), pa.array([1] * len(texts)), pa.array([1] * len(texts))], COUNTED.names)
