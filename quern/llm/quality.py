"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text.

Each line that has a word is held against these rules; the first that it fails is its reason:

* ``boilerplate``: a short line that stands in ``min_docs`` documents or more, amid ever other text: the different lines before
  it are at least half as many as the documents. (The lines of copied documents stand in many documents too, but always after the same
  line.) These counts are made over all documents: a pair of Bloom filters finds the lines that may repeat, and only
  these are counted exactly, by (line, line before it), so that no frequent line is one task's;
* ``navigation``: separators (``|``, ``»``, ``·``, ...) and links stand for more than a fifth of its words, or two and
  more stand in a line of few words;
* ``symbols``: more than ``max_symbols`` signs of ``#*$%&|<>`` for each word;
* ``shouting``: nearly all cased words of a longer line are upper case;
* ``repeats``: the line is equal to an earlier line, or most of its word pairs repeat in the line;
* ``punctuation``: it doesn't end as a sentence ends (and has more words than a title).

A document is rejected if its words fail the base rules, or if the failed lines hold more than
``max_lost`` of the code points of its words. Lines without a word are no loss.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import line_dedup, store
from quern.llm.common import as_bytes, as_text, documents, narrow, no_clash, pieces

#: Fixed values of the contract: the symbols that count.
SYMBOLS = b"#*$%&|<>"
#: What stands between entries of a menu.
SEPARATORS = {"|", "||", "»", "«", "›", "·", "•", "/", ">", ">>", "::", "→"}
#: Ends of a sentence.
TERMINAL = (".", "!", "?", "…", "。", "！", "？", ":", ";")
CLOSING = "\"'”’»)]}›"
SHORT = 25  # words of a line that can be boilerplate
SLICE_BYTES = 64 << 20  # of the input, for each slice of the hash space

_CONTINUED = bytes(range(0x80, 0xC0))
_BLANK = b" \t\n\v\f\r"


def base_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()  # bytes: at ASCII white space
    chars = len(text.translate(None, _BLANK + _CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif not line.isspace() and line:
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            end = 0
            for at, window in enumerate(windows):
                if counts[window] > 1:
                    repeat += at + 3 - max(at, end)
                    end = at + 3
    return len(words), chars, symbols, dup, repeat


def line_reason(line: str, words: list[str], max_symbols: float) -> str | None:
    """Why a line with words fails, or None; whether it stood before is the caller's to know."""
    n = len(words)
    marks = sum(w in SEPARATORS or "://" in w or w.startswith("www.") for w in words)
    if marks and (5 * marks > n or marks >= 2 and n <= 12):
        return "navigation"
    if sum(map(line.count, "#*$%&|<>")) > max_symbols * n:
        return "symbols"
    if n >= 3:
        cased = [w for w in words if w.upper() != w.lower()]
        if len(cased) >= 3 and sum(w == w.upper() for w in cased) > 0.7 * len(cased) and sum(map(len, cased)) > 2 * len(cased):
            return "shouting"
    if n >= 8 and 2 * len(set(zip(words, words[1:]))) < n - 1:
        return "repeats"
    end = line.rstrip(" \t\v\f\r").rstrip(CLOSING)
    if n > 3 and not end.endswith(TERMINAL):
        return "punctuation"
    return None


def short_keys(text: bytes) -> tuple[list[bytes], list[int]]:
    """For each line the 128-bit hash of its key (b"" for a line that is no short one), and a hash of the key of the line with words before it."""
    keys, before, last = [], [], 0
    for line in text.split(b"\n"):
        key = line.strip().lower()
        n = len(key.split(None, SHORT)) if key else 0
        keys.append(xxhash.xxh3_128_digest(key) if 1 < n <= SHORT else b"")
        before.append(last)
        if n:
            last = xxhash.xxh3_64_intdigest(key) >> 1
    return keys, before


def clean(text: bytes, max_symbols: float, frequent: list[bool] | None = None) -> tuple[str, int, int, dict[str, int]]:
    """The text without failed lines, their number, the code points of words in them, and lines by reason. ``frequent``: lines that are boilerplate."""
    kept, lost, gone, why = [], 0, 0, {}
    seen: set[str] = set()
    for k, line in enumerate(text.decode("utf-8", "replace").split("\n")):
        words = [w for w in line.replace("\t", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        reason = None
        if words:
            if frequent is not None and frequent[k]:
                reason = "boilerplate"
            else:
                reason = "repeats" if len(words) > 1 and line in seen else line_reason(line, words, max_symbols)
            seen.add(line)
        if reason:
            lost += 1
            gone += sum(map(len, words))
            why[reason] = why.get(reason, 0) + 1
        else:
            kept.append(line)
    return "\n".join(kept), lost, gone, why


_FOUND = ("hi", "lo", "before", "n")


def _contexts(folder: str, slices: int, flush: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            hi, lo = line_dedup._split([k for k, _ in held])
            return pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array([b for _, b in held], pa.int64()), pa.array(list(held.values()), pa.int64())], list(_FOUND))

        for batch in pieces(batches):
            pairs: list[tuple[bytes, int]] = []
            for text in as_bytes(batch.column("text")):
                own: dict[bytes, int] = {}
                for key, before in zip(*short_keys(text)):
                    own.setdefault(key, before)  # a document counts once, by the first place of the line
                own.pop(b"", None)
                pairs.extend(own.items())
            if pairs:
                hit = line_dedup._suspected(folder, slices, *line_dedup._split([k for k, _ in pairs]))
                held.update(pairs[k] for k in np.flatnonzero(hit))
            if len(held) >= flush:
                yield send()
                held.clear()
        if held:
            yield send()

    return run


def count_boilerplate(rows: DataFrame, min_docs: int) -> tuple[str, int]:
    """Counts short lines over all documents; (folder of the keys that are boilerplate, their slices)."""
    folder, slices = store.new_dir(rows.sparkSession, "boilerplate"), store.slices_for(rows, SLICE_BYTES)
    line_dedup.find_suspects(rows, lambda text: short_keys(text)[0], folder, slices)
    found = rows.select("text").mapInArrow(_contexts(folder, slices), "hi long, lo long, before long, n long")
    found = found.groupBy("hi", "lo", "before").agg(F.sum("n").alias("n")).groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("lines"))
    line_dedup.write_keys(found.filter((F.col("n") >= min_docs) & (2 * F.col("lines") >= F.col("n"))).select("hi", "lo", F.lit(0).cast("long").alias("first")), folder, slices)
    return folder, slices


def _judge(names: list[str], min_words: int, max_repeat: int, max_symbols: float, max_lost: float, counted: tuple[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, texts = [], as_bytes(batch.column("text"))
            keys = [short_keys(text)[0] for text in texts]
            short = [k for own in keys for k in own if k]
            known = dict(zip(short, line_dedup._confirmed(*counted, *line_dedup._split(short))[0].tolist())) if short else {}
            for text, own in zip(texts, keys):
                n, chars, symbols, dup, repeat = base_stats(text)
                failed = n < min_words or 100 * repeat > max_repeat * n
                out, lost, gone, why = clean(text, max_symbols, [known.get(k, False) for k in own]) if text else ("", 0, 0, {})
                reason = max(why, key=lambda k: (why[k], k)) if why else None
                rows.append((n, chars, symbols, dup, repeat, failed, not failed and gone <= max_lost * chars, lost, gone, reason, out.encode()))
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
            made = {c: pa.array(x, k) for c, x, k in zip(STATS, columns, kinds)} | {"text": as_text(list(columns[-1]))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return run


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_lines", "lost_chars", "main_reason")
_KINDS = ("long",) * 5 + ("boolean",) * 2 + ("long",) * 2 + ("string",)


def clean_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, max_symbols: float = 0.25, max_lost: float = 0.5, min_docs: int = 10, carry: list[str] | None = None) -> DataFrame:
    """Cleans each text by line and judges the document.

    Returns doc_id, text (without the failed lines), the columns of ``STATS`` and the carried ones, which may
    not have these names (``ValueError``). ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` percent of them in
    3-word windows that are found twice or more. A null or empty text has no words and fails. Each row
    stands for itself: null ids, ties and repeated rows stay; an empty table gives an empty result.
    """
    no_clash(carry, ("doc_id", "text", *STATS))
    rows = narrow(docs, id_col, text_col, carry)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | dict(zip(STATS, _KINDS))
    names = [*rows.columns, *STATS]
    return rows.mapInArrow(_judge(names, min_words, max_repeat, max_symbols, max_lost, count_boilerplate(rows, min_docs)), ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _stats_only(inner):
    keep = ["doc_id", *STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            yield batch.select(keep)

    return run


def judge_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, max_symbols: float = 0.25, max_lost: float = 0.5, min_docs: int = 10) -> DataFrame:
    """As ``clean_documents``, without the texts."""
    rows = narrow(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    inner = _judge(["doc_id", "text", *STATS], min_words, max_repeat, max_symbols, max_lost, count_boilerplate(rows, min_docs))
    return rows.mapInArrow(_stats_only(inner), ", ".join([f"doc_id {kind}", *(f"{c} {k}" for c, k in zip(STATS, _KINDS))]))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge_documents(documents(spark, sf_dir))
