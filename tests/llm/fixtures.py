"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, key string, n long"
BASE = "The quick brown fox jumps over the lazy dog near the old river bank. It was a bright day in April, and the clocks were striking."


def texts() -> list[str | None]:
    rng = random.Random(5)
    names = ["alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "Straße", "ñandú", "çava", "漢字"]
    out: list[str | None] = [None, "", "   ", "\n\n", "one", "One", "a b", BASE, BASE, BASE.upper(), BASE + " tail", "x " * 3000, "ab" * 4000]
    out += [" ".join(rng.choice(names) for _ in range(n)) for n in (3, 9, 10, 11, 60, 200)]
    shared = "All rights reserved. Shared footer line"
    for k in range(14):
        body = [" ".join(rng.choice(names) + str(rng.randrange(40)) for _ in range(12)) + "." for _ in range(4)]
        out.append("\n".join([*body[:2], f"  {shared} " if k % 2 else shared.lower(), *body[2:], "", "\t"]))
    out += ["Menu | Home | About\nReal sentence here, with enough words to stay in place.\nMenu | Home | About", "a\rb\x0bc\x0cd\te", "it's <|endoftext|> don't 'st \x1c \x85 ́é ǅ 12,345!"]
    out += ["It is 20°C today.", "©2024 all rights, £5 or 3×4", "¿Qué? «mot» §12 x² café·bar ¡Hola! a\u00adb 50£", "µm ªº ¼ été20 ÷ ĳ ŉa İstanbul"]
    words = [rng.choice(names) + str(rng.randrange(99)) for _ in range(120)]
    out.append(" ".join(words))
    for k in (3, 40, 80):
        out.append(" ".join([*words[:k], "changed", *words[k + 1 :]]))
    out.append(" ".join(words[:60] + words[70:]))
    return out


def documents(spark, base: list | None = None):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t), -1, "k", 7) for i, t in enumerate(base if base is not None else texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def folder(spark, path, base: list | None = None, **others) -> str:
    documents(spark, base).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    for name, df in others.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
