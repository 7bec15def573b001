"""Every query of the library by name: ``QUERIES`` (spark, sf_dir) -> DataFrame, and ``ORACLE`` SQL text."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its SQL."""

    def keep(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return keep


from quern.plans import corpus, families, glyphs, laid, lenses, objects, runs, seams, shapes, stats, strings  # noqa: E402, F401
