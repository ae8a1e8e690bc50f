"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfold.plans import cards, dealt, derived, entries, labels, ledger, memory, more, pages, parsing, scalars, sources, streams

MODULES = (dealt, scalars, ledger, derived, memory, cards, parsing, streams, more, entries, pages, sources, labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
