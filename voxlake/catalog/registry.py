"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxlake.catalog.bindings import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def checked_by(sql: str, **extra: str) -> str:
    """The SQL with the views it names in front; ``extra`` adds views of its own, in order. A view may name itself."""
    named = {**CTES, **extra}
    wanted: list[str] = []

    def names(name: str, text: str) -> bool:
        return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) is not None

    def need(text: str, within: tuple[str, ...] = ()) -> None:
        for name in named:
            if name not in wanted and name not in within and names(name, text):
                need(named[name], (*within, name))
                wanted.append(name)

    need(sql)
    if not wanted:
        return sql.strip()
    views = ",\n".join(f"{name} AS (\n{named[name].strip()}\n)" for name in wanted)
    recursive = "RECURSIVE " if any(names(name, named[name]) for name in wanted) else ""
    return f"WITH {recursive}{views}\n{sql.strip()}"


def query(name: str, sql: str | None = None, **extra: str):
    """Register a function of ``Tables`` as a query, with its SQL where there is one."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = checked_by(sql, **extra)
        return build

    return add
