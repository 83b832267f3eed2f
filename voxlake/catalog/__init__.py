"""Every operator bound to the given tables, with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["workflow", "speech", "times", "texts", "signals", "embeddings", "live"]


def _load() -> None:
    for family in FAMILIES:
        import_module(f"voxlake.catalog.{family}")


def all_queries():
    from voxlake.catalog.registry import QUERIES

    _load()
    return dict(sorted(QUERIES.items()))


def all_oracles():
    from voxlake.catalog.registry import ORACLES

    _load()
    return dict(sorted(ORACLES.items()))
