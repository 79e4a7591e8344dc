"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("pages", "encoding", "text", "tables", "listing", "models", "streams", "scalars")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"queries.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return dict(sorted(_merged("QUERIES").items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(_merged("SQL").items()))
