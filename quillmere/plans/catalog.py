"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("records", "texts", "metrics", "sets", "windows", "contracts", "chain", "decisions", "audits", "states", "files", "extras")


def _modules():
    for name in MODULES:
        try:
            yield import_module(f"quillmere.plans.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"quillmere.plans.{name}":
                raise


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
