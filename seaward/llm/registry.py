"""Queries of this subpackage and, where SQL can express them, the same as DuckDB SQL."""

from __future__ import annotations

import importlib

MODULES = ["media", "bpe", "packing", "warc", "quality", "toxicity", "simhash", "secrets", "neighbours", "licences", "mixing", "spelling", "periodic"]


def _collect(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"seaward.llm.{m}"), name)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
