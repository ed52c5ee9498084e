"""SQL whose columns have the types of a Spark query."""

from __future__ import annotations


def typed(sql: str, types: dict[str, str]) -> str:
    """``sql`` with some columns cast."""
    return "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items()) + f") FROM ({sql})"
