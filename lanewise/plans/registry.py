"""Name → query and name → oracle."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def r6(expr: str, digits: int = 6) -> str:
    """SQL twin of functions.numeric.r6."""
    return f"(round_even(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
