"""Markdown of small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a report shows at most; a larger table is an error, not a cut.
MOST_ROWS = 1000


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.2f}%"


def decimal(x: float | None, places: int = 4) -> str:
    return "n/a" if x is None else f"{x:.{places}f}"


def signed(x: float | None, places: int = 4) -> str:
    return "n/a" if x is None else f"{x:+.{places}f}"


def interval(low: float, high: float, places: int = 2) -> str:
    return f"[{low:.{places}f}, {high:.{places}f}]"


def markdown(df: DataFrame, order: list[str]) -> str:
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report")
    cell = lambda v: decimal(v) if isinstance(v, float) else "n/a" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
