"""Single evaluation of costly expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Catalyst merges neighbouring projections and then copies an expression to every place that uses it, which repeats
    JSON parsing or higher-order functions many times. A one-row generator keeps the projections apart.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(c) for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(made)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
