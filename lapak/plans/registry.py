"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapak.plans.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix a SELECT with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ",\n".join(f"{name} AS ({SQL_VIEWS[name].strip()})" for name in needed)
    text = body.strip()
    if not head:
        return text
    if text.upper().startswith("WITH "):
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"


def query(name: str, oracle: str | None = None):
    """Register a query ``fn(t) -> DataFrame`` over the views of ``Tables``, with its SQL when there is one."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add
