"""Registration of queries and their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """A named DuckDB building block, usable from any oracle text."""
    CTES[name] = body.strip()


def with_ctes(sql: str) -> str:
    """Put the WITH clause in front that `sql` needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_body(name)

    def visit_body(name: str) -> None:
        text = CTES[name]
        for dep in CTES:
            if dep != name and dep not in order and re.search(rf"\b{dep}\b", text):
                visit_body(dep)
        if name not in order:
            order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    # materialized: a block that several others read is computed once
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    body = sql.strip()
    if body.startswith("WITH "):  # the query brings its own CTEs
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # driver timestamps carry no zone; every conversion reads them as UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def oracle_texts() -> dict[str, str]:
    return {k: with_ctes(v) for k, v in ORACLES.items()}
