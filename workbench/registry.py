"""Registry of queries and oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Register a derived relation for use by name in oracle SQL."""
    CTES[name] = sql.strip()


def oracle(body: str) -> str:
    """Prefix ``body`` with the derived relations it mentions, directly or not."""
    used: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", sql):
                used.add(name)
                visit(CTES[name])

    visit(body)
    if not used:
        return body.strip()
    parts = [f"{name} AS (\n{CTES[name]}\n)" for name in CTES if name in used]
    head = ",\n".join(parts)
    body = body.strip()
    if body[:15].upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a Spark query and, where it can be written in SQL, its twin."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratio(num: str, den: str, digits: int) -> str:
    """SQL twin of ``assay.functions.exact.ratio``."""
    s = 10**digits
    n, d = f"CAST({num} AS BIGINT)", f"GREATEST(CAST({den} AS BIGINT), 1)"
    return f"(SIGN({n}) * ((2 * {s} * ABS({n}) + {d}) // (2 * {d})) / {s}.0::DOUBLE + 0.0::DOUBLE)"


def percent(part: str, whole: str, digits: int = 2) -> str:
    return ratio(f"100 * CAST({part} AS BIGINT)", whole, digits)
