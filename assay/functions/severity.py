"""Fixed vocabularies and the expressions that rank them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities, best to worst order used by every ranked list.
SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# Medallion layers in processing order.
LAYERS = ("RAW", "BRONZE", "SILVER", "GOLD")
UNKNOWN_LAYER = "UNKNOWN"

# Thresholds shared by several operators.
LAYER_HEALTHY_SCORE = 85
LAYER_WARN_SCORE = 65
NODE_OK_SCORE = 80
NODE_WARN_SCORE = 60


def lookup(value: Column, mapping: dict, default) -> Column:
    """A small constant mapping as one CASE expression."""
    items = list(mapping.items())
    expr = reduce(
        lambda acc, kv: acc.when(value == F.lit(kv[0]), F.lit(kv[1])),
        items[1:],
        F.when(value == F.lit(items[0][0]), F.lit(items[0][1])),
    )
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def severity_rank(severity: Column, unknown: int = 3) -> Column:
    """0 for CRITICAL up to 3 for LOW; anything else ranks ``unknown``."""
    return lookup(severity, {s: i for i, s in enumerate(SEVERITY_ORDER)}, unknown)


def layer_rank(layer: Column, unknown: int = 99) -> Column:
    return lookup(layer, {s: i for i, s in enumerate(LAYERS)}, unknown)


def node_health(score: Column) -> Column:
    """Lineage-node health of a quality score; unprofiled tables are neutral."""
    return (
        F.when(score.isNull() | (score >= NODE_OK_SCORE), "ok")
        .when(score >= NODE_WARN_SCORE, "warn")
        .otherwise("fail")
    )


def layer_status(score: Column) -> Column:
    return (
        F.when(score >= LAYER_HEALTHY_SCORE, "HEALTHY")
        .when(score >= LAYER_WARN_SCORE, "WARN")
        .otherwise("ISSUES")
    )


def first_filled(*cols: Column, default: str) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(default))
