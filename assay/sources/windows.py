"""half-open time windows that reach the parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Window presets in hours.
PRESET_HOURS = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24}


def find_column(df: DataFrame, name: str | None) -> str | None:
    """Column of ``df`` called ``name`` in any case."""
    return {c.lower(): c for c in df.columns}.get(name.lower()) if name else None


def window_condition(df: DataFrame, column: str | None, lo=None, hi=None) -> Column | None:
    """Condition ``lo <= column < hi``, or None for an unknown column or no bound.

    Bounds are cast to the column's own type, which keeps them pushable.
    """
    actual = find_column(df, column)
    if actual is None or (lo is None and hi is None):
        return None
    dtype = df.schema[actual].dataType
    parts = []
    if lo is not None:
        parts.append(F.col(actual) >= F.lit(lo).cast(dtype))
    if hi is not None:
        parts.append(F.col(actual) < F.lit(hi).cast(dtype))
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def window_filter(df: DataFrame, column: str | None, lo=None, hi=None) -> tuple[DataFrame, bool]:
    """``df`` inside the window and whether the scan is partial."""
    cond = window_condition(df, column, lo, hi)
    return (df, False) if cond is None else (df.filter(cond), True)


def preset_filter(df: DataFrame, column: str, preset: str, as_of: str, history: DataFrame | None = None) -> DataFrame:
    """Window presets 24h, 7d, 30d and since_last, ending at ``as_of``.

    ``since_last`` starts at the newest ``run_at`` of ``history``; without a
    former run it scans everything up to ``as_of``.
    """
    actual = find_column(df, column)
    if actual is None:
        return df
    dtype = df.schema[actual].dataType
    end = F.lit(as_of).cast(dtype)
    if preset == "since_last":
        start = history.agg(F.max("run_at").cast(dtype).alias("start")).scalar() if history is not None else F.lit(None)
        return df.filter((F.col(actual) < end) & (start.isNull() | (F.col(actual) >= start)))
    start = (F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(PRESET_HOURS[preset]))).cast(dtype)
    return df.filter((F.col(actual) >= start) & (F.col(actual) < end))
