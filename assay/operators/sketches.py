"""A store of mergeable sketches: any window of a table's profile without a scan.

One scan of new rows gives, for every column and day, counts, NULLs, numeric
bounds and three sketches: HyperLogLog for distinct values, KLL for quantiles
and a heavy-hitter summary for top values.  A profile of a window merges the
sketches of its days, whose size does not depend on the rows behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import text
from assay.functions.exact import percent
from assay.operators.profile import profiled_fields

# log2 of the registers of a distinct count, size of a quantile sketch, values that a heavy-hitter summary tracks.
DISTINCT_LG, QUANTILE_K, TRACKED = 14, 400, 1024
# What the sizes above promise: relative error of a distinct count (one standard deviation) and error of a rank.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (DISTINCT_LG / 2), 0.01
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def sketch_columns(df: DataFrame, table_fqn: str, time_column: str) -> DataFrame:
    """One row for each column and day of ``df``, from one scan; rows without a time belong to day NULL.

    Values are compared as in the exact profile.  Long values keep a digest in
    the heavy-hitter summary, so a sketch's size is bounded by ``TRACKED``.
    """
    fields = profiled_fields(df)
    quoted = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    nothing = F.lit(None).cast("double")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = quoted(f)
        same = text.comparable(c, f.dataType)
        shown = same.cast("string") if not isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.to_json(c)
        shown = F.when(F.length(shown) > 64, F.concat(F.lit("sha256:"), F.sha2(shown, 256))).otherwise(shown)
        aggs += [F.count_if(c.isNull()).alias(f"nulls_{i}"), F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(same)), DISTINCT_LG).alias(f"distinct_{i}"),
                 F.call_function("approx_top_k_accumulate", shown, F.lit(TRACKED)).alias(f"top_{i}")]
        if isinstance(f.dataType, T.NumericType):
            number = text.comparable(c.cast("double"), T.DoubleType())
            aggs += [F.min(number).alias(f"min_{i}"), F.max(number).alias(f"max_{i}"), F.kll_sketch_agg_double(number, F.lit(QUANTILE_K)).alias(f"quantiles_{i}")]
    one = df.groupBy(F.to_date(F.col(time_column)).alias("day")).agg(*aggs)
    cells = []
    for i, f in enumerate(fields):
        numeric = isinstance(f.dataType, T.NumericType)
        cells.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col("rows").alias("row_count"), F.col(f"nulls_{i}").alias("null_count"),
            (F.col(f"min_{i}") if numeric else nothing).alias("min_num"), (F.col(f"max_{i}") if numeric else nothing).alias("max_num"), F.col(f"distinct_{i}").alias("distinct_sketch"),
            (F.col(f"quantiles_{i}") if numeric else F.lit(None).cast("binary")).alias("quantile_sketch"), F.col(f"top_{i}").alias("top_sketch")))
    return one.select(F.lit(table_fqn).alias("table_fqn"), "day", F.inline(F.array(*cells)))


def save_sketches(sketches: DataFrame, path: str) -> None:
    """Add to the store under ``path``; days of a table that are there already are replaced, so a run can be repeated."""
    days = sketches.repartition("table_fqn", "day")
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_fqn", "day").parquet(path)


def window_profile(store: DataFrame, since=None, until=None, top: int = 10) -> DataFrame:
    """One row for each table and column over the days ``since`` <= day < ``until`` (dates, or None for no bound), merged from ``store``.

    Counts, NULLs and bounds are exact.  ``distinct_count`` has a relative
    standard deviation of ``DISTINCT_ERROR``, ``quantiles`` a rank error of
    ``RANK_ERROR``; the counts in ``top_values`` are estimates too.  The days
    reach the scan as partitions.
    """
    if since is not None:
        store = store.filter(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        store = store.filter(F.col("day") < F.lit(until).cast("date"))
    return _merged(store, top)


def profile_since_last_run(store: DataFrame, history: DataFrame, top: int = 10) -> DataFrame:
    """As :func:`window_profile` from the day of each table's newest run in ``history`` (table_fqn, run_at) on; all days of a table without one."""
    last = history.groupBy("table_fqn").agg(F.to_date(F.max("run_at")).alias("_since"))
    return _merged(store.join(last, "table_fqn", "left").filter(F.col("_since").isNull() | (F.col("day") >= F.col("_since"))), top)


def _merged(days: DataFrame, top: int) -> DataFrame:
    combined = days.groupBy("table_fqn", "column_name", "data_type").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"),
        F.hll_union_agg("distinct_sketch").alias("_distinct"), F.kll_merge_agg_double("quantile_sketch").alias("_quantiles"),
        F.call_function("approx_top_k_combine", F.col("top_sketch"), F.lit(TRACKED)).alias("_top"))
    ranks = F.array(*[F.lit(q) for q in QUANTILES])
    filled = F.kll_sketch_get_n_double("_quantiles") > 0
    return combined.select(
        "table_fqn", "column_name", "data_type", "row_count", "null_count", percent(F.col("null_count"), F.col("row_count")).alias("null_pct"), "min_num", "max_num",
        F.hll_sketch_estimate("_distinct").alias("distinct_count"), F.when(filled, F.kll_sketch_get_quantile_double("_quantiles", ranks)).alias("quantiles"),
        F.call_function("approx_top_k_estimate", F.col("_top"), F.lit(top)).alias("top_values"))
