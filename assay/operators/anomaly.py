"""Anomaly detection against run history.

A history frame holds one row per run and table (or column).  ``latest_only``
scans keep eight runs per key, trimmed before the shuffle; scans of all past
runs look at each key month by month (see ``relational.trailing``).

Scores are compared after rounding to nine decimals: the exact value of a
whole-number baseline is then not lost to the last bit of a double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.exact import ratio, scaled
from assay.functions.severity import lookup, severity_rank
from assay.operators.relational import exists_flag, latest_per_key, merge_keyed, newest_values, trailing
from assay.session import cut_lineage

BASELINE_RUNS = 7
MIN_BASELINE = 3
SIGMA = 2
SIGMA_CRITICAL = 3

# Default thresholds (volume %, distribution %, freshness hours).
DEFAULT_VOL_PCT = 30.0
DEFAULT_DIST_PCT = 20.0
DEFAULT_FRESHNESS_HOURS = 24.0

# Label and intent per anomaly type.
TYPE_LABELS = {
    "VOLUME": ("Volume drop", "danger"),
    "VOLUME_DROP": ("Volume drop", "danger"),
    "DISTRIBUTION": ("Segment / drift", "warning"),
    "SEGMENT": ("Segment / drift", "warning"),
    "SOURCE": ("Source late", "warning"),
    "SOURCE_LATE": ("Source late", "warning"),
    "THRESHOLD": ("Threshold breach", "warning"),
    "FRESHNESS": ("Freshness gap", "warning"),
    "DUPLICATE": ("Duplicate surge", "danger"),
}

COLUMNS = ("anomaly_id", "connection_id", "detected_at", "layer", "table_fqn", "column_name", "anomaly_type",
           "description", "severity", "metric_value", "baseline_value", "deviation_pct", "status")


def type_label(anomaly_type: Column) -> Column:
    return lookup(anomaly_type, {k: v[0] for k, v in TYPE_LABELS.items()}, F.initcap(F.replace(anomaly_type, F.lit("_"), F.lit(" "))))


def type_intent(anomaly_type: Column) -> Column:
    return lookup(anomaly_type, {k: v[1] for k, v in TYPE_LABELS.items()}, "warning")


def with_thresholds(df: DataFrame, thresholds: DataFrame | None) -> DataFrame:
    """Thresholds of each connection, defaults where none are set."""
    names = {"vol_pct": DEFAULT_VOL_PCT, "dist_pct": DEFAULT_DIST_PCT, "freshness_hours": DEFAULT_FRESHNESS_HOURS}
    if thresholds is None:
        return df.withColumns({k: F.lit(v) for k, v in names.items()})
    joined = df.join(thresholds.select("connection_id", *names), "connection_id", "left")
    return joined.withColumns({k: F.coalesce(F.col(k).cast("double"), F.lit(v)) for k, v in names.items()})


def with_baseline(history: DataFrame, keys: Sequence[str], value: Column, latest_only: bool,
                  extra: dict | None = None) -> DataFrame:
    """Count, sum, mean and deviation of the up to seven runs before each run."""
    h = history.withColumn("_v", value)
    stats = {"_n": lambda w: F.count("_v").over(w), "_sum": lambda w: F.sum("_v").over(w),
             "_mean": lambda w: F.avg("_v").over(w), "_sd": lambda w: F.stddev_samp("_v").over(w), **(extra or {})}
    if latest_only:
        eight = latest_per_key(h, keys, [F.desc("run_at")], BASELINE_RUNS + 1, rank="_newest")
        w = Window.partitionBy(*keys).orderBy("run_at").rowsBetween(-BASELINE_RUNS, -1)
        h = eight.withColumns({k: make(w) for k, make in stats.items()}).filter(F.col("_newest") == 1).drop("_newest")
    else:
        h = trailing(h, keys, "run_at", BASELINE_RUNS, stats)
    return h.filter(F.col("_n") >= MIN_BASELINE)


def sigmas(floor: float) -> Column:
    """Distance from the baseline in deviations; ``floor`` stands in for a deviation of 0."""
    sd = F.when(F.col("_sd") == 0, F.lit(float(floor))).otherwise(F.col("_sd"))
    return F.round((F.col("_v") - F.col("_mean")) / sd, 9)


def _percent_off() -> Column:
    """Deviation of a whole number from its whole-number baseline, floor 1 on the mean."""
    off = (F.col("_n") * F.col("_v") - F.col("_sum")) * 100
    return ratio(off, F.greatest(F.col("_sum"), F.col("_n")), 1)


def _whole(x: Column) -> Column:
    return F.format_number(F.round(x, 0).cast("bigint"), 0)


def _record(fired: DataFrame, anomaly_type: str, column: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    column = F.lit(None).cast("string") if column is None else column
    key = F.concat_ws("|", F.lit(anomaly_type), "connection_id", "table_fqn", F.coalesce(column, F.lit("")),
                      F.date_format("run_at", "yyyy-MM-dd HH:mm:ss"))
    return (fired.withColumn("column_name", column)
            .withColumn("anomaly_id", F.sha2(key, 256))
            .withColumn("anomaly_type", F.lit(anomaly_type))
            .withColumn("detected_at", F.col("run_at"))
            .withColumn("status", F.lit("open"))
            .select(*COLUMNS, *keep))


def detect_volume(history: DataFrame, thresholds: DataFrame | None = None, latest_only: bool = True,
                  keep: Sequence[str] = ()) -> DataFrame:
    """A1: row count off its baseline by two deviations and by ``vol_pct`` percent.

    ``keep`` names further history columns to carry along.
    """
    h = with_baseline(history, ["connection_id", "table_fqn"], F.col("row_count").cast("bigint"), latest_only)
    z, pct = sigmas(1), _percent_off()
    h = with_thresholds(h.withColumn("_z", z).withColumn("deviation_pct", pct), thresholds)
    hit = h.filter((F.abs("_z") >= SIGMA) & (F.abs("deviation_pct") >= F.col("vol_pct")))
    way = F.when(F.col("_v") < F.col("_mean"), "Fewer").otherwise("More")
    text = F.concat(way, F.lit(" rows than usual: "), F.format_number("_v", 0), F.lit(" where recent runs had about "),
                    F.format_number(F.floor("_mean"), 0), F.lit(", "), _whole(F.abs("deviation_pct")), F.lit("% off"))
    return _record(hit.withColumn("description", text)
                   .withColumn("severity", F.when(F.abs("_z") > SIGMA_CRITICAL, "CRITICAL").otherwise("HIGH"))
                   .withColumn("metric_value", F.col("_v").cast("double"))
                   .withColumn("baseline_value", ratio(F.col("_sum"), F.col("_n"), 0)), "VOLUME", keep=keep)


def detect_null_rate(history: DataFrame, thresholds: DataFrame | None = None, latest_only: bool = True) -> DataFrame:
    """A2: NULL rate above its baseline; a missing rate counts as 0, a rate of 0 never fires."""
    hundredths = scaled(F.coalesce("null_pct", F.lit(0.0)), 2)
    h = with_baseline(history, ["connection_id", "table_fqn", "column_name"], hundredths, latest_only)
    h = h.withColumn("_z", sigmas(50)).withColumn("deviation_pct", _percent_off())
    hit = with_thresholds(h, thresholds).filter(
        (F.col("_v") > 0) & (F.col("_z") >= SIGMA) & (F.col("deviation_pct") >= F.col("dist_pct")))
    metric, mean = F.col("_v") / 100.0, F.col("_mean") / 100.0
    text = F.concat(F.lit("NULL share of "), "column_name", F.lit(": "), F.format_number(metric, 1), F.lit("%, recent runs had "),
                    F.format_number(mean, 1), F.lit("%, a rise by "), _whole(F.col("deviation_pct")), F.lit("%"))
    return _record(hit.withColumn("description", text)
                   .withColumn("severity", F.when(F.col("_v") > 1000, "CRITICAL").otherwise("HIGH"))
                   .withColumn("metric_value", metric)
                   .withColumn("baseline_value", ratio(F.col("_sum"), F.col("_n") * 100, 2)),
                   "DISTRIBUTION", F.col("column_name"))


def detect_metric(history: DataFrame, thresholds: DataFrame | None = None, latest_only: bool = True) -> DataFrame:
    """A3: column mean off its baseline; runs without a mean are skipped."""
    known = history.filter(F.col("mean_value").isNotNull())
    # Sums of decimals do not depend on their order; doubles would round differently from run to run.
    exact = F.col("mean_value").cast("decimal(24,6)")
    h = with_baseline(known, ["connection_id", "table_fqn", "column_name"], F.col("mean_value").cast("double"), latest_only,
                      {"_total": lambda w: F.sum(exact).over(w)})
    n, total = F.col("_n"), F.col("_total")
    off = (exact * n - total) * 100 / F.greatest(F.abs(total), n)
    h = with_thresholds(h.withColumn("_z", sigmas(1)).withColumn("deviation_pct", F.round(off, 1).cast("double")), thresholds)
    hit = h.filter((F.abs("_z") >= SIGMA) & (F.abs("deviation_pct") >= F.col("vol_pct")))
    way = F.when(F.col("_v") < F.col("_mean"), "fell").otherwise("rose")
    text = F.concat(F.lit("Mean of "), "column_name", F.lit(" "), way, F.lit(" by "), _whole(F.abs("deviation_pct")), F.lit("%, from about "),
                    _whole(F.col("_mean")), F.lit(" in recent runs to "), _whole(F.col("_v")))
    return _record(hit.withColumn("description", text)
                   .withColumn("severity", F.when(F.abs("_z") > SIGMA_CRITICAL, "CRITICAL").otherwise("HIGH"))
                   .withColumn("metric_value", F.col("_v"))
                   .withColumn("baseline_value", F.round(F.col("_total") / F.col("_n"), 2).cast("double")), "THRESHOLD", F.col("column_name"))


def detect_freshness(last_seen: DataFrame, as_of: Column, thresholds: DataFrame | None = None) -> DataFrame:
    """A4: tables not seen for longer than their SLA.

    ``last_seen`` has (connection_id, table_fqn, layer, run_at); the newest
    ``run_at`` per table counts.
    """
    newest = last_seen.groupBy("connection_id", "table_fqn").agg(
        F.max_by("layer", "run_at").alias("layer"), F.max("run_at").alias("run_at"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(F.col("run_at").cast("timestamp"))) / 3600.0
    h = with_thresholds(newest.withColumn("_age", age), thresholds)
    sla = F.col("freshness_hours")
    hit = h.filter(F.col("run_at").isNotNull() & (sla > 0) & (F.col("_age") > sla))
    text = F.concat(F.lit("Not seen since "), F.date_format("run_at", "yyyy-MM-dd HH:mm"), F.lit(", that is "), _whole(F.col("_age")),
                    F.lit(" hours; agreed are "), _whole(sla))
    return _record(hit.withColumn("description", text)
                   .withColumn("severity", F.when(F.col("_age") > sla * 2, "HIGH").otherwise("MEDIUM"))
                   .withColumn("metric_value", F.round("_age", 1))
                   .withColumn("baseline_value", sla)
                   .withColumn("deviation_pct", F.round((F.col("_age") - sla) / sla * 100, 1)), "FRESHNESS")


def scan(reports: DataFrame, column_stats: DataFrame, as_of: Column, thresholds: DataFrame | None = None) -> DataFrame:
    """A5: every detector over every table, as one plan."""
    return (detect_freshness(reports, as_of, thresholds)
            .unionByName(detect_volume(reports, thresholds))
            .unionByName(detect_null_rate(column_stats, thresholds))
            .unionByName(detect_metric(column_stats, thresholds)))


def segment_history(rows: DataFrame, segment: str, ts: str, unit: str = "day") -> DataFrame:
    """Rows per segment and period, with 0 where a segment is silent.

    The calendar runs from the first to the last period of the data, so its
    size is periods times segments, independent of the number of rows.  Rows
    are counted once and the counts kept in the shared folder.
    """
    counted = cut_lineage(rows.groupBy(F.col(segment).cast("string").alias("segment"), F.date_trunc(unit, F.col(ts)).alias("run_at")).agg(
        F.count(F.lit(1)).alias("rows")))
    bounds = counted.agg(F.struct(F.min("run_at").alias("lo"), F.max("run_at").alias("hi")).alias("b")).scalar()
    periods = F.explode(F.sequence(bounds["lo"], bounds["hi"], F.expr(f"INTERVAL 1 {unit.upper()}")))
    calendar = counted.select("segment").distinct().select("segment", periods.alias("run_at"))
    filled = calendar.join(counted, ["segment", "run_at"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    totals = counted.groupBy("run_at").agg(F.sum("rows").alias("all_rows"))
    return filled.join(totals, "run_at", "left").withColumn("all_rows", F.coalesce("all_rows", F.lit(0)))


def detect_segment(history: DataFrame, connection_id: str, table_fqn: str, layer: str,
                   thresholds: DataFrame | None = None, latest_only: bool = True) -> DataFrame:
    """A6 (extension): A1 per segment, with the segment's share of the period."""
    h = history.withColumns({"connection_id": F.lit(connection_id), "table_fqn": F.concat(F.lit(table_fqn + "/"), "segment"),
                             "layer": F.lit(layer), "row_count": F.col("rows"),
                             "share_pct": ratio(F.col("rows") * 100, F.col("all_rows"), 2)})
    hits = detect_volume(h, thresholds, latest_only, keep=("segment", "share_pct"))
    return hits.withColumn("anomaly_type", F.lit("SEGMENT"))


# --- the inbox ---------------------------------------------------------------

_OPEN_KEY = ["connection_id", "table_fqn", "column_key", "anomaly_type"]


def save_anomalies(existing: DataFrame, detected: DataFrame) -> DataFrame:
    """Refresh the open anomaly of the same place and type, insert the others.

    The result is the new log with ``is_new`` on inserted rows; closed
    anomalies are never touched.
    """
    keyed = lambda df: df.withColumn("column_key", F.coalesce("column_name", F.lit("")))
    is_open = F.col("status") == "open"
    newest = latest_per_key(keyed(detected), _OPEN_KEY, [F.desc("detected_at"), F.asc("anomaly_id")])
    open_rows = keyed(existing.filter(is_open)).withColumn("is_new", F.lit(False))
    merged = merge_keyed(open_rows, newest.withColumn("is_new", F.lit(True)), _OPEN_KEY, set_columns=[
        "detected_at", "description", "severity", "metric_value", "baseline_value", "deviation_pct"])
    closed = existing.filter(~is_open | F.col("status").isNull()).withColumn("is_new", F.lit(False))
    return merged.drop("column_key").unionByName(closed)


def inbox(anomalies: DataFrame, reports: DataFrame, fingerprints: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """Open anomalies, the last seven row counts of VOLUME ones, and a known-incident flag."""
    open_rows = anomalies.filter("status = 'open'")
    if connections is not None:
        open_rows = open_rows.join(connections.select("connection_id"), "connection_id", "left_semi")
    keys = ["connection_id", "table_fqn"]
    counts = newest_values(reports, keys, [F.desc("run_at")], "run_at", "row_count", 7, "history_values")
    known = fingerprints.select("connection_id", F.col("related_table").alias("table_fqn"))
    flagged = exists_flag(open_rows.join(counts, keys, "left"), known, keys, "has_fingerprint")
    volume_only = F.when(F.col("anomaly_type") == "VOLUME", F.col("history_values"))
    return flagged.withColumn("history_values", volume_only).orderBy(F.desc("detected_at"), "anomaly_id")


def fingerprints_from(acknowledged: DataFrame, known: DataFrame, as_of: Column) -> DataFrame:
    """A10: incidents to remember: acknowledged with a note that the library lacks.

    ``acknowledged`` is the anomaly frame plus ``ack_note`` and ``acknowledged_by``.
    """
    note = F.trim("ack_note")
    noted = acknowledged.filter(F.coalesce(note, F.lit("")) != "").withColumn("resolution", note)
    noted = noted.withColumn("related_table", F.col("table_fqn"))
    keys = ["connection_id", "related_table", "resolution"]
    first = latest_per_key(noted, keys, [F.asc("detected_at"), F.asc("anomaly_id")])
    fresh = first.join(known.select(*keys).distinct(), keys, "left_anti")
    cause = F.when(F.col("description").isNull(), F.col("anomaly_type")).otherwise(
        F.concat_ws(": ", "anomaly_type", "description"))
    return fresh.select(
        "connection_id", F.lit(100).alias("similarity_pct"), as_of.cast("date").alias("incident_date"),
        F.date_format(as_of, "EEEE").alias("incident_day"), cause.alias("root_cause"), "resolution",
        F.col("acknowledged_by").alias("resolved_by"), "related_table")


def fingerprint_list(fingerprints: DataFrame) -> DataFrame:
    """The library by similarity."""
    return fingerprints.orderBy(F.desc("similarity_pct"), F.desc("incident_date"), "related_table", "resolution")


# --- A12: text ---------------------------------------------------------------

def explain(anomalies: DataFrame) -> DataFrame:
    """Where, why and next actions of each anomaly, from fixed sentences."""
    kind = F.coalesce("anomaly_type", F.lit("DATA"))
    table, layer = F.coalesce("table_fqn", F.lit("the table")), F.coalesce("layer", F.lit("UNKNOWN"))
    sev = F.coalesce("severity", F.lit("HIGH"))
    sign = F.when(F.col("deviation_pct") >= 0, "+").otherwise("-")
    dev = F.when(F.col("deviation_pct").isNull(), "significantly").otherwise(
        F.concat(sign, F.format_number(F.abs("deviation_pct"), 1), F.lit("%")))
    place = F.concat(table, F.lit(" ("), layer, F.lit(" layer)"))
    why = (F.when(kind == "VOLUME", F.concat(
               F.lit("A "), F.lower(sev), F.lit(" change in the volume of "), place, F.lit(", "), dev,
               F.lit(" against its baseline: consumers may be reading incomplete or stale data.")))
           .when(kind == "DISTRIBUTION", F.concat(
               F.lit("Columns of "), place, F.lit(" moved "), dev,
               F.lit(" from their baseline: decisions and models built on them may be biased.")))
           .otherwise(F.concat(
               F.lit("A "), F.lower(sev), F.lit(" "), F.lower(kind), F.lit(" breach on "), place, F.lit(", "), dev,
               F.lit(" deviation: reports and pipelines downstream may be affected."))))
    actions = (F.when(kind == "VOLUME", F.array(
                   F.concat(F.lit("Check the last load of "), table), F.concat(F.lit("Compare source counts with the "), layer, F.lit(" table")),
                   F.lit("Pause dependent reports until the cause is known"), F.lit("Tell the pipeline owner and the steward")))
               .when(kind == "DISTRIBUTION", F.array(
                   F.concat(F.lit("Profile the columns of "), table), F.lit("Compare with the last seven runs"),
                   F.lit("Look for a schema or process change at the source"), F.lit("Re-validate models that use the columns")))
               .otherwise(F.array(
                   F.concat(F.lit("Look for recent changes to "), table), F.lit("Check that the threshold is right"),
                   F.lit("Tell the data and report owners"), F.lit("Record the finding and open a task"))))
    what = F.coalesce("description", F.concat(kind, F.lit(" anomaly on "), table, F.lit(": "), dev, F.lit(" off its baseline.")))
    return anomalies.select(
        "anomaly_id", what.alias("what_happened"), F.concat_ws(" / ", layer, table).alias("where_found"),
        F.coalesce(F.date_format("detected_at", "MMM dd, yyyy HH:mm 'UTC'"), F.lit("unknown")).alias("first_seen"),
        why.alias("why_it_matters"), F.concat(F.lit("Severity: "), sev).alias("how_bad"), actions.alias("recommended_actions"))


def by_severity(anomalies: DataFrame) -> list[Column]:
    """Total order used by every ranked anomaly list."""
    return [severity_rank(F.col("severity")), F.desc("detected_at"), F.asc("anomaly_id")]
