"""Questions about past profiling runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.exact import ratio, scaled
from assay.functions.severity import severity_rank
from assay.operators.relational import changed_columns, latest_per_key, with_previous


def schema_drift(previous: DataFrame, current: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Added, dropped and retyped columns, per table if ``keys`` name it; types compare in upper case."""
    return changed_columns(previous, current, keys)


def drift_summary(drift: DataFrame) -> DataFrame:
    """P17 as one row with sorted name lists; no row of ``drift`` means no drift."""
    def names(kind):
        return F.sort_array(F.collect_list(F.when(F.col("change") == kind, F.col("column_name"))))
    return drift.agg((F.count(F.lit(1)) > 0).alias("has_drift"), names("added").alias("added"),
                     names("dropped").alias("dropped"), names("type_changed").alias("type_changed"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """Newest report of each table."""
    return latest_per_key(reports, ["connection_id", "table_fqn"], [F.desc("run_at"), F.desc("report_id")])


def latest_risks(reports: DataFrame, risks: DataFrame) -> DataFrame:
    """Risks of each table's newest report, numbered by ``place`` from the most severe on."""
    key = ["connection_id", "table_fqn"]
    own = risks.join(latest_reports(reports).select(*key, "report_id"), [*key, "report_id"], "left_semi")
    return latest_per_key(own, key, [severity_rank(F.col("severity")), F.asc("risk_type"), F.asc("column_name")], None, rank="place")


def report_history(reports: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` runs of each table with changes to the run before."""
    newest = latest_per_key(reports, ["connection_id", "table_fqn"], [F.desc("run_at")], limit)
    h = with_previous(newest, ["connection_id", "table_fqn"], [F.asc("run_at")], ["row_count", "quality_score"])
    prev, delta = F.col("prev_row_count"), F.col("row_count") - F.col("prev_row_count")
    score_delta = ratio(scaled(F.col("quality_score"), 1) - scaled(F.col("prev_quality_score"), 1), F.lit(10), 1)
    return (h.withColumn("score_delta", score_delta)
            .withColumn("row_count_delta", delta)
            .withColumn("row_count_delta_pct", F.when(prev != 0, ratio(delta * 100, prev, 1))))


def table_context(tables: DataFrame, rules: DataFrame, anomalies: DataFrame, tasks: DataFrame) -> DataFrame:
    """P20: what else is known about each connection's table: rules, open anomalies, open tasks."""
    key = ["connection_id", "table_fqn"]
    r = rules.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rules_total"),
        F.count_if(F.col("status").isin("approved", "active")).alias("rules_active"),
        F.count_distinct("column_name").alias("columns_with_rules"))
    a = anomalies.filter("status = 'open'").groupBy(*key).agg(F.count(F.lit(1)).alias("open_anomalies"))
    t = tasks.filter("status IN ('open', 'in_progress')").groupBy(*key).agg(F.count(F.lit(1)).alias("open_tasks"))
    joined = tables.join(r, key, "left").join(a, key, "left").join(t, key, "left")
    return joined.fillna(0, ["rules_total", "rules_active", "columns_with_rules", "open_anomalies", "open_tasks"])


def rule_coverage(rules: DataFrame) -> DataFrame:
    """P20: rules per connection, table and column, table-level rules under one label."""
    column = F.coalesce("column_name", F.lit("(table-level)"))
    return rules.groupBy("connection_id", "table_fqn", column.alias("column_name")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("approved", "active")).alias("active"))


def top_open_anomalies(anomalies: DataFrame, n: int | None = 5) -> DataFrame:
    """P20: each table's most severe open anomalies; None lists all."""
    order = [severity_rank(F.col("severity")), F.desc("detected_at"), F.asc("anomaly_id")]
    return latest_per_key(anomalies.filter("status = 'open'"), ["connection_id", "table_fqn"], order, n, rank="rank")
