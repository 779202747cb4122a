"""Scan all tables against their history and refresh the inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators import anomaly
from assay.session import cut_lineage


def scan_and_save(log: DataFrame, reports: DataFrame, column_stats: DataFrame, as_of: Column,
                  thresholds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The new anomaly log and, per connection, how many anomalies are new."""
    found = cut_lineage(anomaly.scan(reports, column_stats, as_of, thresholds))
    saved = cut_lineage(anomaly.save_anomalies(log, found))
    return saved, saved.filter("is_new").groupBy("connection_id").agg(F.count(F.lit(1)).alias("new_anomalies"))
