"""The whole jobs end to end."""

import datetime as dt

from pyspark.sql import functions as F

from assay.operators import anomaly
from assay.plans.anomaly_scan import scan_and_save
from assay.plans.profile_table import ForeignKey, profile_table
from assay.plans.rule_run import run_scope


def test_profile_table(spark):
    rows = [(1, 10, "a", dt.datetime(2024, 1, 1)), (2, 11, None, dt.datetime(2024, 1, 2)), (2, 99, None, dt.datetime(2024, 1, 3)),
            (3, 10, "b", dt.datetime(2024, 1, 4)), (4, 10, "c", dt.datetime(2024, 1, 5))]
    orders = spark.createDataFrame(rows, "order_id int, customer_id int, note string, at timestamp")
    customers = spark.createDataFrame([(10,), (11,)], "id int")
    fk = ForeignKey(["customer_id"], customers, ["id"], "main.customers")
    p = profile_table(orders, foreign_keys=[fk])
    assert {(r.column_name, r.risk_type, r.severity) for r in p.risks.collect()} == {
        ("note", "NULL_HIGH", "CRITICAL"), ("order_id", "DUPLICATE_KEY", "CRITICAL"), ("customer_id", "REFERENTIAL_ORPHAN", "CRITICAL")}
    s = p.scores.first()
    assert (s.row_count, s.completeness_score, s.uniqueness_score, s.consistency_score) == (5, 90.0, 60.0, 100.0)
    assert s.quality_score == round(90 * 0.35 + 60 * 0.25 + 25 + 15, 1) and not p.is_partial_scan
    part = profile_table(orders, partition_column="AT", window_from="2024-01-02", window_to="2024-01-04", keys=[["order_id", "note"]])
    assert part.is_partial_scan and part.scores.first().row_count == 2


def test_rule_run(spark):
    t = spark.createDataFrame([(1,), (None,)], "x int")
    base = [("ok", "x IS NOT NULL", "approved", None), ("draft", "x > 1", "draft", None), ("bad", "y > 1", "active", None)]
    r = spark.createDataFrame([("c", k, k, "gold.t", "GOLD", e, "HIGH", False, s, u) for k, e, s, u in base],
                              "connection_id string, rule_id string, rule_name string, table_fqn string, layer string, rule_expression string, "
                              "severity string, is_cde_rule boolean, status string, snooze_until timestamp")
    nodes = spark.createDataFrame([("c", "gold.t", "ok"), ("c", "gold.u", "warn")], "connection_id string, external_id string, health_status string")
    run = run_scope({"gold.t": t}, r, connection_id="c", run_id="r1", as_of=F.lit("2024-01-31").cast("timestamp"), nodes=nodes)
    s = run.summary.first()
    assert (s.total_rules, s.passed, s.failed, s.errors, s.overall_quality_score) == (2, 0, 1, 1, 25.0)
    assert {n.external_id: n.health_status for n in run.nodes.collect()} == {"gold.t": "fail", "gold.u": "warn"}


def test_scan_and_save(spark):
    day = dt.datetime(2024, 3, 1)
    counts = [4320, 4200, 4380, 4250, 4300, 450]
    reports = spark.createDataFrame([("c", "t", "RAW", day + dt.timedelta(days=i), n) for i, n in enumerate(counts)],
                                    "connection_id string, table_fqn string, layer string, run_at timestamp, row_count bigint")
    stats = spark.createDataFrame([], "connection_id string, table_fqn string, layer string, run_at timestamp, column_name string, null_pct double, mean_value double")
    empty = anomaly.detect_volume(reports.limit(0))
    as_of = F.lit("2024-03-06 12:00:00").cast("timestamp")
    log, new = scan_and_save(empty, reports, stats, as_of)
    assert new.first().new_anomalies == 1
    again, none = scan_and_save(log.drop("is_new"), reports, stats, as_of)
    assert again.count() == 1 and none.count() == 0
