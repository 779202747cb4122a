"""Connections with equal table names, rule ids and different runs stay apart."""

import datetime as dt

from pyspark.sql import functions as F

from assay.operators import intel, lineage, rule_results, trust

DAY = dt.datetime(2024, 1, 1)


def results(spark):
    rows = []
    for conn, days in (("a", (1, 2)), ("b", (1, 3))):
        for day in days:
            bad = (conn, day) in (("a", 2), ("b", 1))
            rows.append((conn, f"{conn}{day}", f"{conn}{day}/r", "r", "", "s.t", "GOLD", "FAIL" if bad else "PASS", "CRITICAL", 50.0 if bad else 0.0, 40.0 if bad else 100.0, False, DAY + dt.timedelta(days=day)))
    return spark.createDataFrame(rows, "connection_id string, run_id string, result_id string, rule_id string, rule_name string, table_fqn string, layer string, status string, "
                                       "severity string, fail_pct double, quality_score double, is_expected_failure boolean, run_timestamp timestamp").withColumn("failed_records", F.lit(5))


def reports(spark):
    rows = [(c, f"{c}{d}", "s.t", "GOLD", q, 100, DAY + dt.timedelta(days=d)) for c, d, q in (("a", 1, 50.0), ("a", 2, 60.0), ("b", 1, 90.0), ("b", 2, 70.0))]
    return spark.createDataFrame(rows, "connection_id string, report_id string, table_fqn string, layer string, quality_score double, row_count int, run_at timestamp")


def anomalies(spark, n=8):
    rows = [("a", f"x{i}", "s.t", None, "VOLUME", "CRITICAL", "open", DAY, f"no {i}") for i in range(n)]
    return spark.createDataFrame(rows, "connection_id string, anomaly_id string, table_fqn string, column_name string, anomaly_type string, severity string, status string, detected_at timestamp, description string")


def by_connection(df, *columns):
    return {r["connection_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_newest_run_of_each_connection(spark):
    r = results(spark)
    assert by_connection(trust.issues_by_severity(r), "severity", "issues") == {"a": ("CRITICAL", 1)}
    assert by_connection(trust.latest_run_health(r), "run_id", "overall_quality_score") == {"a": ("a2", 40.0), "b": ("b3", 100.0)}
    assert by_connection(trust.run_counts(r), "open_issues", "execution_runs") == {"a": (1, 2), "b": (0, 2)}
    assert by_connection(trust.newly_failing(r), "rule_id") == {"a": ("r",)}


def test_layers_and_summary(spark):
    r, p, a = results(spark), reports(spark), anomalies(spark)
    gold = trust.layer_health(p, r).where("layer = 'GOLD'")
    assert by_connection(gold, "score", "open_issues", "trend_delta") == {"a": (60.0, 1, 10.0), "b": (70.0, 0, -20.0)}
    registry = spark.createDataFrame([("a", "FAIL"), ("b", "PASS")], "connection_id string, health string")
    summary = trust.trust_summary(p, r, a, registry)
    assert by_connection(summary, "open_critical", "active_anomalies", "cde_health_pct", "pipeline_status") == {"a": (1, 8, 0.0, "ISSUES"), "b": (0, 0, 100.0, "HEALTHY")}


def test_attention_is_per_connection_and_unlimited_on_demand(spark):
    r = results(spark)
    rules = spark.createDataFrame([("r", "name", "c")], "rule_id string, rule_name string, column_name string")
    tasks = spark.createDataFrame([], "task_id int, priority string, title string, owner string, status string, due_date date")
    limited = trust.attention_queue(anomalies(spark, 30), r, rules, tasks, F.lit(DAY))
    assert limited.where("connection_id = 'a'").count() == 10 and limited.where("connection_id = 'b'").count() == 0
    assert trust.attention_queue(anomalies(spark, 30), r, rules, tasks, F.lit(DAY), size=None, per_kind={}).count() == 31


def test_every_open_anomaly_counts_for_the_score(spark):
    stats = spark.createDataFrame([], "connection_id string, report_id string, table_fqn string, column_name string, null_pct double")
    rules = spark.createDataFrame([("r", "name", "c")], "rule_id string, rule_name string, column_name string")
    nodes = spark.createDataFrame([("a", "up", "fail"), ("b", "up", "ok")], "connection_id string, external_id string, health_status string")
    edges = spark.createDataFrame([("a", "up", "s.t"), ("b", "up", "s.t")], "connection_id string, source string, target string")
    none = results(spark).limit(0)
    score = lambda n: by_connection(intel.trust_receipts(reports(spark).withColumn("quality_score", F.lit(99.0)), stats, none, rules, anomalies(spark, n), nodes, edges), "score", "upstream_issues")
    assert score(0) == {"a": (95.0, 1), "b": (99.0, 0)}
    assert score(5)["a"] == (55.0, 1)
    assert score(7)["a"] == (39.0, 1) and score(20)["a"] == (5.0, 1)
    signals = intel.receipt_signals(reports(spark), stats, none, rules, anomalies(spark, 8))
    fields = intel.receipt_fields(signals, reports(spark), stats, texts=None).first()
    assert fields["signals"] == 8 and fields["signal"].count(";") == 7 and "no 7" in fields["signal"]


def test_dashboard_counts_are_per_connection(spark):
    a = anomalies(spark, 3).unionByName(anomalies(spark, 2).withColumn("connection_id", F.lit("b"))).withColumn("layer", F.lit("GOLD"))
    assert by_connection(trust.anomaly_breakdown(a), "anomaly_type", "n") == {"a": ("VOLUME", 3), "b": ("VOLUME", 2)}
    assert by_connection(trust.anomalies_by_layer(a), "layer", "n") == {"a": ("GOLD", 3), "b": ("GOLD", 2)}
    later = a.withColumn("detected_at", F.when(F.col("connection_id") == "a", F.lit(DAY)).otherwise(F.lit(DAY - dt.timedelta(days=9))))
    assert by_connection(trust.new_anomalies(later, F.lit(DAY)), "new_anomalies") == {"a": (3,), "b": (0,)}
    fresh = trust.layer_freshness(reports(spark).filter("connection_id = 'b' OR run_at < '2024-01-03'"), results(spark).limit(0), F.lit(DAY + dt.timedelta(days=3)))
    assert by_connection(fresh.where("layer = 'GOLD'"), "age_hours", "state") == {"a": (48.0, "aging"), "b": (24.0, "fresh")}
    assert fresh.where("layer = 'RAW' AND state = 'never'").count() == 2


def test_columns_and_rules_are_per_connection(spark):
    dictionary = spark.createDataFrame([(c, "s.t", "GOLD", "col", f"{c}.col", True, 1.0, "x" if c == "a" else None, None) for c in "ab"],
                                       "connection_id string, table_fqn string, layer string, column_name string, column_id string, is_cde boolean, cde_score double, business_name string, description string")
    stats = spark.createDataFrame([("a", "s.t", "col", 0.0), ("b", "s.t", "col", 30.0)], "connection_id string, table_fqn string, column_name string, null_pct double")
    rules = spark.createDataFrame([("a", "s.t", "GOLD", "col", "approved", False, None), ("b", "s.t", "GOLD", None, "draft", True, "s.u")],
                                  "connection_id string, table_fqn string, layer string, column_name string, status string, is_cde_rule boolean, related_table_fqn string")
    for by_table in (False, True):
        assert by_connection(trust.cde_status(dictionary, stats, rules, by_table), "rule_coverage", "health") == {"a": (1, "HEALTHY"), "b": (0, "CRIT")}
    assert by_connection(trust.layer_coverage(dictionary, rules), "dict_pct", "rule_pct") == {"a": (100.0, 100.0), "b": (0.0, 0.0)}
    assert by_connection(rule_results.rules_per_table(rules), "approved", "pending", "cde", "cross_table") == {"a": (1, 0, 0, 0), "b": (0, 1, 1, 1)}


def test_lineage_is_per_connection(spark):
    pair = "connection_id string, source string, target string"
    log = spark.createDataFrame([("a", "x", "y"), ("a", "x", "y"), ("b", "x", "y"), ("b", "x", "only a")], pair).selectExpr("*", "1 AS execution_count", "'q' AS query_text")
    known = spark.createDataFrame([(c, t) for c in "ab" for t in "xy"] + [("a", "only a")], "connection_id string, table_fqn string")
    found = lineage.query_log_edges(log, known)
    assert by_connection(found, "source", "target", "confidence") == {"a": ("x", "y", 0.75), "b": ("x", "y", 0.6)}
    nodes = known.withColumnRenamed("table_fqn", "external_id")
    edges = found.withColumn("status", F.when(F.col("connection_id") == "a", "confirmed").otherwise("suggested"))
    assert by_connection(lineage.coverage(known, nodes, edges), "total_known_tables", "tables_with_edges", "suggested_pending", "completeness_pct") == {"a": (3, 2, 0, 66.7), "b": (2, 0, 1, 0.0)}
    assert by_connection(lineage.edges_by_origin(edges), "edges") == {"a": (1,)}
    back = spark.createDataFrame([("a", "y", "x"), ("b", "y", "x")], pair).selectExpr("*", "'suggested' AS status")
    decisions = spark.createDataFrame([("a", "y", "x", "approve", 1), ("b", "y", "x", "approve", 2)], pair + ", decision string, rank int")
    reviewed = lineage.review_edges(edges.select(*back.columns).unionByName(back), decisions).filter("source = 'y'")
    assert by_connection(reviewed, "status", "review") == {"a": ("suggested", "blocked_by_cycle"), "b": ("confirmed", "approved")}
    wanted = spark.createDataFrame([("a", "y", "x", 1), ("b", "y", "x", 1)], pair + ", rank int")
    confirmed = edges.filter("status = 'confirmed'").select("connection_id", "source", "target", "status")
    assert by_connection(lineage.import_edges(confirmed, wanted), "outcome", "rank") == {"a": ("cycle", 1), "b": ("confirmed", 1)}
    new = spark.createDataFrame([("a", "new", None, None, None), ("b", "only a", None, None, None)], "connection_id string, external_id string, label string, layer string, node_type string")
    assert by_connection(lineage.import_nodes(nodes, new, wanted), "external_id") == {"a": ("new",), "b": ("only a",)}
