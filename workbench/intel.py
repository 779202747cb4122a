"""Pre-run intelligence queries (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import intel, trust
from workbench import derived as d
from workbench.anomalies import anomaly_log, fingerprints
from workbench.registry import cte, query, ratio
from workbench.trust import _S10

_NOW = f"TIMESTAMP '{d.AS_OF}'"
cte("w_connrun", "SELECT x.* FROM w_results x JOIN (SELECT connection_id, arg_max(run_id, run_timestamp) AS run_id FROM w_results GROUP BY 1) r USING (connection_id, run_id)")
cte("w_repeat", f"SELECT connection_id, rule_id, count(DISTINCT run_id) AS runs FROM w_results WHERE status = 'FAIL' AND run_timestamp > {_NOW} - INTERVAL 60 DAYS GROUP BY 1, 2 HAVING count(DISTINCT run_id) >= 2")
cte("w_swings", f"""
SELECT connection_id, table_fqn, row_count AS cur, p AS prev, {ratio('100 * (row_count - p)', 'p', 1)} AS delta_pct, abs(row_count - p) * 100 >= p * 40 AS is_large FROM (
  SELECT *, lead(row_count) OVER w AS p, row_number() OVER w AS rn FROM w_reports WINDOW w AS (PARTITION BY connection_id, table_fqn ORDER BY run_at DESC))
WHERE rn = 1 AND p > 0 AND abs(row_count - p) * 100 >= p * 20""")
cte("w_signals", f"""
SELECT *, round(greatest(5.0, least(99.0, base_score - (least(15, 5 * critical) + least(10, 2 * high) + least(9, 3 * repeat_offenders) + least(10, 5 * large_swings)
       + CASE WHEN profiling_h IS NULL THEN 10 WHEN profiling_h > 48 THEN 5 ELSE 0 END))), 1) AS predicted_score FROM (
SELECT c.connection_id, base_score, coalesce(open_total, 0) AS open_total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(rep, 0) AS repeat_offenders,
       coalesce(swings, 0) AS swings, coalesce(large_swings, 0) AS large_swings, profiling_h, execution_h
FROM (SELECT DISTINCT connection_id FROM w_tables) c
LEFT JOIN (SELECT connection_id, {ratio(f'sum({_S10})', '10 * count(*)', 4)} AS base_score FROM w_connrun GROUP BY 1) USING (connection_id)
LEFT JOIN (SELECT connection_id, count(*) AS open_total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high FROM w_anoms WHERE status = 'open' GROUP BY 1) USING (connection_id)
LEFT JOIN (SELECT connection_id, count(*) AS rep FROM w_repeat GROUP BY 1) USING (connection_id)
LEFT JOIN (SELECT connection_id, count(*) AS swings, count(*) FILTER (WHERE is_large) AS large_swings FROM w_swings GROUP BY 1) USING (connection_id)
LEFT JOIN (SELECT connection_id, round((epoch({_NOW}) - epoch(max(run_at))) / 3600.0::DOUBLE, 1) AS profiling_h FROM w_reports GROUP BY 1) USING (connection_id)
LEFT JOIN (SELECT connection_id, round((epoch({_NOW}) - epoch(max(run_timestamp))) / 3600.0::DOUBLE, 1) AS execution_h FROM w_results GROUP BY 1) USING (connection_id))""")


def _history(spark, sf, keep_log=False):
    """Anomalies, results and reports from one staged count of lineitem."""
    base = d.stage(d.monthly(spark, sf))
    log = anomaly_log(spark, sf, base)
    return d.stage(log) if keep_log else log, d.results(spark, sf, base), d.reports(spark, sf, base), base


def _signals(spark, sf, log, results, reports):
    return intel.advisory_signals(d.tables(spark, sf), log, results, reports, d.as_of(), 60)


@query("i1_open_by_severity", "SELECT connection_id, severity, count(*) AS n FROM w_anoms WHERE status = 'open' GROUP BY 1, 2")
def i1(spark, sf):
    return intel.open_by_severity(anomaly_log(spark, sf))


@query("i1_top_tables", """
SELECT connection_id, table_fqn, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY connection_id ORDER BY n DESC, table_fqn) AS INTEGER) AS rank FROM (
  SELECT connection_id, table_fqn, count(*) AS n FROM w_anoms WHERE status = 'open' GROUP BY 1, 2)) WHERE rank <= 3""")
def i1_tables(spark, sf):
    return intel.top_affected_tables(anomaly_log(spark, sf))


cte("w_failing", """
SELECT connection_id, rule_id, coalesce(nullif(rule_name, ''), 'unnamed rule') AS shown_name, table_fqn, fail_pct, severity, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY connection_id ORDER BY fail_pct DESC, rule_id) AS INTEGER) AS rank FROM w_connrun WHERE status = 'FAIL') WHERE rank <= 5""")


@query("i2_failing_rules", "SELECT connection_id, rule_id, shown_name, fail_pct, rank FROM w_failing")
def i2(spark, sf):
    return intel.failing_rules(d.results(spark, sf), d.rules(spark, sf)).select("connection_id", "rule_id", "shown_name", "fail_pct", "rank")


@query("i3_repeat", "SELECT * FROM w_repeat")
def i3(spark, sf):
    return intel.repeat_offenders(d.results(spark, sf), d.as_of(), 60)


@query("i4_volume_trend", "SELECT * FROM w_swings")
def i4(spark, sf):
    return intel.volume_trends(d.reports(spark, sf))


@query("i5_ages", "SELECT connection_id, profiling_h, execution_h FROM w_signals")
def i5(spark, sf):
    return intel.ages(d.reports(spark, sf), d.results(spark, sf), d.as_of())


@query("i6_dow", f"""
SELECT connection_id, 'Monday' AS today_name, {ratio(f'count(*) FILTER (WHERE dayofweek(detected_at) = dayofweek({_NOW}))', '13', 1)} AS today_avg, {ratio('count(*)', '90', 1)} AS overall_avg
FROM w_anoms WHERE detected_at > {_NOW} - INTERVAL 90 DAYS GROUP BY 1""")
def i6(spark, sf):
    return intel.weekday_rate(anomaly_log(spark, sf), d.as_of())


@query("i7_fingerprints", """
SELECT connection_id, related_table, resolution, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY connection_id ORDER BY incident_date DESC, related_table, resolution) AS INTEGER) AS rank FROM w_fp) WHERE rank <= 3""")
def i7(spark, sf):
    return intel.recent_fingerprints(fingerprints(spark, sf)).select("connection_id", "related_table", "resolution", "rank")


@query("i8_base_score", "SELECT connection_id, base_score FROM w_signals")
def i8(spark, sf):
    return intel.base_scores(d.tables(spark, sf), d.results(spark, sf), d.reports(spark, sf))


@query("i9_predicted", "SELECT * FROM w_signals")
def i9(spark, sf):
    return _signals(spark, sf, *_history(spark, sf)[:3])


cte("w_topswings", "SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY abs(delta_pct) DESC, table_fqn) AS rank FROM w_swings")
cte("w_reasons", """
SELECT connection_id, CAST(row_number() OVER (PARTITION BY connection_id ORDER BY k, rank) AS INTEGER) AS reason_no, risk, text FROM (
SELECT connection_id, 1 AS k, 1 AS rank, CASE WHEN critical > 0 THEN 'high' ELSE 'med' END AS risk,
       'Open anomalies: ' || open_total || ' (critical ' || critical || ', high ' || high || '), most of them on ' || (SELECT arg_min(table_fqn, (-n, table_fqn)) FROM (
          SELECT table_fqn, count(*) AS n FROM w_anoms a WHERE a.status = 'open' AND a.connection_id = w_signals.connection_id GROUP BY 1)) AS text FROM w_signals WHERE open_total > 0
UNION ALL SELECT connection_id, 2, rank, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'high' ELSE 'med' END, 'Rule ' || shown_name || ' of ' || table_fqn || ': ' || fail_pct || '% of the rows fail' FROM w_failing WHERE rank <= 2
UNION ALL SELECT connection_id, 3, rank, CASE WHEN abs(delta_pct) >= 40 THEN 'high' ELSE 'med' END, 'Rows of ' || table_fqn || ': ' || prev || ' before, ' || cur || ' now' FROM w_topswings WHERE rank <= 2
UNION ALL SELECT connection_id, 4, 1, 'med', 'No profile within 48 hours' FROM w_signals WHERE profiling_h IS NULL OR profiling_h > 48)
QUALIFY reason_no <= 5""")


def _reasons(spark, sf, log, results, reports):
    signals = d.stage(_signals(spark, sf, log, results, reports))
    return intel.risk_reasons(signals, intel.failing_rules(results, d.rules(spark, sf)), intel.top_volume_trends(intel.volume_trends(reports)),
                              intel.top_affected_tables(log))


@query("i10_reasons", "SELECT * FROM w_reasons")
def i10(spark, sf):
    return _reasons(spark, sf, *_history(spark, sf, keep_log=True)[:3])


cte("w_tabrun", "SELECT x.* FROM w_results x JOIN (SELECT connection_id, table_fqn, arg_max(run_id, run_timestamp) AS run_id FROM w_results GROUP BY 1, 2) r USING (connection_id, table_fqn, run_id)")
cte("w_rsig", """
WITH f AS (
SELECT x.connection_id, x.table_fqn, r.column_name AS field, CASE WHEN x.status = 'FAIL' AND x.severity IN ('CRITICAL', 'HIGH') THEN 2 ELSE 1 END AS rank, 0 AS source,
       CASE WHEN x.status = 'FAIL' THEN coalesce(nullif(x.rule_name, ''), 'rule') || ': ' || fail_pct || '% of the rows fail, ' || lower(x.severity)
            ELSE coalesce(nullif(x.rule_name, ''), 'rule') || ': not evaluated, the run had an error' END AS signal
FROM w_tabrun x LEFT JOIN w_rules r ON r.rule_id = x.rule_id WHERE x.status IN ('FAIL', 'ERROR')
UNION ALL SELECT connection_id, table_fqn, coalesce(column_name, 'Entire table'), CASE WHEN severity = 'CRITICAL' THEN 2 ELSE 1 END, 1, lower(severity) || ' ' || lower(anomaly_type) || ' anomaly: ' || severity || '/' || table_fqn FROM (SELECT * FROM w_anoms WHERE status = 'open'))
SELECT * FROM f UNION ALL
SELECT s.connection_id, s.table_fqn, s.column_name, 1, 2, 'NULL share ' || s.null_pct || '% at the last profile' FROM w_stats s JOIN w_latest l USING (report_id)
WHERE s.null_pct >= 10 AND NOT EXISTS (SELECT 1 FROM f WHERE f.table_fqn = s.table_fqn AND f.field = s.column_name)""")


def _receipt_inputs(spark, sf):
    log, results, reports, base = _history(spark, sf, keep_log=True)
    log = log.withColumn("description", F.concat_ws("/", "severity", "table_fqn"))
    return reports, d.column_stats(spark, sf, base), results, d.rules(spark, sf), log


@query("i11_receipt", """
WITH v AS (SELECT connection_id, table_fqn, field, max(rank) AS rank, min(source) AS source, count(*) AS signals FROM w_rsig GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY connection_id, table_fqn ORDER BY max(rank) DESC, min(source), field) <= 6),
t AS (SELECT connection_id, table_fqn, field, string_agg(signal, '; ' ORDER BY source, signal) AS signal FROM (
  SELECT * FROM w_rsig QUALIFY row_number() OVER (PARTITION BY connection_id, table_fqn, field ORDER BY source, signal) <= 3) GROUP BY 1, 2, 3)
SELECT v.table_fqn, v.field, CASE WHEN rank = 2 THEN 'fail' ELSE 'warn' END AS status, t.signal, v.signals FROM v JOIN t USING (connection_id, table_fqn, field)
UNION ALL
SELECT table_fqn, column_name, 'ok', 'no finding, NULL share below 1%', 0 FROM (SELECT s.* FROM w_stats s JOIN w_latest l USING (report_id)
  WHERE s.null_pct < 1 AND NOT EXISTS (SELECT 1 FROM w_rsig f WHERE f.table_fqn = s.table_fqn AND f.field = s.column_name)
  QUALIFY row_number() OVER (PARTITION BY s.connection_id, s.table_fqn ORDER BY s.column_name) <= 2)""")
def i11(spark, sf):
    reports, stats, results, rules, anomalies = _receipt_inputs(spark, sf)
    signals = d.stage(intel.receipt_signals(reports, stats, results, rules, anomalies))
    return intel.receipt_fields(signals, reports, stats).drop("connection_id")


_RECEIPTS = """
SELECT l.table_fqn, l.row_count, greatest(50, least(CAST(round(l.quality_score * 10) AS BIGINT) - 10 * (8 * coalesce(c, 0) + 5 * coalesce(h, 0) + 4 * coalesce(f, 0) + 4 * coalesce(u, 0)),
         CASE w WHEN 2 THEN 650 WHEN 1 THEN 820 ELSE 990 END)) / 10.0::DOUBLE AS score, coalesce(u, 0) AS upstream_issues, strftime(lc, '%Y-%m-%d') AS last_clean
FROM w_latest l LEFT JOIN (SELECT table_fqn, max(rank) AS w FROM w_rsig GROUP BY 1) USING (table_fqn)
LEFT JOIN (SELECT table_fqn, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'HIGH') AS h FROM (SELECT * FROM w_anoms WHERE status = 'open') GROUP BY 1) USING (table_fqn)
LEFT JOIN (SELECT table_fqn, count(*) FILTER (WHERE status = 'FAIL') AS f FROM w_tabrun GROUP BY 1) USING (table_fqn)
LEFT JOIN (SELECT e.connection_id, target AS table_fqn, count(*) AS u FROM w_tedges e JOIN w_tnodes n ON n.external_id = e.source AND n.connection_id = e.connection_id WHERE health_status <> 'ok' GROUP BY 1, 2) USING (connection_id, table_fqn)
LEFT JOIN (SELECT table_fqn, max(run_at) AS lc FROM w_reports WHERE quality_score >= 85 GROUP BY 1) USING (table_fqn)"""


def _receipts(spark, sf):
    out = intel.trust_receipts(*_receipt_inputs(spark, sf), d.table_nodes(spark, sf), d.table_edges(spark, sf))
    return out.withColumn("last_clean", F.date_format("last_clean", "yyyy-MM-dd"))


@query("i12_receipt_score", f"SELECT table_fqn, row_count, score, upstream_issues FROM ({_RECEIPTS})")
def i12(spark, sf):
    return _receipts(spark, sf).select("table_fqn", "row_count", "score", "upstream_issues")


@query("i13_last_clean", f"SELECT table_fqn, last_clean FROM ({_RECEIPTS})")
def i13(spark, sf):
    return _receipts(spark, sf).select("table_fqn", "last_clean")


_FACT_DAY = "2001-10-01 06:00:00"


@query("i14_daily_facts", f"""
SELECT connection_id, score, delta, runs_today, anomalies_today, open_anomalies, open_critical,
       format('Runs of the day: {{}}. Anomalies found: {{}}. Left to resolve: {{}} anomalies, {{}} critical rule failures.', runs_today, anomalies_today, open_anomalies, open_critical) AS narrative
FROM (SELECT connection_id, {ratio(f'sum({_S10})', '10 * count(*)', 0)} AS score, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL') AS open_critical FROM w_connrun GROUP BY 1)
JOIN (SELECT connection_id, count(DISTINCT run_id) FILTER (WHERE CAST(run_timestamp AS DATE) = DATE '{_FACT_DAY[:10]}') AS runs_today FROM w_results GROUP BY 1) USING (connection_id)
JOIN (SELECT connection_id, count(*) FILTER (WHERE CAST(detected_at AS DATE) = DATE '{_FACT_DAY[:10]}') AS anomalies_today, count(*) FILTER (WHERE status = 'open') AS open_anomalies FROM w_anoms GROUP BY 1) USING (connection_id)
JOIN (SELECT connection_id, {ratio('CAST(round(q * 10) AS BIGINT) - CAST(round(p * 10) AS BIGINT)', '10', 1)} AS delta FROM (
  SELECT connection_id, overall_score AS q, lead(overall_score) OVER w AS p, row_number() OVER w AS rn FROM w_trust WINDOW w AS (PARTITION BY connection_id ORDER BY score_date DESC)) WHERE rn = 1) USING (connection_id)""")
def i14(spark, sf):
    log, results, reports, _ = _history(spark, sf)
    return intel.daily_facts(d.tables(spark, sf), trust.trust_snapshot(reports, results), results, log, d.as_of(_FACT_DAY))


@query("i14_decisions_today", "SELECT event_type, count(*) AS n FROM w_audit WHERE CAST(event_timestamp AS DATE) = DATE '2024-01-15' GROUP BY 1 ORDER BY n DESC, event_type LIMIT 6")
def i14_decisions(spark, sf):
    return intel.decisions_today(d.audit(spark, sf), d.as_of("2024-01-15 12:00:00"))


@query("i16_receipt_tables", "SELECT connection_id, table_fqn, layer, quality_score FROM w_latest")
def i16(spark, sf):
    return intel.eligible_tables(d.reports(spark, sf))


@query("i17_recommendations", """
SELECT connection_id, CAST(row_number() OVER (PARTITION BY connection_id ORDER BY kind, no, text) AS INTEGER) AS place, text FROM (
SELECT connection_id, 1 AS kind, reason_no AS no, text FROM w_reasons
UNION ALL SELECT connection_id, 2, 1, 'Start with the critical rule failures: ' || count(*) FROM w_lastrun WHERE status = 'FAIL' AND severity = 'CRITICAL' GROUP BY 1
UNION ALL SELECT connection_id, 3, 1, 'Look through the open anomalies: ' || count(*) || ', the first on ' || first(table_fqn ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, detected_at DESC, anomaly_id) FROM w_anoms WHERE status = 'open' GROUP BY 1
UNION ALL SELECT c.connection_id, 5, ascii(l.layer), 'Profile ' || l.layer || ' for the first time' FROM (SELECT DISTINCT connection_id FROM w_tables) c, (VALUES ('RAW'), ('BRONZE'), ('SILVER'), ('GOLD')) AS l(layer)
  WHERE NOT EXISTS (SELECT 1 FROM w_latest r WHERE r.connection_id = c.connection_id AND r.layer = l.layer AND r.quality_score > 0)
UNION ALL SELECT DISTINCT connection_id, 4, ascii(layer), 'Repair the failing rules of ' || layer || ' and run it again' FROM w_lastrun WHERE status = 'FAIL' AND layer <> 'UNKNOWN')""")
def i17(spark, sf):
    log, results, reports, _ = _history(spark, sf, keep_log=True)
    summary = trust.trust_summary(reports, results, log, d.registry(spark, sf))
    out = intel.recommendations(_reasons(spark, sf, log, results, reports), summary, log, trust.layer_health(reports, results), d.as_of(), limit=None)
    return out.select("connection_id", "place", "text")
