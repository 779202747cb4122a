"""Trust queries (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import trust
from workbench import derived as d
from workbench.anomalies import anomaly_log
from workbench.registry import cte, percent, query, ratio
from workbench.rules import _score_sql

cte("w_latest", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, table_fqn ORDER BY run_at DESC, report_id DESC) AS rn FROM w_reports) WHERE rn = 1")
cte("w_lastrun", "SELECT x.* FROM w_results x JOIN (SELECT connection_id, arg_max(run_id, run_timestamp) AS run_id FROM w_results GROUP BY 1) r USING (connection_id, run_id)")
_S10 = "CAST(round(quality_score * 10) AS BIGINT)"
_LAYER_AVG = f"SELECT connection_id, layer, {ratio(f'sum({_S10})', '10 * count(*)', 4)} AS score, count(*) AS profiled_tables FROM w_latest GROUP BY 1, 2"
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"
_LAYERS = "(VALUES ('RAW'), ('BRONZE'), ('SILVER'), ('GOLD')) AS l(layer)"


@query("t1_layer_avg", _LAYER_AVG)
def t1(spark, sf):
    return trust.layer_averages(d.reports(spark, sf))


@query("t2_issues_by_severity", "SELECT connection_id, severity, count(*) AS issues FROM w_lastrun WHERE status = 'FAIL' GROUP BY 1, 2")
def t2(spark, sf):
    return trust.issues_by_severity(d.results(spark, sf))


@query("t3_latest_run", f"SELECT connection_id, run_id, count(*) FILTER (WHERE status = 'ERROR') AS errors, {_score_sql()} AS overall_quality_score FROM w_lastrun GROUP BY 1, 2")
def t3(spark, sf):
    return trust.latest_run_health(d.results(spark, sf)).drop("run_timestamp")


_T4 = """SELECT connection_id, layer, count(*) FILTER (WHERE status = 'FAIL') AS open_issues, count(*) AS rule_count, any_value(n) AS execution_runs
FROM w_lastrun JOIN (SELECT connection_id, count(DISTINCT run_id) AS n FROM w_results GROUP BY 1) USING (connection_id) GROUP BY 1, 2"""


@query("t4_run_counts", _T4)
def t4(spark, sf):
    return trust.run_counts(d.results(spark, sf))


_T5 = f"""SELECT connection_id, layer, {ratio('sum(CAST(round(q * 10) AS BIGINT) - CAST(round(p * 10) AS BIGINT))', '10 * count(*)', 1)} AS trend_delta FROM (
  SELECT connection_id, layer, quality_score AS q, lead(quality_score) OVER w AS p, row_number() OVER w AS rn FROM w_reports WINDOW w AS (PARTITION BY connection_id, table_fqn ORDER BY run_at DESC))
  WHERE rn = 1 AND p IS NOT NULL GROUP BY 1, 2"""


@query("t5_layer_trend", _T5)
def t5(spark, sf):
    return trust.layer_trend(d.reports(spark, sf))


@query("t6_breakdown", """
SELECT connection_id, anomaly_type, count(*) AS n, CASE anomaly_type WHEN 'VOLUME' THEN 'Volume drop' WHEN 'DISTRIBUTION' THEN 'Segment / drift' ELSE 'Threshold breach' END AS label,
       CASE anomaly_type WHEN 'VOLUME' THEN 'danger' ELSE 'warning' END AS intent FROM w_anoms WHERE status = 'open' GROUP BY 1, 2""")
def t6(spark, sf):
    return trust.anomaly_breakdown(anomaly_log(spark, sf))


@query("t6_by_layer", "SELECT connection_id, layer, count(*) AS n FROM w_anoms WHERE status = 'open' GROUP BY 1, 2")
def t6_layer(spark, sf):
    return trust.anomalies_by_layer(anomaly_log(spark, sf))


_T7 = f"SELECT {percent('''count(*) FILTER (WHERE health IN ('PASS', 'HEALTHY'))''', 'count(*)', 1)} AS cde_health_pct FROM w_cde"


@query("t7_cde_health", _T7)
def t7(spark, sf):
    return trust.cde_health(d.registry(spark, sf))


def _layer_day(x: str) -> str:
    return (f"CASE WHEN count(*) FILTER (WHERE layer = '{x}') > 0 THEN "
            + ratio(f"coalesce(sum({_S10}) FILTER (WHERE layer = '{x}'), 0)", f"10 * count(*) FILTER (WHERE layer = '{x}')", 1) + f" END AS {x.lower()}_score")


cte("w_trust", f"""
SELECT o.*, raw_score, bronze_score, silver_score, gold_score FROM (
  SELECT connection_id, CAST(run_timestamp AS DATE) AS score_date, {_score_sql()} AS overall_score, count(*) AS rules_total,
         count(*) FILTER (WHERE status = 'PASS') AS rules_passed, count(*) FILTER (WHERE status = 'FAIL') AS rules_failed FROM w_results GROUP BY 1, 2) o
LEFT JOIN (SELECT connection_id, CAST(run_at AS DATE) AS score_date, {', '.join(_layer_day(x) for x in ('RAW', 'BRONZE', 'SILVER', 'GOLD'))} FROM w_reports GROUP BY 1, 2) p
  USING (connection_id, score_date)
""")


def trust_history(spark, sf):
    return trust.trust_snapshot(d.reports(spark, sf), d.results(spark, sf))


@query("t8_score_delta", f"""
SELECT connection_id, p AS yesterday_score, {ratio('CAST(round(q * 10) AS BIGINT) - CAST(round(p * 10) AS BIGINT)', '10', 1)} AS score_delta FROM (
  SELECT connection_id, overall_score AS q, lead(overall_score) OVER w AS p, row_number() OVER w AS rn FROM w_trust WINDOW w AS (PARTITION BY connection_id ORDER BY score_date DESC)) WHERE rn = 1""")
def t8(spark, sf):
    return trust.score_delta(trust_history(spark, sf))


@query("t9_layer_health", f"""
SELECT connection_id, layer, round(coalesce(a.score, 0), 1) AS score, CASE WHEN coalesce(a.score, 0) >= 85 THEN 'HEALTHY' WHEN coalesce(a.score, 0) >= 65 THEN 'WARN' ELSE 'ISSUES' END AS status,
       coalesce(c.open_issues, 0) AS open_issues, coalesce(c.rule_count, 0) AS rule_count, t.trend_delta
FROM (SELECT DISTINCT connection_id, l.layer FROM w_tables, {_LAYERS}) k LEFT JOIN ({_LAYER_AVG}) a USING (connection_id, layer) LEFT JOIN ({_T4}) c USING (connection_id, layer)
LEFT JOIN ({_T5}) t USING (connection_id, layer)""")
def t9_layers(spark, sf):
    base = d.stage(d.monthly(spark, sf))
    return trust.layer_health(d.reports(spark, sf, base), d.results(spark, sf, base))


@query("t9_summary", f"""
SELECT connection_id, overall_score, open_critical, open_high, open_medium, open_errors, coalesce(active_anomalies, 0) AS active_anomalies, coalesce(cde, 100.0) AS cde_health_pct, profiled_table_count,
       CASE WHEN open_critical > 0 OR open_errors > 0 THEN 'ISSUES' WHEN open_high > 0 THEN 'RECOVERING' ELSE 'HEALTHY' END AS pipeline_status,
       strftime(greatest(run_at, profiled_at), '%Y-%m-%d') AS last_run_day
FROM (SELECT connection_id, {_score_sql()} AS overall_score, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL') AS open_critical,
             count(*) FILTER (WHERE status = 'FAIL' AND severity = 'HIGH') AS open_high, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'MEDIUM') AS open_medium,
             count(*) FILTER (WHERE status = 'ERROR') AS open_errors, max(run_timestamp) AS run_at FROM w_lastrun GROUP BY 1)
JOIN (SELECT connection_id, count(*) AS profiled_table_count, max(run_at) AS profiled_at FROM w_latest GROUP BY 1) USING (connection_id)
LEFT JOIN (SELECT connection_id, {percent("count(*) FILTER (WHERE health IN ('PASS', 'HEALTHY'))", 'count(*)', 1)} AS cde FROM w_cde GROUP BY 1) USING (connection_id)
LEFT JOIN (SELECT connection_id, count(*) AS active_anomalies FROM w_anoms WHERE status = 'open' GROUP BY 1) USING (connection_id)""")
def t9(spark, sf):
    base = d.stage(d.monthly(spark, sf))
    out = trust.trust_summary(d.reports(spark, sf, base), d.results(spark, sf, base), anomaly_log(spark, sf, base), d.registry(spark, sf))
    return out.withColumn("last_run_day", F.date_format("last_run_at", "yyyy-MM-dd")).drop("last_run_at")


@query("t10_trust_snapshot", "SELECT * REPLACE (strftime(score_date, '%Y-%m-%d') AS score_date) FROM w_trust")
def t10(spark, sf):
    return trust_history(spark, sf).withColumn("score_date", F.date_format("score_date", "yyyy-MM-dd"))


_PRIO = _RANK.replace("severity", "priority")


def _first(n: int, order: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY connection_id ORDER BY {order}) <= {n}"


_QUEUE = _RANK.replace('ELSE 3', "WHEN 'LOW' THEN 3 ELSE 9") + ", ts IS NULL, ts, kind, entity_id"


@query("t13_attention", f"""
SELECT connection_id, kind, entity_id, severity, title, ts, CAST(row_number() OVER (PARTITION BY connection_id ORDER BY {_QUEUE}) AS INTEGER) AS place FROM (
SELECT * FROM (SELECT connection_id, 'anomaly' AS kind, anomaly_id AS entity_id, severity, anomaly_type || table_fqn AS title, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS ts FROM w_anoms WHERE status = 'open' {_first(10, _RANK + ', detected_at DESC, anomaly_id')})
UNION ALL SELECT * FROM (SELECT connection_id, 'rule', rule_id, severity, 'Rule failing: ' || coalesce(nullif(rule_name, ''), 'unnamed rule'), strftime(run_timestamp, '%Y-%m-%d %H:%M:%S') FROM w_lastrun WHERE status = 'FAIL' AND NOT is_expected_failure {_first(8, _RANK + ', fail_pct DESC, rule_id')})
UNION ALL SELECT * FROM (SELECT NULL, 'task', CAST(task_id AS VARCHAR), priority, 'Overdue task: ' || title, NULL FROM w_tasks WHERE status IN ('open', 'in_progress') AND due_date < DATE '{d.AS_OF[:10]}' ORDER BY due_date, task_id LIMIT 5))
QUALIFY place <= 10""")
def t13(spark, sf):
    base = d.stage(d.monthly(spark, sf))
    log = anomaly_log(spark, sf, base).withColumn("description", F.concat("anomaly_type", "table_fqn"))
    q = trust.attention_queue(log, d.results(spark, sf, base), d.rules(spark, sf), d.tasks(spark, sf), d.as_of())
    return q.select("connection_id", "kind", "entity_id", "severity", "title", "ts", "place")


@query("t14_new_anomalies", "SELECT connection_id, count(*) FILTER (WHERE detected_at > TIMESTAMP '2001-07-01 06:00:00' - INTERVAL 24 HOURS AND detected_at <= TIMESTAMP '2001-07-01 06:00:00') AS new_anomalies FROM w_anoms GROUP BY 1")
def t14(spark, sf):
    return trust.new_anomalies(anomaly_log(spark, sf), d.as_of("2001-07-01 06:00:00"))


@query("t15_newly_failing", """
WITH r AS (SELECT connection_id, run_id, row_number() OVER (PARTITION BY connection_id ORDER BY max(run_timestamp) DESC) AS rn FROM w_results GROUP BY 1, 2),
f AS (SELECT DISTINCT connection_id, rule_id, table_fqn, rn FROM w_results JOIN r USING (connection_id, run_id) WHERE status = 'FAIL' AND rn <= 2)
SELECT connection_id, rule_id, table_fqn FROM f WHERE rn = 1 AND EXISTS (SELECT 1 FROM r WHERE r.connection_id = f.connection_id AND r.rn = 2)
AND NOT EXISTS (SELECT 1 FROM f AS p WHERE p.rn = 2 AND p.connection_id = f.connection_id AND p.rule_id = f.rule_id)""")
def t15(spark, sf):
    return trust.newly_failing(d.results(spark, sf))


@query("t16_freshness", f"""
SELECT connection_id, layer, strftime(ts, '%Y-%m-%d %H') AS last_checked, age_hours, CASE WHEN ts IS NULL THEN 'never' WHEN age_hours <= 24 THEN 'fresh' WHEN age_hours <= 72 THEN 'aging' ELSE 'stale' END AS state
FROM (SELECT connection_id, layer, ts, round((epoch(TIMESTAMP '2001-11-02 12:00:00') - epoch(ts)) / 3600.0::DOUBLE, 1) AS age_hours FROM (SELECT DISTINCT connection_id, l.layer FROM w_reports, {_LAYERS}) LEFT JOIN (
  SELECT connection_id, layer, max(ts) AS ts FROM (SELECT connection_id, layer, run_at AS ts FROM w_reports UNION ALL SELECT connection_id, layer, run_timestamp FROM w_results) GROUP BY 1, 2) USING (connection_id, layer))""")
def t16(spark, sf):
    out = trust.layer_freshness(d.reports(spark, sf), d.results(spark, sf), d.as_of("2001-11-02 12:00:00"))
    return out.withColumn("last_checked", F.date_format("last_checked", "yyyy-MM-dd HH"))


@query("t17_trust_trend", f"SELECT connection_id, strftime(score_date, '%Y-%m-%d') AS score_day, overall_score FROM w_trust WHERE score_date >= DATE '{d.AS_OF[:10]}' - 200")
def t17(spark, sf):
    out = trust.last_days(trust_history(spark, sf), "score_date", d.as_of(), 200)
    return out.select("connection_id", F.date_format("score_date", "yyyy-MM-dd").alias("score_day"), "overall_score")


_FAILS = "SELECT connection_id, CAST(run_timestamp AS DATE) AS fail_date, count(*) FILTER (WHERE status = 'FAIL') AS fail_count FROM w_results GROUP BY 1, 2"


@query("t18_rule_fail_trend", f"SELECT connection_id, strftime(fail_date, '%m-%d') AS label, fail_count FROM ({_FAILS}) WHERE fail_date >= DATE '{d.AS_OF[:10]}' - 120")
def t18(spark, sf):
    out = trust.last_days(trust.rule_failures_per_day(d.results(spark, sf)), "fail_date", d.as_of(), 120)
    return out.select("connection_id", F.date_format("fail_date", "MM-dd").alias("label"), "fail_count")


@query("t19_rule_fail_snapshot", f"SELECT connection_id, strftime(fail_date, '%Y-%m-%d') AS fail_date, fail_count FROM ({_FAILS})")
def t19(spark, sf):
    return trust.rule_failures_per_day(d.results(spark, sf)).withColumn("fail_date", F.date_format("fail_date", "yyyy-MM-dd"))


def _cde_rows(spark, sf):
    """Critical data elements named like the monitored columns."""
    names = F.when(F.col("data_type") == "PROMO", "returnflag").when(F.col("data_type") == "STANDARD", "discount_key").when(
        F.col("data_type") == "ECONOMY", "quantity").otherwise(F.col("column_name"))
    return d.dictionary(spark, sf).withColumn("column_name", names)


_CDE_ROWS = "(SELECT * REPLACE (CASE data_type WHEN 'PROMO' THEN 'returnflag' WHEN 'STANDARD' THEN 'discount_key' WHEN 'ECONOMY' THEN 'quantity' ELSE column_name END AS column_name) FROM w_dict)"


@query("t20_cde_status", f"""
SELECT connection_id, column_id, column_name, cde_score, coalesce(nulls, 0.0) AS last_null_pct, coalesce(n, 0) AS rule_coverage,
       CASE WHEN coalesce(nulls, 0) < 1 THEN 'HEALTHY' WHEN nulls < 5 THEN 'WARN' ELSE 'CRIT' END AS health
FROM {_CDE_ROWS} LEFT JOIN (SELECT connection_id, column_name, {ratio('sum(CAST(round(null_pct * 100) AS BIGINT))', '100 * count(null_pct)', 4)} AS nulls FROM w_stats GROUP BY 1, 2) USING (connection_id, column_name)
LEFT JOIN (SELECT connection_id, column_name, count(*) AS n FROM w_rules WHERE status IN ('approved', 'active') GROUP BY 1, 2) USING (connection_id, column_name) WHERE is_cde""")
def t20(spark, sf):
    out = trust.cde_status(_cde_rows(spark, sf), d.column_stats(spark, sf), d.rules(spark, sf))
    return out.select("connection_id", "column_id", "column_name", "cde_score", "last_null_pct", "rule_coverage", "health")


@query("t21_audit", """
SELECT audit_id, strftime(event_timestamp, '%H:%M') AS time, strftime(event_timestamp, '%Y-%m-%d') AS date, coalesce(user_name, 'System') AS user, event_type AS action,
       'RULE · ' || coalesce(entity_name, entity_id) AS entity FROM w_audit ORDER BY event_timestamp DESC, audit_id DESC LIMIT 20""")
def t21(spark, sf):
    return trust.audit_list(d.audit(spark, sf))


_PRICE = lambda side: "CASE " + " ".join(f"WHEN model LIKE '{k}' THEN {p[side]}" for k, p in {
    "ollama/%": (0, 0), "%claude-haiku%": (80, 400), "%gpt-4o-mini%": (15, 60), "%gpt-4o%": (250, 1000)}.items()) + f" WHEN model IS NULL THEN NULL ELSE {(300, 1200)[side]} END"
_USAGE = f"""
SELECT feature, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(w) / sum(calls), 0) AS avg_latency_ms,
       CAST(coalesce(sum(calls) FILTER (WHERE status IN ('ai', 'success')), 0) AS BIGINT) AS ai_calls, CAST(coalesce(sum(calls) FILTER (WHERE status = 'fallback'), 0) AS BIGINT) AS fallback_calls,
       CAST(coalesce(sum(calls) FILTER (WHERE status = 'error'), 0) AS BIGINT) AS error_calls, coalesce(CAST(sum(c4) AS BIGINT), 0) / 10000.0::DOUBLE AS estimated_cost_usd, bool_and(model IS NOT NULL) AS cost_known
FROM (SELECT feature, model, status, calls, i, o, CASE WHEN timed = calls THEN lat::DOUBLE ELSE lat * calls / greatest(timed, 1)::DOUBLE END AS w,
             CAST(round({ratio('i * pi + o * po', '100000000', 4)} * 10000) AS BIGINT) AS c4
      FROM (SELECT feature, model, status, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS lat, count(latency_ms) AS timed,
                   any_value({_PRICE(0)}) AS pi, any_value({_PRICE(1)}) AS po FROM w_calls GROUP BY 1, 2, 3)) GROUP BY feature"""


@query("t22_ai_cost", _USAGE)
def t22(spark, sf):
    return trust.ai_usage(d.model_calls(spark, sf, True), d.model_calls(spark, sf, False))


@query("t22_ai_totals", f"""
SELECT CAST(sum(calls) AS BIGINT) AS total_calls, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
       {percent('sum(ai_calls)', 'sum(calls)', 1)} AS ai_success_rate, {percent('sum(fallback_calls)', 'sum(calls)', 1)} AS fallback_rate, {percent('sum(error_calls)', 'sum(calls)', 1)} AS error_rate,
       {ratio('sum(CAST(round(estimated_cost_usd * 10000) AS BIGINT))', '10000', 2)} AS estimated_cost_usd, bool_and(cost_known) AS cost_fully_known FROM ({_USAGE})""")
def t22_totals(spark, sf):
    return trust.ai_usage_totals(trust.ai_usage(d.model_calls(spark, sf, True), d.model_calls(spark, sf, False)))


@query("t23_layer_coverage", f"""
SELECT connection_id, layer, {percent('described', 'total', 0)} AS dict_pct, {percent('least(coalesce(rc, 0), total)', 'total', 0)} AS rule_pct
FROM (SELECT connection_id, layer, count(*) AS total, count(*) FILTER (WHERE coalesce(business_name, '') <> '' OR coalesce(description, '') <> '') AS described FROM w_dict GROUP BY 1, 2)
LEFT JOIN (SELECT connection_id, layer, count(DISTINCT column_name) AS rc FROM w_rules WHERE status IN ('approved', 'active') GROUP BY 1, 2) USING (connection_id, layer)""")
def t23(spark, sf):
    return trust.layer_coverage(d.dictionary(spark, sf), d.rules(spark, sf))


@query("t24_top_anomalies", f"SELECT anomaly_id, severity, table_fqn FROM w_anoms WHERE status = 'open' {_first(3, _RANK + ', detected_at DESC, anomaly_id')}")
def t24(spark, sf):
    return trust.top_anomalies(anomaly_log(spark, sf)).select("anomaly_id", "severity", "table_fqn")


@query("t25_task_list", f"""
SELECT task_id, priority, days_overdue FROM (SELECT *, CAST(DATE '{d.AS_OF[:10]}' - due_date AS INTEGER) AS days_overdue FROM w_tasks WHERE status IN ('open', 'in_progress') AND due_date < DATE '{d.AS_OF[:10]}')""")
def t25(spark, sf):
    return trust.task_list(trust.overdue_tasks(d.tasks(spark, sf), d.as_of())).select("task_id", "priority", "days_overdue")
