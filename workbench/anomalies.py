"""Anomaly queries (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import anomaly
from workbench import derived as d
from workbench.registry import cte, query, ratio, table

_OUT = "anomaly_id, connection_id, table_fqn, column_name, anomaly_type, severity, metric_value, baseline_value, deviation_pct"


def _window(source: str, keys: str, value: str, where: str = "TRUE") -> str:
    return f"""SELECT *, count(v) OVER w AS bn, sum(v) OVER w AS bs, avg(v) OVER w AS bm, stddev_samp(v) OVER w AS bsd, CAST(sum(CAST(round(v * 10000) AS BIGINT)) OVER w AS BIGINT) AS bs4,
       row_number() OVER (PARTITION BY {keys} ORDER BY run_at DESC) AS newest
FROM (SELECT *, {value} AS v FROM {source} WHERE {where})
WINDOW w AS (PARTITION BY {keys} ORDER BY run_at ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


def _id(kind: str, column: str) -> str:
    return f"sha256('{kind}|' || connection_id || '|' || table_fqn || '|' || {column} || '|' || strftime(run_at, '%Y-%m-%d %H:%M:%S'))"


_OFF = ratio("100 * (bn * v - bs)", "greatest(bs, bn)", 1)


def _z(floor: str) -> str:
    return f"round((v - bm) / CASE WHEN bsd = 0 THEN {floor} ELSE bsd END, 9)"


def volume_sql(source: str, latest: bool, pct: str = "30") -> str:
    return f"""SELECT {_id('VOLUME', "''")} AS anomaly_id, connection_id, run_at AS detected_at, layer, table_fqn, NULL::VARCHAR AS column_name,
       'VOLUME' AS anomaly_type, CASE WHEN abs({_z('1')}) > 3 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
       v::DOUBLE AS metric_value, {ratio('bs', 'bn', 0)} AS baseline_value, {_OFF} AS deviation_pct,
       CASE WHEN v < bm THEN 'Fewer' ELSE 'More' END || ' rows than usual: ' || format('{{:,}}', v) || ' where recent runs had about '
         || format('{{:,}}', CAST(floor(bm) AS BIGINT)) || ', ' || format('{{:,}}', CAST(round(abs({_OFF})) AS BIGINT)) || '% off' AS description
FROM ({_window(source, 'connection_id, table_fqn', 'CAST(row_count AS BIGINT)')})
WHERE bn >= 3 AND abs({_z('1')}) >= 2 AND abs({_OFF}) >= {pct}{' AND newest = 1' if latest else ''}"""


def null_sql(source: str, latest: bool) -> str:
    return f"""SELECT {_id('DISTRIBUTION', 'column_name')} AS anomaly_id, connection_id, run_at AS detected_at, layer, table_fqn, column_name,
       'DISTRIBUTION' AS anomaly_type, CASE WHEN v > 1000 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
       v / 100.0::DOUBLE AS metric_value, {ratio('bs', 'bn * 100', 2)} AS baseline_value, {_OFF} AS deviation_pct,
       column_name || ' null rate' AS description
FROM ({_window(source, 'connection_id, table_fqn, column_name', 'CAST(round(coalesce(null_pct, 0) * 100) AS BIGINT)')})
WHERE bn >= 3 AND v > 0 AND {_z('50')} >= 2 AND {_OFF} >= 20{' AND newest = 1' if latest else ''}"""


def metric_sql(source: str, latest: bool) -> str:
    w4 = "CAST(round(v * 10000) AS BIGINT)"
    off = ratio(f"100 * (bn * {w4} - bs4)", "greatest(abs(bs4), 10000 * bn)", 1)
    return f"""SELECT {_id('THRESHOLD', 'column_name')} AS anomaly_id, connection_id, run_at AS detected_at, layer, table_fqn, column_name,
       'THRESHOLD' AS anomaly_type, CASE WHEN abs({_z('1')}) > 3 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
       v AS metric_value, {ratio('bs4', '10000 * bn', 2)} AS baseline_value, {off} AS deviation_pct, column_name || ' moved' AS description
FROM ({_window(source, 'connection_id, table_fqn, column_name', 'mean_value', 'mean_value IS NOT NULL')})
WHERE bn >= 3 AND abs({_z('1')}) >= 2 AND abs({off}) >= 30{' AND newest = 1' if latest else ''}"""


def freshness_sql(source: str, now: str, sla: str = "24") -> str:
    age = f"(epoch(TIMESTAMP '{now}') - epoch(run_at)) / 3600.0::DOUBLE"
    return f"""SELECT {_id('FRESHNESS', "''")} AS anomaly_id, connection_id, run_at AS detected_at, layer, table_fqn, NULL::VARCHAR AS column_name,
       'FRESHNESS' AS anomaly_type, CASE WHEN {age} > 2 * {sla} THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       round({age}, 1) AS metric_value, {sla}::DOUBLE AS baseline_value, round(({age} - {sla}) / {sla} * 100, 1) AS deviation_pct, 'stale' AS description
FROM (SELECT connection_id, table_fqn, arg_max(layer, run_at) AS layer, max(run_at) AS run_at FROM {source} GROUP BY 1, 2)
WHERE {age} > {sla}"""


cte("w_anoms", f"""
SELECT *, CASE WHEN detected_at >= TIMESTAMP '2001-01-01' THEN 'open' ELSE 'acknowledged' END AS status FROM (
{volume_sql('w_reports', False)}
UNION ALL BY NAME {null_sql('w_stats', False)}
UNION ALL BY NAME {metric_sql('w_stats', False)})
""")


def anomaly_log(spark, sf, base=None):
    """Anomalies of every past month; those of the last year are still open."""
    base = d.stage(d.monthly(spark, sf)) if base is None else base
    reports, stats = d.reports(spark, sf, base), d.column_stats(spark, sf, base)
    found = (anomaly.detect_volume(reports, latest_only=False)
             .unionByName(anomaly.detect_null_rate(stats, latest_only=False))
             .unionByName(anomaly.detect_metric(stats, latest_only=False)))
    return found.withColumn("status", F.when(F.col("detected_at") >= d.as_of("2001-01-01"), "open").otherwise("acknowledged"))


def _pick(df, names=_OUT):
    return df.select(*[c.strip() for c in names.split(",")])


def _event_columns(spark, sf):
    return d.event_days(spark, sf).withColumn("column_name", F.lit("value"))


_EVENT_COLS = "(SELECT *, 'value' AS column_name FROM w_event_days)"


@query("a1_volume_events", f"SELECT {_OUT}, description FROM ({volume_sql('w_event_days', False, '1')})")
def a1(spark, sf):
    """Every day against the seven before it, with a 1 % floor so that quiet data still fires."""
    loose = d.event_days(spark, sf).select("connection_id").distinct().select(
        "connection_id", F.lit(1.0).alias("vol_pct"), F.lit(None).cast("double").alias("dist_pct"), F.lit(None).cast("double").alias("freshness_hours"))
    return _pick(anomaly.detect_volume(d.event_days(spark, sf), loose, latest_only=False), _OUT + ", description")


@query("a1_volume_latest", f"SELECT {_OUT} FROM ({volume_sql('w_reports', True)})")
def a1_latest(spark, sf):
    return _pick(anomaly.detect_volume(d.reports(spark, sf)))


@query("a2_null_rate_events", f"SELECT {_OUT} FROM ({null_sql(_EVENT_COLS, False)})")
def a2(spark, sf):
    return _pick(anomaly.detect_null_rate(_event_columns(spark, sf), latest_only=False))


@query("a3_metric_events", f"SELECT {_OUT} FROM ({metric_sql('w_stats', False)})")
def a3(spark, sf):
    return _pick(anomaly.detect_metric(d.column_stats(spark, sf), latest_only=False))


@query("a4_freshness", f"SELECT {_OUT} FROM ({freshness_sql('w_reports', d.AS_OF)})")
def a4(spark, sf):
    return _pick(anomaly.detect_freshness(d.reports(spark, sf), d.as_of()))


@query("a5_scan", f"SELECT {_OUT} FROM ({freshness_sql('w_reports', d.AS_OF)} UNION ALL BY NAME {volume_sql('w_reports', True)} "
       f"UNION ALL BY NAME {null_sql('w_stats', True)} UNION ALL BY NAME {metric_sql('w_stats', True)})")
def a5(spark, sf):
    base = d.stage(d.monthly(spark, sf))
    return _pick(anomaly.scan(d.reports(spark, sf, base), d.column_stats(spark, sf, base), d.as_of()))


_SEG = f"""
WITH c AS (SELECT event_type AS segment, date_trunc('hour', ts) AS run_at, count(*) AS rows FROM events WHERE user_id < 5000000 GROUP BY 1, 2),
cal AS (SELECT segment, p AS run_at FROM (SELECT DISTINCT segment FROM c),
        (SELECT unnest(generate_series(min(run_at), max(run_at), INTERVAL 1 HOUR)) AS p FROM c)),
f AS (SELECT cal.segment, cal.run_at, coalesce(c.rows, 0) AS rows FROM cal LEFT JOIN c USING (segment, run_at)),
h AS (SELECT segment, run_at, rows AS row_count, CAST(sum(rows) OVER (PARTITION BY run_at) AS BIGINT) AS all_rows, 'conn_e' AS connection_id,
             'bronze.events/' || segment AS table_fqn, 'BRONZE' AS layer FROM f)
SELECT a.table_fqn, strftime(a.detected_at, '%Y-%m-%d %H') AS period, h.segment, a.severity, a.metric_value, a.deviation_pct,
       {ratio('100 * h.row_count', 'h.all_rows', 2)} AS share_pct, 'SEGMENT' AS anomaly_type
FROM ({volume_sql('h', False)}) a JOIN h ON h.table_fqn = a.table_fqn AND h.run_at = a.detected_at"""


@query("a6_segment_events", _SEG.replace(" WHERE user_id < 5000000", ""))
def a6(spark, sf):
    h = anomaly.segment_history(table(spark, sf, "events"), "event_type", "ts", "hour")
    out = anomaly.detect_segment(h, "conn_e", "bronze.events", "BRONZE", latest_only=False)
    return out.select("table_fqn", F.date_format("detected_at", "yyyy-MM-dd HH").alias("period"), "segment", "severity",
                      "metric_value", "deviation_pct", "share_pct", "anomaly_type")


_TH = "(SELECT DISTINCT connection_id, CASE WHEN connection_id = 'conn_1' THEN 60.0::DOUBLE END AS vol_pct FROM w_tables)"


@query("a7_thresholds", f"""
SELECT a.anomaly_id, a.table_fqn, a.deviation_pct, coalesce(t.vol_pct, 30.0::DOUBLE) AS vol_pct
FROM ({volume_sql('w_reports', False, '0')}) a LEFT JOIN {_TH} t USING (connection_id)
WHERE abs(a.deviation_pct) >= coalesce(t.vol_pct, 30.0)""")
def a7(spark, sf):
    th = d.tables(spark, sf).select("connection_id").distinct().select(
        "connection_id", F.when(F.col("connection_id") == "conn_1", 60.0).alias("vol_pct"),
        F.lit(None).cast("double").alias("dist_pct"), F.lit(None).cast("double").alias("freshness_hours"))
    hits = anomaly.detect_volume(d.reports(spark, sf), th, latest_only=False)
    return anomaly.with_thresholds(hits, th).select("anomaly_id", "table_fqn", "deviation_pct", "vol_pct")


_NEW = f"""(SELECT * FROM ({volume_sql('w_reports', True)}) UNION ALL BY NAME SELECT * FROM ({null_sql('w_stats', True)}) UNION ALL BY NAME SELECT * FROM ({metric_sql('w_stats', True)}))"""


@query("a8_dedupe", f"""
WITH det AS {_NEW},
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, table_fqn, coalesce(column_name, ''), anomaly_type, status ORDER BY detected_at, anomaly_id) AS rn
        FROM w_anoms) WHERE rn = 1),
k AS (SELECT o.*, n.anomaly_id AS n_id, n.detected_at AS n_at, n.severity AS n_sev, n.metric_value AS n_mv FROM old o LEFT JOIN det n
      ON o.status = 'open' AND n.connection_id = o.connection_id AND n.table_fqn = o.table_fqn
         AND coalesce(n.column_name, '') = coalesce(o.column_name, '') AND n.anomaly_type = o.anomaly_type)
SELECT anomaly_id, table_fqn, anomaly_type, CASE WHEN n_id IS NULL THEN severity ELSE n_sev END AS severity,
       CASE WHEN n_id IS NULL THEN metric_value ELSE n_mv END AS metric_value,
       strftime(CASE WHEN n_id IS NULL THEN detected_at ELSE n_at END, '%Y-%m-%d') AS detected_on, status, FALSE AS is_new FROM k
UNION ALL
SELECT anomaly_id, table_fqn, anomaly_type, severity, metric_value, strftime(detected_at, '%Y-%m-%d'), 'open', TRUE FROM det n
WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.status = 'open' AND n.connection_id = o.connection_id AND n.table_fqn = o.table_fqn
                  AND coalesce(n.column_name, '') = coalesce(o.column_name, '') AND n.anomaly_type = o.anomaly_type)""")
def a8(spark, sf):
    from assay.operators.relational import latest_per_key
    base = d.stage(d.monthly(spark, sf))
    log = d.stage(anomaly_log(spark, sf, base))
    log = latest_per_key(log.withColumn("_c", F.coalesce("column_name", F.lit(""))),
                         ["connection_id", "table_fqn", "_c", "anomaly_type", "status"],
                         [F.asc("detected_at"), F.asc("anomaly_id")]).drop("_c")
    stats = d.column_stats(spark, sf, base)
    fresh = anomaly.detect_volume(d.reports(spark, sf, base)).unionByName(anomaly.detect_null_rate(stats)).unionByName(anomaly.detect_metric(stats))
    return anomaly.save_anomalies(log, d.stage(fresh)).select(
        "anomaly_id", "table_fqn", "anomaly_type", "severity", "metric_value",
        F.date_format("detected_at", "yyyy-MM-dd").alias("detected_on"), "status", "is_new")


def fingerprints(spark, sf, log=None):
    log = (anomaly_log(spark, sf) if log is None else log).filter("status = 'acknowledged'")
    noted = (log.withColumn("ack_note", F.when(F.col("severity") == "CRITICAL", F.concat(F.lit(" reload "), F.lower("anomaly_type"), F.lit(" "))))
             .withColumn("acknowledged_by", F.lit("ana@example.com")))
    known = d.tables(spark, sf).filter("layer = 'RAW'").select(
        "connection_id", F.col("table_fqn").alias("related_table"), F.lit("reload volume").alias("resolution"))
    return anomaly.fingerprints_from(noted, known, d.as_of())


cte("w_fp", f"""
SELECT connection_id, 100 AS similarity_pct, DATE '{d.AS_OF[:10]}' AS incident_date, 'Monday' AS incident_day, anomaly_type, table_fqn AS related_table, resolution,
       'ana@example.com' AS resolved_by
FROM (SELECT *, 'reload ' || lower(anomaly_type) AS resolution,
             row_number() OVER (PARTITION BY connection_id, table_fqn, anomaly_type ORDER BY detected_at, anomaly_id) AS rn
      FROM w_anoms WHERE status = 'acknowledged' AND severity = 'CRITICAL')
WHERE rn = 1 AND NOT (lower(split_part(table_fqn, '.', 1)) = 'raw' AND anomaly_type = 'VOLUME')
""")


@query("a9_inbox", """
WITH h AS (SELECT connection_id, table_fqn, string_agg(CAST(row_count AS VARCHAR), ',' ORDER BY run_at) AS hist FROM (
  SELECT *, row_number() OVER (PARTITION BY connection_id, table_fqn ORDER BY run_at DESC) AS rn FROM w_reports) WHERE rn <= 7 GROUP BY 1, 2)
SELECT a.anomaly_id, a.table_fqn, a.severity, CASE WHEN a.anomaly_type = 'VOLUME' THEN h.hist END AS history_values,
       EXISTS (SELECT 1 FROM w_fp f WHERE f.connection_id = a.connection_id AND f.related_table = a.table_fqn) AS has_fingerprint
FROM w_anoms a LEFT JOIN h USING (connection_id, table_fqn) WHERE a.status = 'open'""")
def a9(spark, sf):
    base = d.stage(d.monthly(spark, sf))
    log = d.stage(anomaly_log(spark, sf, base))
    box = anomaly.inbox(log, d.reports(spark, sf, base), fingerprints(spark, sf, log))
    return box.select("anomaly_id", "table_fqn", "severity", F.array_join("history_values", ",").alias("history_values"), "has_fingerprint")


@query("a10_fingerprints", "SELECT connection_id, CAST(similarity_pct AS INTEGER) AS similarity_pct, incident_day, resolution, resolved_by, related_table FROM w_fp")
def a10(spark, sf):
    return fingerprints(spark, sf).select("connection_id", "similarity_pct", "incident_day", "resolution", "resolved_by", "related_table")


@query("a11_fingerprint_list", "SELECT related_table, resolution, CAST(similarity_pct AS INTEGER) AS similarity_pct FROM w_fp ORDER BY similarity_pct DESC, incident_date DESC, related_table, resolution")
def a11(spark, sf):
    return anomaly.fingerprint_list(fingerprints(spark, sf)).select("related_table", "resolution", "similarity_pct")


@query("a12_explanations", """
SELECT anomaly_id, layer || ' / ' || table_fqn AS where_found, strftime(detected_at, '%b %d, %Y %H:%M UTC') AS first_seen,
       'Severity: ' || severity AS how_bad,
       CASE anomaly_type
         WHEN 'VOLUME' THEN 'A ' || lower(severity) || ' change in the volume of ' || table_fqn || ' (' || layer || ' layer), ' || dev || ' against its baseline: consumers may be reading incomplete or stale data.'
         WHEN 'DISTRIBUTION' THEN 'Columns of ' || table_fqn || ' (' || layer || ' layer) moved ' || dev || ' from their baseline: decisions and models built on them may be biased.'
         ELSE 'A ' || lower(severity) || ' threshold breach on ' || table_fqn || ' (' || layer || ' layer), ' || dev || ' deviation: reports and pipelines downstream may be affected.' END AS why_it_matters
FROM (SELECT *, CASE WHEN deviation_pct >= 0 THEN '+' ELSE '-' END || format('{:,.1f}', abs(deviation_pct)) || '%' AS dev FROM w_anoms WHERE status = 'open')""")
def a12(spark, sf):
    out = anomaly.explain(anomaly_log(spark, sf).filter("status = 'open'"))
    return out.select("anomaly_id", "where_found", "first_seen", "how_bad", "why_it_matters")
