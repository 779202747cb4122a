import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from assay.operators import anomaly
from assay.operators.relational import previous_run

DAY = dt.datetime(2024, 3, 1)
REPORT = "connection_id string, table_fqn string, layer string, run_at timestamp, row_count bigint"
STAT = "connection_id string, table_fqn string, layer string, run_at timestamp, column_name string, null_pct double, mean_value double"


def volumes(spark, counts, table="raw.t"):
    return spark.createDataFrame([("c", table, "RAW", DAY + dt.timedelta(days=i), n) for i, n in enumerate(counts)], REPORT)


def test_volume_drop(spark):
    hit = anomaly.detect_volume(volumes(spark, [4320, 4200, 4380, 4250, 4300, 450])).collect()
    assert len(hit) == 1
    assert (hit[0].severity, hit[0].baseline_value, hit[0].deviation_pct, hit[0].metric_value) == ("CRITICAL", 4290.0, -89.5, 450.0)
    assert hit[0].description == "Fewer rows than usual: 450 where recent runs had about 4,290, 90% off"


def test_needs_three_baseline_runs(spark):
    assert anomaly.detect_volume(volumes(spark, [100, 100, 900])).count() == 0
    assert anomaly.detect_volume(volumes(spark, [100, 100, 100, 900])).count() == 1


def test_stable_baseline_needs_the_percent_floor(spark):
    assert anomaly.detect_volume(volumes(spark, [1000] * 5 + [1003])).count() == 0
    loose = spark.createDataFrame([("c", 0.0, None, None)], "connection_id string, vol_pct double, dist_pct double, freshness_hours double")
    assert anomaly.detect_volume(volumes(spark, [1000] * 5 + [1003]), loose).first().severity == "HIGH"


def test_seeded_history_of_four_tables(spark):
    reports, stats = [], []
    tables = {"customers": (27, 500, {"email": (3.70, 42.0, None, None), "country": (3.70, 0.37, None, None)}),
              "payments": (3804, 400, {"amount": (0.0, 0.0, 2200.0, 1040.0)}),
              "items": (9004, 600, {"quantity": (0.0, 0.0, 3.0, 1.84), "line_total": (0.0, 0.0, 5800.0, 3480.0)}),
              "orders": (4006, 280, {"net": (0.0, 0.0, 2100.0, 2120.0), "gross": (0.0, 0.0, 2400.0, 2380.0)})}
    for name, (base, injected, cols) in tables.items():
        for d in range(7, -1, -1):
            at = DAY - dt.timedelta(days=d)
            reports.append(("c", name, "RAW", at, base + injected if d == 0 else int(base * (1 + ((d % 3) - 1) * 0.02))))
            for col, (n0, n1, m0, m1) in cols.items():
                stats.append(("c", name, "RAW", at, col, n1 if d == 0 else n0, m1 if d == 0 else m0))
    r, s = spark.createDataFrame(reports, REPORT), spark.createDataFrame(stats, STAT)
    assert [x.table_fqn for x in anomaly.detect_volume(r).collect()] == ["customers"]
    nulls = anomaly.detect_null_rate(s).collect()
    assert [(x.column_name, x.severity) for x in nulls] == [("email", "CRITICAL")]
    means = {x.column_name: x.deviation_pct for x in anomaly.detect_metric(s).collect()}
    assert means == {"amount": -52.7, "line_total": -40.0}


def test_null_history_counts_missing_as_zero_and_zero_never_fires(spark):
    rows = [("c", "t", "RAW", DAY + dt.timedelta(days=i), "x", p, None) for i, p in enumerate([None, None, None, 8.0])]
    assert anomaly.detect_null_rate(spark.createDataFrame(rows, STAT)).first().severity == "HIGH"
    rows[-1] = (*rows[-1][:5], 0.0, None)
    assert anomaly.detect_null_rate(spark.createDataFrame(rows, STAT)).count() == 0


def test_freshness(spark):
    as_of = F.lit("2024-03-03 00:00:00").cast("timestamp")
    old = anomaly.detect_freshness(volumes(spark, [1]), as_of).first()
    assert (old.severity, old.metric_value, old.deviation_pct) == ("MEDIUM", 48.0, 100.0)
    assert anomaly.detect_freshness(volumes(spark, [1, 1, 1]), as_of).count() == 0


def test_whole_history_equals_plain_python(spark):
    rng = random.Random(3)
    rows, expected = [], set()
    for t in range(4):
        counts = [rng.randint(1, 12) for _ in range(150)]
        for i, n in enumerate(counts):
            at = DAY + dt.timedelta(days=i * (1 if t < 3 else 40))
            rows.append(("c", f"t{t}", "RAW", at, n))
            base = counts[max(0, i - 7):i]
            if len(base) >= 3:
                mean, sd = statistics.mean(base), statistics.stdev(base) or 1
                if abs(round((n - mean) / sd, 9)) >= 2 and abs(n - mean) / max(mean, 1) * 100 >= 29.95:
                    expected.add((f"t{t}", at))
    got = anomaly.detect_volume(spark.createDataFrame(rows, REPORT), latest_only=False).collect()
    assert {(x.table_fqn, x.detected_at) for x in got} == expected


def test_previous_run_across_months(spark):
    df = volumes(spark, list(range(100)))
    got = {r.row_count: r.prev_row_count for r in previous_run(df, ["table_fqn"], "run_at", ["row_count"]).collect()}
    assert got == {i: (i - 1 if i else None) for i in range(100)}


def test_silent_segment_counts_zero(spark):
    rows = [("a", DAY + dt.timedelta(days=i)) for i in range(10) for _ in range(20)] + [("b", DAY + dt.timedelta(days=i)) for i in range(9) for _ in range(20)]
    h = anomaly.segment_history(spark.createDataFrame(rows, "seg string, ts timestamp"), "seg", "ts")
    hit = anomaly.detect_segment(h, "c", "t", "RAW").collect()
    assert [(x.segment, x.metric_value, x.share_pct) for x in hit] == [("b", 0.0, 0.0)]


def test_inbox_refreshes_open_anomalies(spark):
    old = anomaly.detect_volume(volumes(spark, [100, 101, 99, 100, 900]))
    new = anomaly.detect_volume(volumes(spark, [100, 101, 99, 100, 100, 950]))
    saved = anomaly.save_anomalies(old, new).collect()
    assert [(r.metric_value, r.is_new) for r in saved] == [(950.0, False)]
    assert saved[0].anomaly_id == old.first().anomaly_id
    closed = anomaly.save_anomalies(old.withColumn("status", F.lit("acknowledged")), new).collect()
    assert sorted((r.status, r.is_new) for r in closed) == [("acknowledged", False), ("open", True)]


def test_fingerprints_need_a_note_and_are_new(spark):
    acked = anomaly.detect_volume(volumes(spark, [100, 101, 99, 100, 900])).withColumn("acknowledged_by", F.lit("me"))
    none = spark.createDataFrame([], "connection_id string, related_table string, resolution string")
    as_of = F.lit("2024-03-09").cast("timestamp")
    assert anomaly.fingerprints_from(acked.withColumn("ack_note", F.lit("  ")), none, as_of).count() == 0
    fp = anomaly.fingerprints_from(acked.withColumn("ack_note", F.lit(" reload ")), none, as_of)
    assert (fp.first().resolution, fp.first().incident_day) == ("reload", "Saturday")
    assert anomaly.fingerprints_from(acked.withColumn("ack_note", F.lit("reload")), fp, as_of).count() == 0


def test_trailing_rows_of_sparse_and_dense_units(spark):
    """Months with one run and with twenty give what one window per key gives; the former take no part in windows inside months."""
    from assay.operators.relational import trailing

    days = [f"2023-{m:02d}-01" for m in range(1, 9)] + [f"2023-09-{d:02d}" for d in range(1, 21)] + ["2023-10-05", "2023-12-01"]
    rows = [(k, d, (i * 7 + len(k)) % 11) for k in ("a", "bb") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "k string, d string, v int").withColumn("at", F.to_timestamp("d"))
    out = trailing(df, ["k"], "at", 3, {"total": lambda w: F.sum("v").over(w)})
    got = {(r.k, r.d): r.total for r in out.collect()}
    by_key = {k: [v for key, _, v in rows if key == k] for k in ("a", "bb")}
    assert len(rows) == len(got) == out.count()
    assert got == {(k, d): sum(vs[max(0, i - 3):i]) if i else None for k, vs in by_key.items() for i, d in enumerate(days)}
    assert "_size" in out._jdf.queryExecution().optimizedPlan().toString().split("sum(v")[1].split("Window [count")[0].split("Filter")[1]


def test_newest_runs_are_hashed_before_they_are_compared(spark):
    from assay.operators import trust

    rows = [("x", "r1", "2024-01-01"), ("x", "r2", "2024-01-03"), ("x", "r1", "2024-01-02"), ("x", "r3", "2024-01-03"), ("y", "r9", None), ("y", "r8", None), (None, "r1", "2024-01-01")]
    results = spark.createDataFrame(rows, "connection_id string, run_id string, at string").withColumn("run_timestamp", F.to_timestamp("at"))
    newest = trust.latest_runs(results)
    assert {(r.connection_id, r.run_id) for r in newest.collect()} == {("x", "r3"), ("y", "r9"), (None, "r1")}
    assert "max(run_timestamp" in newest._jdf.queryExecution().optimizedPlan().toString()


def test_reasons_read_the_log_that_was_written(spark, sf):
    """The detectors of the whole history run once, not once for each use of the log."""
    from workbench import load

    plan = load().QUERIES["i10_reasons"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev" not in plan
