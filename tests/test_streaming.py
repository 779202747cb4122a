import datetime as dt
import time

from assay.streaming import events as ev

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, k int, v int"


def put(spark, path, rows, n):
    spark.createDataFrame([(T0 + dt.timedelta(minutes=m), k, v) for m, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    put(spark, src, [(1, 1, 5), (2, 1, None), (90, 1, 1)], 1)
    s = lambda: ev.last_seen(ev.file_stream(spark, src, SCHEMA), "ts", "k", "1 hour", "10 minutes")
    ev.to_parquet(s(), out, state).awaitTermination()
    put(spark, src, [(3, 1, 9), (200, 1, 1)], 2)
    late = ev.LateRows()
    spark.streams.addListener(late)
    q = ev.to_parquet(s(), out, state)
    q.awaitTermination()
    for _ in range(100):  # events arrive a little later
        if q.id in late.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.totals[q.id] == 1
    got = sorted((r.window_start.hour, r.events) for r in spark.read.parquet(out).collect())
    assert got == [(0, 2), (1, 1)]


def test_open_windows_are_current(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    s = lambda: ev.last_seen(ev.file_stream(spark, src, SCHEMA), "ts", "k", "1 hour", "10 minutes")
    for rows in ([(1, 1, 5), (2, 2, 5)], [(30, 1, 5)], [(70, 1, 5)]):
        put(spark, src, rows, 1)
        ev.keep_updates(s(), out, state).awaitTermination()
    got = {(r.window_start.hour, r.k): (r.last_seen.minute, r.events) for r in ev.current_rows(spark, out, ["window_start", "k"]).collect()}
    assert got == {(0, 1): (30, 2), (0, 2): (2, 1), (1, 1): (10, 1)}


def entities(spark, src, out, state, **options):
    s = ev.entity_freshness(ev.file_stream(spark, src, SCHEMA), "ts", "k", dt.timedelta(hours=1), "10 minutes", **options)
    ev.keep_updates(s, out, state).awaitTermination()
    return {r.k: (int((r.last_seen - T0).total_seconds() // 60), r.overdue) for r in ev.current_rows(spark, out, ["k"]).collect()}


def test_silence_raises_a_row(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    put(spark, src, [(0, 1, 5), (5, 1, 5), (5, 2, 5), (0, None, 1)], 1)
    assert entities(spark, src, out, state) == {1: (5, False), 2: (5, False)}
    put(spark, src, [(75, 2, 5)], 2)  # the watermark is exactly an hour after the last row of 1
    assert entities(spark, src, out, state) == {1: (5, False), 2: (75, False)}
    put(spark, src, [(76, 3, 5)], 3)
    assert entities(spark, src, out, state) == {1: (5, True), 2: (75, False), 3: (76, False)}
    put(spark, src, [(80, 1, 5), (6, 1, 5)], 4)  # back again; a late row does not move it
    assert entities(spark, src, out, state) == {1: (80, False), 2: (75, False), 3: (76, False)}
    put(spark, src, [(400, 3, 5)], 5)
    assert entities(spark, src, out, state) == {1: (80, True), 2: (75, True), 3: (400, False)}


def test_forgotten_entities_leave_the_state(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    for m in (0, 100, 1000, 1001, 2000):
        put(spark, src, [(m, 1 if m == 0 else 2, 5)], 1)
        got = entities(spark, src, out, state, forget=dt.timedelta(hours=5))
    assert got == {1: (0, True), 2: (2000, False)}
    rows = [r.asDict(True) for r in spark.read.format("statestore").load(state).collect()]
    assert [r["key"]["k"] for r in rows] == [2]


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    s = lambda: ev.last_seen(ev.file_stream(spark, src, SCHEMA), "ts", "k", "1 hour", "10 minutes")
    current = lambda: {(r.window_start.hour, r.k): (r.last_seen.minute, r.events) for r in ev.current_rows(spark, out, ["window_start", "k"]).collect()}
    for n, rows in enumerate([[(1, 1, 5), (2, 2, 5)], [(30, 1, 5)], [(40, 2, 5), (70, 1, 5)], [(75, 1, 5)]]):
        put(spark, src, rows, 1)
        ev.keep_updates(s(), out, state, keys=["window_start", "k"], compact_every=3).awaitTermination()
        (tmp_path / "out" / "batch_id=99").mkdir(exist_ok=True)  # a batch that was never finished does not count
    assert current() == {(0, 1): (30, 2), (0, 2): (40, 2), (1, 1): (15, 2)}
    assert len(list((tmp_path / "out").glob("_merged-*"))) >= 1
    before = current()
    for _ in range(2):
        ev.compact(spark, out, ["window_start", "k"])
        assert current() == before
    assert len(list((tmp_path / "out").glob("_merged-*"))) == 1
    assert [p.name for p in (tmp_path / "out").glob("batch_id=*")] == ["batch_id=99"]


def test_batches_are_checked_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    put(spark, src, [(1, 1, 5), (2, 1, None)], 1)
    rules = {"has_v": "v IS NOT NULL", "big": "v > 4"}
    ev.check_stream(ev.file_stream(spark, src, SCHEMA), rules, out, state).awaitTermination()
    put(spark, src, [(3, 2, 1)], 2)
    ev.check_stream(ev.file_stream(spark, src, SCHEMA), rules, out, state).awaitTermination()
    got = {(r.batch_id, r.rule_id): (r.total_records, r.failed_records) for r in spark.read.parquet(out).collect()}
    assert got == {(0, "has_v"): (2, 1), (0, "big"): (2, 1), (1, "has_v"): (1, 0), (1, "big"): (1, 1)}


def test_windowed_profile_counts_nulls(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    put(spark, src, [(1, 1, 5), (2, 1, None), (3, 2, 5), (500, 1, 1)], 1)
    ev.to_parquet(ev.windowed_profile(ev.file_stream(spark, src, SCHEMA), "ts", "1 hour", "1 minute", ["k", "v"]), out, state).awaitTermination()
    got = {r.column_name: (r.row_count, r.null_count, r.approx_distinct, r.null_pct) for r in spark.read.parquet(out).collect()}
    assert got == {"k": (3, 0, 2, 0.0), "v": (3, 1, 1, 33.33)}
