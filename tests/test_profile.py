import datetime as dt
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators import history, integrity, profile
from assay.sources.windows import preset_filter, window_filter


def stats(df, **kw):
    return {r.column_name: r for r in profile.profile_columns(df, **kw).collect()}


def test_profile_of_mixed_columns(spark):
    rows = [(1, "a@b.co", 1.5, dt.datetime(2024, 1, 1)), (2, "nope", None, None), (3, None, -0.0, None), (4, "a@b.co", 0.0, None)]
    df = spark.createDataFrame(rows, "id int, mail string, x double, at timestamp")
    s = stats(df)
    assert (s["id"].distinct_count, s["id"].cardinality_ratio, s["id"].has_duplicates) == (4, 1.0, False)
    assert (s["mail"].null_count, s["mail"].null_pct, s["mail"].format_pattern) == (1, 25.0, "MIXED")
    assert s["mail"].top_values[0] == "a@b.co" and None in s["mail"].top_values
    assert s["mail"].health == "CRIT" and s["mail"].quality_score == 50.0
    assert s["x"].distinct_count == 2 and s["x"].min_num == 0.0 and s["x"].max_num == 1.5
    assert s["at"].null_pct == 75.0 and s["at"].format_pattern == "TIMESTAMP"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    s = stats(df)
    assert s["a"].null_pct == 0.0 and s["a"].distinct_count == 0 and s["a"].mean_val is None
    assert s["b"].format_pattern == "UNKNOWN" and s["b"].health == "HEALTHY"
    row = profile.score_table(profile.profile_columns(df), F.lit(0), F.lit(None)).first()
    assert row.completeness_score == 100.0


def test_nested_and_odd_columns(spark):
    schema = T.StructType([T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("m", T.MapType(T.StringType(), T.IntegerType())),
                           T.StructField("odd `name`", T.StringType()), T.StructField("a.b", T.IntegerType())])
    df = spark.createDataFrame([([1, 2], {"k": 1}, "x", 1), ([1, 2], {"k": 2}, "y", 1)], schema)
    s = stats(df)
    assert "m" not in s and s["v"].distinct_count == 1 and s["odd `name`"].distinct_count == 2 and s["a.b"].duplicate_rows == 2


def test_long_texts_come_back_whole(spark):
    long_a, long_b = "lorem " * 400, "lorem " * 400 + "x"
    df = spark.createDataFrame([(long_a,), (long_a,), (long_b,), ("short",)], "t string")
    top = {r.value: r.frequency for r in profile.top_values(df, long_text=["t"]).collect()}
    assert top == {long_a: 2, long_b: 1, "short": 1}
    assert profile.duplicate_rows(df).first().duplicate_rows == 1


def test_ties_do_not_depend_on_length_or_on_long_text(spark):
    values = [f"{i:02d}" + "x" * (i * 13 % 100) for i in range(12)] * 2 + ["z" * 200] * 3 + [None, None, ""]
    df = spark.createDataFrame([(v,) for v in values], "t string").repartition(4)
    plain = [tuple(r) for r in profile.top_values(df, 5).orderBy("rank").collect()]
    assert plain == [tuple(r) for r in profile.top_values(df, 5, long_text=["t"]).orderBy("rank").collect()]
    assert [r[2] for r in plain] == ["z" * 200] + sorted(values[:12])[:4]
    assert profile.top_values(df, None, long_text=["t"]).count() == 15


def test_dates_keep_their_form(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date")
    assert profile.top_values(df).first().value == "2024-01-01"


def test_approximate_path_counts_no_values(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}", None) for i in range(300)], "k int, s string, n double")
    approx = profile.profile_columns(df, approx=True, top_n=2)
    plan = approx._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_top_k" in plan and not re.search(r"Aggregate \[[^]]*\], \[", plan)  # global aggregates only
    rows = {r.column_name: r for r in approx.collect()}
    assert rows["s"].distinct_count == 3 and rows["s"].has_duplicates and rows["s"].duplicate_groups is None and len(rows["s"].top_values) == 2
    assert not rows["n"].has_duplicates and rows["n"].null_pct == 100.0


def test_approximate_mode_is_close(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"))
    exact, approx = stats(df)["k"].distinct_count, stats(df, approx=True)["k"].distinct_count
    assert exact == 1000 and abs(approx - exact) < 100


def test_formats_keep_tie_order(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-03",)], "d string")
    # Both DATE_ISO and PHONE match; the earlier format wins.
    assert profile.formats(df).first().format_pattern == "DATE_ISO"
    uuid = spark.createDataFrame([("123E4567-e89b-12d3-a456-426614174000",)], "u string")
    assert profile.formats(uuid, top_values_only=1).first().format_pattern == "UUID"


def test_key_candidates_and_duplicates(spark):
    df = spark.createDataFrame([(i // 2, i, "x") for i in range(10)] + [(99, 99, "y")], "order_id int, n int, c string")
    names = [r.column_name for r in profile.key_candidates(profile.profile_columns(df)).collect()]
    assert names == ["n"]
    assert [r.column_name for r in profile.key_candidates(profile.profile_columns(df), fk_like=["N"]).collect()] == []
    d = profile.key_duplicates(df, [["n"], ["order_id"], ["order_id", "c"]])
    worst = profile.worst_key_duplicate(d).first()
    assert (worst.key_columns, worst.duplicate_groups, worst.duplicate_rows) == ("order_id", 5, 10)


def test_orphans_ignore_null_and_window_children_only(spark):
    child = spark.createDataFrame([(1, 5), (2, 5), (None, 5), (9, 5), (9, 1)], "k int, day int")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    r = integrity.orphan_check(child, ["k"], parent, ["id"]).first()
    assert (r.orphan_count, r.orphan_pct) == (3, 60.0)
    r = integrity.orphan_check(child, ["k"], parent, ["id"], window=F.col("day") == 5).first()
    assert (r.orphan_count, r.orphan_pct) == (2, 50.0)


def test_fk_inference(spark):
    rows = [("s", "orders", "order_id"), ("s", "orders", "customer_id"), ("s", "orders", "box_key"), ("s", "customers", "id"),
            ("s", "boxes", "box_key"), ("s", "boxes", "id"), ("t", "customer", "customer_id"), ("s", "orders", "id")]
    got = {(r.table_name, r.column_name): (r.parent_table, r.parent_column)
           for r in integrity.infer_foreign_keys(spark.createDataFrame(rows, "schema_name string, table_name string, column_name string")).collect()}
    # The rule strips a plural s only, so a table in -es finds its own key; that never has orphans.
    assert got == {("orders", "customer_id"): ("customers", "id"), ("orders", "box_key"): ("boxes", "box_key"), ("boxes", "box_key"): ("boxes", "box_key")}


def test_risk_thresholds(spark):
    rows = [(20.0, "STRING"), (20.01, "STRING"), (5.0, "MIXED"), (5.01, "STRING")]
    st = spark.createDataFrame([(f"c{i}", p, f) for i, (p, f) in enumerate(rows)], "column_name string, null_pct double, format_pattern string")
    got = {(r.column_name, r.risk_type) for r in profile.column_risks(st).collect()}
    assert got == {("c0", "NULL_MODERATE"), ("c1", "NULL_HIGH"), ("c2", "FORMAT_MIXED"), ("c3", "NULL_MODERATE")}


def test_drift(spark):
    a = spark.createDataFrame([("id", "int"), ("old", "string"), ("amt", "double")], "column_name string, data_type string")
    b = spark.createDataFrame([("id", "INT"), ("new", "string"), ("amt", "bigint")], "column_name string, data_type string")
    s = history.drift_summary(history.schema_drift(a, b)).first()
    assert (s.has_drift, s.added, s.dropped, s.type_changed) == (True, ["new"], ["old"], ["amt"])
    assert history.drift_summary(history.schema_drift(a, a)).first().has_drift is False


def test_windows(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 2, 3)], "ts timestamp_ntz")
    part, partial = window_filter(df, "TS", "2024-01-02", "2024-01-03")
    assert partial and part.count() == 1
    assert window_filter(df, "gone", "2024-01-02") == (df, False) and window_filter(df, "ts") == (df, False)
    runs = spark.createDataFrame([], "run_at timestamp")
    assert preset_filter(df, "ts", "since_last", "2024-01-03 00:00:00", runs).count() == 2
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan(window_filter(
        spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderdate", "1998-01-01")[0])


def plan(df):
    return df._jdf.queryExecution().toString()


def test_minimal_keys_and_dependencies_equal_brute_force(spark):
    import itertools
    import random

    from assay.operators import keys

    rng = random.Random(3)
    rows = [(i // 4, i % 4, rng.randrange(3), f"n{i // 4}", None if i == 5 else i, 1.0, rng.choice([0.0, -0.0, 2.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "head int, line int, small int, name string, holes int, same double, `odd.name` double").repartition(4)
    names = [f.name for f in df.schema.fields]
    groups = lambda s: len({tuple(r[names.index(c)] for c in s) for r in rows})
    filled = [c for c in names if c != "holes"]
    unique = []
    for size in (1, 2, 3):
        unique += [s for s in itertools.combinations(filled, size) if groups(s) == len(rows) and not any(set(k) <= set(s) for k in unique)]
    assert keys.minimal_keys(df) == unique and ("head", "line") in unique and ("line", "name") in unique
    found = set(keys.dependencies(df))
    varied = [c for c in names if c != "same"]
    assert found == {((x,), a) for x in varied if groups((x,)) < len(rows) for a in varied if a != x and groups((x, a)) == groups((x,))} == {(("head",), "name"), (("name",), "head")}
    two = set(keys.dependencies(df, 2))
    assert found <= two and all(groups(x) == groups((*x, a)) for x, a in two)
    suggested = {r.rule_type: r.check_args for r in keys.key_rules(spark, [("head", "line")], [(("head",), "name")]).collect()}
    assert suggested == {"UNIQUE": '{"columns": ["head", "line"]}', "DEPENDENCY": '{"columns": ["head"], "value": "name"}'}
    assert keys.minimal_keys(df.limit(0)) == [] and keys.dependencies(df.limit(0)) == []
