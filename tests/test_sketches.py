"""Sketches of a window against the exact profile of its rows, and inclusions against joins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from assay.operators import integrity, sketches
from test_reachability import jobs_of

ROWS = "id long, who int, amount double, kind string, note string, at timestamp"


def rows():
    rng = random.Random(12)
    out = []
    for i in range(30_000):
        kind = rng.choice(["a"] * 6 + ["b"] * 3 + ["c"])
        note = None if i % 7 == 0 else f"note {rng.randrange(12_000)}" + " long" * 30 * (i % 3 == 0)
        out.append((i, rng.randrange(4000), None if i % 10 == 0 else rng.gauss(50, 20), kind, note, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)))
    return out


def test_a_window_is_merged_within_the_bounds(spark, tmp_path):
    df = spark.createDataFrame(rows(), ROWS).repartition(5)
    half = df.filter("at < '2024-01-10'")
    sketches.save_sketches(sketches.sketch_columns(half, "s.t", "at"), f"{tmp_path}/store")
    sketches.save_sketches(sketches.sketch_columns(df.filter("at >= '2024-01-09'"), "s.t", "at"), f"{tmp_path}/store")  # the ninth is done again
    store = spark.read.parquet(f"{tmp_path}/store")
    merged = sketches.window_profile(store, "2024-01-03", "2024-01-18", top=3)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "store" in plan and "day" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    inside = df.filter("at >= '2024-01-03' AND at < '2024-01-18'").cache()
    n = inside.count()
    got = {r.column_name: r for r in merged.collect()}
    assert set(got) == set(df.columns)
    for c, r in got.items():
        exact = inside.agg(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("distinct")).first()
        assert (r.row_count, r.null_count) == (n, exact.nulls)
        assert abs(r.distinct_count - exact.distinct) <= max(1, 4 * sketches.DISTINCT_ERROR * exact.distinct)
    amounts = sorted(r.amount for r in inside.select("amount").dropna().collect())
    assert (got["amount"].min_num, got["amount"].max_num) == (amounts[0], amounts[-1])
    for q, value in zip(sketches.QUANTILES, got["amount"].quantiles):
        rank = sum(a <= value for a in amounts) / len(amounts)
        assert abs(rank - q) <= sketches.RANK_ERROR
    assert got["kind"].quantiles is None
    top = [(t["item"], t["count"]) for t in got["kind"].top_values]
    assert top == [(r.kind, r["count"]) for r in inside.groupBy("kind").count().orderBy(F.desc("count")).collect()]


def test_since_the_last_run(spark):
    df = spark.createDataFrame(rows()[:6000], ROWS)
    store = sketches.sketch_columns(df, "s.t", "at").unionByName(sketches.sketch_columns(df, "s.new", "at"))
    runs = spark.createDataFrame([("s.t", dt.datetime(2024, 1, 2)), ("s.t", dt.datetime(2024, 1, 4, 12))], "table_fqn string, run_at timestamp")
    got = {r.table_fqn: r.row_count for r in sketches.profile_since_last_run(store, runs).filter("column_name = 'id'").collect()}
    assert got == {"s.t": df.filter("at >= '2024-01-04'").count(), "s.new": 6000}


def test_empty_window_and_rows_without_a_day(spark):
    df = spark.createDataFrame([(1, None, float("nan"), None, "", None)], ROWS)
    store = sketches.sketch_columns(df, "s.t", "at")
    assert sketches.window_profile(store, "2024-01-01").count() == 0
    assert {r.column_name: (r.row_count, r.null_count) for r in sketches.window_profile(store).collect()} == {
        "id": (1, 0), "who": (1, 1), "amount": (1, 0), "kind": (1, 1), "note": (1, 0), "at": (1, 1)}


def test_two_hundred_references_in_one_pass(spark):
    """Columns of multiples: c_k holds those of k + 1, as different types; a hot value makes up half of the rows."""
    base = spark.range(1200)
    wide = base.select(*[F.when(F.col("id") % (k + 1) == 0, F.when(F.col("id") < 600, F.lit(0)).otherwise(F.col("id"))).cast(("long", "int", "double")[k % 3]).alias(f"c{k}") for k in range(100)])
    tables = {("s", "a"): wide, ("s", "b"): wide.select(*[F.col(f"c{k}").alias(f"d{k}") for k in range(100)])}
    references = [(("s", "a", f"c{i}"), ("s", "b", f"d{j}")) for i, j in random.Random(1).sample([(i, j) for i in range(100) for j in range(100)], 200)]
    found, jobs = jobs_of(spark, "references", lambda: integrity.check_inclusions(tables, references).collect())
    assert jobs <= 8
    held = {k: [0 if i < 600 else i for i in range(1200) if i % (k + 1) == 0] for k in range(100)}
    for r in found:
        child, parent = held[int(r.column_name[1:])], set(held[int(r.parent_column[1:])])
        lost = [v for v in child if v not in parent]
        assert (r.child_rows, r.orphan_count, r.orphan_values) == (len(child), len(lost), len(set(lost)))
    assert len(found) == 200


def test_inclusions_among_all_columns(spark):
    tables = {("s", "a"): spark.createDataFrame([(1, "x", None), (2, "y", None), (None, "x", None)], "i int, t string, none int"),
              ("s", "b"): spark.createDataFrame([(1.0, "x"), (2.0, "1"), (3.5, "2")], "f double, u string")}
    columns = [("s", "a", "i"), ("s", "a", "t"), ("s", "a", "none"), ("s", "b", "f"), ("s", "b", "u")]
    found = {((r.table_name, r.column_name), (r.parent_table, r.parent_column)) for r in integrity.inclusion_dependencies(tables, columns).collect()}
    assert found == {(("a", "i"), ("b", "f"))}
    assert integrity.check_inclusions(tables, []).count() == 0
    one = integrity.check_inclusions(tables, [(("s", "a", "none"), ("s", "b", "f"))]).first()
    assert (one.child_rows, one.orphan_count) == (0, 0)
