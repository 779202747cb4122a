from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.functions.exact import mean_of, percent, ratio


def half_up(n, d, digits):
    q = (Decimal(n) / Decimal(max(d, 1))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    return float(q) + 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(0, 10**7)), min_size=50, max_size=200))
def test_ratio_is_decimal_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    for r in df.select("n", "d", ratio(F.col("n"), F.col("d"), 2).alias("q")).collect():
        assert r.q == half_up(r.n, r.d, 2)


def test_percent_of_nothing_is_zero(spark):
    assert spark.range(1).select(percent(F.lit(0), F.lit(0)).alias("p")).first().p == 0.0


def test_ties_round_away_from_zero(spark):
    rows = [(1, 8), (-1, 8), (3, 600)]
    got = [r.q for r in spark.createDataFrame(rows, "n int, d int").select(ratio(F.col("n") * 100, F.col("d"), 0).alias("q")).collect()]
    assert got == [13.0, -13.0, 1.0]


def test_mean_of_tenths(spark):
    df = spark.createDataFrame([(87.6,), (87.7,), (None,)], "s double")
    assert df.agg(mean_of(F.col("s"), 1, 1).alias("m")).first().m == 87.7
