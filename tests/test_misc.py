"""Merges, sinks, incidents, catalog and receipts on small rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assay.functions.text import csv_safe, normalise_fqn, table_tokens
from assay.operators import catalog, incidents, intel, trust
from assay.operators.relational import merge_keyed
from assay.sources import readers, sinks

ROW = "k int, v string, s string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_variants(spark):
    old = spark.createDataFrame([(1, "a", "draft"), (2, "b", "final")], ROW)
    new = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, "C", "x")], ROW)
    assert rows(merge_keyed(old, new, ["k"])) == [(1, "A", "x"), (2, "B", "x"), (3, "C", "x")]
    assert rows(merge_keyed(old, new, ["k"], insert_only=True)) == [(1, "a", "draft"), (2, "b", "final"), (3, "C", "x")]
    assert rows(merge_keyed(old, new, ["k"], set_columns=["v"], replace_when=F.col("o.s") == "draft")) == [
        (1, "A", "draft"), (2, "b", "final"), (3, "C", "x")]


def test_versioned_table_survives_its_own_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_version(spark.createDataFrame([(1, "a", "s")], ROW), path, 1)
    assert sinks.merge_into(spark, path, spark.createDataFrame([(1, "b", "s"), (2, "c", "s")], ROW), ["k"]) == 2
    latest, version = sinks.read_latest(spark, path)
    assert version == 2 and rows(latest) == [(1, "b", "s"), (2, "c", "s")]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'say "hi"'), (None, "a,b")], "f string, q string")
    sinks.export_csv(df, str(tmp_path / "csv"))
    lines = sorted(set(spark.read.text(str(tmp_path / "csv")).toPandas()["value"]))
    assert lines == ['"","a,b"', '"\'=1+1","say ""hi"""', '"f","q"']
    assert spark.range(1).select(csv_safe(F.lit("-5"))).first()[0] == "'-5"


def test_readers(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.option("header", True).csv(str(tmp_path / "c"))
    assert readers.read_table(spark, str(tmp_path / "c"), "csv", schema="a int, b string", header=True).first().b == "x"
    with pytest.raises(ValueError):
        readers.read_table(spark, "x", "xls")


def test_names(spark):
    raw = ["[Db].[dbo].[T]", "Db.crm.T", "Db..T", " T "]
    got = [r.n for r in spark.createDataFrame([(x,) for x in raw], "x string").select(normalise_fqn(F.col("x")).alias("n")).collect()]
    assert got == ["Db.T", "Db.crm.T", "Db.T", "T"]
    tok = spark.createDataFrame([("BronzeDB.br_Order_Items2",), ("gold.gas",)], "x string").select(table_tokens(F.col("x")).alias("t")).collect()
    assert [r.t for r in tok] == [["order", "item"], ["gas"]]


def test_incident_rules(spark):
    cases = {
        "Chicago stores stopped sending": "segment", "one partition is offline": "segment", "revenue is null today": "nullcol",
        "an unapproved entry": "whitelist", "value not in the enum": "whitelist", "error code 77 started to appear": "whitelist",
        "volume fell by half": "volume", "only 40 % came": "volume", "only 12 records came": "volume", "the row count is off": "volume",
        "the file did not arrive": "source", "data volume is correct today": "unknown", "hello": "unknown",
    }
    df = spark.createDataFrame([(t, k) for t, k in cases.items()], "text string, expected_key string")
    wrong = incidents.classify(df).filter("key <> expected_key").collect()
    assert wrong == []
    total = incidents.accuracy(incidents.confusion(df)).filter("expected_key = 'ALL'").first()
    assert (total.total, total.accuracy, total.passes) == (13, 1.0, True)


def test_table_match_needs_a_shared_word(spark):
    s = spark.createDataFrame([("orders enriched",), ("br_customers",), ("zebra",)], "search string")
    t = spark.createDataFrame([("bronze.br_customers",), ("silver.orders",), ("silver.order_items_old",)], "table_fqn string")
    got = {r.search: (r.table_fqn, r.score) for r in catalog.match_tables(s, t).collect()}
    assert got == {"orders enriched": ("silver.orders", 1.0), "br_customers": ("bronze.br_customers", 100.0)}


def test_unknown_model_and_longest_name(spark):
    calls = spark.createDataFrame([("f", m, "ai", 1000, 1000, 10) for m in ("gpt-4o-mini", "gpt-4o", "ollama/x", "odd", None)],
                                  "feature string, model string, status string, input_tokens bigint, output_tokens bigint, latency_ms bigint")
    r = trust.ai_usage(calls.limit(0).withColumnRenamed("feature", "call_type"), calls).first()
    assert r.estimated_cost_usd == pytest.approx(0.0008 + 0.0125 + 0.015, abs=5e-5) and r.cost_known is False


def test_predicted_score_caps(spark):
    s = spark.createDataFrame([(90.0, 10, 10, 10, 10, None), (3.0, 0, 0, 0, 0, 1.0), (120.0, 0, 0, 0, 0, 49.0)],
                              "base_score double, critical int, high int, repeat_offenders int, large_swings int, profiling_h double")
    assert [r[0] for r in s.select(intel.predicted_score(s)).collect()] == [36.0, 5.0, 99.0]


def test_newly_failing_needs_two_runs(spark):
    r = spark.createDataFrame([("r1", "a", "FAIL", dt.datetime(2024, 1, 1))], "run_id string, rule_id string, status string, run_timestamp timestamp").withColumns({"table_fqn": F.lit("t"), "connection_id": F.lit("c")})
    assert trust.newly_failing(r).count() == 0
    two = r.unionByName(r.withColumns({"run_id": F.lit("r2"), "rule_id": F.lit("b"), "run_timestamp": F.lit("2024-01-02").cast("timestamp")}))
    assert [x.rule_id for x in trust.newly_failing(two).collect()] == ["b"]


@pytest.mark.parametrize("common", [0, 1, 3, 1000])
def test_best_table_does_not_depend_on_what_is_common(spark, common):
    rng = random.Random(5)
    pool = ["supplier", "order", "item", "daily", "fact", "stage"]
    name = lambda: "gold." + "_".join(rng.sample(pool, rng.randrange(1, 5)))
    tables, searches = sorted({name() for _ in range(60)}), sorted({name() for _ in range(40)} | {"gold.zebra", "gold.supplier_zebra"})

    def words(n):
        return [w[:-1] if w.endswith("s") and len(w) > 3 else w for w in n.split(".")[1].split("_")]

    want = {}
    for q in searches:
        lists = {tuple(words(t)): min(x for x in tables if words(x) == words(t)) for t in tables}
        if tuple(words(q)) in lists:
            want[q] = (lists[tuple(words(q))], 100.0)
            continue
        scored = [(-len(set(words(q)) & set(w)) / len(w), t) for w, t in lists.items() if set(words(q)) & set(w)]
        if scored:
            want[q] = (min(scored)[1], round(-min(scored)[0], 4))
    found = catalog.match_tables(spark.createDataFrame([(q,) for q in searches], "search string"), spark.createDataFrame([(t,) for t in tables], "table_fqn string"), common)
    assert {r.search: (r.table_fqn, r.score) for r in found.collect()} == want
