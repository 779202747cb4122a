"""Spark queries against DuckDB: a cross-section by default, all with ASSAY_FULL=1."""

import os

import pytest

import __spark_entry__ as entry
from workbench import load
from workbench.verify import compare

QUERIES = {name: entry.queries()[name] for name in load().QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
SAMPLE = ("p3_distinct_lineitem p4_top_texts_documents p9_key_dups_lineitem p12_score_lineitem p14_risks_lineitem r1_unique_lineitem "
          "r2_batch_customer r7_full_run r17_regenerate_drafts r25_ship_after_order r40_46_lint a1_volume_latest a3_metric_events a6_segment_events "
          "a8_dedupe t9_layer_health t13_attention t22_ai_cost i9_predicted i12_receipt_score g5_cycles g8_root_causes g11_paths g17_review "
          "d8_fuzzy_match c1_classify s8_query_history s13_csv_export f1_window_presets j8_full_outer x1_windowed_profile").split()
NAMES = list(QUERIES) if os.environ.get("ASSAY_FULL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, sf, name):
    ok, note = compare(spark, duck, sf, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["total_records", "failed_records", "fail_pct", "status", "quality_score"]
    assert df.count() == 1
