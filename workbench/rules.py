"""Rule queries (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.exact import percent as pct
from assay.operators import history, profile, rule_lint, rule_results, rules
from assay.operators.relational import latest_per_key
from workbench import derived as d
from workbench.registry import cte, oracle, percent, query, ratio, table


def _scored(counted, cde=False, severity="HIGH"):
    out = rules.score_results(counted.withColumn("is_cde_rule", F.lit(cde)))
    return out.select("total_records", "failed_records", "fail_pct", "status", "quality_score")


def _scored_sql(total: str, failed: str, source: str, cde: bool = False) -> str:
    p = percent("failed_records", "total_records")
    score = ratio(f"greatest(0, 10000 - {2 if cde else 1} * CAST(round({p} * 100) AS BIGINT))", "100", 1)
    return (f"SELECT total_records, failed_records, {p} AS fail_pct, CASE WHEN failed_records > 0 THEN 'FAIL' ELSE 'PASS' END AS status, "
            f"{score} AS quality_score FROM (SELECT {total} AS total_records, {failed} AS failed_records FROM {source})")


def _row(cond: str, source: str) -> str:
    return _scored_sql("count(*)", f"count(*) FILTER (WHERE NOT coalesce({cond}, FALSE))", source)


def _grouped(source: str, keys: str, failing: str, extra: str = "") -> str:
    return _scored_sql("CAST(sum(n) AS BIGINT)", f"CAST(coalesce(sum(n) FILTER (WHERE {failing}), 0) AS BIGINT)",
                       f"(SELECT count(*) AS n{extra} FROM {source} GROUP BY {keys})")


@query("r1_unique_lineitem", _scored_sql("count(*)", "count(*) FILTER (WHERE c <> 1)",
       "(SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem)"))
def r1(spark, sf):
    """The flagship: composite-key uniqueness, by counting keys."""
    return _scored(rules.unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("r1_rule_text_window", _scored_sql("count(*)", "count(*) FILTER (WHERE c <> 1)",
       "(SELECT count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS c FROM orders)"))
def r1_text(spark, sf):
    """The same shape as free rule text, window and all."""
    return _scored(rules.check_rule(table(spark, sf, "orders"), rules.unique_text(["o_custkey", "o_orderdate"])))


@query("r1_rule_text_exists", _row("o_custkey IS NULL OR EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)", "orders o"))
def r1_exists(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    return _scored(rules.check_rule(
        table(spark, sf, "orders"),
        "o_custkey IS NULL OR EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = t.o_custkey AND c.c_acctbal >= 0)"))


_BATCH = {"balance": "c_acctbal >= 0", "segment": "c_mktsegment IN ('BUILDING', 'MACHINERY')", "nation": "nullif(c_nationkey, 3) < 20",
          "name": "c_name LIKE 'Customer#%'"}


@query("r2_batch_customer", " UNION ALL ".join(
    f"SELECT '{k}' AS rule_id, count(*) AS total_records, count(*) FILTER (WHERE NOT coalesce({e}, FALSE)) AS failed_records FROM customer"
    for k, e in _BATCH.items()))
def r2(spark, sf):
    return rules.check_rules(table(spark, sf, "customer"), _BATCH)


@query("r4_failed_sample", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 20")
def r4(spark, sf):
    """Failing rows in order of their key, so that the same ones are shown each time."""
    return rules.failed_rows(table(spark, sf, "customer").orderBy("c_custkey"), "c_acctbal >= 0").select("c_custkey", "c_name", "c_acctbal")


_RUN = [
    rules.Rule("c1", "silver.customer", "c_acctbal >= 0", "balance", "SILVER", "HIGH"),
    rules.Rule("c2", "silver.customer", "c_mktsegment IS NOT NULL", "segment", "SILVER", "LOW"),
    rules.Rule("c3", "silver.customer", "no_such_column > 1", "broken", "SILVER", "MEDIUM"),
    rules.Rule("o1", "gold.orders", "o_orderstatus IN ('O', 'F')", "status", "GOLD", "CRITICAL", True),
    rules.Rule("o2", "gold.orders", "COUNT(*) OVER (PARTITION BY o_orderkey) = 1", "key", "GOLD", "CRITICAL"),
    rules.Rule("o4", "gold.orders", rules.unique_text(["o_custkey", "o_orderdate"]), "one a day", "GOLD", "MEDIUM",
               rule_type="UNIQUE", check_args='{"columns": ["o_custkey", "o_orderdate"]}'),
    rules.Rule("k1", "bronze.customer", "EXISTS (SELECT 1 FROM gold.customer c WHERE c.c_custkey = t.c_custkey)", "kept", "BRONZE", "LOW"),
    rules.Rule("k2", "gold.customer", "", "ordered", "GOLD", "LOW", rule_type="FK", check_args='{"columns": ["c_custkey"], "ref": "gold.orders", "ref_columns": ["o_custkey"]}'),
    rules.Rule("k3", "gold.customer", "EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = t.c_custkey)", "ambiguous", "GOLD", "LOW"),
    rules.Rule("o3", "gold.orders", "EXISTS (SELECT 1 FROM silver.customer c WHERE c.c_custkey = t.o_custkey AND c.c_acctbal >= 0)", "fk", "GOLD", "HIGH"),
    rules.Rule("p1", "bronze.part", "p_size BETWEEN 1 AND 40", "size", "BRONZE", "MEDIUM"),
    rules.Rule("x1", "raw.nowhere", "a = 1", "lost", "RAW", "HIGH"),
]


def _shown(key: str, source: str, failing: str, columns: str) -> str:
    """The keys of the failing rows with the smallest digests."""
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns.split())
    return f"(SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT CAST({key} AS VARCHAR) AS k FROM {source} WHERE {failing} ORDER BY md5(concat_ws('|', {cells})) LIMIT 20))"


_C, _O = "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"
_SHOWN = {
    "c1": _shown("c_custkey", "customer", "NOT c_acctbal >= 0", _C), "o1": _shown("o_orderkey", "orders", "o_orderstatus NOT IN ('O', 'F')", _O),
    "o3": _shown("o_orderkey", "orders o", "NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)", _O),
    "k1": _shown("c_custkey", "customer", "c_mktsegment = 'MACHINERY'", _C), "p1": _shown("p_partkey", "part", "NOT p_size BETWEEN 1 AND 40", "p_partkey p_name p_brand p_type p_size p_retailprice")}
_RUN_SQL = f"""
SELECT rule_id, table_fqn, layer, severity, total_records, failed_records, fail_pct, status,
       CASE WHEN status = 'ERROR' THEN 0.0::DOUBLE ELSE {ratio('greatest(0, 10000 - m * CAST(round(fail_pct * 100) AS BIGINT))', '100', 1)} END AS quality_score,
       CASE {' '.join(f"WHEN rule_id = '{r}' AND status = 'FAIL' THEN {sql}" for r, sql in _SHOWN.items())} END AS sampled
FROM (SELECT *, {percent('failed_records', 'total_records')} AS fail_pct,
             CASE WHEN err THEN 'ERROR' WHEN failed_records > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (
  SELECT 'c1' AS rule_id, 'silver.customer' AS table_fqn, 'SILVER' AS layer, 'HIGH' AS severity, 1 AS m, FALSE AS err, count(*) AS total_records, count(*) FILTER (WHERE NOT c_acctbal >= 0) AS failed_records FROM customer
  UNION ALL SELECT 'c2', 'silver.customer', 'SILVER', 'LOW', 1, FALSE, count(*), count(*) FILTER (WHERE c_mktsegment IS NULL) FROM customer
  UNION ALL SELECT 'c3', 'silver.customer', 'SILVER', 'MEDIUM', 1, TRUE, 0, 0
  UNION ALL SELECT 'o1', 'gold.orders', 'GOLD', 'CRITICAL', 2, FALSE, count(*), count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) FROM orders
  UNION ALL SELECT 'o2', 'gold.orders', 'GOLD', 'CRITICAL', 1, FALSE, count(*), count(*) - count(DISTINCT o_orderkey) FROM orders
  UNION ALL SELECT 'o3', 'gold.orders', 'GOLD', 'HIGH', 1, FALSE, count(*), count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)) FROM orders o
  UNION ALL SELECT 'o4', 'gold.orders', 'GOLD', 'MEDIUM', 1, FALSE, CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate)
  UNION ALL SELECT 'k1', 'bronze.customer', 'BRONZE', 'LOW', 1, FALSE, count(*), count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') FROM customer
  UNION ALL SELECT 'k2', 'gold.customer', 'GOLD', 'LOW', 1, FALSE, count(*), count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)) FROM customer c WHERE c_mktsegment <> 'MACHINERY'
  UNION ALL SELECT 'k3', 'gold.customer', 'GOLD', 'LOW', 1, TRUE, 0, 0
  UNION ALL SELECT 'p1', 'bronze.part', 'BRONZE', 'MEDIUM', 1, FALSE, count(*), count(*) FILTER (WHERE NOT p_size BETWEEN 1 AND 40) FROM part
  UNION ALL SELECT 'x1', 'raw.nowhere', 'RAW', 'HIGH', 1, TRUE, 0, 0))"""
_W2 = "CASE severity WHEN 'CRITICAL' THEN 6 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 2 END"


def _score_sql(where: str = "") -> str:
    return ratio(f"sum(CAST(round(quality_score * 10) AS BIGINT) * {_W2})", f"(10 * sum({_W2}))", 1)


def _run(spark, sf):
    """Three tables called customer: the gold one lacks a segment."""
    c = table(spark, sf, "customer")
    tabs = {"bronze.customer": c, "silver.customer": c, "gold.customer": c.filter("c_mktsegment <> 'MACHINERY'"),
            "gold.orders": table(spark, sf, "orders"), "bronze.part": table(spark, sf, "part")}
    return rules.execute_rules(tabs, _RUN, run_id="run_1", as_of=d.as_of())


@query("r5_result_rows", _RUN_SQL)
def r5(spark, sf):
    """Results with the keys of the rows that are shown; typed rules show keys with their counts, which tests compare."""
    sample = F.from_json("sample_failed_records", "array<struct<c_custkey: bigint, o_orderkey: bigint, p_partkey: bigint>>")
    keys = F.array_sort(F.transform(sample, lambda r: F.coalesce(r["o_orderkey"], r["c_custkey"], r["p_partkey"]).cast("string")))
    sampled = F.when(F.col("rule_id").isin("c1", "o1", "o3", "k1", "p1"), F.array_join(keys, ","))
    return _run(spark, sf).select("rule_id", "table_fqn", "layer", "severity", "total_records", "failed_records", "fail_pct", "status", "quality_score", sampled.alias("sampled"))


@query("r6_weighted_score", f"SELECT layer, {_score_sql()} AS overall_quality_score FROM w_results GROUP BY layer")
def r6(spark, sf):
    return rules.weighted_score(d.results(spark, sf), "layer")


@query("r7_full_run", f"""
SELECT 'run_1' AS run_id, count(*) AS total_rules, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed,
       count(*) FILTER (WHERE status = 'ERROR') AS errors, {_score_sql()} AS overall_quality_score FROM ({_RUN_SQL})""")
def r7(spark, sf):
    return rules.run_summary(_run(spark, sf))


_NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY run_timestamp DESC, result_id DESC) AS rn FROM w_results) WHERE rn = 1)"


@query("r10_current_state", f"""
SELECT n.rule_id, n.run_id, n.status, n.quality_score FROM {_NEWEST} n JOIN w_rules r ON r.rule_id = n.rule_id WHERE r.status IN ('approved', 'active')""")
def r10(spark, sf):
    return rule_results.current_state(d.results(spark, sf), d.rules(spark, sf)).select("rule_id", "run_id", "status", "quality_score")


@query("r10_never_run", """
SELECT rule_id, table_fqn FROM w_rules r WHERE status IN ('approved', 'active')
AND NOT EXISTS (SELECT 1 FROM w_results x WHERE x.rule_id = r.rule_id AND x.run_timestamp >= TIMESTAMP '2001-11-01')""")
def r10_never(spark, sf):
    recent = d.results(spark, sf).filter(F.col("run_timestamp") >= d.as_of("2001-11-01"))
    return rule_results.never_run(d.rules(spark, sf), recent).select("rule_id", "table_fqn")


@query("r11_run_results", """
SELECT x.rule_id, coalesce(r.rule_name, '') AS rule_name, x.status, x.status = 'FAIL' AND NOT x.is_expected_failure AS counts_as_failed
FROM w_results x LEFT JOIN w_rules r ON r.rule_id = x.rule_id WHERE x.run_id = (SELECT arg_max(run_id, run_timestamp) FROM w_results)""")
def r11(spark, sf):
    res = d.results(spark, sf)
    latest = res.agg(F.max_by("run_id", "run_timestamp").alias("run_id")).scalar()
    return rule_results.run_results(res, d.rules(spark, sf), latest).select("rule_id", "rule_name", "status", "counts_as_failed")


_CARDS = f"""
SELECT layer, count(*) AS rules, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed,
       count(*) FILTER (WHERE status = 'ERROR') AS errored, {ratio('sum(CAST(round(quality_score * 10) AS BIGINT))', '10 * count(*)', 0)} AS score,
       count(*) FILTER (WHERE status = 'ERROR') = count(*) AS all_errored
FROM {{}} WHERE layer IN ('RAW', 'BRONZE', 'SILVER', 'GOLD') GROUP BY layer"""


@query("r12_layer_cards", _CARDS.format("w_results"))
def r12(spark, sf):
    return rule_results.layer_cards(d.results(spark, sf))


@query("r13_merge_scoped", f"""
WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY run_timestamp DESC) AS rn FROM w_results WHERE run_timestamp < TIMESTAMP '2001-01-01') WHERE rn = 1),
scoped AS (SELECT * FROM {_NEWEST} WHERE layer = 'GOLD')
SELECT rule_id, result_id, status FROM scoped UNION ALL SELECT rule_id, result_id, status FROM old WHERE rule_id NOT IN (SELECT rule_id FROM scoped)""")
def r13(spark, sf):
    res = d.results(spark, sf)
    order = [F.desc("run_timestamp"), F.desc("result_id")]
    old = latest_per_key(res.filter(F.col("run_timestamp") < d.as_of("2001-01-01")), ["rule_id"], order)
    scoped = latest_per_key(res.filter("layer = 'GOLD'"), ["rule_id"], order)
    return rule_results.merge_results(old, scoped).select("rule_id", "result_id", "status")


@query("r14_rules_per_table", """
SELECT connection_id, table_fqn, count(*) AS total, count(*) FILTER (WHERE status IN ('approved', 'active')) AS approved, count(*) FILTER (WHERE status = 'draft') AS pending,
       count(*) FILTER (WHERE is_cde_rule) AS cde, count(related_table_fqn) AS cross_table FROM w_rules GROUP BY 1, 2""")
def r14(spark, sf):
    return rule_results.rules_per_table(d.rules(spark, sf))


@query("r15_decisions", """
SELECT rule_id, outcome, CASE WHEN outcome = 'applied' THEN CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'retired' WHEN 'snooze' THEN 'snoozed' ELSE 'draft' END ELSE status END AS status,
       CASE WHEN outcome = 'applied' AND decision = 'edit' THEN 'l_tax <= 0.05' ELSE rule_expression END AS rule_expression,
       CASE WHEN outcome = 'applied' AND decision = 'approve' THEN by_user WHEN layer IN ('UNKNOWN', 'RAW') THEN 'old@example.com' END AS approved_by
FROM (SELECT *, CASE WHEN decision IS NULL THEN NULL WHEN decision = 'approve' AND created_by = by_user THEN 'own_rule' WHEN decision = 'merge' THEN 'invalid' ELSE 'applied' END AS outcome
  FROM (SELECT *, CASE WHEN layer = 'UNKNOWN' THEN NULL WHEN rule_no = 1 THEN 'snooze' WHEN rule_no = 2 THEN 'edit' WHEN rule_no = 3 THEN 'approve' WHEN layer = 'RAW' THEN 'merge' ELSE 'reject' END AS decision,
               CASE WHEN layer = 'GOLD' THEN 'ana@example.com' ELSE 'eve@example.com' END AS by_user FROM w_rules))""")
def r15(spark, sf):
    all_rules = d.rules(spark, sf).withColumn("approved_by", F.when(F.col("layer").isin("UNKNOWN", "RAW"), "old@example.com"))
    no = F.col("rule_no")
    decisions = all_rules.filter("layer <> 'UNKNOWN'").select(
        "rule_id",
        F.when(no == 1, "snooze").when(no == 2, "edit").when(no == 3, "approve").when(F.col("layer") == "RAW", "merge").otherwise("reject").alias("decision"),
        F.when(F.col("layer") == "GOLD", "ana@example.com").otherwise("eve@example.com").alias("decided_by"),
        F.lit(False).alias("is_admin"), d.as_of().alias("snooze_until"),
        F.when(no == 2, "l_tax <= 0.05").alias("edited_expression"))
    return rule_results.decide(all_rules, decisions).select("rule_id", "outcome", "status", "rule_expression", "approved_by")


@query("r15_acknowledged", """
SELECT result_id, CASE WHEN status = 'FAIL' AND layer = 'RAW' THEN TRUE ELSE is_expected_failure END AS is_expected_failure FROM w_results""")
def r15_ack(spark, sf):
    res = d.results(spark, sf)
    acks = res.filter("status = 'FAIL' AND layer = 'RAW'").select(
        "result_id", F.lit(True).alias("is_expected"), F.lit("known").alias("reason"), F.lit("ana@example.com").alias("acknowledged_by"))
    return rule_results.acknowledge(res, acks).select("result_id", "is_expected_failure")


@query("r16_key_uniqueness", """
SELECT s.table_fqn, s.column_name, s.distinct_count::DOUBLE / s.row_count >= 0.95 AS is_unique FROM w_stats s
JOIN (SELECT table_fqn, max(run_at) AS run_at FROM w_reports GROUP BY 1) l ON l.table_fqn = s.table_fqn AND l.run_at = s.run_at
WHERE regexp_matches(s.column_name, '(?i)(_id|id|key|code)$')""")
def r16(spark, sf):
    latest = history.latest_reports(d.reports(spark, sf))
    return rule_results.sibling_keys(d.column_stats(spark, sf), latest)


@query("r17_regenerate_drafts", """
WITH s AS (SELECT connection_id, table_fqn, n AS rule_name, 'new text' AS rule_expression FROM w_tables, (SELECT unnest(['discount_range', 'tax_range', 'fresh_rule', '']) AS n) WHERE layer = 'SILVER'),
o AS (SELECT *, CASE WHEN rule_no = 1 AND s_acct < 0 THEN 'draft' ELSE status END AS st FROM (SELECT r.*, t.s_acctbal AS s_acct FROM w_rules r JOIN w_tables t USING (table_fqn))),
k AS (SELECT * FROM o WHERE NOT (st = 'draft' AND created_by = 'AI_AGENT' AND table_fqn IN (SELECT table_fqn FROM s)))
SELECT coalesce(k.table_fqn, s.table_fqn) AS table_fqn, coalesce(k.rule_name, s.rule_name) AS rule_name,
       CASE WHEN k.rule_id IS NULL THEN s.rule_expression WHEN s.rule_name IS NOT NULL AND k.st = 'draft' THEN s.rule_expression ELSE k.rule_expression END AS rule_expression,
       coalesce(k.st, 'draft') AS status
FROM k FULL OUTER JOIN s ON k.table_fqn = s.table_fqn AND k.rule_name = s.rule_name""")
def r17(spark, sf):
    tabs = d.tables(spark, sf)
    broke = tabs.filter("s_acctbal < 0").select("table_fqn", F.lit(True).alias("_neg"))
    existing = (d.rules(spark, sf).join(broke, "table_fqn", "left")
                .withColumn("status", F.when((F.col("rule_no") == 1) & F.col("_neg"), "draft").otherwise(F.col("status")))
                .withColumn("generation_source", F.lit("single_table")).drop("_neg"))
    names = F.explode(F.array(*[F.lit(n) for n in ("discount_range", "tax_range", "fresh_rule", "")]))
    new = tabs.filter("layer = 'SILVER'").select(
        "connection_id", "table_fqn", names.alias("rule_name"), F.lit("new text").alias("rule_expression"),
        F.lit("again").alias("rule_description"), F.lit("single_table").alias("generation_source"), F.lit("draft").alias("status"))
    return rule_results.regenerate_drafts(existing, new).select("table_fqn", "rule_name", "rule_expression", "status")


@query("r18_candidate_rules", """
SELECT *, CASE rule_type WHEN 'UNIQUE' THEN '{"columns":["' || column_name || '"]}' ELSE '' END AS check_args FROM (
SELECT 'o_orderkey' AS column_name, 'NULL_CHECK' AS rule_type, '`o_orderkey` IS NOT NULL' AS rule_expression, 'HIGH' AS severity, 'o_orderkey_null_check' AS rule_name
UNION ALL SELECT 'o_orderkey', 'RANGE', '`o_orderkey` BETWEEN ' || min(o_orderkey)::DOUBLE || ' AND ' || max(o_orderkey)::DOUBLE, 'MEDIUM', 'o_orderkey_range' FROM orders
UNION ALL SELECT 'o_orderkey', 'UNIQUE', 'COUNT(*) OVER (PARTITION BY `o_orderkey`) = 1', 'CRITICAL', 'o_orderkey_unique'
UNION ALL SELECT 'o_orderpriority', 'NULL_CHECK', '`o_orderpriority` IS NOT NULL', 'HIGH', 'o_orderpriority_null_check'
UNION ALL SELECT 'o_orderpriority', 'ENUM', '`o_orderpriority` IN (' || string_agg(DISTINCT '''' || o_orderpriority || '''', ', ' ORDER BY '''' || o_orderpriority || '''') || ')', 'MEDIUM', 'o_orderpriority_enum' FROM orders
UNION ALL SELECT 'status', 'ENUM', '`status` IS NULL OR `status` IN (' || string_agg(DISTINCT '''' || o_orderstatus || '''', ', ' ORDER BY '''' || o_orderstatus || '''') FILTER (WHERE o_orderstatus <> 'P') || ')', 'MEDIUM', 'status_enum' FROM orders)""")
def r18(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return rule_results.candidate_rules(profile.profile_columns(df)).fillna("", ["check_args"])


# --- shapes ------------------------------------------------------------------

@query("r20_null", _row("nullif(o_orderstatus, 'P') IS NOT NULL", "orders"))
def r20(spark, sf):
    df = table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return _scored(rules.check_rule(df, rules.not_null("o_orderstatus")))


@query("r21_range_acctbal", _row("c_acctbal BETWEEN 0 AND 9000", "customer"))
def r21(spark, sf):
    return _scored(rules.check_rule(table(spark, sf, "customer"), rules.in_range("c_acctbal", 0, 9000)))


@query("r22_enum_status", _row("nullif(o_orderstatus, 'P') IS NULL OR o_orderpriority IN ('1-URGENT', '2-HIGH')", "orders"))
def r22(spark, sf):
    df = table(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return _scored(rules.check_rule(df, rules.one_of("p", ["1-URGENT", "2-HIGH"], null_passes=True)))


@query("r23_unique_composite", _grouped("orders", "o_custkey, o_orderpriority", "n > 1"))
def r23(spark, sf):
    return _scored(rules.unique(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"]))


@query("r24_format_url", _row(r"regexp_matches(url, '^https://[\w.]+/[a-z]{2}/\d+')", "pages"))
def r24(spark, sf):
    return _scored(rules.check_rule(table(spark, sf, "pages"), rules.matches("url", r"^https://[\w.]+/[a-z]{2}/\d+")))


@query("r25_ship_after_order", _scored_sql("count(*)", "count(*) FILTER (WHERE NOT coalesce(l_shipdate >= o_orderdate, FALSE))", "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"))
def r25(spark, sf):
    return _scored(rules.ordered_with_parent(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate", table(spark, sf, "orders"), "o_orderkey", "o_orderdate"))


@query("r25_cross_column", _row("l_extendedprice >= l_quantity * 900 AND (l_returnflag <> 'R' OR l_linestatus = 'F')", "lineitem"))
def r25_row(spark, sf):
    return _scored(rules.check_rule(table(spark, sf, "lineitem"), "l_extendedprice >= l_quantity * 900 AND (l_returnflag <> 'R' OR l_linestatus = 'F')"))


@query("r26_single_current", _grouped("orders", "o_custkey", "cur <> 1", ", count(*) FILTER (WHERE o_orderstatus = 'O') AS cur"))
def r26(spark, sf):
    return _scored(rules.exactly_one(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus") == "O"))


@query("r27_fd_name", _grouped("part", "p_name", "nv <> 1", ", count(DISTINCT p_brand) AS nv"))
def r27(spark, sf):
    return _scored(rules.depends_on(table(spark, sf, "part"), ["p_name"], "p_brand"))


@query("r27_fd_part_price", _grouped("lineitem JOIN part ON l_partkey = p_partkey", "l_partkey", "nv <> 1", ", count(DISTINCT p_retailprice) AS nv"))
def r27_holds(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _scored(rules.depends_on(df, ["l_partkey"], "p_retailprice"))


@query("r28_volume_per_day", _grouped("events", "date_trunc('day', ts)", "n < 335"))
def r28(spark, sf):
    days = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return _scored(rules.min_volume(days, ["day"], 335))


@query("r29_fk", _row("nullif(o_custkey, 7) IS NULL OR EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment <> 'BUILDING')", "orders o"))
def r29(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_custkey", F.nullif("o_custkey", F.lit(7)))
    c = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    return _scored(rules.foreign_key(o, ["o_custkey"], c, ["c_custkey"]))


@query("r30_composite_fk", _row("EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = l.l_suppkey AND c.c_nationkey = l.l_linenumber)", "lineitem l"))
def r30(spark, sf):
    return _scored(rules.foreign_key(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber"],
                                     table(spark, sf, "customer"), ["c_custkey", "c_nationkey"]))


@query("r31_header_detail", _row("abs(o_totalprice - s) <= 100000", "orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"))
def r31(spark, sf):
    return _scored(rules.header_matches_detail(
        table(spark, sf, "orders"), "o_orderkey", F.col("o_totalprice"), table(spark, sf, "lineitem"), "l_orderkey",
        F.col("l_extendedprice").cast("decimal(18,2)"), 100000.0))


@query("r32_reverse", _row("EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)", "orders o"))
def r32(spark, sf):
    return _scored(rules.has_child(table(spark, sf, "orders"), ["o_orderkey"], table(spark, sf, "lineitem"), ["l_orderkey"]))


@query("r33_hierarchy", _row("parent IS NULL OR EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = h.conv_id AND x.turn = h.parent AND x.role = 'user')",
       "(SELECT conv_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent FROM conversations) h"))
def r33(spark, sf):
    """A turn points at the turn before it in the same table."""
    turns = table(spark, sf, "conversations").withColumn("parent", F.when(F.col("turn") > 0, F.col("turn") - 1))
    return _scored(rules.foreign_key(turns, ["conv_id", "parent"], turns.filter("role = 'user'"), ["conv_id", "turn"]))


# --- lint --------------------------------------------------------------------

# (rule text, findings it must give)
_TEXTS = (
    ("COALESCE(qty, 0) = 0", ["inverted_null_check"]), ("COALESCE(qty, 0) = 1", []),
    ("ZEROIFNULL(qty) = 0", ["inverted_null_check"]), ("qty IS NOT NULL", []),
    ("ISNULL(a, 0) AND ISNULL(b, 0)", ["bare_value_condition"]), ("ISNULL(a, 0) > 1 AND ISNULL(b, 0) > 2", []),
    ("[qty].ISNULL(0)", ["dot_chained_call"]), ("ISNULL([qty], 0) > 0", []),
    ("cid IS NOT NULL AND EXISTS (SELECT 1 FROM orders o WHERE o.k = t.cid)", ["null_hostile_key"]),
    ("cid IS NULL OR EXISTS (SELECT 1 FROM orders o WHERE o.k = t.cid)", []),
    ("EXISTS (SELECT 1 FROM orders o WHERE o.[k] = [qty])", ["uncorrelated_exists"]),
    ("EXISTS (SELECT 1 FROM orders o WHERE o.k = 7)", []),
    ("EXISTS (SELECT 1 FROM [gold].[Brz_Orders] o WHERE o.k = t.k)", ["unknown_table:Brz_Orders", "unknown_column:Brz_Orders"]),
    ("EXISTS (SELECT 1 FROM gold.orders o JOIN missing m WHERE o.k = t.k)", ["unknown_table:missing"]),
    ("[nope] >= [qty]", ["unknown_column:nope"]), ("[dbo].[qty] >= 0", []),
)


def lint_inputs(spark, sf):
    """One rule per part, its text chosen by the part's size, and the catalog it may use."""
    texts = F.array(*[F.lit(t) for t, _ in _TEXTS])
    p = table(spark, sf, "part")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    the_rules = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("rule_id"),
                         F.concat(F.lit("gold."), brand).alias("table_fqn"),
                         F.get(texts, F.col("p_size") % len(_TEXTS)).alias("rule_expression"))
    brands = p.select(F.concat(F.lit("gold."), brand).alias("table_fqn")).distinct()
    catalog = brands.unionByName(p.select(F.lit("gold.orders").alias("table_fqn")).distinct()).select(
        "table_fqn", F.explode(F.array(*[F.lit(c) for c in ("Qty", "k", "cid", "gold")])).alias("column_name"))
    return the_rules, catalog


@query("r40_46_lint", "SELECT 'p' || p_partkey AS rule_id, split_part(f, ':', 1) AS finding, nullif(split_part(f, ':', 2), '') AS name FROM (SELECT p_partkey, unnest(CASE p_size % 16 "
       + " ".join(f"WHEN {i} THEN {found if found else '[]::VARCHAR[]'}" for i, (_, found) in enumerate(_TEXTS)) + " END) AS f FROM part)")
def lint(spark, sf):
    return rule_lint.lint_rules(*lint_inputs(spark, sf))
