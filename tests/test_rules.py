import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from assay.operators import rule_lint, rule_results, rules
from assay.operators.rules import Rule


def as_of():
    return F.lit("2024-01-31").cast("timestamp")


def run(tables, rs, action=rules.run_rules):
    return {r.rule_id: r for r in action(tables, rs, run_id="r", as_of=as_of()).collect()}


def test_null_fails_and_errors_do_not_stop_the_run(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "x int, s string")
    other = spark.createDataFrame([(1,)], "x int")
    got = run({"raw.t": t, "raw.other": other, "raw.empty": t.limit(0)}, [
        Rule("null", "raw.t", "x > 0"), Rule("cde", "raw.t", "x > 0", is_cde_rule=True), Rule("window", "raw.t", "COUNT(*) OVER (PARTITION BY s) = 1"),
        Rule("exists", "raw.t", "EXISTS (SELECT 1 FROM other o WHERE o.x = t.x)"), Rule("scalar", "raw.t", "x = (SELECT max(x) FROM other)"),
        Rule("bad", "raw.t", "nope > 1"), Rule("syntax", "raw.t", "x >> > 1"), Rule("gone", "raw.missing", "x > 1"), Rule("empty", "raw.empty", "x > 1"),
        Rule("typed", "raw.t", "FALSE", check=lambda df, tables: rules.unique(df, ["s"]))])
    assert {k: (v.status, v.total_records, v.failed_records) for k, v in got.items()} == {
        "null": ("FAIL", 3, 1), "cde": ("FAIL", 3, 1), "window": ("PASS", 3, 0), "exists": ("FAIL", 3, 2), "scalar": ("FAIL", 3, 2),
        "bad": ("ERROR", 0, 0), "syntax": ("ERROR", 0, 0), "gone": ("ERROR", 0, 0), "empty": ("PASS", 0, 0), "typed": ("PASS", 3, 0)}
    assert (got["null"].fail_pct, got["null"].quality_score, got["cde"].quality_score) == (33.33, 66.7, 33.3)


def test_tables_of_one_name_stay_apart(spark):
    yes, no = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    spark.createDataFrame([(7,)], "mine int").createOrReplaceTempView("orders")
    rs = [Rule("silver", "raw.t", "EXISTS (SELECT 1 FROM silver.orders o WHERE o.x = t.x)"), Rule("gold", "raw.t", "EXISTS (SELECT 1 FROM `gold`.`Orders` o WHERE o.x = t.x)"),
          Rule("short", "raw.t", "EXISTS (SELECT 1 FROM orders o WHERE o.x = t.x)"), Rule("own", "raw.t", "EXISTS (SELECT 1 FROM only o WHERE o.x = t.x)")]
    for order in (["silver.orders", "gold.orders"], ["gold.orders", "silver.orders"]):
        tables = {"raw.t": yes, **{n: yes if n.startswith("silver") else no for n in order}, "raw.only": yes}
        got = run(tables, rs)
        assert {k: v.status for k, v in got.items()} == {"silver": "PASS", "gold": "FAIL", "short": "ERROR", "own": "PASS"}
    assert spark.table("orders").columns == ["mine"] and not spark.catalog.tableExists("only")
    spark.catalog.dropTempView("orders")


def test_samples_of_failing_rows(spark):
    t = spark.createDataFrame([(i, i // 2, None if i > 6 else "a") for i in range(9)], "x int, k int, s string")
    parent = spark.createDataFrame([(0,), (1,)], "k int")
    rs = [Rule("row", "t", "x < 3"), Rule("ok", "t", "x >= 0"), Rule("window", "t", "COUNT(*) OVER (PARTITION BY k) = 1"),
          Rule("unique", "t", "", rule_type="UNIQUE", check_args='{"columns": ["k"]}'), Rule("fk", "t", "", rule_type="FK", check_args='{"columns": ["k"], "ref": "p", "ref_columns": ["k"]}'),
          Rule("dep", "t", "", rule_type="DEPENDENCY", check_args='{"columns": ["k"], "value": "x"}'), Rule("vol", "t", "", rule_type="VOLUME", check_args='{"columns": ["k"], "at_least": 2}'),
          Rule("cur", "t", "", rule_type="SINGLE_CURRENT", check_args='{"columns": ["k"], "current": "s IS NULL"}'), Rule("wrong", "t", "", rule_type="FK", check_args="{}")]
    got = {r.rule_id: r for r in rules.execute_rules({"t": t, "p": parent}, rs, run_id="r", as_of=as_of(), sample=3).collect()}
    assert {k: (v.status, v.failed_records) for k, v in got.items()} == {
        "row": ("FAIL", 6), "ok": ("PASS", 0), "window": ("FAIL", 8), "unique": ("FAIL", 8), "fk": ("FAIL", 5), "dep": ("FAIL", 8), "vol": ("FAIL", 1), "cur": ("FAIL", 6), "wrong": ("ERROR", 0)}
    assert got["ok"].sample_failed_records is None
    rows = json.loads(got["row"].sample_failed_records)
    assert len(rows) == 3 and all(r["x"] >= 3 for r in rows)
    assert all(r["n"] == 2 for r in json.loads(got["unique"].sample_failed_records))
    assert {r["k"] for r in json.loads(got["fk"].sample_failed_records)} == {2, 3, 4}
    plan = rules.count_failures({"t": t, "p": parent}, [r for r in rs if r.rule_type in rules.TYPED and r.rule_id != "wrong"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_run_time_failure_is_isolated(spark):
    t = spark.createDataFrame([("1",), ("x",)], "s string")
    rs = [Rule("ok", "t", "s IS NOT NULL"), Rule("boom", "t", "raise_error(s) IS NULL", severity="HIGH")]
    got = run({"t": t}, rs, rules.execute_rules)
    assert (got["ok"].status, got["boom"].status, got["boom"].table_fqn) == ("PASS", "ERROR", "t")


def test_other_failures_end_the_run(spark):
    """A task that breaks for no fault of a rule, as with a lost executor, is no rule error."""
    def broken(batches):
        raise OSError("no disk")
        yield

    t = spark.createDataFrame([("1",)], "s string").mapInArrow(broken, "s string")
    with pytest.raises(PythonException):
        rules.execute_rules({"t": t}, [Rule("ok", "t", "s IS NOT NULL")], run_id="r", as_of=as_of())


def test_row_rules_share_one_scan(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    df = rules.count_failures({"c": t}, [Rule(f"r{i}", "c", f"c_acctbal > {i}") for i in range(5)])
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_typed_checks_agree_with_their_text(spark):
    t = spark.createDataFrame([(1, "a", True), (1, "a", False), (2, "b", True), (2, "c", True), (None, "d", False), (None, None, True), (3, None, False)],
                              "k int, v string, cur boolean")
    pairs = [
        (rules.unique(t, ["k"]), "COUNT(*) OVER (PARTITION BY k) = 1"),
        (rules.exactly_one(t, ["k"], F.col("cur")), "SUM(CASE WHEN cur THEN 1 ELSE 0 END) OVER (PARTITION BY k) = 1"),
        (rules.depends_on(t, ["k"], "v"), "size(collect_set(v) OVER (PARTITION BY k)) = 1"),
        (rules.min_volume(t, ["k"], 2), "COUNT(*) OVER (PARTITION BY k) >= 2"),
        (rules.row_check(t, F.col("v") == "a"), "v = 'a'"),
    ]
    for typed, text in pairs:
        assert typed.first() == rules.check_rule(t, text).first(), text
    t.createOrReplaceTempView("typed_self")
    fk = rules.foreign_key(t, ["k"], t.filter("cur"), ["k"])
    assert fk.first() == rules.check_rule(t, "k IS NULL OR EXISTS (SELECT 1 FROM typed_self c WHERE c.k = t.k AND c.cur)").first()


def test_cross_table_checks(spark):
    parent = spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "id int, total int")
    child = spark.createDataFrame([(1, 4, 1), (1, 6, 9), (3, 1, 1)], "pid int, amt int, day int")
    assert rules.has_child(parent, ["id"], child, ["pid"]).first().failed_records == 2
    assert rules.header_matches_detail(parent, "id", F.col("total"), child, "pid", F.col("amt"), 0).first().failed_records == 2
    assert rules.ordered_with_parent(child, "pid", "day", parent.withColumn("since", F.lit(5)), "id", "since").first().failed_records == 2


def test_weighted_score(spark):
    r = spark.createDataFrame([(100.0, "CRITICAL"), (50.0, "LOW"), (0.0, "odd")], "quality_score double, severity string")
    assert rules.weighted_score(r).first()[0] == round((300 + 25) / 4.5, 1)
    assert rules.weighted_score(r.limit(0)).first()[0] == 0.0


def test_decisions(spark):
    r = spark.createDataFrame([(k, "draft", "me", "x") for k in "abcdef"], "rule_id string, status string, created_by string, rule_expression string").withColumn(
        "snooze_until", F.lit(None).cast("timestamp"))
    dec = spark.createDataFrame([("a", "approve", "me", False, None), ("b", "approve", "me", True, None), ("c", "approve", "you", False, "y"),
                                 ("d", "edit", "you", False, "y"), ("e", "what", "you", False, None)],
                                "rule_id string, decision string, decided_by string, is_admin boolean, edited_expression string").withColumn("snooze_until", as_of())
    got = {x.rule_id: (x.outcome, x.status, x.rule_expression) for x in rule_results.decide(r, dec).collect()}
    assert got == {"a": ("own_rule", "draft", "x"), "b": ("applied", "approved", "x"), "c": ("edit_with_approve", "draft", "x"),
                   "d": ("applied", "draft", "y"), "e": ("invalid", "draft", "x"), "f": (None, "draft", "x")}


def test_lint_cases(spark):
    cases = [
        ("IFNULL(a, -1) = -1", {"inverted_null_check"}), ("COALESCE(a, 'x') = 'y'", set()),
        ("ISNULL(a,0) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.k = t.k)", {"bare_value_condition"}), ("ISNULL(a,0) = 1 OR b > 0", set()),
        ('"a".IN(\'x\')', {"dot_chained_call"}), ("`t`.`a` IN ('x')", set()),
        ("k IS NOT NULL AND x > 0 AND EXISTS (SELECT 1 FROM orders o WHERE o.k = t.k)", {"null_hostile_key"}),
        ("k IS NOT NULL AND (x > 0) AND EXISTS (SELECT 1 FROM orders o WHERE o.k = t.k)", set()),
        ("EXISTS (SELECT 1 FROM orders o WHERE o.k = k)", {"uncorrelated_exists"}), ("EXISTS (SELECT 1 FROM orders o WHERE o.k = t . k AND o.x = NULL)", set()),
        ("EXISTS (SELECT 1 FROM sales.orderz o WHERE o.k = t.k)", {"unknown_table"}), ("EXISTS (SELECT 1 FROM [sales].[Orders] o WHERE o.k = t.k)", {"unknown_column"}),
        ("[a] > [zz]", {"unknown_column"}), ("[dbo].[t].[A] > 0 AND [sales.t] > 0", set()),
    ]
    r = spark.createDataFrame([(str(i), "sales.t", e) for i, (e, _) in enumerate(cases)], "rule_id string, table_fqn string, rule_expression string")
    catalog = spark.createDataFrame([("sales.t", c) for c in "abkx"] + [("sales.orders", "k")], "table_fqn string, column_name string")
    got = {}
    for f in rule_lint.lint_rules(r, catalog).collect():
        got.setdefault(f.rule_id, set()).add(f.finding)
    for i, (text, want) in enumerate(cases):
        assert got.get(str(i), set()) == want, text


def test_names_in_strings_and_comments_stay(spark):
    t = spark.createDataFrame([("silver.orders", 1), ("gold.orders", 2)], "source_table string, x int")
    orders = spark.createDataFrame([(1,)], "x int")
    got = run({"raw.t": t, "silver.orders": orders}, [
        Rule("literal", "raw.t", "t.source_table = 'silver.orders'"), Rule("double", "raw.t", 't.source_table = "silver.orders"'), Rule("escaped", "raw.t", r"t.source_table <> 'it\'s silver.orders'"),
        Rule("comment", "raw.t", "/* silver.orders' */ EXISTS (SELECT 1 FROM silver.orders o WHERE o.x = t.x) -- silver.orders")])
    assert {k: (v.status, v.failed_records) for k, v in got.items()} == {"literal": ("FAIL", 1), "double": ("FAIL", 1), "escaped": ("PASS", 0), "comment": ("FAIL", 1)}


@pytest.mark.parametrize("expression,windowless", [
    ("COUNT(*) OVER (PARTITION BY k) = 1", True), ("count(1) over (partition by t.k, `odd name`) < 3 AND v > 2", True), ("COUNT(*) OVER (PARTITION BY k) = COUNT(*) OVER (PARTITION BY k, v)", True),
    ("v <> 3 OR COUNT(*) OVER (PARTITION BY `odd name`) > 5000", True), ("COUNT(*) OVER (PARTITION BY k) = 1 OR SUM(v) OVER (PARTITION BY k) > 3", False),
    ("COUNT(*) OVER (PARTITION BY k ORDER BY v) = 1", False), ("'COUNT(*) OVER (PARTITION BY k)' <> 'x'", False)])
def test_counts_over_a_key_without_a_window(spark, expression, windowless):
    """A key with half of the rows, and NULL keys."""
    t = spark.range(4000).selectExpr("CASE WHEN id < 2000 THEN 0 WHEN id < 2100 THEN NULL ELSE id div 2 END AS k", "id % 4 AS v", "CAST(id % 7 AS string) AS `odd name`")
    expected = t.alias("t").selectExpr(f"CASE WHEN {expression} THEN 0 ELSE 1 END AS f").selectExpr("count(*) AS n", "sum(f) AS f").first()
    found = rules.check_rule(t, expression)
    assert tuple(found.first()) == tuple(expected)
    assert ("Window" in found._jdf.queryExecution().executedPlan().toString()) == (not windowless and "OVER (" in expression.upper().replace("'COUNT(*) OVER (PARTITION BY K)'", ""))
    assert tuple(rules.check_rule(t.limit(0), expression).first()) == (0, 0)


def test_samples_repeat_and_share_a_scan(spark, tmp_path):
    spark.range(3000).selectExpr("id", "id % 11 AS k", "array(id) AS list").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    several = [Rule(f"r{i}", "t", f"k <> {i}") for i in range(12)]
    samples = rules.failing_samples({"t": t}, several, 5)
    assert samples._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    first = {r.rule_id: r.sample_failed_records for r in samples.collect()}
    again = {r.rule_id: r.sample_failed_records for r in rules.failing_samples({"t": t.repartition(7)}, several, 5).collect()}
    assert first == again and set(first) == {f"r{i}" for i in range(11)}
    digests = {r.id: r.d for r in t.select("id", rules.row_digest(t).alias("d")).collect()}
    for i in range(11):
        assert {r["id"] for r in json.loads(first[f"r{i}"])} == set(sorted((x for x in range(3000) if x % 11 == i), key=digests.get)[:5])


def test_uncorrelated_exists_edges(spark):
    cases = {"EXISTS (SELECT 1 FROM c WHERE c.id = id)": True, "exists (select 1 from c where c.[id] = [id])": True, 'EXISTS (SELECT 1 FROM c WHERE c."id" = `id`)': True,
             "EXISTS (SELECT 1 FROM c WHERE c.id = t.id)": False, "EXISTS (SELECT 1 FROM c WHERE c.id = t . id)": False, "EXISTS (SELECT 1 FROM c WHERE c.id = 5)": False,
             "EXISTS (SELECT 1 FROM c WHERE c.id = NULL)": False, "EXISTS (SELECT 1 FROM c WHERE c.ok = true)": False, "EXISTS (SELECT 1 FROM c WHERE id = c.id)": False,
             "c.id = id": False, "EXISTS (SELECT 1 FROM c WHERE c.id = long_name AND c.k = t.k)": True}
    df = spark.createDataFrame([(e,) for e in cases], "e string")
    assert {r.e: r.hit for r in df.select("e", rule_lint.uncorrelated_exists(F.col("e")).alias("hit")).collect()} == cases
