"""Source, sink, filter and join queries (S, F, J)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.operators import filters, lineage, relational, rule_results, rules, trust
from assay.session import shared_folder
from assay.sources import datasets, metadata, readers, sinks, windows
from workbench import derived as d
from workbench.lineage import all_edges, key_constraints, manifests
from workbench.registry import query, table


def _folder(spark):
    return f"{shared_folder(spark)}/assay-tables-{uuid.uuid4().hex}"


# --- sources -----------------------------------------------------------------

@query("s1_read_formats", " UNION ALL ".join(
    f"SELECT '{f}' AS format, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(o_custkey) AS BIGINT) AS customers, "
    "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, "
    "count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 2" for f in (*readers.FILE_FORMATS, "table")))
def s1(spark, sf):
    """Orders written and read back in every file format, and through the catalog."""
    orders = table(spark, sf, "orders")
    base, out = _folder(spark), None

    def totals(df):
        return df.groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("o_custkey").alias("customers"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
            F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"),
            F.count_distinct("o_orderpriority").alias("priorities"))

    for fmt in readers.FILE_FORMATS:
        orders.write.format(fmt).save(f"{base}/{fmt}")
        back = readers.read_table(spark, f"{base}/{fmt}", fmt, schema=orders.schema)
        part = totals(back).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    view = f"assay_orders_{uuid.uuid4().hex}"
    orders.createOrReplaceTempView(view)
    listed = totals(readers.read_table(spark, view, "table"))
    return out.unionByName(listed.withColumn("format", F.lit("table")))


_SCHEMAS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string", "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string"}
_COLUMNS = {t: [c.rsplit(" ", 1) for c in s.split(", ")] for t, s in _SCHEMAS.items()}
_ROWS = " UNION ALL ".join(f"SELECT 'main.{t}' AS table_fqn, {len(c)} AS columns, count(*) AS row_count FROM {t}" for t, c in _COLUMNS.items())


@query("s2_table_catalog", _ROWS)
def s2(spark, sf):
    tabs = {f"main.{t}": table(spark, sf, t) for t in _SCHEMAS}
    return metadata.table_catalog(spark, {**tabs, "information_schema.tables": table(spark, sf, "region")})


@query("s2_column_catalog", f"""
SELECT c.table_fqn, c.column_name, c.data_type, n.row_count FROM (VALUES {', '.join(f"('main.{t}', '{n}', '{k}')" for t, c in _COLUMNS.items() for n, k in c)}) AS c(table_fqn, column_name, data_type)
JOIN ({_ROWS}) n USING (table_fqn)""")
def s2_columns(spark, sf):
    tabs = {f"main.{t}": table(spark, sf, t) for t in _SCHEMAS}
    cols = metadata.column_catalog(spark, tabs).select("table_fqn", "column_name", "data_type")
    return cols.join(metadata.table_catalog(spark, tabs).select("table_fqn", "row_count"), "table_fqn")


@query("s2_session_tables", "SELECT 'assay_catalog_' || t AS table_name, n FROM (SELECT 'labels' AS t, count(*) AS n FROM labels UNION ALL SELECT 'nation', count(*) FROM nation)")
def s2_session(spark, sf):
    """Tables that the session's catalog lists, read through it."""
    names = [f"assay_catalog_{t}" for t in ("labels", "nation")]
    for name in names:
        table(spark, sf, name.removeprefix("assay_catalog_")).createOrReplaceTempView(name)
    found = metadata.session_tables(spark)
    parts = [found[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names]
    return parts[0].unionByName(parts[1])


@query("s7_foreign_keys", """
SELECT 'fk_' || child || '_' || parent AS constraint_name, parent AS parent_fqn, child AS child_fqn, 'key,line_no' AS parent_columns, 'parent_key,parent_line' AS child_columns
FROM (SELECT source AS parent, target AS child FROM w_tedges UNION ALL SELECT table_fqn, table_fqn FROM w_tables)""")
def s7(spark, sf):
    return key_constraints(spark, sf).withColumns({c: F.array_join(c, ",") for c in ("parent_columns", "child_columns")})


def query_log(spark, sf):
    """A statement per order: inserts, merges and plain reads, with uneven spacing and case."""
    key, s = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    text = (F.when(s == "F", F.concat(F.lit("INSERT  INTO gold.c_"), key, F.lit(" SELECT * FROM silver.orders")))
            .when(s == "P", F.concat(F.lit("MERGE INTO gold.c_"), key, F.lit("\n USING x")))
            .otherwise(F.concat(F.lit("SELECT * FROM gold.c_"), key)))
    odd = F.when(F.col("o_orderpriority") == "5-LOW", F.replace(text, F.lit(" "), F.lit("   "))).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", odd.alias("query_text"), F.col("o_orderdate").alias("executed_at"), F.floor(F.col("o_totalprice") / 1000).alias("execution_count"))


@query("s8_query_history", """
SELECT o_orderkey, statement, execution_count FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY execution_count DESC, o_orderdate DESC, o_orderpriority = '5-LOW' DESC) AS rn FROM (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN 'insert into gold.c_' || o_custkey || ' select * from silver.orders' ELSE 'merge into gold.c_' || o_custkey || ' using x' END AS statement,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS execution_count FROM orders WHERE o_orderstatus IN ('F', 'P'))) WHERE rn = 1""")
def s8(spark, sf):
    from assay.functions.text import normalised_statement
    h = metadata.query_history(query_log(spark, sf))
    return h.select("o_orderkey", normalised_statement(F.col("query_text")).alias("statement"), "execution_count")


@query("s8_plan_runs", "SELECT user_id AS plan_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS executed_at, CAST(sum(event_id % 7) AS BIGINT) AS execution_count FROM events GROUP BY 1")
def s8_plans(spark, sf):
    """Run-time statistics added up per plan; a user's events are a plan's runs."""
    runs = table(spark, sf, "events").select(F.col("user_id").alias("plan_id"), F.col("ts").alias("last_execution_time"), (F.col("event_id") % 7).alias("count_executions"))
    return metadata.plan_runs(runs).withColumn("executed_at", F.date_format("executed_at", "yyyy-MM-dd HH:mm:ss"))


def _schema_tables(spark, sf):
    return d.tables(spark, sf).select("connection_id", "table_fqn", F.split_part("table_fqn", F.lit("."), F.lit(1)).alias("schema_name"), "layer")


_LISTING = """SELECT t.table_fqn, lower(t.layer) AS schema_name, t.layer, round(coalesce(l.quality_score, 0)) AS score, coalesce(l.row_count, 0) AS rows, coalesce(strftime(l.run_at, '%Y-%m-%d'), '—') AS profiled,
 coalesce(round(l.quality_score) > 0 AND round(l.quality_score) < 70, FALSE) AS hot FROM w_tables t LEFT JOIN (SELECT * FROM w_latest WHERE layer <> 'GOLD') l ON l.table_fqn = t.table_fqn"""


@query("s9_datasets", _LISTING)
def s9(spark, sf):
    out = datasets.list_datasets(_schema_tables(spark, sf), d.reports(spark, sf).filter("layer <> 'GOLD'"))
    return out.select("table_fqn", "schema_name", "layer", "score", "rows", "profiled", "hot")


@query("s9_dataset_groups", f"SELECT schema_name, layer, count(*) AS tables, count(*) FILTER (WHERE hot) AS hot_tables, CAST(sum(rows) AS BIGINT) AS rows FROM ({_LISTING}) GROUP BY 1, 2")
def s9_groups(spark, sf):
    return datasets.dataset_groups(datasets.list_datasets(_schema_tables(spark, sf), d.reports(spark, sf).filter("layer <> 'GOLD'")))


@query("s10_layer_resolution", "SELECT table_fqn, CASE layer WHEN 'RAW' THEN 'BRONZE' WHEN 'GOLD' THEN 'UNKNOWN' ELSE layer END AS layer FROM w_tables")
def s10(spark, sf):
    t = _schema_tables(spark, sf).drop("layer")
    assigned = t.select("schema_name").distinct().filter("schema_name IN ('raw', 'gold')").select(
        "schema_name", F.when(F.col("schema_name") == "raw", "BRONZE").otherwise("monitor").alias("assigned"))
    return datasets.resolve_layers(t, assigned).select("table_fqn", "layer")


@query("s11_saved_reports", """
SELECT r.table_fqn, count(DISTINCT r.report_id) AS reports, count(*) AS stats, CAST(sum(s.row_count) AS BIGINT) AS rows FROM w_reports r JOIN w_stats s USING (report_id) GROUP BY 1""")
def s11(spark, sf):
    base = _folder(spark)
    sinks.save_reports(base, d.reports(spark, sf), d.column_stats(spark, sf))
    r, s = spark.read.parquet(f"{base}/reports").select("report_id", "table_fqn"), spark.read.parquet(f"{base}/column_stats").select("report_id", "row_count")
    return r.join(s, "report_id").groupBy("table_fqn").agg(F.count_distinct("report_id").alias("reports"), F.count(F.lit(1)).alias("stats"), F.sum("row_count").alias("rows"))


@query("s12_saved_results", "SELECT connection_id, run_id, count(*) AS results, count(*) FILTER (WHERE status = 'FAIL') AS failed FROM w_results GROUP BY 1, 2")
def s12(spark, sf):
    path = f"{_folder(spark)}/results"
    sinks.append_table(d.results(spark, sf), path)
    return spark.read.parquet(path).groupBy("connection_id", "run_id").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("status") == "FAIL").alias("failed"))


_Q = lambda c: f"""'"' || replace(CASE WHEN coalesce({c}, '')[1:1] IN ('=', '+', '-', '@') THEN '''' || {c} ELSE coalesce({c}, '') END, '"', '""') || '"'"""


@query("s13_csv_export", f"SELECT {_Q('column_id')} || ',' || {_Q('description')} || ',' || {_Q('quoted')} AS line FROM (SELECT *, '\"' || data_type || '\"' AS quoted FROM w_dict)")
def s13(spark, sf):
    dic = d.dictionary(spark, sf).select("column_id", "description", F.concat(F.lit('"'), "data_type", F.lit('"')).alias("quoted"))
    return sinks.csv_lines(dic)


@query("s14_json_samples", """
SELECT '{"n_nationkey":' || n_nationkey || ',"c_name":"' || c_name || '","seen":"2024-02-03T04:05:06","day":"2024-02-03","share":1.5,"raw":"' || lower(hex(encode(c_mktsegment))) || '"}' AS sample
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def s14(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return sinks.json_samples(c.select("n_nationkey", "c_name", F.lit("2024-02-03 04:05:06").cast("timestamp_ntz").alias("seen"), F.lit("2024-02-03").cast("date").alias("day"),
                                       F.lit("1.5").cast("decimal(5,2)").alias("share"), F.col("c_mktsegment").cast("binary").alias("raw")))


@query("s15_manifest_entries", """
SELECT 'project_' || c_custkey AS project, e.uid AS uid, e.fqn AS fqn, e.deps AS deps FROM (SELECT c_custkey, unnest([
  {'uid': 'model.p.clean', 'fqn': 'Silver.clean_' || c_custkey, 'deps': 'source.p.nation,source.p.unknown'}, {'uid': 'model.p.mart', 'fqn': 'Gold.sales.mart_' || c_nationkey, 'deps': 'model.p.clean,model.p.mart'},
  {'uid': 'source.p.nation', 'fqn': 'Raw.crm.nation_' || c_nationkey, 'deps': ''}]) AS e FROM customer)""")
def s15(spark, sf):
    return metadata.read_manifest(manifests(spark, sf), "project", "manifest").select("project", "uid", "fqn", F.array_join("depends_on", ",").alias("deps"))


@query("s16_graph_difference", """
SELECT 'edge' AS kind, 'remove' AS action, source, target FROM w_tedges WHERE target LIKE 'gold.%'
UNION ALL SELECT 'edge', 'add', table_fqn, 'export.' || table_fqn FROM w_tables WHERE layer = 'SILVER'
UNION ALL SELECT 'node', 'add', 'new.' || table_fqn, NULL FROM w_tables WHERE layer = 'RAW'
UNION ALL SELECT 'node', 'remove', table_fqn, NULL FROM w_tables t WHERE layer = 'UNKNOWN' AND NOT EXISTS (SELECT 1 FROM w_tedges e WHERE e.target NOT LIKE 'gold.%' AND t.table_fqn IN (e.source, e.target))""")
def s16(spark, sf):
    edges, nodes, tabs = d.table_edges(spark, sf), d.table_nodes(spark, sf), d.tables(spark, sf)
    name = lambda p: F.concat(F.lit(p), F.col("table_fqn"))
    wanted_edges = edges.filter("target NOT LIKE 'gold.%'").select("source", "target").unionByName(
        tabs.filter("layer = 'SILVER'").select(F.col("table_fqn").alias("source"), name("export.").alias("target")))
    wanted_nodes = nodes.filter("layer <> 'UNKNOWN'").select("external_id").unionByName(tabs.filter("layer = 'RAW'").select(name("new.").alias("external_id")))
    return lineage.graph_difference(nodes, edges, wanted_nodes, wanted_edges)


# --- filters -----------------------------------------------------------------

@query("f1_window_presets", """
SELECT preset, count(*) AS n FROM (SELECT '24h' AS preset FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOURS AND ts < TIMESTAMP '2024-01-20'
UNION ALL SELECT '7d' FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS AND ts < TIMESTAMP '2024-01-20' UNION ALL SELECT '30d' FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 30 DAYS AND ts < TIMESTAMP '2024-01-20'
UNION ALL SELECT 'since_last' FROM events WHERE ts >= (SELECT max(run_at) FROM w_event_days WHERE run_at < TIMESTAMP '2024-01-18') AND ts < TIMESTAMP '2024-01-20' UNION ALL SELECT 'no_column' FROM events) GROUP BY 1""")
def f1(spark, sf):
    e = table(spark, sf, "events")
    runs = d.event_days(spark, sf).filter(F.col("run_at") < d.as_of("2024-01-18"))
    out = None
    for preset, column in (("24h", "TS"), ("7d", "ts"), ("30d", "ts"), ("since_last", "ts"), ("no_column", "missing")):
        part = windows.preset_filter(e, column, "24h" if preset == "no_column" else preset, "2024-01-20 00:00:00", runs)
        part = part.agg(F.lit(preset).alias("preset"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def connections(spark, sf):
    return d.tables(spark, sf).select("connection_id").distinct().withColumn("org_id", F.when(F.col("connection_id") == "conn_1", "acme").otherwise("other"))


@query("f3_visible_anomalies", "SELECT anomaly_id, table_fqn FROM w_anoms WHERE connection_id = 'conn_1'")
def f3(spark, sf):
    from workbench.anomalies import anomaly_log
    return filters.visible(anomaly_log(spark, sf), connections(spark, sf), "acme").select("anomaly_id", "table_fqn")


@query("f4_rule_selection", "SELECT rule_id, severity FROM w_rules WHERE connection_id = 'conn_0' AND status IN ('approved', 'active') AND layer = 'GOLD'")
def f4(spark, sf):
    return rules.select_rules(d.rules(spark, sf), "conn_0", layer="GOLD").select("rule_id", "severity")


@query("f5_snooze_expiry", f"SELECT rule_id, CASE WHEN status = 'snoozed' AND snooze_until <= TIMESTAMP '{d.AS_OF}' THEN 'draft' ELSE status END AS status FROM w_rules")
def f5(spark, sf):
    return rule_results.expire_snoozes(d.rules(spark, sf), d.as_of()).select("rule_id", "status")


@query("f6_key_columns", "SELECT column_id FROM (SELECT *, CASE WHEN status = 'draft' THEN column_name || '_ID' WHEN is_pii THEN column_name || 'Code' ELSE column_name END AS n FROM w_dict) WHERE regexp_matches(n, '(?i)(_id|id|key|code)$')")
def f6(spark, sf):
    name = F.when(F.col("status") == "draft", F.concat("column_name", F.lit("_ID"))).when(F.col("is_pii"), F.concat("column_name", F.lit("Code"))).otherwise(F.col("column_name"))
    return filters.key_columns(d.dictionary(spark, sf).withColumn("column_name", name)).select("column_id")


@query("f7_null_samples", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1999-01-01' ORDER BY o_orderkey LIMIT 10")
def f7(spark, sf):
    """Rows without a status inside a window, in order of their key, so that the same ones are shown each time."""
    from assay.operators.profile import risk_samples
    o = table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))).orderBy("o_orderkey")
    s = risk_samples(o, F.col("o_orderstatus").isNull(), 10, windows.window_condition(o, "o_orderdate", "1999-01-01"))
    row = F.from_json("sample", "o_orderkey bigint, o_orderdate string")
    return s.select(row.alias("r")).select("r.o_orderkey", F.substring("r.o_orderdate", 1, 10).alias("day"))


@query("f8_dictionary_grid", "SELECT column_id FROM w_dict WHERE (contains(lower(column_name), 'red') OR contains(lower(coalesce(description, '')), 'red') OR contains(lower(coalesce(business_name, '')), 'red')) AND status = 'draft' AND NOT is_cde AND layer = 'SILVER'")
def f8(spark, sf):
    return filters.dictionary_grid(d.dictionary(spark, sf), search="RED", status="draft", layer="SILVER", is_cde=False, sort_by="cde_score", descending=True).select("column_id")


@query("f9_rule_grid", "SELECT rule_id, 'rule' AS grid FROM w_rules WHERE related_table_fqn IS NOT NULL AND contains(lower(rule_expression), 'l_tax') UNION ALL SELECT result_id, 'result' FROM w_results WHERE status = 'FAIL' AND NOT is_expected_failure AND layer = 'BRONZE'")
def f9(spark, sf):
    a = filters.rule_grid(d.rules(spark, sf), rule_type="CROSS_TABLE", search="L_TAX").select("rule_id", F.lit("rule").alias("grid"))
    b = filters.result_grid(d.results(spark, sf), layer="BRONZE", status="FAIL").select(F.col("result_id").alias("rule_id"), F.lit("result").alias("grid"))
    return a.unionByName(b)


# --- joins -------------------------------------------------------------------

@query("j1_anti_join", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def j1(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.anti_join(table(spark, sf, "orders"), li, ["o_orderkey"]).select("o_orderkey")


@query("j2_exists_flag", "SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS has_label FROM documents d")
def j2(spark, sf):
    return relational.exists_flag(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"], "has_label")


@query("j3_stats_of_reports", "SELECT s.report_id, s.column_name, r.quality_score FROM w_stats s JOIN w_reports r USING (report_id) WHERE s.null_pct > 50")
def j3(spark, sf):
    high = d.column_stats(spark, sf).filter("null_pct > 50").select("report_id", "column_name")
    return high.join(d.reports(spark, sf).select("report_id", "quality_score"), "report_id")


@query("j4_named_results", "SELECT x.result_id, coalesce(nullif(x.rule_name, ''), nullif(r.rule_name, ''), 'unnamed rule') AS shown_name FROM w_results x LEFT JOIN w_rules r USING (rule_id) WHERE x.status = 'FAIL'")
def j4(spark, sf):
    return trust.with_rule_names(d.results(spark, sf).filter("status = 'FAIL'"), d.rules(spark, sf), "unnamed rule").select("result_id", "shown_name")


@query("j5_latest_row", "SELECT c_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM customer LEFT JOIN LATERAL (SELECT * FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON TRUE")
def j5(spark, sf):
    last = relational.latest_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))


@query("j6_last_values", "SELECT table_fqn, string_agg(row_count, ',' ORDER BY run_at) AS history FROM (SELECT *, row_number() OVER (PARTITION BY table_fqn ORDER BY run_at DESC) AS rn FROM w_event_days) WHERE rn <= 7 GROUP BY 1")
def j6(spark, sf):
    h = relational.newest_values(d.event_days(spark, sf), ["table_fqn"], [F.desc("run_at")], "run_at", "row_count", 7, "history")
    return h.select("table_fqn", F.array_join("history", ",").alias("history"))


@query("j7_touching_edges", "SELECT DISTINCT n.external_id FROM w_tnodes n JOIN w_alledges e ON e.source = n.external_id OR e.target = n.external_id WHERE e.status = 'confirmed'")
def j7(spark, sf):
    confirmed = all_edges(spark, sf).filter("status = 'confirmed'")
    return relational.touching(d.table_nodes(spark, sf), "external_id", confirmed, "source", "target").select("external_id")


@query("j8_full_outer", "SELECT a.k AS k, a.n AS before, b.n AS after FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) a JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1) b USING (k) UNION ALL "
       "SELECT k, n, NULL FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') UNION ALL "
       "SELECT k, NULL, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')")
def j8(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    old, _ = windows.window_filter(o, "o_orderdate", None, "1996-01-01")
    new, _ = windows.window_filter(o, "o_orderdate", "2001-01-01", None)
    return relational.key_counts(old, ["k"], "before").join(relational.key_counts(new, ["k"], "after"), "k", "full_outer")


@query("j9_previous_run", "SELECT report_id, row_count, lag(row_count) OVER (PARTITION BY table_fqn ORDER BY run_at) AS prev_row_count FROM w_reports")
def j9(spark, sf):
    return relational.previous_run(d.reports(spark, sf), ["table_fqn"], "run_at", ["row_count"]).select("report_id", "row_count", "prev_row_count")


@query("j10_composite_match", """
SELECT p_partkey, n, CAST(q AS BIGINT) AS q, reviewed FROM (SELECT p_partkey FROM part) LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) FILTER (WHERE (l_orderkey, l_suppkey) IN (SELECT o_orderkey, o_custkey FROM orders)) AS reviewed FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def j10(spark, sf):
    """Composite-key existence, then aggregate against header."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    pairs = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_suppkey"))
    counted = li.groupBy("l_orderkey", "l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("l_quantity").cast("bigint")).alias("s"))
    flagged = relational.exists_flag(counted, pairs, ["l_orderkey", "l_suppkey"], "hit")
    per = flagged.groupBy("l_partkey").agg(F.sum("c").alias("n"), F.sum("s").alias("q"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("c"))), F.lit(0)).alias("reviewed"))
    return table(spark, sf, "part").select("p_partkey").join(per, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "n", "q", "reviewed")
