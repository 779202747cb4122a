"""Run histories and metadata relations derived from the operational tables.

The driver's tables hold no profiling reports, rule results or lineage, so the
queries build them: a supplier is a monitored table, a ship month one run.
Each relation exists twice, as a DataFrame and as a CTE of the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import exact
from assay.session import staged_table
from workbench.registry import cte, percent, ratio, table

AS_OF = "2001-10-15 06:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


# A relation that a query uses several times is written once to the shared folder; each use reads only its columns.
stage = staged_table


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


# --- monitored tables --------------------------------------------------------

def tables(spark: SparkSession, sf: str) -> DataFrame:
    """One monitored table per supplier; its region decides the layer."""
    layer = (F.when(F.col("n_regionkey") == 0, "RAW").when(F.col("n_regionkey") == 1, "BRONZE")
             .when(F.col("n_regionkey") == 2, "SILVER").when(F.col("n_regionkey") == 3, "GOLD").otherwise("UNKNOWN"))
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return (s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("layer", layer)
            .withColumn("table_fqn", F.concat(F.lower("layer"), F.lit(".supplier_"), F.col("s_suppkey").cast("string")))
            .withColumn("connection_id", F.concat(F.lit("conn_"), (F.col("n_nationkey") % 2).cast("string")))
            .select("s_suppkey", "connection_id", "table_fqn", "layer", "s_acctbal"))


cte("w_tables", """
SELECT s_suppkey, 'conn_' || (n_nationkey % 2) AS connection_id, layer,
       lower(layer) || '.supplier_' || s_suppkey AS table_fqn, s_acctbal
FROM (SELECT *, CASE n_regionkey WHEN 0 THEN 'RAW' WHEN 1 THEN 'BRONZE' WHEN 2 THEN 'SILVER'
                                 WHEN 3 THEN 'GOLD' ELSE 'UNKNOWN' END AS layer
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
""")


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem counted per supplier and ship month, before any join."""
    li = table(spark, sf, "lineitem")
    counted = li.groupBy("l_suppkey", F.date_trunc("month", F.col("l_shipdate")).alias("run_at")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_returnflag") == "A").alias("missing"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_discount") > 0.05).alias("disc_high"),
        F.count_if(F.col("l_discount") == 0).alias("disc_zero"),
        F.count_if(F.col("l_tax") > 0.06).alias("tax_high"),
        F.count_if(F.col("l_quantity") > 49).alias("qty_high"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
    return counted.join(tables(spark, sf), F.col("l_suppkey") == F.col("s_suppkey"))


cte("w_monthly", """
SELECT m.*, t.* FROM (
  SELECT l_suppkey, date_trunc('month', l_shipdate) AS run_at, count(*) AS n,
         count(*) FILTER (WHERE l_returnflag = 'A') AS missing,
         count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
         count(*) FILTER (WHERE l_discount > 0.05) AS disc_high,
         count(*) FILTER (WHERE l_discount = 0) AS disc_zero,
         count(*) FILTER (WHERE l_tax > 0.06) AS tax_high,
         count(*) FILTER (WHERE l_quantity > 49) AS qty_high,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
  FROM lineitem GROUP BY 1, 2) m JOIN w_tables t ON m.l_suppkey = t.s_suppkey
""")


# --- profiling history -------------------------------------------------------

def reports(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    n = F.col("n")
    m = ((monthly(spark, sf) if base is None else base)
         .withColumn("completeness_score", exact.percent(n - F.col("missing"), n, 1))
         .withColumn("uniqueness_score", exact.percent(n - F.col("returned"), n, 1))
         .withColumn("consistency_score", exact.percent(n - F.col("disc_high"), n, 1))
         .withColumn("freshness_score", F.lit(100.0)))
    tenths = (exact.scaled(F.col("completeness_score"), 1) * 35 + exact.scaled(F.col("uniqueness_score"), 1) * 25
              + exact.scaled(F.col("consistency_score"), 1) * 25 + F.lit(15000))
    return m.select(
        F.concat("table_fqn", F.lit("@"), F.date_format("run_at", "yyyy-MM")).alias("report_id"),
        "connection_id", "table_fqn", "layer", "run_at", n.alias("row_count"), "completeness_score",
        "uniqueness_score", "consistency_score", "freshness_score",
        exact.ratio(tenths, F.lit(1000), 1).alias("quality_score"))


cte("w_reports", f"""
SELECT report_id, connection_id, table_fqn, layer, run_at, row_count, completeness_score, uniqueness_score,
       consistency_score, freshness_score,
       {ratio('round(completeness_score*10)*35 + round(uniqueness_score*10)*25 + round(consistency_score*10)*25 + 15000', '1000', 1)} AS quality_score
FROM (SELECT table_fqn || '@' || strftime(run_at, '%Y-%m') AS report_id, connection_id, table_fqn, layer, run_at,
             n AS row_count, {percent('n - missing', 'n', 1)} AS completeness_score,
             {percent('n - returned', 'n', 1)} AS uniqueness_score,
             {percent('n - disc_high', 'n', 1)} AS consistency_score, 100.0::DOUBLE AS freshness_score
      FROM w_monthly)
""")


def column_stats(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    n, zero, none = F.col("n"), F.lit(0.0), F.lit(None).cast("double")

    def cell(name, dtype, pct, distinct, mean):
        return F.struct(F.lit(name).alias("column_name"), F.lit(dtype).alias("data_type"), pct.alias("null_pct"),
                        distinct.cast("bigint").alias("distinct_count"), mean.alias("mean_value"))

    return (monthly(spark, sf) if base is None else base).select(
        F.concat("table_fqn", F.lit("@"), F.date_format("run_at", "yyyy-MM")).alias("report_id"),
        "connection_id", "table_fqn", "layer", "run_at", n.alias("row_count"),
        F.inline(F.array(
            cell("returnflag", "STRING", exact.percent(F.col("missing"), n), F.lit(2), none),
            cell("quantity", "DOUBLE", zero, F.least(n, F.lit(50)), exact.ratio(F.col("qty"), n, 4)),
            cell("discount_key", "DOUBLE", exact.percent(F.col("disc_zero"), n), n - F.col("disc_zero"), none))))


cte("w_stats", f"""
SELECT table_fqn || '@' || strftime(run_at, '%Y-%m') AS report_id, connection_id, table_fqn, layer, run_at,
       n AS row_count, c.column_name, c.data_type, c.null_pct, c.distinct_count, c.mean_value
FROM (SELECT *, unnest([
   {{'column_name': 'returnflag', 'data_type': 'STRING', 'null_pct': {percent('missing', 'n')},
     'distinct_count': 2::BIGINT, 'mean_value': NULL::DOUBLE}},
   {{'column_name': 'quantity', 'data_type': 'DOUBLE', 'null_pct': 0.0::DOUBLE,
     'distinct_count': least(n, 50)::BIGINT, 'mean_value': {ratio('qty', 'n', 4)}}},
   {{'column_name': 'discount_key', 'data_type': 'DOUBLE', 'null_pct': {percent('disc_zero', 'n')},
     'distinct_count': (n - disc_zero)::BIGINT, 'mean_value': NULL::DOUBLE}}]) AS c FROM w_monthly)
""")


# --- rules and their results -------------------------------------------------

_RULE_COLS = ("rule_name", "column_name", "rule_expression", "rule_type", "severity", "is_cde_rule", "created_by",
              "related_table_fqn", "rule_description")
_RULES = (
    ("discount_range", "discount", "l_discount <= 0.05", "RANGE", "HIGH", False, "AI_AGENT", None, "discount stays low"),
    ("tax_range", "tax", "l_tax <= 0.06", "FK", "MEDIUM", False, "AI_AGENT", "gold.orders", "[Cross-table: gold.orders] tax matches"),
    ("", "returnflag", "nullif(l_returnflag, 'A') IS NOT NULL", "NULL_CHECK", "CRITICAL", True, "ana@example.com", None, "flag is present"),
    ("quantity_cap", "quantity", "l_quantity <= 49", "VOLUME", "LOW", False, "bo@example.com", None, "a self-referencing cap"),
)


def rules(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i + 1).alias("rule_no"),
                               *[F.lit(v).cast("string" if not isinstance(v, bool) else "boolean").alias(c)
                                 for c, v in zip(_RULE_COLS, r)]) for i, r in enumerate(_RULES)])
    no, bal = F.col("rule_no"), F.col("s_acctbal")
    return (tables(spark, sf).select("*", F.inline(cells)).select(
        F.concat("table_fqn", F.lit("#"), no.cast("string")).alias("rule_id"), "rule_no", "connection_id", "table_fqn",
        "layer", *_RULE_COLS,
        F.when(no == 1, "approved").when(no == 2, "active").when((no == 3) & (bal >= 0), "approved")
        .when(no == 3, "draft").when(bal < 0, "retired").otherwise("snoozed").alias("status"),
        F.when((no == 4) & (bal >= 0), F.timestamp_add("DAY", F.col("s_suppkey").cast("int"), F.lit("2001-08-01").cast("timestamp"))).alias("snooze_until"),
        F.timestamp_add("HOUR", F.col("s_suppkey").cast("int"), F.lit("2001-01-01").cast("timestamp")).alias("created_at")))


def _sql_rule(i, r):
    lit = lambda v: "NULL::VARCHAR" if v is None else (str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'")
    return "{'rule_no': %d, %s}" % (i + 1, ", ".join(f"'{c}': {lit(v)}" for c, v in zip(_RULE_COLS, r)))


cte("w_rules", f"""
SELECT table_fqn || '#' || r.rule_no AS rule_id, r.rule_no AS rule_no, connection_id, table_fqn, layer,
       {', '.join('r.' + c + ' AS ' + c for c in _RULE_COLS)},
       CASE WHEN r.rule_no = 1 THEN 'approved' WHEN r.rule_no = 2 THEN 'active'
            WHEN r.rule_no = 3 AND s_acctbal >= 0 THEN 'approved' WHEN r.rule_no = 3 THEN 'draft'
            WHEN s_acctbal < 0 THEN 'retired' ELSE 'snoozed' END AS status,
       CASE WHEN r.rule_no = 4 AND s_acctbal >= 0 THEN TIMESTAMP '2001-08-01' + to_days(CAST(s_suppkey AS INTEGER)) END AS snooze_until,
       TIMESTAMP '2001-01-01' + to_hours(s_suppkey) AS created_at
FROM (SELECT *, unnest([{', '.join(_sql_rule(i, r) for i, r in enumerate(_RULES))}]) AS r FROM w_tables)
""")


def results(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """Four rules per supplier and month, counted in the one scan of ``monthly``."""
    n = F.col("n")
    cells = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.col(c).alias("failed"), F.lit(name).alias("rule_name"),
                               F.lit(sev).alias("severity"), F.lit(cde).alias("is_cde_rule"))
                      for i, c, name, sev, cde in _RESULT_RULES])
    readable = n > 2
    m = ((monthly(spark, sf) if base is None else base).select("*", F.inline(cells))
         .withColumn("total_records", F.when(readable, n).otherwise(0))
         .withColumn("failed_records", F.when(readable, F.col("failed")).otherwise(0))
         .withColumn("fail_pct", exact.percent(F.col("failed_records"), F.col("total_records"))))
    penalty = exact.scaled(F.col("fail_pct"), 2) * F.when(F.col("is_cde_rule"), 2).otherwise(1)
    score = exact.ratio(F.greatest(F.lit(0), F.lit(10000) - penalty), F.lit(100), 1)
    run_id = F.concat(F.lit("run_"), F.date_format("run_at", "yyyy-MM"))
    rule_id = F.concat("table_fqn", F.lit("#"), F.col("rule_no").cast("string"))
    return m.select(
        F.concat(run_id, F.lit("/"), rule_id).alias("result_id"), run_id.alias("run_id"),
        F.col("run_at").alias("run_timestamp"), "connection_id", rule_id.alias("rule_id"), "rule_name", "table_fqn",
        "layer", F.when(~readable, "ERROR").when(F.col("failed") > 0, "FAIL").otherwise("PASS").alias("status"),
        "total_records", "failed_records", "fail_pct", F.when(readable, score).otherwise(0.0).alias("quality_score"),
        "severity", "is_cde_rule",
        ((F.col("rule_no") == 4) & (F.col("layer") == "BRONZE")).alias("is_expected_failure"))


_RESULT_RULES = ((1, "disc_high", "discount_range", "HIGH", False), (2, "tax_high", "tax_range", "MEDIUM", False),
                 (3, "missing", "", "CRITICAL", True), (4, "qty_high", "quantity_cap", "LOW", False))

cte("w_results", f"""
SELECT 'run_' || strftime(run_at, '%Y-%m') || '/' || table_fqn || '#' || r.rule_no AS result_id,
       'run_' || strftime(run_at, '%Y-%m') AS run_id, run_at AS run_timestamp, connection_id,
       table_fqn || '#' || r.rule_no AS rule_id, r.rule_name AS rule_name, table_fqn, layer,
       CASE WHEN n <= 2 THEN 'ERROR' WHEN r.failed > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
       CASE WHEN n <= 2 THEN 0 ELSE n END AS total_records, CASE WHEN n <= 2 THEN 0 ELSE r.failed END AS failed_records,
       CASE WHEN n <= 2 THEN 0.0 ELSE r.fail_pct END AS fail_pct,
       CASE WHEN n <= 2 THEN 0.0 ELSE {ratio('greatest(0, 10000 - CAST(round(r.fail_pct * 100) AS BIGINT) * CASE WHEN r.is_cde_rule THEN 2 ELSE 1 END)', '100', 1)} END AS quality_score,
       r.severity AS severity, r.is_cde_rule AS is_cde_rule, (r.rule_no = 4 AND layer = 'BRONZE') AS is_expected_failure
FROM (SELECT *, unnest([{', '.join("{'rule_no': %d, 'failed': %s, 'fail_pct': %s, 'rule_name': '%s', 'severity': '%s', 'is_cde_rule': %s}" % (i, c, percent(c, 'n'), name, sev, str(cde).upper()) for i, c, name, sev, cde in _RESULT_RULES)}]) AS r FROM w_monthly)
""")


# --- work lists and logs -----------------------------------------------------

def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """One review task per order."""
    o = table(spark, sf, "orders")
    prio = (F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW"))
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done")
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.concat(F.lit("Review order "), F.col("o_orderkey").cast("string")).alias("title"),
        prio.alias("priority"), status.alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise(F.concat(F.lit("owner_"), F.col("o_custkey").cast("string"))).alias("owner"),
        F.date_add(F.col("o_orderdate").cast("date"), 90).alias("due_date"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("related_entity_id"))


cte("w_tasks", """
SELECT o_orderkey AS task_id, 'Review order ' || o_orderkey AS title,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'owner_' || o_custkey END AS owner,
       CAST(o_orderdate AS DATE) + 90 AS due_date, o_orderdate AS created_at, 'customer_' || o_custkey AS related_entity_id
FROM orders
""")


def audit(spark: SparkSession, sf: str) -> DataFrame:
    """One audit entry per event."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("audit_id"), F.col("ts").alias("event_timestamp"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("user_name"),
        F.upper("event_type").alias("event_type"), F.lit("RULE").alias("entity_type"),
        F.when(F.col("value") > 250, F.concat(F.lit("rule "), F.col("user_id").cast("string"))).alias("entity_name"),
        F.col("event_id").cast("string").alias("entity_id"))


cte("w_audit", """
SELECT event_id AS audit_id, ts AS event_timestamp, CASE WHEN event_type = 'error' THEN NULL ELSE 'user_' || user_id END AS user_name,
       upper(event_type) AS event_type, 'RULE' AS entity_type, CASE WHEN value > 250 THEN 'rule ' || user_id END AS entity_name,
       CAST(event_id AS VARCHAR) AS entity_id
FROM events
""")

# --- events per day ----------------------------------------------------------

def event_days(spark: SparkSession, sf: str) -> DataFrame:
    """Daily runs of five event tables."""
    e = table(spark, sf, "events")
    d = e.groupBy("event_type", F.date_trunc("day", F.col("ts")).alias("run_at")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("value") > 400).alias("nulls"),
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return d.select(
        F.concat(F.lit("conn_"), F.col("event_type")).alias("connection_id"), F.concat(F.lit("bronze.events_"), F.col("event_type")).alias("table_fqn"),
        F.lit("BRONZE").alias("layer"), "run_at", "row_count",
        exact.percent(F.col("nulls"), F.col("row_count")).alias("null_pct"),
        exact.ratio(F.col("cents"), F.col("row_count") * 100, 4).alias("mean_value"))


cte("w_event_days", f"""
SELECT 'conn_' || event_type AS connection_id, 'bronze.events_' || event_type AS table_fqn, 'BRONZE' AS layer, run_at, row_count,
       {percent('nulls', 'row_count')} AS null_pct, {ratio('cents', '100 * row_count', 4)} AS mean_value
FROM (SELECT event_type, date_trunc('day', ts) AS run_at, count(*) AS row_count,
             count(*) FILTER (WHERE value > 400) AS nulls, sum(CAST(round(value * 100) AS BIGINT)) AS cents
      FROM events GROUP BY 1, 2)
""")

# --- dictionary and critical data elements -----------------------------------

def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """One dictionary entry per part: its brand is the table."""
    p = table(spark, sf, "part")
    brand, size = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.col("p_size")
    layer = F.when(size <= 12, "RAW").when(size <= 25, "BRONZE").when(size <= 38, "SILVER").otherwise("GOLD")
    fqn = F.concat(F.lower(layer), F.lit("."), brand)
    column = F.concat(F.lower("p_type"), F.lit("_"), F.col("p_partkey").cast("string"))
    return p.select(
        F.concat(fqn, F.lit("."), column).alias("column_id"), F.concat(F.lit("conn_"), (F.col("p_partkey") % 2).cast("string")).alias("connection_id"),
        fqn.alias("table_fqn"), layer.alias("layer"), column.alias("column_name"), F.col("p_type").alias("data_type"),
        F.when(size % 3 != 0, F.initcap("p_name")).alias("business_name"),
        F.when(size % 5 != 0, F.concat(F.lit("="), F.col("p_name"))).alias("description"),
        (size > 40).alias("is_cde"), (F.col("p_type") == "PROMO").alias("is_pii"),
        F.when(size % 4 != 0, (size * 2).cast("double")).alias("cde_score"),
        F.when(size % 7 == 0, "approved").when(size % 7 == 1, "rejected").otherwise("draft").alias("status"))


cte("w_dict", """
SELECT table_fqn || '.' || column_name AS column_id, connection_id, table_fqn, layer, column_name, data_type,
       CASE WHEN p_size % 3 <> 0 THEN upper(p_name[1:1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] END AS business_name,
       CASE WHEN p_size % 5 <> 0 THEN '=' || p_name END AS description, p_size > 40 AS is_cde, p_type = 'PROMO' AS is_pii,
       CASE WHEN p_size % 4 <> 0 THEN (p_size * 2)::DOUBLE END AS cde_score,
       CASE WHEN p_size % 7 = 0 THEN 'approved' WHEN p_size % 7 = 1 THEN 'rejected' ELSE 'draft' END AS status
FROM (SELECT *, lower(layer) || '.' || lower(replace(p_brand, '#', '_')) AS table_fqn FROM (
  SELECT *, CASE WHEN p_size <= 12 THEN 'RAW' WHEN p_size <= 25 THEN 'BRONZE' WHEN p_size <= 38 THEN 'SILVER' ELSE 'GOLD' END AS layer,
         lower(p_type) || '_' || p_partkey AS column_name, 'conn_' || (p_partkey % 2) AS connection_id, p_type AS data_type FROM part))
""")


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Registered critical data elements: those of the dictionary with a score."""
    return dictionary(spark, sf).filter(F.col("is_cde") & F.col("cde_score").isNotNull()).select(
        "connection_id", "table_fqn", "column_name", "cde_score",
        F.when(F.col("status") == "rejected", "FAIL").when(F.col("status") == "approved", "PASS").otherwise("HEALTHY").alias("health"),
        F.lit("ana@example.com").alias("promoted_by"), F.lit(0).alias("rule_count"))


cte("w_cde", """
SELECT connection_id, table_fqn, column_name, cde_score,
       CASE status WHEN 'rejected' THEN 'FAIL' WHEN 'approved' THEN 'PASS' ELSE 'HEALTHY' END AS health, 'ana@example.com' AS promoted_by, 0 AS rule_count
FROM w_dict WHERE is_cde AND cde_score IS NOT NULL
""")


# --- model calls -------------------------------------------------------------

_MODELS = ("claude-haiku-3", "gpt-4o-mini-2024", "azure/gpt-4o", "ollama/llama3", "mystery-1", None)


def model_calls(spark: SparkSession, sf: str, rule_log: bool) -> DataFrame:
    """Model calls from events: errors and signups in the rule log, the rest in the usage log."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    in_rule_log = F.col("event_type").isin("error", "signup")
    e = e.filter(in_rule_log if rule_log else ~in_rule_log)
    status = (F.when(k >= 90, "error").when(F.lit(rule_log), "success").when(k >= 70, "fallback").otherwise("ai"))
    return e.select(
        F.col("event_type").alias("call_type" if rule_log else "feature"),
        F.get(F.array(*[F.lit(m).cast("string") for m in _MODELS]), (k % 6).cast("int")).alias("model"), status.alias("status"),
        F.round(F.col("value") * 100).cast("bigint").alias("input_tokens"), F.round(F.col("value") * 10).cast("bigint").alias("output_tokens"),
        F.when(k != 13, k * 17).cast("bigint").alias("latency_ms"), F.col("ts").alias("created_at"))


cte("w_calls", f"""
SELECT event_type AS feature, CASE k % 6 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODELS) if m)} END AS model,
       CASE WHEN k >= 90 THEN 'error' WHEN event_type IN ('error', 'signup') THEN 'success' WHEN k >= 70 THEN 'fallback' ELSE 'ai' END AS status,
       CAST(round(value * 100) AS BIGINT) AS input_tokens, CAST(round(value * 10) AS BIGINT) AS output_tokens,
       CASE WHEN k <> 13 THEN CAST(k * 17 AS BIGINT) END AS latency_ms
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")

# --- lineage between monitored tables ----------------------------------------

def table_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A tree over the monitored tables: supplier s feeds suppliers 3s to 3s+2.  The source decides the connection."""
    t = tables(spark, sf)
    up = t.select((F.col("s_suppkey")).alias("up"), "connection_id", F.col("table_fqn").alias("source"))
    down = t.filter("s_suppkey > 0").select(F.floor(F.col("s_suppkey") / 3).alias("up"), F.col("table_fqn").alias("target"))
    return down.join(up, "up").select("connection_id", "source", "target", F.lit("FEEDS").alias("edge_type"), F.lit("confirmed").alias("status"),
                                      F.lit("fk").alias("discovered_via"), F.lit(None).cast("double").alias("confidence"))


cte("w_tedges", """
SELECT u.connection_id, u.table_fqn AS source, t.table_fqn AS target, 'FEEDS' AS edge_type, 'confirmed' AS status, 'fk' AS discovered_via, NULL::DOUBLE AS confidence
FROM w_tables t JOIN w_tables u ON u.s_suppkey = t.s_suppkey // 3 WHERE t.s_suppkey > 0
""")


def table_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Lineage nodes of the monitored tables; a negative balance is a failure."""
    bal = F.col("s_acctbal")
    return tables(spark, sf).select(
        "connection_id", F.col("table_fqn").alias("external_id"), F.col("table_fqn").alias("label"), "layer",
        F.when(F.col("layer") == "GOLD", "report").otherwise("table").alias("node_type"),
        F.when(bal < 0, "fail").when(bal < 1000, "warn").otherwise("ok").alias("health_status"))


cte("w_tnodes", """
SELECT connection_id, table_fqn AS external_id, table_fqn AS label, layer, CASE WHEN layer = 'GOLD' THEN 'report' ELSE 'table' END AS node_type,
       CASE WHEN s_acctbal < 0 THEN 'fail' WHEN s_acctbal < 1000 THEN 'warn' ELSE 'ok' END AS health_status
FROM w_tables
""")
