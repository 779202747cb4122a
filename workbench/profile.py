"""Profile queries (P)."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from assay.operators import history, integrity, keys, profile, sketches
from assay.operators.relational import latest_per_key
from assay.plans import profile_table
from assay.session import shared_folder
from workbench import derived as d
from workbench.registry import percent, query, ratio, table


def _orders_with_nulls(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))


_ORD = "(SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)"


@query("p1_row_count_window", """
SELECT count(*) AS row_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def p1(spark, sf):
    from assay.sources.windows import window_filter
    df, _ = window_filter(table(spark, sf, "orders"), "O_ORDERDATE", "1998-01-01", "1999-01-01")
    return profile.row_count(df)


@query("p2_null_stats_orders", f"""
SELECT c AS column_name, nulls AS null_count, {percent('nulls', 'n')} AS null_pct FROM (
  SELECT count(*) AS n, unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS c,
         unnest([count(*) - count(o_orderkey), count(*) - count(o_custkey), count(*) - count(o_orderstatus),
                 count(*) - count(o_totalprice), count(*) - count(o_orderdate), count(*) - count(o_orderpriority)]) AS nulls
  FROM {_ORD})""")
def p2(spark, sf):
    return profile.null_stats(_orders_with_nulls(spark, sf))


_LI = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
       "l_returnflag l_linestatus l_shipdate").split()


@query("p3_distinct_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, {ratio(f'count(DISTINCT {c})', 'count(*)', 4)} AS cardinality_ratio FROM lineitem"
    for c in _LI))
def p3(spark, sf):
    return profile.distinct_counts(table(spark, sf, "lineitem"))


_TOP = """
SELECT column_name, rank, value, frequency FROM (
  SELECT column_name, value, count(*) AS frequency,
         row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value ASC NULLS LAST) AS rank
  FROM ({}) GROUP BY column_name, value) WHERE rank <= 10"""


_EVENT_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {v} AS value FROM events" for c, v in {
        "event_id": "CAST(event_id AS VARCHAR)", "user_id": "CAST(user_id AS VARCHAR)", "event_type": "event_type", "day": "strftime(ts, '%Y-%m-%d')",
        "value": "CAST(CAST(round(value) AS BIGINT) AS VARCHAR)", "props": "nullif(props, '{\"k\": 1}')"}.items())


@query("p4_top_values_events", _TOP.format(_EVENT_VALUES))
def p4(spark, sf):
    """Every column of events, the time as its day and the value as a whole number."""
    e = table(spark, sf, "events")
    return profile.top_values(e.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), F.round("value").cast("bigint").alias("value"),
                                       F.nullif("props", F.lit('{"k": 1}')).alias("props")))


@query("p4_top_texts_documents", _TOP.format("SELECT 'text' AS column_name, text AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents "
                                              "UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents"))
def p4_texts(spark, sf):
    """Every column of documents."""
    return profile.top_values(table(spark, sf, "documents"), long_text=["text", "source"])


@query("p5_numeric_part", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS min_num, max({c})::DOUBLE AS max_num, "
    f"round(avg({c}::DOUBLE), 4) AS mean_val, round(stddev_samp({c}::DOUBLE), 4) AS std_dev FROM part"
    for c in ("p_partkey", "p_size", "p_retailprice")))
def p5(spark, sf):
    return profile.numeric_stats(table(spark, sf, "part"))


def _customer_formats(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", "c_name", "c_mktsegment",
        F.concat(F.col("c_nationkey").cast("string"), F.lit("@example.com")).alias("mail"),
        F.when(F.col("c_nationkey") < 8, "555-123-4567").otherwise(F.concat(F.lit("n/a "), F.col("c_nationkey").cast("string"))).alias("phone"),
        F.lit(None).cast("string").alias("empty_col"))


_CUST_FMT = """(SELECT c_custkey, c_name, c_mktsegment, c_nationkey || '@example.com' AS mail,
 CASE WHEN c_nationkey < 8 THEN '555-123-4567' ELSE 'n/a ' || c_nationkey END AS phone, NULL::VARCHAR AS empty_col FROM customer)"""
_FMT_PATTERNS = {"EMAIL": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "UUID": r"^[0-9A-Fa-f-]{36}$", "DATE_ISO": r"^\d{4}-\d{2}-\d{2}$",
                 "DATE_US": r"^\d{2}/\d{2}/\d{4}$", "PHONE": r"^\+?[\d\s\-\(\)]{7,15}$"}


def _format_sql(source: str, cols: list[str], others: list[tuple[str, str]], limit: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM {source}" for c in cols)
    sums = ", ".join(f"count(*) FILTER (WHERE regexp_matches(value, '{p}')) AS m_{n}" for n, p in _FMT_PATTERNS.items())
    best = "greatest(" + ", ".join(f"m_{n}" for n in _FMT_PATTERNS) + ")"
    winner = " ".join(f"WHEN m_{n} = {best} THEN '{n}'" for n in _FMT_PATTERNS)
    inner = f"SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value ASC NULLS LAST) AS rn FROM (SELECT column_name, value, count(*) AS cnt FROM ({long}) GROUP BY 1, 2)"
    rows = f"SELECT * FROM ({inner}) WHERE rn <= 10" if limit == "top" else long
    extra = "".join(f" UNION ALL SELECT '{c}', '{t}'" for c, t in others)
    return (f"SELECT column_name, CASE WHEN filled = 0 THEN 'UNKNOWN' WHEN {best} = 0 THEN 'STRING' "
            f"WHEN {best} * 100 < filled * 80 THEN 'MIXED' ELSE CASE {winner} END END AS format_pattern "
            f"FROM (SELECT column_name, count(value) AS filled, {sums} FROM ({rows}) GROUP BY column_name){extra}")


@query("p6_format_customer", _format_sql(_CUST_FMT, ["c_name", "c_mktsegment", "mail", "phone", "empty_col"], [("c_custkey", "BIGINT")], "top"))
def p6(spark, sf):
    return profile.formats(_customer_formats(spark, sf), top_values_only=10)


@query("p6_format_full_column", _format_sql(_CUST_FMT, ["c_name", "c_mktsegment", "mail", "phone", "empty_col"], [("c_custkey", "BIGINT")], "all"))
def p6_full(spark, sf):
    return profile.formats(_customer_formats(spark, sf))


@query("p7_row_dups_documents", """
SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE lang = 'de') GROUP BY doc_id, text, lang, source, n_chars)""")
def p7(spark, sf):
    """Whole documents, the German ones twice."""
    docs = table(spark, sf, "documents")
    return profile.duplicate_rows(docs.unionByName(docs.filter("lang = 'de'")))


@query("p8_key_candidates", f"""
SELECT column_name, id_like, cardinality_ratio FROM (
  SELECT *, regexp_matches(column_name, '(?i)(^id$|_id$|id$|_key$|key$)') AS id_like FROM (
  {' UNION ALL '.join(f"SELECT {i} AS ord, '{c}' AS column_name, {ratio(f'count(DISTINCT {c})', 'count(*)', 4)} AS cardinality_ratio, count(*) AS n FROM documents JOIN labels USING (doc_id)" for i, c in enumerate(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic']))}))
WHERE n > 1 AND ((id_like AND cardinality_ratio >= 0.6) OR cardinality_ratio >= 0.9)
ORDER BY id_like DESC, cardinality_ratio DESC, ord""")
def p8(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    stats = profile.profile_columns(df, long_text=["text"])
    return profile.key_candidates(stats).select("column_name", "id_like", "cardinality_ratio")


_DUPS = """SELECT {i} AS ordinal, '{k}' AS key_columns, count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY {k} HAVING count(*) > 1)"""
_KEYS = (["l_orderkey", "l_linenumber"], ["l_orderkey"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


def _set_rows(name: str, columns: list[str], size: int) -> str:
    """A row for each set of columns: its names and the number of its groups."""
    return " UNION ALL ".join(f"SELECT {list(s)!r} AS c, count(DISTINCT {{{', '.join(f'{chr(39)}{x}{chr(39)}: {x}' for x in s)}}}) AS g FROM {name}"
                              for k in range(1, size + 1) for s in itertools.combinations(columns, k))


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("p8_minimal_keys", f"""
WITH sets AS MATERIALIZED ({_set_rows('lineitem', _LINE_COLUMNS, 3)}), unique_sets AS (SELECT c FROM sets WHERE g = (SELECT count(*) FROM lineitem))
SELECT 'UNIQUE' AS rule_type, array_to_string(c, ',') AS columns FROM unique_sets u WHERE NOT EXISTS (SELECT 1 FROM unique_sets v WHERE len(v.c) < len(u.c) AND list_has_all(u.c, v.c))""")
def p8_minimal(spark, sf):
    """The smallest unique sets of columns of lineitem, found without a hint."""
    lines = table(spark, sf, "lineitem").select(*_LINE_COLUMNS)
    return keys.key_rules(spark, keys.minimal_keys(lines)).select("rule_type", "columns")


_HOME_COLUMNS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal", "n_nationkey", "n_name", "n_regionkey"]


@query("r27_found_dependencies", f"""
WITH homes AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey), sets AS MATERIALIZED ({_set_rows('homes', _HOME_COLUMNS, 2)})
SELECT 'DEPENDENCY' AS rule_type, x.c[1] AS columns, list_filter(xa.c, lambda v : v <> x.c[1])[1] AS value
FROM sets x JOIN sets xa ON len(x.c) = 1 AND len(xa.c) = 2 AND list_contains(xa.c, x.c[1]) AND xa.g = x.g
JOIN sets a ON len(a.c) = 1 AND a.c[1] = list_filter(xa.c, lambda v : v <> x.c[1])[1] WHERE x.g > 1 AND a.g > 1 AND x.g < (SELECT count(*) FROM homes)""")
def r27_found(spark, sf):
    """What single columns of suppliers with their nations determine, as typed rules."""
    homes = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = keys.key_rules(spark, [], keys.dependencies(homes.select(*_HOME_COLUMNS)))
    return found.select("rule_type", "columns", F.get_json_object("check_args", "$.value").alias("value"))


@query("p9_key_dups_lineitem", " UNION ALL ".join(_DUPS.format(i=i, k=",".join(k)) for i, k in enumerate(_KEYS)))
def p9(spark, sf):
    return profile.key_duplicates(table(spark, sf, "lineitem"), _KEYS)


@query("p9_worst_key_sample", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 5""")
def p9_sample(spark, sf):
    return profile.duplicate_key_samples(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("p10_orphans_documents_labels", f"""
SELECT 'doc_id' AS fk_column, 'main.labels' AS parent_table_fqn, 'doc_id' AS parent_column, count(*) FILTER (WHERE l.doc_id IS NULL) AS orphan_count,
       {percent('count(*) FILTER (WHERE l.doc_id IS NULL)', 'count(*)')} AS orphan_pct, 'declared_fk' AS source
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def p10(spark, sf):
    return integrity.orphan_check(table(spark, sf, "documents"), ["doc_id"], table(spark, sf, "labels"), ["doc_id"],
                                  parent_name="main.labels")


@query("p10_orphan_samples", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 5""")
def p10_samples(spark, sf):
    return integrity.orphan_samples(table(spark, sf, "documents"), ["doc_id"], table(spark, sf, "labels"), ["doc_id"])


@query("p11_fk_inference", """
SELECT 'sales' AS schema_name, 'orders' AS table_name, 'customer_id' AS column_name, 'customers' AS parent_table, 'id' AS parent_column,
       count(*) FILTER (WHERE c.c_custkey IS NULL) AS orphan_count
FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') c ON o.o_custkey = c.c_custkey""")
def p11(spark, sf):
    """The naming rule over renamed tables, then the orphan check it asks for."""
    customers = table(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("placed_at"))
    return integrity.check_inferred_keys({("sales", "customers"): customers, ("sales", "orders"): orders})


_KEYED = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"],
          "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "documents": ["doc_id"], "labels": ["doc_id"], "conversations": ["conv_id"]}
_KEY_COLUMNS = [("main", t, c) for t, cs in _KEYED.items() for c in cs]


def _key_tables(spark, sf):
    return {("main", t): table(spark, sf, t) for t in _KEYED}


@query("p11_inclusion_dependencies", " UNION ALL ".join(
    f"SELECT 'main' AS schema_name, '{a}' AS table_name, '{x}' AS column_name, 'main' AS parent_schema, '{b}' AS parent_table, '{y}' AS parent_column, (SELECT count(DISTINCT {x}) FROM {a}) AS child_values "
    f"WHERE NOT EXISTS (SELECT {x} FROM {a} WHERE {x} IS NOT NULL EXCEPT SELECT {y} FROM {b}) AND EXISTS (SELECT 1 FROM {a} WHERE {x} IS NOT NULL)"
    for _, a, x in _KEY_COLUMNS for _, b, y in _KEY_COLUMNS if (a, x) != (b, y)))
def p11_inclusions(spark, sf):
    """Which of all key columns lie within which others."""
    return integrity.inclusion_dependencies(_key_tables(spark, sf), _KEY_COLUMNS)


_REFERENCES = [("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
               ("lineitem", "l_partkey", "orders", "o_orderkey"), ("documents", "doc_id", "labels", "doc_id"), ("orders", "o_orderkey", "documents", "doc_id")]


@query("p11_references", " UNION ALL ".join(
    f"SELECT '{a}' AS table_name, '{x}' AS column_name, '{b}' AS parent_table, '{y}' AS parent_column, count({x}) AS child_rows, count({x}) FILTER (WHERE {x} NOT IN (SELECT {y} FROM {b} WHERE {y} IS NOT NULL)) AS orphan_count, "
    f"count(DISTINCT {x}) FILTER (WHERE {x} NOT IN (SELECT {y} FROM {b} WHERE {y} IS NOT NULL)) AS orphan_values FROM {a}" for a, x, b, y in _REFERENCES))
def p11_references(spark, sf):
    """Orphans of several references at once."""
    found = integrity.check_inclusions(_key_tables(spark, sf), [(("main", a, x), ("main", b, y)) for a, x, b, y in _REFERENCES])
    return found.drop("schema_name", "parent_schema")


def sketch_store(spark, sf):
    """Sketches of all columns of events and orders by day, saved and read back."""
    path = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    for name, day in (("events", "ts"), ("orders", "o_orderdate")):
        sketches.save_sketches(sketches.sketch_columns(table(spark, sf, name), f"main.{name}", day), path)
    return spark.read.parquet(path)


_SKETCHED = {"events": ("ts", "TIMESTAMP '2024-01-08'", "TIMESTAMP '2024-01-15'", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
             "orders": ("o_orderdate", "TIMESTAMP '1997-03-01'", "TIMESTAMP '2024-01-15'", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])}
_NUMBERS = {"event_id", "user_id", "value", "o_orderkey", "o_custkey", "o_totalprice"}


@query("p1_sketch_since_last_run", " UNION ALL ".join(
    f"SELECT 'main.{t}' AS table_fqn, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
    + (f"min({c})::DOUBLE AS min_num, max({c})::DOUBLE AS max_num" if c in _NUMBERS else "NULL::DOUBLE AS min_num, NULL::DOUBLE AS max_num")
    + f" FROM {t} WHERE CAST({day} AS DATE) >= CAST({since} AS DATE)" for t, (day, since, _, cs) in _SKETCHED.items() for c in cs))
def p1_sketch(spark, sf):
    """Counts, NULLs and bounds since each table's newest run, merged from sketches."""
    runs = spark.createDataFrame([("main.events", "2024-01-02"), ("main.events", "2024-01-08"), ("main.orders", "1997-03-01")], "table_fqn string, day string")
    found = sketches.profile_since_last_run(sketch_store(spark, sf), runs.select("table_fqn", F.to_timestamp("day").alias("run_at")))
    return found.select("table_fqn", "column_name", "row_count", "null_count", "min_num", "max_num")


@query("p3_sketch_window")
def p3_sketch(spark, sf):
    """Distinct counts, quantiles and top values of one week, merged from sketches; the bounds are asserted by tests."""
    found = sketches.window_profile(sketch_store(spark, sf), "2024-01-08", "2024-01-15", top=5)
    return found.select("table_fqn", "column_name", "row_count", "distinct_count", "quantiles", F.transform("top_values", lambda t: F.struct(t["item"].alias("value"), t["count"].alias("n"))).alias("top_values"))


_FLAG = "nullif(l_returnflag, 'A')"
_LI_FLAG = ", ".join(_FLAG + " AS l_returnflag" if c == "l_returnflag" else c for c in _LI)
_NULLS = percent("count(*) FILTER (WHERE l_returnflag IS NULL)", "count(*)")


def _lineitem(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("A")))


@query("p12_score_lineitem", f"""
SELECT n AS row_count, {ratio('10000 * 11 - CAST(round(null_pct * 100) AS BIGINT)', '1100', 1)} AS completeness_score, {percent('greatest(0, n - (n - g) - d)', 'n', 1)} AS uniqueness_score,
       100.0::DOUBLE AS consistency_score, 100.0::DOUBLE AS freshness_score,
       round((110000 - round(null_pct * 100)) / 1100.0::DOUBLE * 0.35 + greatest(0, n - (n - g) - d) * 100.0::DOUBLE / n * 0.25 + 100.0 * 0.25 + 100.0 * 0.15, 1) AS quality_score
FROM (SELECT count(*) AS n, {_NULLS} AS null_pct, (SELECT count(*) FROM (SELECT DISTINCT {_LI_FLAG} FROM lineitem)) AS g,
             (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS d FROM (SELECT {_LI_FLAG} FROM lineitem))""")
def p12(spark, sf):
    df = _lineitem(spark, sf)
    dups = profile.duplicate_rows(df).select("duplicate_rows").scalar()
    worst = profile.key_duplicates(df, [["l_orderkey", "l_linenumber"]]).select("duplicate_rows").scalar()
    return profile.score_table(profile.profile_columns(df), dups, worst)


@query("p13_column_health", f"""
SELECT column_name, null_pct, CASE WHEN null_pct > 20 THEN 'CRIT' WHEN null_pct > 5 THEN 'WARN' ELSE 'HEALTHY' END AS health,
       {ratio('greatest(0, 10000 - 2 * CAST(round(null_pct * 100) AS BIGINT))', '100', 1)} AS quality_score
FROM (SELECT 'o_orderkey' AS column_name, {percent('count(*) - count(o_orderkey)', 'count(*)')} AS null_pct FROM orders UNION ALL
      SELECT 'o_custkey', {percent('count(*) - count(o_custkey)', 'count(*)')} FROM orders UNION ALL
      SELECT 'o_orderdate', {percent('count(*) - count(o_orderdate)', 'count(*)')} FROM orders UNION ALL
      SELECT 'o_orderpriority', {percent('count(*) - count(o_orderpriority)', 'count(*)')} FROM orders UNION ALL
      SELECT 'status', {percent("count(*) FILTER (WHERE o_orderstatus = 'P')", 'count(*)')} FROM orders UNION ALL
      SELECT 'price', {percent("count(*) FILTER (WHERE o_totalprice > 450000)", 'count(*)')} FROM orders)""")
def p13(spark, sf):
    """P13 and P16 next to each other."""
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") <= 450000, F.col("o_totalprice")).alias("price"))
    return profile.profile_columns(df).select("column_name", "null_pct", "health", "quality_score")


@query("p14_risks_lineitem", f"""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a FROM lineitem),
k AS (SELECT count(*) AS g, CAST(sum(c) AS BIGINT) AS r FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)),
o AS (SELECT count(*) AS c FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P'))
SELECT 'l_returnflag' AS column_name, 'NULL_HIGH' AS risk_type, 'CRITICAL' AS severity FROM n WHERE {percent('a', 'n')} > 20
UNION ALL SELECT 'l_orderkey,l_linenumber', 'DUPLICATE_KEY', CASE WHEN {percent('r', 'n')} >= 1 THEN 'CRITICAL' ELSE 'HIGH' END FROM k, n WHERE r > 0
UNION ALL SELECT 'l_orderkey', 'REFERENTIAL_ORPHAN', CASE WHEN {percent('c', 'n')} >= 5 THEN 'CRITICAL' WHEN {percent('c', 'n')} >= 1 THEN 'HIGH' ELSE 'MEDIUM' END FROM o, n WHERE c > 0""")
def p14(spark, sf):
    df = _lineitem(spark, sf)
    parents = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    dups = profile.key_duplicates(df, [["l_orderkey", "l_linenumber"]])
    total = profile.row_count(df).scalar()
    orphans = integrity.orphan_check(df, ["l_orderkey"], parents, ["o_orderkey"], parent_name="main.orders")
    risks = (profile.column_risks(profile.profile_columns(df))
             .unionByName(profile.duplicate_key_risk(dups, total))
             .unionByName(profile.orphan_risks(orphans)))
    return risks.select("column_name", "risk_type", "severity")


@query("p15_failing_samples", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 10")
def p15(spark, sf):
    """Failing rows in order of their key, so that the same ones are shown each time."""
    sample = profile.risk_samples(table(spark, sf, "customer").orderBy("c_custkey"), F.col("c_acctbal") < 0, 10)
    row = F.from_json("sample", "c_custkey bigint, c_name string")
    return sample.select(row.alias("r")).select("r.c_custkey", "r.c_name")


@query("p17_stored_drift", """
WITH kinds AS (SELECT table_fqn, column_name, data_type, row_number() OVER (PARTITION BY table_fqn, column_name ORDER BY run_at DESC) AS rn, run_at FROM w_stats),
last AS (SELECT table_fqn, max(run_at) AS now FROM w_stats GROUP BY 1), prev AS (SELECT s.table_fqn, max(s.run_at) AS before FROM w_stats s JOIN last l USING (table_fqn) WHERE s.run_at < l.now GROUP BY 1)
SELECT table_fqn, c.column_name, c.old_type, c.new_type, c.change FROM last JOIN prev USING (table_fqn), (VALUES ('discount_key', 'DOUBLE', NULL, 'dropped'), ('discount', NULL, 'DOUBLE', 'added'), ('quantity', 'DOUBLE', 'BIGINT', 'type_changed')) AS c(column_name, old_type, new_type, change)
WHERE EXISTS (SELECT 1 FROM w_stats s WHERE s.table_fqn = last.table_fqn AND s.run_at = last.now AND s.row_count % 2 = 0)""")
def p17(spark, sf):
    """Latest stored column statistics of every table against the run before; every second latest run was made after a schema change."""
    stats = d.column_stats(spark, sf)
    runs = latest_per_key(stats.select("connection_id", "table_fqn", "run_at", "row_count").distinct(), ["connection_id", "table_fqn"], [F.desc("run_at")], 2, rank="rn")
    two = stats.join(runs, ["connection_id", "table_fqn", "run_at", "row_count"])
    changed = F.col("row_count") % 2 == 0
    now = two.filter("rn = 1").select("connection_id", "table_fqn", F.when(changed & (F.col("column_name") == "discount_key"), "discount").otherwise(F.col("column_name")).alias("column_name"),
                                      F.when(changed & (F.col("column_name") == "quantity"), "BIGINT").otherwise(F.col("data_type")).alias("data_type"))
    before = two.filter("rn = 2").select("connection_id", "table_fqn", "column_name", "data_type")
    drift = history.schema_drift(before, now.join(before.select("connection_id", "table_fqn").distinct(), ["connection_id", "table_fqn"], "left_semi"), ["connection_id", "table_fqn"])
    return drift.drop("connection_id")


@query("p18_history_events_daily", f"""
SELECT table_fqn, run_day, row_count, row_count_delta, row_count_delta_pct FROM (
SELECT table_fqn, strftime(run_at, '%Y-%m-%d') AS run_day, row_count, row_count - p AS row_count_delta,
       CASE WHEN p <> 0 THEN {ratio('100 * (row_count - p)', 'p', 1)} END AS row_count_delta_pct
FROM (SELECT *, lag(row_count) OVER (PARTITION BY table_fqn ORDER BY run_at) AS p FROM
       (SELECT *, row_number() OVER (PARTITION BY table_fqn ORDER BY run_at DESC) AS rn FROM w_event_days) WHERE rn <= 10))""")
def p18(spark, sf):
    h = history.report_history(d.event_days(spark, sf).withColumn("quality_score", F.lit(100.0)), 10)
    return h.select("table_fqn", F.date_format("run_at", "yyyy-MM-dd").alias("run_day"), "row_count",
                    "row_count_delta", "row_count_delta_pct")


@query("p19_latest_report", """
SELECT table_fqn, report_id, quality_score, layer FROM (
  SELECT *, row_number() OVER (PARTITION BY connection_id, table_fqn ORDER BY run_at DESC) AS rn FROM w_reports) WHERE rn = 1""")
def p19(spark, sf):
    return history.latest_reports(d.reports(spark, sf)).select("table_fqn", "report_id", "quality_score", "layer")


@query("p19_latest_risks", """
SELECT s.connection_id, s.table_fqn, s.column_name, severity, CAST(row_number() OVER (PARTITION BY s.connection_id, s.table_fqn ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, s.column_name) AS INTEGER) AS place
FROM (SELECT *, CASE WHEN null_pct > 20 THEN 'CRITICAL' WHEN null_pct > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM w_stats WHERE null_pct > 0) s
JOIN (SELECT report_id FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, table_fqn ORDER BY run_at DESC) AS rn FROM w_reports) WHERE rn = 1) l ON l.report_id = s.report_id""")
def p19_risks(spark, sf):
    """NULL risks of every table's newest report, the most severe first."""
    risk = F.when(F.col("null_pct") > 20, "CRITICAL").when(F.col("null_pct") > 5, "MEDIUM").otherwise("LOW")
    risks = d.column_stats(spark, sf).filter("null_pct > 0").withColumn("severity", risk).withColumn("risk_type", F.lit("NULLS"))
    return history.latest_risks(d.reports(spark, sf), risks).select("connection_id", "table_fqn", "column_name", "severity", "place")


@query("p20_table_context", """
WITH r AS (SELECT connection_id, table_fqn, count(*) AS rules_total, count(*) FILTER (WHERE status IN ('approved', 'active')) AS rules_active,
                  count(DISTINCT column_name) AS columns_with_rules FROM w_rules GROUP BY 1, 2),
a AS (SELECT connection_id, table_fqn, count(*) AS open_anomalies FROM w_anoms WHERE status = 'open' GROUP BY 1, 2),
t AS (SELECT related_entity_id, count(*) AS open_tasks FROM w_tasks WHERE status IN ('open', 'in_progress') GROUP BY 1)
SELECT x.connection_id, x.table_fqn, coalesce(rules_total, 0) AS rules_total, coalesce(rules_active, 0) AS rules_active,
       coalesce(columns_with_rules, 0) AS columns_with_rules,
       coalesce(open_anomalies, 0) AS open_anomalies, coalesce(open_tasks, 0) AS open_tasks
FROM w_tables x LEFT JOIN r USING (connection_id, table_fqn) LEFT JOIN a USING (connection_id, table_fqn)
LEFT JOIN t ON t.related_entity_id = 'customer_' || x.s_suppkey""")
def p20(spark, sf):
    from workbench import anomalies
    tabs = d.tables(spark, sf)
    tasks = d.tasks(spark, sf).join(
        tabs.select("connection_id", "table_fqn", F.concat(F.lit("customer_"), F.col("s_suppkey").cast("string")).alias("related_entity_id")),
        "related_entity_id")
    return history.table_context(tabs.select("connection_id", "table_fqn"), d.rules(spark, sf), anomalies.anomaly_log(spark, sf), tasks)


@query("p21_health_counts", """
SELECT s.connection_id, s.table_fqn, count(*) FILTER (WHERE null_pct > 20) AS crit_columns,
       count(*) FILTER (WHERE null_pct <= 20 AND null_pct > 5) AS warn_columns,
       count(*) FILTER (WHERE r.column_name IS NULL) AS columns_without_rules
FROM w_stats s LEFT JOIN (SELECT DISTINCT connection_id, table_fqn, column_name FROM w_rules) r
  ON r.connection_id = s.connection_id AND r.table_fqn = s.table_fqn AND r.column_name = s.column_name
GROUP BY 1, 2""")
def p21(spark, sf):
    stats = d.column_stats(spark, sf).withColumn("health", profile.column_health(F.col("null_pct"), F.lit("STRING")))
    return profile.health_counts(stats, d.rules(spark, sf))


_ALL = {t: c.split() for t, c in {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text"}.items()}


@query("p22_profile_all", " UNION ALL ".join(
    f"SELECT '{t}' AS table_fqn, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
    f"count(DISTINCT {c}) AS distinct_count, {ratio(f'count(DISTINCT {c})', 'count(*)', 4)} AS cardinality_ratio FROM {t}"
    for t, cols in _ALL.items() for c in cols))
def p22(spark, sf):
    """Every column of every table."""
    return profile.profile_all({t: table(spark, sf, t) for t in _ALL}, long_text=["text", "html"]).select(
        "table_fqn", "column_name", "row_count", "null_count", "distinct_count", "cardinality_ratio")


def _lines(spark, sf):
    """Lines under names that the naming rule understands, and the orders they may refer to."""
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.nullif("l_returnflag", F.lit("A")).alias("flag"),
                                             "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    return df, table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), "o_orderdate")


@query("p22_profile_job", f"""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a FROM lineitem),
k AS (SELECT count(*) AS g, CAST(sum(c) AS BIGINT) AS r FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)),
o AS (SELECT count(*) AS c, count(DISTINCT l_orderkey) AS keys FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P'))
SELECT 'flag' AS column_name, 'NULL_HIGH' AS risk_type, 'CRITICAL' AS severity, least(a, 5) AS sampled FROM n WHERE {percent('a', 'n')} > 20
UNION ALL SELECT 'order_id,line', 'DUPLICATE_KEY', CASE WHEN {percent('r', 'n')} >= 1 THEN 'CRITICAL' ELSE 'HIGH' END, least(g, 5) FROM k, n WHERE r > 0
UNION ALL SELECT 'order_id', 'REFERENTIAL_ORPHAN', CASE WHEN {percent('c', 'n')} >= 5 THEN 'CRITICAL' WHEN {percent('c', 'n')} >= 1 THEN 'HIGH' ELSE 'MEDIUM' END, least(keys, 5) FROM o, n WHERE c > 0""")
def p22_job(spark, sf):
    """The whole job over lineitem: an inferred reference, a composite key, and samples of every risk."""
    df, orders = _lines(spark, sf)
    p = profile_table.profile_table(df, keys=[["order_id", "line"]], inferred={"orders": orders}, name="lines", samples=5)
    sampled = F.size(F.from_json("sample", "array<map<string,string>>")).cast("bigint")
    return p.risks.select("column_name", "risk_type", "severity", sampled.alias("sampled"))


@query("s11_saved_profile", """
SELECT 'main.customer@2001-10-15T06:00:00' AS report_id, count(*) AS row_count, 5::BIGINT AS columns, 2::BIGINT AS drifted, 'ok' AS health_status FROM customer""")
def s11_profile(spark, sf):
    """A profile of customer saved with its report, and drift against stored columns of which one went and one has another type."""
    df = table(spark, sf, "customer")
    before = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type")) for c, t in (
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "smallint"), ("c_acctbal", "double"), ("c_mktsegment", "string"), ("c_phone", "string"))])))
    p = profile_table.profile_table(df, previous_columns=before)
    base = f"{shared_folder(spark)}/assay-profile-{uuid.uuid4().hex}"
    nodes = profile_table.save_profile(base, p, d.table_nodes(spark, sf).withColumns({"position_order": F.lit(0), "is_source": F.lit(True)}), connection_id="c", table_fqn="main.customer",
                                       layer="GOLD", run_at=d.as_of())
    stored, stats = spark.read.parquet(f"{base}/reports"), spark.read.parquet(f"{base}/column_stats")
    counted = stats.groupBy("report_id").agg(F.count(F.lit(1)).alias("columns"))
    health = nodes.filter("external_id = 'main.customer'").select(F.col("external_id").alias("table_fqn"), "health_status")
    return stored.join(counted, "report_id").join(health, "table_fqn").select("report_id", "row_count", "columns", p.drift.agg(F.count(F.lit(1))).scalar().alias("drifted"), "health_status")


@query("p20_rule_coverage", """
SELECT connection_id, table_fqn, column_name, count(*) AS total, count(*) FILTER (WHERE status IN ('approved', 'active')) AS active FROM w_rules GROUP BY 1, 2, 3""")
def p20_coverage(spark, sf):
    return history.rule_coverage(d.rules(spark, sf))


@query("p20_top_anomalies", """
SELECT connection_id, table_fqn, anomaly_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY connection_id, table_fqn
  ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, detected_at DESC, anomaly_id) AS INTEGER) AS rank FROM w_anoms WHERE status = 'open') WHERE rank <= 5""")
def p20_anomalies(spark, sf):
    from workbench import anomalies
    return history.top_open_anomalies(anomalies.anomaly_log(spark, sf)).select("connection_id", "table_fqn", "anomaly_id", "rank")
