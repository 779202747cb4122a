"""Dictionary, merge and incident queries (D, M, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import catalog, incidents
from assay.operators.relational import merge_keyed
from workbench import derived as d
from workbench.registry import percent, query, ratio, table


@query("m1_keyed_merge", """
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey <> 4 OR c_nationkey = 3
UNION ALL SELECT c_custkey, c_acctbal + 1, 'NEW' FROM customer WHERE c_nationkey = 4""")
def m1(spark, sf):
    """Customers of nation 4 arrive, those of nation 3 get a new balance only."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    old = c.filter("c_nationkey <> 4").drop("c_nationkey")
    new = c.filter("c_nationkey IN (3, 4)").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return merge_keyed(old, new, ["c_custkey"], set_columns=["c_acctbal"])


def _enriched(spark, sf):
    dic = d.dictionary(spark, sf).withColumn("sensitivity_tag", F.lit("NONE"))
    new = dic.filter("layer IN ('RAW', 'GOLD')").select(
        "column_id", "connection_id", "table_fqn", "layer", "column_name", "data_type", F.upper("column_name").alias("business_name"),
        F.lit("described").alias("description"), F.lit(True).alias("is_cde"), F.lit(50.0).alias("cde_score"), F.lit("PII").alias("sensitivity_tag"), F.lit("draft").alias("status"))
    return dic, new


@query("d1_dictionary_merge", """
SELECT column_id, CASE WHEN layer IN ('RAW', 'GOLD') THEN upper(column_name) ELSE business_name END AS business_name,
       CASE WHEN layer IN ('RAW', 'GOLD') THEN 'described' ELSE description END AS description, status,
       CASE WHEN layer IN ('RAW', 'GOLD') THEN 'PII' ELSE 'NONE' END AS sensitivity_tag FROM w_dict WHERE layer <> 'RAW' OR status = 'approved'
UNION ALL SELECT column_id, upper(column_name), 'described', 'draft', 'PII' FROM w_dict WHERE layer = 'RAW' AND status <> 'approved'""")
def d1(spark, sf):
    """New RAW columns arrive unless already approved; GOLD descriptions are refreshed."""
    dic, new = _enriched(spark, sf)
    known = dic.filter("layer <> 'RAW' OR status = 'approved'")
    return catalog.enrich_dictionary(known, new).select("column_id", "business_name", "description", "status", "sensitivity_tag")


@query("d1_not_enriched", "SELECT column_id FROM w_dict WHERE layer NOT IN ('RAW', 'GOLD')")
def d1_missing(spark, sf):
    return catalog.not_enriched(*_enriched(spark, sf)).select("column_id")


@query("d2_column_decisions", """
SELECT column_id, CASE WHEN is_pii THEN 'approved' WHEN data_type = 'ECONOMY' THEN 'rejected' ELSE status END AS status, CASE WHEN is_pii THEN 'ana@example.com' WHEN layer = 'GOLD' THEN 'old@example.com' END AS approved_by,
       CASE WHEN is_pii THEN '2001-10-15' WHEN layer = 'GOLD' THEN '2000-01-01' END AS approved_on FROM w_dict""")
def d2(spark, sf):
    dic = d.dictionary(spark, sf)
    dec = dic.filter("is_pii OR data_type = 'ECONOMY'").select(
        "column_id", F.when(F.col("is_pii"), "approve").otherwise("reject").alias("decision"), F.lit("ana@example.com").alias("decided_by"))
    gold = F.col("layer") == "GOLD"
    dic = dic.withColumns({"approved_by": F.when(gold, "old@example.com"), "approved_at": F.when(gold, d.as_of("2000-01-01"))})
    return catalog.decide_columns(dic, dec, d.as_of()).select("column_id", "status", "approved_by", F.date_format("approved_at", "yyyy-MM-dd").alias("approved_on"))


@query("d2_cde_registry", """
SELECT column_name, cde_score, CASE WHEN is_pii THEN 'PASS' ELSE health END AS health, promoted_by FROM (
  SELECT c.*, w.is_pii, w.data_type FROM w_cde c JOIN w_dict w USING (connection_id, table_fqn, column_name)) WHERE is_pii OR data_type <> 'ECONOMY'
UNION ALL SELECT column_name, coalesce(cde_score, 0.0), 'PASS', 'ana@example.com' FROM w_dict WHERE is_pii AND NOT (is_cde AND cde_score IS NOT NULL)""")
def d2_cde(spark, sf):
    dic = d.dictionary(spark, sf)
    acts = dic.filter("is_pii OR data_type = 'ECONOMY'").select(
        "column_id", F.when(F.col("is_pii"), "promote").otherwise("demote").alias("action"), F.lit("ana@example.com").alias("decided_by"))
    _, reg = catalog.decide_cdes(dic, d.registry(spark, sf), acts)
    return reg.select("column_name", "cde_score", "health", "promoted_by")


@query("d3_cde_view", """
SELECT w.column_id, w.cde_score, coalesce(c.health, 'PASS') AS health, coalesce(c.promoted_by, '') AS promoted_by, coalesce(c.rule_count, 0) AS rule_count
FROM w_dict w LEFT JOIN w_cde c USING (connection_id, table_fqn, column_name) WHERE is_cde""")
def d3(spark, sf):
    return catalog.cde_view(d.dictionary(spark, sf), d.registry(spark, sf)).select("column_id", "cde_score", "health", "promoted_by", "rule_count")


_ROLL = """SELECT layer, table_fqn, count(*) AS total, count(*) FILTER (WHERE coalesce(description, '') <> '') AS enriched, count(*) FILTER (WHERE status = 'approved') AS approved,
       CAST(grouping(layer, table_fqn) AS BIGINT) AS level FROM w_dict GROUP BY ROLLUP (layer, table_fqn)"""


@query("d5_coverage_rollup", _ROLL)
def d5(spark, sf):
    return catalog.coverage_rollup(d.dictionary(spark, sf))


@query("d5_layer_totals", f"SELECT layer, total, enriched, {percent('enriched', 'total', 1)} AS enriched_pct FROM ({_ROLL}) WHERE level = 1")
def d5_layers(spark, sf):
    return catalog.layer_totals(catalog.coverage_rollup(d.dictionary(spark, sf)))


@query("d6_provenance", """
SELECT rule_id, CASE WHEN rule_no = 2 THEN 'cross_table' WHEN rule_no = 1 THEN 'single_table' WHEN rule_no = 3 AND layer = 'GOLD' THEN 'nl' WHEN rule_no = 4 THEN 'cross_table' ELSE 'manual' END AS generation_source,
       CASE WHEN rule_no = 2 THEN 'gold.orders' END AS related_table_fqn FROM w_rules""")
def d6(spark, sf):
    r = d.rules(spark, sf).withColumn("generation_source", F.lit(None).cast("string")).withColumn("related_table_fqn", F.lit(None).cast("string"))
    r = r.withColumn("nl_source", F.when((F.col("rule_no") == 3) & (F.col("layer") == "GOLD"), "said so"))
    r = r.withColumn("created_by", F.when(F.col("rule_no") == 4, "AI_AGENT").otherwise(F.col("created_by"))).withColumn(
        "rule_type", F.when(F.col("rule_no") == 4, "FK").otherwise(F.col("rule_type")))
    return catalog.backfill_provenance(r).select("rule_id", "generation_source", "related_table_fqn")


_TOK = """list_transform(list_filter(string_split_regex(regexp_replace(lower({0}), '^(br|bz|raw|stg|src|sl|gl|bronze|silver|gold)_', ''), '[^a-z]+'), lambda x: x <> ''),
  lambda w: CASE WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w END)"""


@query("d8_fuzzy_match", f"""
WITH s AS (SELECT DISTINCT search, {_TOK.format("search")} AS st FROM (SELECT p_name || ' ' || lower(p_brand) AS search FROM part)),
t AS (SELECT tt, min(table_fqn) AS table_fqn FROM (SELECT DISTINCT table_fqn, {_TOK.format("split_part(table_fqn, '.', 2)")} AS tt FROM (
  SELECT 'bronze.br_' || replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN 's' ELSE '_' || lower(p_type) END AS table_fqn FROM part)) GROUP BY 1),
p AS (SELECT search, table_fqn, CASE WHEN st = tt THEN 100.0 ELSE length(list_intersect(list_distinct(st), list_distinct(tt))) / length(tt)::DOUBLE END AS score FROM s, t)
SELECT search, table_fqn, round(score, 4) AS score FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY search ORDER BY score DESC, table_fqn) = 1""")
def d8(spark, sf):
    p = table(spark, sf, "part")
    searches = p.select(F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("search"))
    name = F.concat(F.lit("bronze.br_"), F.replace("p_name", F.lit(" "), F.lit("_")),
                    F.when(F.col("p_size") > 25, "s").otherwise(F.concat(F.lit("_"), F.lower("p_type"))))
    return catalog.match_tables(searches, p.select(name.alias("table_fqn")))


@query("d9_known_anywhere", """
WITH c AS (SELECT table_fqn, layer FROM w_tables WHERE layer <> 'RAW'), x AS (SELECT DISTINCT table_fqn FROM w_dict), r AS (SELECT DISTINCT table_fqn, layer FROM w_rules)
SELECT table_fqn, coalesce(c.layer, CASE WHEN x.table_fqn IS NOT NULL THEN 'OTHER' END, r.layer) AS layer, c.layer IS NOT NULL AS in_catalog, x.table_fqn IS NOT NULL AS in_dictionary, r.layer IS NOT NULL AS has_rules
FROM (SELECT table_fqn FROM c UNION SELECT table_fqn FROM x UNION SELECT table_fqn FROM r) LEFT JOIN c USING (table_fqn) LEFT JOIN x USING (table_fqn) LEFT JOIN r USING (table_fqn)""")
def d9(spark, sf):
    return catalog.known_anywhere(d.tables(spark, sf).filter("layer <> 'RAW'"), d.dictionary(spark, sf), d.rules(spark, sf))


# --- incident texts ----------------------------------------------------------

def texts(spark, sf):
    """Whole documents and conversation turns; short notes are made from events."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("run_id"), "text")
    turns = table(spark, sf, "conversations").select(F.concat_ws(":", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("run_id"), "text")
    return docs.unionByName(turns).unionByName(notes(spark, sf).select("run_id", "text"))


_NOTES = {
    "click": ("segment", "Orders from the EMEA region STOPPED at noon, user "),
    "view": ("nullcol", "The amount column is not populated for user "),
    "purchase": ("volume", "Row count looks wrong, only 40 % loaded for user "),
    "signup": ("whitelist", "An unexpected status code shows up for user "),
    "error": ("source", "The CRM feed has not landed, said user "),
}


def notes(spark, sf):
    """An incident note per event; one in ten says something else."""
    e = table(spark, sf, "events")
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.lit(None).cast("string")
    expected = F.lit(None).cast("string")
    for name, (key, words) in _NOTES.items():
        text, expected = F.when(t == name, F.lit(words)).otherwise(text), F.when(t == name, F.lit(key)).otherwise(expected)
    vague = F.when(k >= 90, F.lit("Please have a look at this, user ")).otherwise(text)
    return e.select(F.concat(F.lit("note:"), F.col("event_id").cast("string")).alias("run_id"), F.concat(vague, F.col("user_id").cast("string")).alias("text"),
                    expected.alias("expected_key"), F.col("ts").alias("started_at"), (F.col("value") > 100).alias("grounded"))


_NOTES_SQL = f"""SELECT 'note:' || event_id AS run_id, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 90 THEN 'Please have a look at this, user ' ELSE CASE event_type {' '.join(f"WHEN '{n}' THEN '{w}'" for n, (_, w) in _NOTES.items())} END END || user_id AS text,
 CASE event_type {' '.join(f"WHEN '{n}' THEN '{k}'" for n, (k, _) in _NOTES.items())} END AS expected_key, ts AS started_at, value > 100 AS grounded FROM events"""


def _any(words):
    return "(" + " OR ".join("contains(t, '" + w.replace("'", "''") + "')" for w in words) + ")"


_CLASS = f"""CASE WHEN {_any(incidents.PLACES)} AND {_any(incidents.ABSENCE)} THEN 'segment:0.45' WHEN {_any(incidents.SLICES)} AND {_any(incidents.ABSENCE)} THEN 'segment:0.40'
 WHEN {_any(incidents.NULL_WORDS)} AND {_any(incidents.COLUMN_WORDS)} THEN 'nullcol:0.45'
 WHEN contains(t, 'whitelist') OR (contains(t, 'invalid') AND contains(t, 'value')) OR contains(t, 'unapproved') OR regexp_matches(t, '{incidents.NOT_IN_ENUM}') OR regexp_matches(t, '{incidents.ODD_VALUE}') OR regexp_matches(t, '{incidents.CODE_APPEARS}') THEN 'whitelist:0.43'
 WHEN (contains(t, 'volume') AND {_any(incidents.LOSS_WORDS)}) OR (contains(t, 'drop') AND {_any(incidents.COUNTED)}) OR regexp_matches(t, '{incidents.ONLY_PERCENT}') OR regexp_matches(t, '{incidents.ONLY_COUNT}') THEN 'volume:0.42'
 WHEN contains(t, 'row count') THEN 'volume:0.40' WHEN {_any(incidents.LATE_PHRASES)} THEN 'source:0.43' ELSE 'unknown:0.20' END"""


@query("c1_classify", f"""
SELECT run_id, split_part(v, ':', 1) AS key, CAST(split_part(v, ':', 2) AS DOUBLE) AS confidence FROM (SELECT run_id, {_CLASS} AS v FROM (SELECT run_id, lower(text) AS t FROM (
  SELECT 'doc:' || doc_id AS run_id, text FROM documents UNION ALL SELECT 'conv:' || conv_id || ':' || turn, text FROM conversations UNION ALL SELECT run_id, text FROM ({_NOTES_SQL}))))""")
def c1(spark, sf):
    return incidents.classify(texts(spark, sf)).select("run_id", "key", "confidence")


_CONF = f"SELECT expected_key, split_part(v, ':', 1) AS got_key, count(*) AS n FROM (SELECT expected_key, {_CLASS} AS v FROM (SELECT *, lower(text) AS t FROM ({_NOTES_SQL}))) GROUP BY 1, 2"


@query("c2_confusion", _CONF)
def c2_confusion(spark, sf):
    return incidents.confusion(notes(spark, sf))


@query("c2_accuracy", f"""
SELECT expected_key, total, correct, accuracy, accuracy >= 0.85 AS passes FROM (SELECT coalesce(expected_key, 'ALL') AS expected_key, CAST(sum(n) AS BIGINT) AS total,
  CAST(coalesce(sum(n) FILTER (WHERE expected_key = got_key), 0) AS BIGINT) AS correct, {ratio('coalesce(sum(n) FILTER (WHERE expected_key = got_key), 0)', 'sum(n)', 4)} AS accuracy
  FROM ({_CONF}) GROUP BY ROLLUP (expected_key))""")
def c2(spark, sf):
    return incidents.accuracy(incidents.confusion(notes(spark, sf)))


_RUNS = f"SELECT run_id, started_at, grounded, split_part(v, ':', 1) AS key, CAST(split_part(v, ':', 2) AS DOUBLE) AS confidence FROM (SELECT *, {_CLASS} AS v FROM (SELECT *, lower(text) AS t FROM ({_NOTES_SQL})))"


def _runs(spark, sf):
    return incidents.classify(notes(spark, sf))


@query("c3_run_statistics", f"""
SELECT count(*) AS total_runs, {ratio('sum(CAST(round(confidence * 100) AS BIGINT))', '100 * count(*)', 3)} AS mean_confidence, {ratio('count(*) FILTER (WHERE confidence < 0.8)', 'count(*)', 3)} AS low_confidence_rate,
       {ratio("count(*) FILTER (WHERE key = 'unknown')", 'count(*)', 3)} AS unknown_rate, {ratio('count(*) FILTER (WHERE grounded)', 'count(*)', 3)} AS real_metrics_rate FROM ({_RUNS})""")
def c3(spark, sf):
    return incidents.run_statistics(_runs(spark, sf))


@query("c3_run_types", f"SELECT key, count(*) AS n FROM ({_RUNS}) GROUP BY 1")
def c3_types(spark, sf):
    return incidents.run_types(_runs(spark, sf))


@query("c3_recent_runs", f"SELECT run_id, key FROM ({_RUNS}) ORDER BY started_at DESC, run_id DESC LIMIT 8")
def c3_recent(spark, sf):
    return incidents.recent_runs(_runs(spark, sf)).select("run_id", "key")
