"""Lineage queries (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.text import normalise_fqn
from assay.plans import discover_lineage
from assay.operators import graph, intel, lineage
from assay.sources import metadata
from workbench import derived as d
from workbench.registry import cte, percent, query, table

# --- the record graph: region -> nation -> customer, supplier -> order --------


def _id(prefix, col):
    return F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))


def record_edges(spark, sf):
    t = lambda n: table(spark, sf, n)
    pairs = [
        t("nation").select(_id("region", "n_regionkey").alias("source"), _id("nation", "n_nationkey").alias("target")),
        t("customer").select(_id("nation", "c_nationkey").alias("source"), _id("customer", "c_custkey").alias("target")),
        t("supplier").select(_id("nation", "s_nationkey").alias("source"), _id("supplier", "s_suppkey").alias("target")),
        t("orders").select(_id("customer", "o_custkey").alias("source"), _id("order", "o_orderkey").alias("target")),
        t("lineitem").select("l_suppkey", "l_orderkey").distinct().select(_id("supplier", "l_suppkey").alias("source"), _id("order", "l_orderkey").alias("target")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.lit("confirmed"))


def record_nodes(spark, sf):
    t = lambda n: table(spark, sf, n)
    balance = lambda c: F.when(F.col(c) < 0, "fail").otherwise("ok")
    parts = [
        t("region").select(_id("region", "r_regionkey").alias("external_id"), F.lit("table").alias("node_type"), F.lit("ok").alias("health_status")),
        t("nation").select(_id("nation", "n_nationkey"), F.lit("table"), F.lit("ok")),
        t("customer").select(_id("customer", "c_custkey"), F.lit("table"), balance("c_acctbal")),
        t("supplier").select(_id("supplier", "s_suppkey"), F.lit("table"), balance("s_acctbal")),
        t("orders").select(_id("order", "o_orderkey"), F.lit("report"), F.when(F.col("o_orderstatus") == "F", "fail").otherwise("ok")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


cte("w_redges", """
SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target FROM nation
UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'order:' || l_orderkey FROM lineitem
""")
cte("w_rnodes", """
SELECT 'region:' || r_regionkey AS external_id, 'table' AS node_type, 'ok' AS health_status FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'table', 'ok' FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'table', CASE WHEN c_acctbal < 0 THEN 'fail' ELSE 'ok' END FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'table', CASE WHEN s_acctbal < 0 THEN 'fail' ELSE 'ok' END FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, 'report', CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'ok' END FROM orders
""")


def _closure(starts: str, edges: str = "w_redges", name: str = "reach") -> str:
    return (f"WITH RECURSIVE {name}(start, node) AS (SELECT s.start, e.target FROM ({starts}) s JOIN {edges} e ON e.source = s.start "
            f"UNION SELECT r.start, e.target FROM {name} r JOIN {edges} e ON e.source = r.node)")


# --- discovery ---------------------------------------------------------------

def key_constraints(spark, sf):
    """One two-column constraint per table edge, plus a self reference per table."""
    e = d.table_edges(spark, sf).select("source", "target")
    both = e.unionByName(d.tables(spark, sf).select(F.col("table_fqn").alias("source"), F.col("table_fqn").alias("target")))
    parts = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(a).alias("parent_column"), F.lit(b).alias("child_column"))
                      for p, a, b in ((2, "line_no", "parent_line"), (1, "key", "parent_key"))])
    rows = both.select(F.concat(F.lit("fk_"), "target", F.lit("_"), "source").alias("constraint_name"),
                       F.col("source").alias("parent_fqn"), F.col("target").alias("child_fqn"), F.inline(parts))
    return metadata.foreign_keys(rows)


@query("g1_fk_edges", """
SELECT source, target, 'confirmed' AS status, 'declared key fk_' || target || '_' || source || ', ' || target || '(parent_key,parent_line) refers to ' || source || '(key,line_no)' AS evidence FROM w_tedges""")
def g1(spark, sf):
    return lineage.fk_edges(key_constraints(spark, sf)).select("source", "target", "status", "evidence")


def query_log_pairs(spark, sf):
    """Statements that copy rows between tables, one for each supplier and line number; free lines without tax say how often it ran."""
    t = d.tables(spark, sf)
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        F.count_if((F.col("l_discount") == 0) & (F.col("l_tax") == 0)).alias("execution_count"))
    src = t.select(F.col("s_suppkey").alias("l_suppkey"), "connection_id", F.col("table_fqn").alias("source"))
    return li.join(src, "l_suppkey").select(
        "connection_id", "source", F.concat(F.lit("raw.supplier_"), F.col("l_linenumber").cast("string")).alias("target"), "execution_count",
        F.concat(F.lit(" INSERT INTO t SELECT * FROM "), "source").alias("query_text"))


_QL = """
SELECT connection_id, source, target, CAST(n AS BIGINT) AS n FROM (SELECT t.connection_id, t.table_fqn AS source, 'raw.supplier_' || l_linenumber AS target, greatest(1, count(*) FILTER (WHERE l_discount = 0 AND l_tax = 0)) AS n
  FROM lineitem JOIN w_tables t ON t.s_suppkey = l_suppkey GROUP BY 1, 2, 3) q
WHERE source <> target AND EXISTS (SELECT 1 FROM w_tables k WHERE k.table_fqn = q.target AND k.connection_id = q.connection_id)"""
cte("w_sugg", f"SELECT connection_id, source, target, 'FEEDS' AS edge_type, 'suggested' AS status, 'query_log' AS discovered_via, CASE WHEN n <= 1 THEN 0.6::DOUBLE WHEN n <= 4 THEN 0.75 ELSE 0.9 END AS confidence, n FROM ({_QL})")


def suggestions(spark, sf):
    return lineage.query_log_edges(query_log_pairs(spark, sf), d.tables(spark, sf))


@query("g2_query_log_edges", "SELECT connection_id, source, target, status, confidence, 'Statements run: ' || n || ', one of them: INSERT INTO t SELECT * FROM ' || source AS evidence FROM w_sugg")
def g2(spark, sf):
    return suggestions(spark, sf).select("connection_id", "source", "target", "status", "confidence", "evidence")


def manifests(spark, sf):
    """One project manifest per customer: a source, two models and a test."""
    c = table(spark, sf, "customer")
    key, nat = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat(
        F.lit('{"nodes":{"model.p.clean":{"resource_type":"model","database":"Silver","schema":"dbo","alias":"clean_'), key,
        F.lit('","name":"clean","depends_on":{"nodes":["source.p.nation","source.p.unknown"]}},"model.p.mart":{"resource_type":"model","database":"Gold","schema":"sales","alias":null,"name":"mart_'), nat,
        F.lit('","depends_on":{"nodes":["model.p.clean","model.p.mart"]}},"test.p.t":{"resource_type":"test","database":"Gold","name":"t","depends_on":{"nodes":["model.p.mart"]}}},'
              '"sources":{"source.p.nation":{"database":"Raw","schema":"crm","identifier":"nation_'), nat, F.lit('","name":"n"}}}'))
    return c.select(F.concat(F.lit("project_"), key).alias("project"), text.alias("manifest"))


@query("g3_dbt_edges", """
SELECT 'project_' || c_custkey AS project, 'Raw.crm.nation_' || c_nationkey AS source, 'Silver.clean_' || c_custkey AS target, 'needed by model clean' AS evidence FROM customer
UNION ALL SELECT 'project_' || c_custkey, 'Silver.clean_' || c_custkey, 'Gold.sales.mart_' || c_nationkey, 'needed by model mart_' || c_nationkey FROM customer""")
def g3(spark, sf):
    entries = metadata.read_manifest(manifests(spark, sf), "project", "manifest")
    return lineage.manifest_edges(entries).select("project", "source", "target", "evidence")


def column_edges(spark, sf):
    """Two column edges per table edge."""
    cols = F.array(F.struct(F.lit("Key").alias("source_column"), F.lit("parent_key").alias("target_column")),
                   F.struct(F.lit("qty").alias("source_column"), F.lit("total_qty").alias("target_column")))
    return d.table_edges(spark, sf).select(F.lit("conn").alias("connection_id"), F.col("source").alias("source_fqn"), F.col("target").alias("target_fqn"), F.inline(cols))


cte("w_cedges", """
SELECT source AS source_fqn, target AS target_fqn, c.a AS source_column, c.b AS target_column FROM (
  SELECT *, unnest([{'a': 'Key', 'b': 'parent_key'}, {'a': 'qty', 'b': 'total_qty'}]) AS c FROM w_tedges)""")


@query("g4_column_edges_added", "SELECT source_fqn, source_column, target_fqn, target_column FROM w_cedges")
def g4_add(spark, sf):
    e = column_edges(spark, sf)
    known = e.filter("source_column = 'qty'")
    return lineage.add_column_edges(known, e.unionByName(e)).drop("connection_id")


@query("g4_column_lineage", """
SELECT target_fqn AS table_fqn, 'fed_by' AS direction, target_column AS column_name, source_fqn AS related_table, source_column AS related_column FROM w_cedges
UNION ALL SELECT source_fqn, 'feeds', source_column, target_fqn, target_column FROM w_cedges""")
def g4(spark, sf):
    return lineage.column_lineage(column_edges(spark, sf)).drop("connection_id")


# --- cycles ------------------------------------------------------------------

_CAND = """SELECT 'order:' || o_orderkey AS source, CASE WHEN o_orderstatus = 'O' THEN 'customer:' || o_custkey ELSE 'customer:' || ((o_custkey + 1) % (SELECT count(*) FROM customer)) END AS target FROM orders"""


@query("g5_cycles", f"{_closure('SELECT DISTINCT target AS start FROM cand')} SELECT DISTINCT c.source, c.target FROM cand c JOIN reach r ON r.start = c.target AND r.node = c.source".replace(
    "WITH RECURSIVE ", f"WITH RECURSIVE cand AS ({_CAND}), "))
def g5(spark, sf):
    """Orders that would feed a customer: their own one closes a cycle."""
    n = table(spark, sf, "customer").agg(F.count(F.lit(1))).scalar()
    o = table(spark, sf, "orders")
    other = F.concat(F.lit("customer:"), ((F.col("o_custkey") + 1) % n).cast("string"))
    cand = o.select(_id("order", "o_orderkey").alias("source"),
                    F.when(F.col("o_orderstatus") == "O", _id("customer", "o_custkey")).otherwise(other).alias("target"))
    return graph.closes_cycle(record_edges(spark, sf), cand)


def edge_candidates(spark, sf):
    """Per table: the reverse of its tree edge, a copy of it, a shortcut, and two sibling edges that exclude each other."""
    t = d.tables(spark, sf).select("s_suppkey", "table_fqn")
    up = lambda name, key: t.select(F.col("s_suppkey").alias(name), F.col("table_fqn").alias(key))
    me = t.filter("s_suppkey > 0").withColumn("p", F.floor(F.col("s_suppkey") / 3)).join(up("p", "parent"), "p")
    kinds = me.select("s_suppkey", F.col("parent").alias("a"), F.col("table_fqn").alias("b"))
    rows = [kinds.select(F.col("b").alias("source"), F.col("a").alias("target"), (F.col("s_suppkey") * 10).alias("rank")),
            kinds.select(F.col("a").alias("source"), F.col("b").alias("target"), (F.col("s_suppkey") * 10 + 1).alias("rank")),
            kinds.select(F.col("b").alias("source"), F.col("b").alias("target"), (F.col("s_suppkey") * 10 + 2).alias("rank"))]
    grand = me.withColumn("g", F.floor(F.col("p") / 3)).filter("p > 0").join(up("g", "grand"), "g")
    rows.append(grand.select(F.col("grand").alias("source"), F.col("table_fqn").alias("target"), (F.col("s_suppkey") * 10 + 3).alias("rank")))
    sib = me.filter("s_suppkey % 3 = 0").withColumn("n", F.col("s_suppkey") + 1).join(up("n", "next_fqn"), "n")
    rows.append(sib.select(F.col("table_fqn").alias("source"), F.col("next_fqn").alias("target"), (F.col("s_suppkey") * 10 + 4).alias("rank")))
    rows.append(sib.select(F.col("next_fqn").alias("source"), F.col("table_fqn").alias("target"), (F.col("s_suppkey") * 10 + 5).alias("rank")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("status", F.lit("confirmed"))


cte("w_outcomes", """
WITH x AS (SELECT t.s_suppkey AS s, t.table_fqn AS me, p.table_fqn AS parent, p.s_suppkey AS pk FROM w_tables t JOIN w_tables p ON p.s_suppkey = t.s_suppkey // 3 WHERE t.s_suppkey > 0)
SELECT me AS source, parent AS target, s * 10 AS rank, 'cycle' AS outcome FROM x
UNION ALL SELECT parent, me, s * 10 + 1, 'existed' FROM x
UNION ALL SELECT me, me, s * 10 + 2, 'cycle' FROM x
UNION ALL SELECT g.table_fqn, me, s * 10 + 3, 'confirmed' FROM x JOIN w_tables g ON g.s_suppkey = x.pk // 3 WHERE pk > 0
UNION ALL SELECT me, n.table_fqn, s * 10 + 4, 'confirmed' FROM x JOIN w_tables n ON n.s_suppkey = x.s + 1 WHERE s % 3 = 0
UNION ALL SELECT n.table_fqn, me, s * 10 + 5, 'cycle' FROM x JOIN w_tables n ON n.s_suppkey = x.s + 1 WHERE s % 3 = 0
""")


@query("g6_accept_edges", "SELECT * FROM w_outcomes")
def g6(spark, sf):
    return graph.accept_edges(d.table_edges(spark, sf), edge_candidates(spark, sf))


@query("g7_sources", "SELECT external_id, NOT EXISTS (SELECT 1 FROM w_redges e WHERE e.target = n.external_id) AS is_source FROM w_rnodes n")
def g7(spark, sf):
    return lineage.mark_sources(record_nodes(spark, sf), record_edges(spark, sf)).select("external_id", "is_source")


@query("g8_root_causes", _closure("SELECT external_id AS start FROM w_rnodes WHERE health_status = 'fail'") + """
SELECT f.external_id, count(r.node) AS downstream_impact_count FROM (SELECT external_id FROM w_rnodes WHERE health_status = 'fail') f
LEFT JOIN reach r ON r.start = f.external_id
WHERE NOT EXISTS (SELECT 1 FROM reach a WHERE a.node = f.external_id AND a.start <> f.external_id) GROUP BY 1""")
def g8(spark, sf):
    return graph.root_causes(record_nodes(spark, sf), record_edges(spark, sf))


@query("g9_downstream", _closure("SELECT 'region:1' AS start") + " SELECT node AS external_id, health_status FROM (SELECT node FROM reach UNION SELECT 'region:1') JOIN w_rnodes ON external_id = node")
def g9(spark, sf):
    inside, _ = graph.downstream_graph(record_edges(spark, sf), record_nodes(spark, sf), "region:1")
    return inside.select("external_id", "health_status")


@query("g9_downstream_edges", _closure("SELECT 'nation:3' AS start") + """, ids AS (SELECT node FROM reach UNION SELECT 'nation:3')
SELECT source, target FROM w_redges WHERE source IN (SELECT node FROM ids) AND target IN (SELECT node FROM ids)""")
def g9_edges(spark, sf):
    _, kept = graph.downstream_graph(record_edges(spark, sf), record_nodes(spark, sf), "nation:3")
    return kept.select("source", "target")


@query("g10_reach_both", _closure("SELECT 'customer:7' AS start") + """, up(start, node) AS (SELECT 'customer:7', source FROM w_redges WHERE target = 'customer:7' UNION SELECT u.start, e.source FROM up u JOIN w_redges e ON e.target = u.node)
SELECT node, 'down' AS direction FROM reach UNION ALL SELECT node, 'up' FROM up""")
def g10(spark, sf):
    start = record_nodes(spark, sf).filter("external_id = 'customer:7'").select(F.col("external_id").alias("start"))
    return graph.reach_both(record_edges(spark, sf), start).select("node", "direction")


@query("g11_paths", """
WITH RECURSIVE p(path, node) AS (SELECT external_id, external_id FROM w_rnodes n WHERE NOT EXISTS (SELECT 1 FROM w_redges e WHERE e.target = n.external_id)
  UNION ALL SELECT p.path || '>' || e.target, e.target FROM p JOIN w_redges e ON e.source = p.node)
SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM w_redges e WHERE e.source = p.node)""")
def g11(spark, sf):
    return graph.paths(record_nodes(spark, sf), record_edges(spark, sf)).select(F.array_join("path", ">").alias("path"))


@query("g11_numbered_paths", """
WITH RECURSIVE p(path, node) AS (SELECT [external_id], external_id FROM w_rnodes n WHERE NOT EXISTS (SELECT 1 FROM w_redges e WHERE e.target = n.external_id)
  UNION ALL SELECT list_append(p.path, e.target), e.target FROM p JOIN (SELECT DISTINCT source, target FROM w_redges) e ON e.source = p.node)
SELECT no, path FROM (SELECT row_number() OVER (ORDER BY path) - 1 AS no, array_to_string(path, '>') AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM w_redges e WHERE e.source = p.node))
WHERE no >= 1000 AND no < 3000""")
def g11_numbered(spark, sf):
    """Paths 1000 to 2999 of the record graph; the others are not made."""
    found = graph.numbered_paths(record_nodes(spark, sf), record_edges(spark, sf), 1000, 2000)
    return found.select(F.col("no").cast("long").alias("no"), F.array_join("path", ">").alias("path"))


@query("g12_hops", """
WITH RECURSIVE h(start, node, depth) AS (SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region
  UNION SELECT h.start, e.target, h.depth + 1 FROM h JOIN w_redges e ON e.source = h.node WHERE h.depth < 3)
SELECT start, depth, count(*) AS downstream, count(*) FILTER (WHERE node LIKE 'order:%') AS reports FROM (SELECT start, node, min(depth) AS depth FROM h GROUP BY 1, 2) WHERE depth > 0 GROUP BY 1, 2""")
def g12(spark, sf):
    starts = table(spark, sf, "region").select(_id("region", "r_regionkey").alias("start"))
    return graph.blast_radius(record_edges(spark, sf), record_nodes(spark, sf), starts)


# --- health and listing ------------------------------------------------------

def latest_run(spark, sf):
    return d.results(spark, sf).agg(F.max_by("run_id", "run_timestamp")).scalar()


@query("g13_health_from_run", """
SELECT external_id, coalesce(h, health_status) AS health_status FROM w_tnodes LEFT JOIN (SELECT table_fqn AS external_id, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'fail' ELSE 'ok' END AS h
  FROM w_results WHERE run_id = (SELECT max(run_id) FROM w_results) GROUP BY 1) USING (external_id)""")
def g13(spark, sf):
    return lineage.propagate_health(d.table_nodes(spark, sf), d.results(spark, sf), latest_run(spark, sf)).select("external_id", "health_status")


@query("g14_seed_nodes", """
SELECT table_fqn AS external_id, layer, CASE WHEN quality_score >= 80 THEN 'ok' WHEN quality_score >= 60 THEN 'warn' ELSE 'fail' END AS health_status,
       CASE layer WHEN 'RAW' THEN 0 WHEN 'BRONZE' THEN 1 WHEN 'SILVER' THEN 2 WHEN 'GOLD' THEN 3 ELSE 99 END AS position_order FROM w_latest""")
def g14(spark, sf):
    return lineage.seed_nodes(d.reports(spark, sf)).select("external_id", "layer", "health_status", "position_order")


@query("g15_node_health", """
SELECT external_id, CASE WHEN quality_score IS NULL OR quality_score >= 80 THEN 'ok' WHEN quality_score >= 60 THEN 'warn' ELSE 'fail' END AS health_status
FROM w_tnodes LEFT JOIN (SELECT table_fqn AS external_id, quality_score FROM w_latest WHERE layer <> 'RAW') USING (external_id)""")
def g15(spark, sf):
    return lineage.nodes_health(d.table_nodes(spark, sf), d.reports(spark, sf).filter("layer <> 'RAW'")).select("external_id", "health_status")


def all_edges(spark, sf):
    """Confirmed tree edges and the query-log suggestions, some of them decided."""
    names = ["connection_id", "source", "target", "edge_type", "status", "discovered_via", "confidence"]
    s = suggestions(spark, sf).withColumn("status", F.when(F.col("confidence") == 0.9, "confirmed").when(F.col("confidence") == 0.6, "rejected").otherwise("suggested"))
    return d.table_edges(spark, sf).select(*names).unionByName(s.select(*names))


cte("w_alledges", """
SELECT connection_id, source, target, edge_type, status, discovered_via, confidence FROM w_tedges
UNION ALL SELECT connection_id, source, target, edge_type, CASE confidence WHEN 0.9 THEN 'confirmed' WHEN 0.6 THEN 'rejected' ELSE 'suggested' END, discovered_via, confidence FROM w_sugg
""")


@query("g16_metrics", f"""
SELECT connection_id, total_known_tables, tables_with_edges, {percent('tables_with_edges', 'total_known_tables', 1)} AS completeness_pct, suggested_pending, suggested_approved, suggested_rejected FROM (
SELECT a.connection_id, (SELECT count(*) FROM w_tables t WHERE t.connection_id = a.connection_id) AS total_known_tables,
       (SELECT count(DISTINCT external_id) FROM w_tnodes n JOIN w_alledges e ON e.connection_id = n.connection_id AND (e.source = n.external_id OR e.target = n.external_id)
        WHERE e.status = 'confirmed' AND n.connection_id = a.connection_id) AS tables_with_edges,
       count(*) FILTER (WHERE discovered_via = 'query_log' AND status = 'suggested') AS suggested_pending, count(*) FILTER (WHERE discovered_via = 'query_log' AND status = 'confirmed') AS suggested_approved,
       count(*) FILTER (WHERE discovered_via = 'query_log' AND status = 'rejected') AS suggested_rejected FROM w_alledges a GROUP BY 1)""")
def g16(spark, sf):
    return lineage.coverage(d.tables(spark, sf), d.table_nodes(spark, sf), all_edges(spark, sf))


@query("g16_by_origin", "SELECT connection_id, discovered_via, count(*) AS edges FROM w_alledges WHERE status = 'confirmed' GROUP BY 1, 2")
def g16_origin(spark, sf):
    return lineage.edges_by_origin(all_edges(spark, sf))


@query("g17_suggested", "SELECT connection_id, source, target, confidence FROM w_sugg")
def g17(spark, sf):
    return lineage.suggested_edges(suggestions(spark, sf)).select("connection_id", "source", "target", "confidence")


@query("g17_review", """
WITH RECURSIVE reach(connection_id, start, node) AS (
  SELECT s.connection_id, s.target, e.target FROM (SELECT DISTINCT connection_id, target FROM w_sugg) s JOIN w_tedges e ON e.source = s.target AND e.connection_id = s.connection_id
  UNION SELECT r.connection_id, r.start, e.target FROM reach r JOIN w_tedges e ON e.source = r.node AND e.connection_id = r.connection_id)
SELECT e.connection_id, e.source, e.target, CASE WHEN e.confidence = 0.6 THEN 'rejected' WHEN r.node IS NOT NULL THEN 'suggested' ELSE 'confirmed' END AS status
FROM w_sugg e LEFT JOIN reach r ON r.connection_id = e.connection_id AND r.start = e.target AND r.node = e.source
UNION ALL SELECT connection_id, source, target, status FROM w_tedges""")
def g17_review(spark, sf):
    """Approve by pair name; edges into the tree's top rows that come back down are blocked."""
    columns = ["connection_id", "source", "target", "status", "confidence"]
    e = d.table_edges(spark, sf).select(*columns).unionByName(suggestions(spark, sf).select(*columns))
    dec = suggestions(spark, sf).select("connection_id", "source", "target", F.when(F.col("confidence") == 0.6, "reject").otherwise("approve").alias("decision"),
                                        F.concat("source", F.lit(">"), "target").alias("rank"))
    return lineage.review_edges(e, dec).select("connection_id", "source", "target", "status")


@query("g18_impact", """
WITH RECURSIVE hops(start, node, depth) AS (SELECT n.external_id, e.target, 1 FROM w_tnodes n JOIN w_tedges e ON e.source = n.external_id WHERE n.health_status <> 'ok'
  UNION SELECT h.start, e.target, h.depth + 1 FROM hops h JOIN w_tedges e ON e.source = h.node)
SELECT external_id, n AS downstream_count, CASE WHEN health_status = 'fail' AND n >= 3 THEN 'critical' WHEN health_status = 'fail' THEN 'high' WHEN n >= 1 THEN 'medium' ELSE 'low' END AS severity,
       external_id || ': ' || CASE health_status WHEN 'fail' THEN 'rules fail' ELSE 'a warning is open' END AS state,
       CASE WHEN n = 0 THEN 'Dependents: none known' ELSE 'Dependents: ' || n || ', namely ' || shown || CASE WHEN n > 5 THEN ' and further ones: ' || (n - 5) ELSE '' END END AS dependents,
       CASE WHEN n > 0 THEN 'Look at these before their next load' ELSE 'See whether edges are missing here' END AS action
FROM (SELECT external_id, health_status, count(h.node) AS n, string_agg(h.node, ', ' ORDER BY h.depth, h.node) FILTER (WHERE h.place <= 5) AS shown
      FROM w_tnodes LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, node) AS place FROM (SELECT start, node, min(depth) AS depth FROM hops GROUP BY 1, 2)) h ON h.start = external_id
      WHERE health_status <> 'ok' GROUP BY 1, 2)""")
def g18(spark, sf):
    nodes = d.table_nodes(spark, sf)
    out = lineage.impact(nodes, d.table_edges(spark, sf), nodes.filter("health_status <> 'ok'"))
    return out.select("external_id", "downstream_count", "severity", *[F.get("bullets", F.lit(i)).alias(n) for i, n in enumerate(("state", "dependents", "action"))])


@query("g19_full_graph", "SELECT external_id, health_status, strftime(m, '%Y-%m-%d') AS last_profiled FROM w_tnodes LEFT JOIN (SELECT table_fqn AS external_id, max(run_at) AS m FROM w_reports GROUP BY 1) USING (external_id)")
def g19(spark, sf):
    out = lineage.full_graph(d.table_nodes(spark, sf), d.reports(spark, sf))
    return out.select("external_id", "health_status", F.date_format("last_profiled_at", "yyyy-MM-dd").alias("last_profiled"))


@query("g20_import_nodes", """
SELECT connection_id, external_id, label, layer, node_type FROM (SELECT connection_id, 'new.' || table_fqn AS external_id, 'New ' || s_suppkey AS label, 'GOLD' AS layer, 'report' AS node_type FROM w_tables WHERE layer = 'GOLD'
UNION ALL SELECT connection_id, 'bare.' || table_fqn, 'bare.' || table_fqn, NULL, 'table' FROM w_tables WHERE layer = 'RAW')""")
def g20_nodes(spark, sf):
    t = d.tables(spark, sf)
    wanted = t.filter("layer = 'GOLD'").select("connection_id", F.concat(F.lit("new."), "table_fqn").alias("external_id"), F.concat(F.lit("New "), F.col("s_suppkey").cast("string")).alias("label"),
                                               F.lit("GOLD").alias("layer"), F.lit("report").alias("node_type"))
    edges = t.filter("layer = 'RAW'").select("connection_id", F.col("table_fqn").alias("source"), F.concat(F.lit("bare."), "table_fqn").alias("target"))
    return lineage.import_nodes(d.table_nodes(spark, sf), wanted, edges)


@query("g20_import_edges", "SELECT source, target, rank, outcome FROM w_outcomes")
def g20(spark, sf):
    return lineage.import_edges(d.table_edges(spark, sf).drop("connection_id"), edge_candidates(spark, sf)).select("source", "target", "rank", "outcome")


@query("g21_column_downstream", "SELECT target_fqn, target_column FROM w_cedges WHERE source_fqn = (SELECT table_fqn FROM w_tables WHERE s_suppkey = 1) AND lower(source_column) = 'key' ORDER BY 1, 2 LIMIT 12")
def g21(spark, sf):
    name = d.tables(spark, sf).filter("s_suppkey = 1").first().table_fqn
    return lineage.column_downstream(column_edges(spark, sf), name, "KEY")


@query("g21_table_downstream", "SELECT target, layer FROM w_tedges JOIN w_tnodes ON external_id = target WHERE source = (SELECT table_fqn FROM w_tables WHERE s_suppkey = 2) ORDER BY target LIMIT 8")
def g21_table(spark, sf):
    name = d.tables(spark, sf).filter("s_suppkey = 2").first().table_fqn
    return lineage.table_downstream(d.table_edges(spark, sf), d.table_nodes(spark, sf), name).select("target", "layer")


@query("g22_upstream_health", "SELECT e.connection_id, target AS table_fqn, source AS upstream, health_status FROM w_tedges e JOIN w_tnodes n ON n.external_id = e.source AND n.connection_id = e.connection_id WHERE health_status <> 'ok'")
def g22(spark, sf):
    return intel.upstream_issues(d.table_nodes(spark, sf), d.table_edges(spark, sf))


@query("g23_normalised_names", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Sales.' || p_type WHEN 1 THEN 'Sales.crm.' || p_type WHEN 2 THEN 'Sales.' || p_type ELSE p_type END AS fqn FROM part""")
def g23(spark, sf):
    k, t = F.col("p_size") % 4, F.col("p_type")
    raw = (F.when(k == 0, F.concat(F.lit("[Sales].[dbo].["), t, F.lit("]"))).when(k == 1, F.concat(F.lit(" Sales.crm."), t))
           .when(k == 2, F.concat(F.lit("Sales..["), t, F.lit("] "))).otherwise(t))
    return table(spark, sf, "part").select("p_partkey", normalise_fqn(raw).alias("fqn"))


# --- whole jobs --------------------------------------------------------------

def _graph_rows(found):
    """Edges and nodes of a graph: kind, source, target."""
    node = found.nodes.select(F.lit("node").alias("kind"), F.col("external_id").alias("source"), F.lit(None).cast("string").alias("target"))
    return found.edges.select(F.lit("edge").alias("kind"), "source", "target").unionByName(node)


@query("g2_discovery_run", """
SELECT source, target, 'confirmed' AS status, 'fk' AS discovered_via FROM w_tedges
UNION ALL SELECT source, target, 'suggested', 'query_log' FROM w_sugg s WHERE NOT EXISTS (SELECT 1 FROM w_tedges e WHERE e.source = s.source AND e.target = s.target)""")
def g2_run(spark, sf):
    """Declared keys and the query log over an empty graph."""
    found = discover_lineage.discover(d.table_nodes(spark, sf), d.table_edges(spark, sf).limit(0), d.tables(spark, sf), key_constraints(spark, sf), query_log_pairs(spark, sf))
    return found.edges.select("source", "target", "status", "discovered_via")


@query("g3_discovery_manifests", """
WITH e AS (SELECT 'Raw.crm.nation_' || c_nationkey AS source, 'Silver.clean_' || c_custkey AS target FROM customer
           UNION ALL SELECT 'Silver.clean_' || c_custkey, 'Gold.sales.mart_' || c_nationkey FROM customer)
SELECT 'edge' AS kind, source, target FROM e UNION ALL SELECT 'node', n, NULL FROM (SELECT source AS n FROM e UNION SELECT target FROM e)""")
def g3_run(spark, sf):
    """Every project manifest over an empty graph."""
    entries = metadata.read_manifest(manifests(spark, sf), "project", "manifest")
    none = d.table_nodes(spark, sf).limit(0)
    found = discover_lineage.discover(none, d.table_edges(spark, sf).limit(0), d.tables(spark, sf), manifests=entries)
    return _graph_rows(found)


@query("s16_imported_graph", """
WITH e AS (SELECT source, target FROM w_tedges UNION ALL SELECT table_fqn, 'export.' || table_fqn FROM w_tables)
SELECT 'edge' AS kind, source, target FROM e UNION ALL SELECT 'node', table_fqn, NULL FROM w_tables UNION ALL SELECT 'node', 'export.' || table_fqn, NULL FROM w_tables""")
def s16_import(spark, sf):
    """A graph written as JSON and read back: known edges, their reverse, and an export of every table."""
    t, e = d.tables(spark, sf), d.table_edges(spark, sf)
    export = t.select(F.col("table_fqn").alias("source"), F.concat(F.lit("export."), "table_fqn").alias("target"))
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    wanted = e.select("source", "target").unionByName(back).unionByName(export).withColumn("edge_type", F.lit("FEEDS"))
    text = metadata.write_graph(d.table_nodes(spark, sf), wanted)
    nodes, edges = metadata.read_graph(text, "graph")
    return _graph_rows(discover_lineage.import_graph(d.table_nodes(spark, sf), e, nodes, edges))
