"""Building and reading the lineage graph.

Nodes have (connection_id, external_id, label, layer, node_type,
health_status, is_source), edges (source, target, edge_type, status,
discovered_via, confidence, evidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.exact import percent
from assay.functions.severity import layer_rank, node_health
from assay.operators.graph import accept_edges, edge_set, qualified, unqualified
from assay.operators.history import latest_reports
from assay.operators.reachability import counts_per_start, masks_from, numbered, union, without_own
from assay.operators.relational import anti_join, first_rows, latest_per_key, merge_keyed
from assay.session import staged_table

# Confidence of a query-log edge by number of executions.
ONE_RUN_CONFIDENCE = 0.6
FEW_RUNS_CONFIDENCE = 0.75
MANY_RUNS_CONFIDENCE = 0.9
FEW_RUNS = 4

_PAIR = ["source", "target"]


def _tenant(*frames: DataFrame) -> list[str]:
    """``connection_id`` where all of the frames have it: rows of two connections then stay apart."""
    return ["connection_id"] if all("connection_id" in f.columns for f in frames) else []


def fk_edges(constraints: DataFrame) -> DataFrame:
    """G1: declared keys as confirmed edges parent -> child, self edges dropped."""
    listed = lambda t, c: F.concat(F.col(t), F.lit("("), F.array_join(c, ","), F.lit(")"))
    return constraints.filter(F.col("parent_fqn") != F.col("child_fqn")).select(
        F.col("parent_fqn").alias("source"), F.col("child_fqn").alias("target"), F.lit("FEEDS").alias("edge_type"),
        F.lit("confirmed").alias("status"), F.lit("fk").alias("discovered_via"), F.lit(None).cast("double").alias("confidence"),
        F.concat(F.lit("declared key "), "constraint_name", F.lit(", "), listed("child_fqn", "child_columns"),
                 F.lit(" refers to "), listed("parent_fqn", "parent_columns")).alias("evidence"))


def query_log_edges(statements: DataFrame, known_tables: DataFrame) -> DataFrame:
    """Extracted (source, target, execution_count, query_text) rows as suggested edges.

    Only tables of the catalog count, of the statement's own connection if both
    name one; a pair's executions are summed before the catalog is joined.
    """
    tenant = _tenant(statements, known_tables)
    runs = F.greatest(F.coalesce("execution_count", F.lit(1)), F.lit(1))
    pairs = statements.filter(F.col("source") != F.col("target")).groupBy(*tenant, *_PAIR).agg(
        F.sum(runs).alias("executions"), F.min("query_text").alias("example"))
    known = known_tables.select(*tenant, "table_fqn").distinct()
    for side in _PAIR:
        pairs = pairs.join(known.withColumnRenamed("table_fqn", side), [*tenant, side], "left_semi")
    n = F.col("executions")
    return pairs.select(
        *tenant, *_PAIR, F.lit("FEEDS").alias("edge_type"), F.lit("suggested").alias("status"), F.lit("query_log").alias("discovered_via"),
        F.when(n <= 1, ONE_RUN_CONFIDENCE).when(n <= FEW_RUNS, FEW_RUNS_CONFIDENCE).otherwise(MANY_RUNS_CONFIDENCE).alias("confidence"),
        F.concat(F.lit("Statements run: "), n.cast("string"), F.lit(", one of them: "), F.trim("example")).alias("evidence"))


def manifest_edges(entries: DataFrame) -> DataFrame:
    """Dependencies of a transformation project as confirmed edges.

    ``entries`` comes from ``sources.metadata.read_manifest``: (project, uid,
    is_model, fqn, name, depends_on).
    """
    models = entries.filter(F.col("is_model") & F.col("fqn").isNotNull())
    needs = models.select("project", F.col("fqn").alias("target"), F.coalesce("name", "uid").alias("name"),
                          F.explode("depends_on").alias("uid"))
    ups = entries.filter(F.col("fqn").isNotNull()).select("project", "uid", F.col("fqn").alias("source"))
    return needs.join(ups, ["project", "uid"]).filter(F.col("source") != F.col("target")).select(
        "project", *_PAIR, F.lit("FEEDS").alias("edge_type"), F.lit("confirmed").alias("status"), F.lit("dbt").alias("discovered_via"),
        F.concat(F.lit("needed by model "), "name").alias("evidence"))


_COLUMN_KEY = ["connection_id", "source_fqn", "source_column", "target_fqn", "target_column"]


def add_column_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert column edges that are not there yet."""
    fresh = anti_join(new.dropDuplicates(_COLUMN_KEY), existing, _COLUMN_KEY)
    return existing.unionByName(fresh, allowMissingColumns=True)


def column_lineage(edges: DataFrame) -> DataFrame:
    """Per table and column, what feeds it and what it feeds.

    Neighbours stay rows: a hot column may have any number of them.
    """
    fed = edges.select("connection_id", F.col("target_fqn").alias("table_fqn"), F.lit("fed_by").alias("direction"),
                       F.col("target_column").alias("column_name"), F.col("source_fqn").alias("related_table"),
                       F.col("source_column").alias("related_column"))
    feeds = edges.select("connection_id", F.col("source_fqn").alias("table_fqn"), F.lit("feeds").alias("direction"),
                         F.col("source_column").alias("column_name"), F.col("target_fqn").alias("related_table"),
                         F.col("target_column").alias("related_column"))
    return fed.unionByName(feeds)


def column_downstream(edges: DataFrame, table_fqn: str, column: str, limit: int | None = 12) -> DataFrame:
    """Columns fed by a named column, in any case; ``limit`` None lists all."""
    hit = (F.col("source_fqn") == table_fqn) & (F.lower("source_column") == column.lower())
    return first_rows(edges.filter(hit).orderBy("target_fqn", "target_column"), limit).select("target_fqn", "target_column")


def table_downstream(edges: DataFrame, nodes: DataFrame, table_fqn: str, limit: int | None = 8) -> DataFrame:
    """Direct consumers of a table; ``limit`` None lists all."""
    labels = nodes.select(F.col("external_id").alias("target"), "label", "layer", "node_type")
    return first_rows(edges.filter(F.col("source") == table_fqn).join(labels, "target").orderBy("target"), limit).select(
        "target", "label", "layer", F.coalesce("node_type", F.lit("table")).alias("node_type"))


def mark_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A source has no incoming confirmed edge, of its own connection if edges name one."""
    keys = [c for c in ("connection_id",) if c in nodes.columns and c in edges.columns]
    fed = edges.filter("status = 'confirmed'").select(*keys, F.col("target").alias("external_id")).distinct().withColumn("_fed", F.lit(True))
    return nodes.drop("is_source").join(fed, [*keys, "external_id"], "left").withColumn("is_source", F.col("_fed").isNull()).drop("_fed")


def propagate_health(nodes: DataFrame, results: DataFrame, run_id: Column) -> DataFrame:
    """Tables of a run fail if any rule fails; other nodes keep their health."""
    seen = results.filter(F.col("run_id") == run_id).groupBy("connection_id", F.col("table_fqn").alias("external_id")).agg(
        F.when(F.count_if(F.col("status") == "FAIL") > 0, "fail").otherwise("ok").alias("_health"))
    return nodes.join(seen, ["connection_id", "external_id"], "left").withColumn(
        "health_status", F.coalesce("_health", "health_status")).drop("_health")


def seed_nodes(reports: DataFrame) -> DataFrame:
    """One node per profiled table, health from its latest score."""
    known = F.coalesce("layer", F.lit("UNKNOWN"))
    return latest_reports(reports).select(
        "connection_id", F.col("table_fqn").alias("external_id"), F.col("table_fqn").alias("label"), known.alias("layer"),
        F.lit("table").alias("node_type"), node_health(F.coalesce("quality_score", F.lit(0.0))).alias("health_status"),
        layer_rank(known).alias("position_order"), F.lit(True).alias("is_source"))


def upsert_nodes(nodes: DataFrame, seeded: DataFrame) -> DataFrame:
    """Refresh health, layer and position of known nodes, add new ones."""
    return merge_keyed(nodes, seeded, ["connection_id", "external_id"], set_columns=["health_status", "layer", "position_order"])


def nodes_health(nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """Node health from the latest report; unprofiled nodes are ok."""
    last = latest_reports(reports).select("connection_id", F.col("table_fqn").alias("external_id"), "quality_score")
    return nodes.join(last, ["connection_id", "external_id"], "left").withColumn(
        "health_status", node_health(F.col("quality_score"))).drop("quality_score")


_COVERAGE = ("total_known_tables", "tables_with_edges", "suggested_pending", "suggested_approved", "suggested_rejected")


def coverage(known_tables: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How much of each connection's catalog has lineage, and the state of its suggestions."""
    named = lambda df: df.select("connection_id", *[F.lit(0).cast("long").alias(n) if n not in df.columns else F.col(n) for n in _COVERAGE])
    confirmed = edges.filter("status = 'confirmed'")
    ends = confirmed.select("connection_id", F.col("source").alias("external_id")).unionByName(confirmed.select("connection_id", F.col("target").alias("external_id"))).distinct()
    linked = nodes.select("connection_id", "external_id").distinct().join(ends, ["connection_id", "external_id"], "left_semi")
    hinted = F.col("discovered_via").isin("query_log", "query_log_llm")
    states = edges.groupBy("connection_id").agg(
        F.count_if(hinted & (F.col("status") == "suggested")).alias("suggested_pending"),
        F.count_if(hinted & (F.col("status") == "confirmed")).alias("suggested_approved"),
        F.count_if(hinted & (F.col("status") == "rejected")).alias("suggested_rejected"))
    size = lambda df, name: df.groupBy("connection_id").agg(F.count(F.lit(1)).alias(name))
    parts = union([named(states), named(size(known_tables, "total_known_tables")), named(size(linked, "tables_with_edges"))])
    return parts.groupBy("connection_id").agg(*[F.sum(n).alias(n) for n in _COVERAGE]).withColumn(
        "completeness_pct", percent(F.col("tables_with_edges"), F.col("total_known_tables"), 1))


def edges_by_origin(edges: DataFrame) -> DataFrame:
    """Confirmed edges of each connection by how they were found."""
    return edges.filter("status = 'confirmed'").groupBy("connection_id", "discovered_via").agg(F.count(F.lit(1)).alias("edges"))


def suggested_edges(edges: DataFrame) -> DataFrame:
    """Edges waiting for review, the most confident of each connection first."""
    return edges.filter("status = 'suggested'").orderBy(*_tenant(edges), F.desc_nulls_last("confidence"), "source", "target")


def review_edges(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply approve/reject in order of ``rank``; approvals may not close a cycle.

    ``decisions`` has (source, target, decision, rank).  Only suggested edges
    can be decided; an approval that would close a cycle is left suggested and
    marked.  Where both name a connection, each connection has its own graph.
    """
    if _tenant(edges, decisions):
        return unqualified(_review(qualified(edges, *_PAIR), qualified(decisions, *_PAIR)), *_PAIR).select(*edges.columns, "review")
    return _review(edges, decisions)


def _review(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    pending = edges.filter("status = 'suggested'").select(*_PAIR)
    wanted = decisions.join(pending, _PAIR, "left_semi")
    confirmed = edges.filter("status = 'confirmed'").select(*_PAIR, "status")
    approved = wanted.filter("decision = 'approve'").select(*_PAIR, F.lit("confirmed").alias("status"), "rank")
    outcome = accept_edges(confirmed, approved).select(*_PAIR, F.when(
        F.col("outcome") == "cycle", "blocked_by_cycle").otherwise("approved").alias("review"))
    rejected = wanted.filter("decision = 'reject'").select(*_PAIR, F.lit("rejected").alias("review"))
    return (edges.join(outcome.unionByName(rejected), _PAIR, "left")
            .withColumn("review", F.when(F.col("status") == "suggested", F.col("review")))
            .withColumn("status", F.when(F.col("review") == "approved", "confirmed")
                        .when(F.col("review") == "rejected", "rejected").otherwise(F.col("status"))))


def impact_severity(health: Column, downstream: Column) -> Column:
    """G18."""
    return (F.when((health == "fail") & (downstream >= 3), "critical").when(health == "fail", "high")
            .when((health == "warn") & (downstream >= 1), "medium").otherwise("low"))


def _first_dependents(masks: DataFrame, starts: DataFrame, limit: int | None) -> DataFrame:
    """(start, no, label) of the ``limit`` nearest nodes of each start in ``masks`` (group, node, mask, depth, label).

    Steps are taken from the nearest on; starts that have enough are not asked for any further.
    """
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(F.col("mask"), b) == 1)
    by_start = lambda some: some.withColumn("bit", F.explode(bits)).join(starts.select("start", "group", "bit"), ["group", "bit"])
    if limit is None:
        return latest_per_key(by_start(masks), ["start"], [F.asc("depth"), F.asc("node")], None, rank="no").select("start", "no", "label")
    steps = masks.select("depth").distinct().orderBy("depth").toLocalIterator()
    found, want = [], starts.select("group", F.col("mask").alias("_want"))
    for step in steps:
        open_ = want.groupBy("group").agg(F.bit_or("_want").alias("_want"))
        here = masks.filter(F.col("depth") == step["depth"]).join(open_, "group").withColumn("mask", F.col("mask").bitwiseAND(F.col("_want"))).filter("mask != 0")
        found.append(staged_table(latest_per_key(by_start(here), ["start"], [F.asc("node")], limit, rank="no").select("start", F.lit(step["depth"]).alias("depth"), "node", "label")))
        full = union(found).groupBy("start").count().filter(F.col("count") >= limit)
        left = starts.join(full, "start", "left_anti")
        if left.isEmpty():
            break
        want = left.select("group", F.col("mask").alias("_want"))
    if not found:
        return by_start(masks).select("start", F.lit(1).alias("no"), "label")
    return latest_per_key(union(found), ["start"], [F.asc("depth"), F.asc("node")], limit, rank="no").select("start", "no", "label")


def impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, shown_labels: int | None = 5) -> DataFrame:
    """Severity and three sentences for each table of ``targets`` (external_id); ``shown_labels`` None names all dependents."""
    chosen = nodes.join(targets.select("external_id").distinct(), "external_id", "left_semi")
    starts = numbered(chosen.select(F.col("external_id").alias("start")))
    labels = nodes.select(F.col("external_id").alias("node"), "label")
    masks = staged_table(without_own(masks_from(edge_set(edges.filter("status = 'confirmed'")), starts)[0], starts).join(labels, "node"))
    counted = counts_per_start(masks, starts, {"downstream_count": F.lit(True)}).withColumnRenamed("start", "external_id")
    shown = _first_dependents(masks, starts, shown_labels).groupBy(F.col("start").alias("external_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "label"))), lambda s: s["label"]), ", ").alias("labels"))
    j = chosen.join(counted, "external_id", "left").join(shown, "external_id", "left").fillna(0, ["downstream_count"])
    n, health = F.col("downstream_count"), F.coalesce("health_status", F.lit("ok"))
    state = F.concat("external_id", F.lit(": "), F.when(health == "fail", "rules fail").when(health == "warn", "a warning is open").otherwise("no finding"))
    more = F.lit("") if shown_labels is None else F.when(n > shown_labels, F.concat(F.lit(" and further ones: "), (n - shown_labels).cast("string"))).otherwise("")
    feeds = F.when(n > 0, F.concat(F.lit("Dependents: "), n.cast("string"), F.lit(", namely "), "labels", more)).otherwise(F.lit("Dependents: none known"))
    action = F.when(n > 0, "Look at these before their next load").otherwise("See whether edges are missing here")
    return j.select("external_id", impact_severity(health, n).alias("severity"), "downstream_count",
                    F.array(state, feeds, action).alias("bullets"))


def full_graph(nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """Every node with the time it was last profiled."""
    last = reports.groupBy("connection_id", F.col("table_fqn").alias("external_id")).agg(F.max("run_at").alias("last_profiled_at"))
    return nodes.join(last, ["connection_id", "external_id"], "left")


def import_nodes(nodes: DataFrame, wanted_nodes: DataFrame, wanted_edges: DataFrame) -> DataFrame:
    """Nodes to create, of their connection if all inputs name one; those named only by edges become bare tables."""
    tenant = _tenant(nodes, wanted_nodes, wanted_edges)
    key = [*tenant, "external_id"]
    ends = wanted_edges.select(*tenant, F.col("source").alias("external_id")).unionByName(
        wanted_edges.select(*tenant, F.col("target").alias("external_id"))).distinct()
    bare = anti_join(ends, wanted_nodes, key).select(
        *key, F.col("external_id").alias("label"), F.lit(None).cast("string").alias("layer"), F.lit("table").alias("node_type"))
    listed = wanted_nodes.select(*key, F.coalesce("label", "external_id").alias("label"), "layer",
                                 F.coalesce("node_type", F.lit("table")).alias("node_type"))
    return anti_join(listed.unionByName(bare), nodes, key)


def import_edges(edges: DataFrame, wanted_edges: DataFrame) -> DataFrame:
    """Outcome per imported edge (source, target, rank), as in :func:`accept_edges`; per connection where both inputs name one."""
    if _tenant(edges, wanted_edges):
        wanted = qualified(wanted_edges, *_PAIR).select(*_PAIR, F.lit("confirmed").alias("status"), F.struct("rank", "connection_id").alias("rank"))
        return unqualified(accept_edges(qualified(edges, *_PAIR), wanted), *_PAIR).withColumn("rank", F.col("rank.rank"))
    return accept_edges(edges, wanted_edges.select(*_PAIR, F.lit("confirmed").alias("status"), "rank"))


def graph_difference(current_nodes: DataFrame, current_edges: DataFrame, wanted_nodes: DataFrame,
                     wanted_edges: DataFrame) -> DataFrame:
    """(kind, action, source, target) that turns the current graph into the wanted one.

    A node named by a wanted edge is kept even if it is not listed.
    """
    edge = lambda df, action: df.select(F.lit("edge").alias("kind"), F.lit(action).alias("action"), *_PAIR)
    node = lambda df, action: df.select(F.lit("node").alias("kind"), F.lit(action).alias("action"), F.col("external_id").alias("source"),
                                        F.lit(None).cast("string").alias("target"))
    kept = wanted_nodes.select("external_id").unionByName(wanted_edges.select(F.col("source").alias("external_id"))).unionByName(
        wanted_edges.select(F.col("target").alias("external_id"))).distinct()
    return (edge(anti_join(wanted_edges, current_edges, _PAIR), "add").unionByName(edge(anti_join(current_edges, wanted_edges, _PAIR), "remove"))
            .unionByName(node(anti_join(wanted_nodes, current_nodes, ["external_id"]), "add"))
            .unionByName(node(anti_join(current_nodes, kept, ["external_id"]), "remove")))


