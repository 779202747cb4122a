"""Discover lineage from declared keys, project manifests and the query log, or import it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators import lineage
from assay.operators.graph import accept_edges
from assay.session import cut_lineage

# Order in which kinds of evidence are taken up: what comes first is there when a later edge would close a cycle.
KINDS = ("fk", "dbt", "query_log")
_PAIR = ["source", "target"]
_EDGE = [*_PAIR, "edge_type", "status", "discovered_via", "confidence", "evidence"]


@dataclass(frozen=True)
class Discovery:
    nodes: DataFrame
    edges: DataFrame
    counts: DataFrame


def _taken(edges: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph's edges with the accepted candidates, and the outcome of every candidate."""
    ranked = cut_lineage(candidates)
    outcomes = cut_lineage(accept_edges(edges, ranked.select(*_PAIR, "status", "rank")))
    new = ranked.join(outcomes.filter(F.col("outcome").isin("confirmed", "suggested")).select("rank"), "rank", "left_semi")
    return edges.unionByName(new.select(*_EDGE), allowMissingColumns=True), outcomes.join(ranked.select("rank", "discovered_via"), "rank")


def _with_nodes(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with those that are missing, sources marked anew, and the missing ones."""
    created = cut_lineage(lineage.import_nodes(nodes, wanted, edges.select(*_PAIR)))
    return lineage.mark_sources(nodes.unionByName(created, allowMissingColumns=True), edges.drop("connection_id")), created


def discover(nodes: DataFrame, edges: DataFrame, known_tables: DataFrame, constraints: DataFrame | None = None,
             statements: DataFrame | None = None, manifests: DataFrame | None = None) -> Discovery:
    """The graph of one connection after a discovery run.

    ``constraints`` come from ``metadata.foreign_keys``, ``manifests`` from
    ``metadata.read_manifest``, ``statements`` are extracted (source, target,
    execution_count, query_text) rows.  Of several findings of one edge the
    first kind counts.  ``counts`` has the edges by kind and outcome, and the
    nodes created under kind ``node``.
    """
    known = known_tables.select(*[c for c in ("connection_id", "table_fqn") if c in known_tables.columns]).distinct()
    parts = []
    if constraints is not None:
        parts.append(lineage.fk_edges(constraints).select(*_EDGE))
    if manifests is not None:
        parts.append(lineage.manifest_edges(manifests).withColumn("confidence", F.lit(None).cast("double")).select(*_EDGE))
    if statements is not None:
        parts.append(lineage.query_log_edges(statements, known).select(*_EDGE))
    if not parts:
        return Discovery(lineage.mark_sources(nodes, edges), edges, nodes.sparkSession.createDataFrame([], "discovered_via string, outcome string, n bigint"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("discovered_via")), F.lit(0)).cast("string")
    rank = F.concat_ws("\u001f", order, "source", "target", F.coalesce("evidence", F.lit("")))
    after, outcomes = _taken(edges, found.withColumn("rank", rank).dropDuplicates(["rank"]))
    after = cut_lineage(after)
    everywhere, created = _with_nodes(nodes, after, nodes.select("external_id", "label", "layer", "node_type").limit(0))
    counts = outcomes.groupBy("discovered_via", "outcome").agg(F.count(F.lit(1)).alias("n")).unionByName(
        created.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("discovered_via"), F.lit("created").alias("outcome"), "n"))
    return Discovery(everywhere, after, counts)


def import_graph(nodes: DataFrame, edges: DataFrame, wanted_nodes: DataFrame, wanted_edges: DataFrame) -> Discovery:
    """The graph after an edited one was read by ``metadata.read_graph``; edges come in its order, and none may close a cycle."""
    candidates = wanted_edges.select(*_PAIR, "edge_type", F.lit("confirmed").alias("status"), F.lit("import").alias("discovered_via"),
                                     F.lit(None).cast("double").alias("confidence"), F.lit("imported").alias("evidence"), "rank")
    after, outcomes = _taken(edges, candidates)
    after = cut_lineage(after)
    everywhere, created = _with_nodes(nodes, after, wanted_nodes)
    counts = outcomes.groupBy("discovered_via", "outcome").agg(F.count(F.lit(1)).alias("n")).unionByName(
        created.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("discovered_via"), F.lit("created").alias("outcome"), "n"))
    return Discovery(everywhere, after, counts)
