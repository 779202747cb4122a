"""Metadata sources: catalog, constraints, query history, project manifests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.text import normalised_statement
from assay.operators.relational import latest_per_key

# Schemas that hold no user tables.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "sys", "guest")

# Shapes of statements that move data.
MOVES_DATA = ("%INSERT%INTO%", "%MERGE%", "%SELECT%INTO%", "%CREATE TABLE%AS%")

MODEL_KINDS = ("model", "seed", "snapshot")

_ENTRY = ("struct<resource_type:string,database:string,schema:string,alias:string,identifier:string,name:string,"
          "depends_on:struct<nodes:array<string>>>")
MANIFEST_TYPE = f"struct<nodes:map<string,{_ENTRY}>,sources:map<string,{_ENTRY}>>"


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_fqn, schema_name, table_name, ordinal, column_name, data_type, nullable).

    Built from the schemas the driver already holds; system schemas are left out.
    """
    rows = []
    for fqn, df in tables.items():
        schema, _, name = fqn.rpartition(".")
        if schema.lower() not in SYSTEM_SCHEMAS:
            rows += [(fqn, schema, name, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_fqn string, schema_name string, table_name string, ordinal int, "
                                       "column_name string, data_type string, nullable boolean")


def table_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count, counted in one job."""
    out = None
    for fqn, df in tables.items():
        if fqn.rpartition(".")[0].lower() in SYSTEM_SCHEMAS:
            continue
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(fqn).alias("table_fqn"), F.lit(len(df.columns)).alias("columns"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def session_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """The tables of the session's catalog by qualified name."""
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return {".".join([*(t.namespace or []), t.name]): spark.table(".".join([*(t.namespace or []), t.name])) for t in found}


def foreign_keys(constraint_columns: DataFrame) -> DataFrame:
    """One row per constraint, its columns in key order.

    Input rows are (constraint_name, parent_fqn, child_fqn, position,
    parent_column, child_column); a constraint has a handful of columns.
    """
    pairs = F.sort_array(F.collect_list(F.struct("position", "parent_column", "child_column")))
    grouped = constraint_columns.groupBy("constraint_name", "parent_fqn", "child_fqn").agg(pairs.alias("cols"))
    return grouped.select("constraint_name", "parent_fqn", "child_fqn",
                          F.transform("cols", lambda c: c["parent_column"]).alias("parent_columns"),
                          F.transform("cols", lambda c: c["child_column"]).alias("child_columns"))


def query_history(log: DataFrame, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Data-moving statements, one per normalised text, newest first.

    Of equal statements the one executed most often is kept.
    """
    moves = F.col("query_text").like(MOVES_DATA[0])
    for pattern in MOVES_DATA[1:]:
        moves = moves | F.col("query_text").like(pattern)
    kept = log.filter(moves if since is None else moves & (F.col("executed_at") >= since))
    key = F.sha2(normalised_statement(F.col("query_text")), 256)
    best = latest_per_key(kept.withColumn("_key", key), ["_key"],
                          [F.desc(F.coalesce("execution_count", F.lit(0))), F.desc("executed_at"), F.asc("query_text")]).drop("_key")
    ordered = best.orderBy(F.desc("executed_at"), "query_text")
    return ordered if limit is None else ordered.limit(limit)


def plan_runs(runtime_stats: DataFrame) -> DataFrame:
    """Executions per plan."""
    return runtime_stats.groupBy("plan_id").agg(F.max("last_execution_time").alias("executed_at"), F.sum("count_executions").alias("execution_count"))


def read_manifest(df: DataFrame, project: str, manifest: str) -> DataFrame:
    """(project, uid, is_model, fqn, name, depends_on) of each manifest entry.

    ``manifest`` is the JSON text of a project; tests and other node kinds are
    dropped.  The schema ``dbo`` is left out of names.
    """
    parsed = df.select(F.col(project).alias("project"), F.from_json(manifest, MANIFEST_TYPE).alias("m"))
    nodes = parsed.select("project", F.explode("m.nodes").alias("uid", "d"), F.lit(True).alias("is_model")).filter(
        F.col("d.resource_type").isin(*MODEL_KINDS))
    sources = parsed.select("project", F.explode("m.sources").alias("uid", "d"), F.lit(False).alias("is_model"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.coalesce(filled("d.alias"), filled("d.identifier"), filled("d.name"))
    schema = F.when(F.lower("d.schema") != "dbo", filled("d.schema"))
    fqn = F.when(filled("d.database").isNotNull() & name.isNotNull(), F.concat_ws(".", "d.database", schema, name))
    return nodes.unionByName(sources).select(
        "project", "uid", "is_model", fqn.alias("fqn"), F.col("d.name").alias("name"),
        F.coalesce("d.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"))


GRAPH_TYPE = ("struct<nodes:array<struct<external_id:string,label:string,layer:string,node_type:string>>,"
              "edges:array<struct<source:string,target:string,edge_type:string>>,rank:string>")


def read_graph(df: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of exported graphs, one JSON text a row.

    Edges keep their order in ``rank``, across rows by the rank that a text
    names, or else by its digest.  Nodes
    without an id and edges without both ends are dropped; edges feed unless
    they say otherwise.
    """
    parsed = df.select(F.from_json(graph, GRAPH_TYPE).alias("g"), F.sha2(graph, 256).alias("digest")).select("g", F.coalesce("g.rank", "digest").alias("of"))
    nodes = parsed.select(F.inline("g.nodes")).filter(F.col("external_id").isNotNull()).dropDuplicates(["external_id"])
    listed = parsed.select("of", F.posexplode("g.edges").alias("no", "e"))
    edges = listed.select("e.source", "e.target", F.coalesce("e.edge_type", F.lit("FEEDS")).alias("edge_type"),
                          F.concat_ws("/", "of", F.lpad(F.col("no").cast("string"), 12, "0")).alias("rank"))
    return nodes, edges.filter(F.col("source").isNotNull() & F.col("target").isNotNull())


def write_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as JSON texts in column ``graph``, one for each node and each edge, hence short whatever the graph's size.

    The rank that an edge's text names orders edges by source, target and type.
    """
    n = nodes.select(F.struct(F.array(F.struct("external_id", "label", "layer", "node_type")).alias("nodes")).alias("x"))
    rank = F.concat_ws("\0", "source", "target", "edge_type")
    e = edges.select(F.struct(F.array(F.struct("source", "target", "edge_type")).alias("edges"), rank.alias("rank")).alias("x"))
    return n.select(F.to_json("x").alias("graph")).unionByName(e.select(F.to_json("x").alias("graph")))
