"""Dataset listing and layer resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.severity import LAYERS, UNKNOWN_LAYER
from assay.operators.history import latest_reports

HOT_BELOW = 70

# Assignments that are not layers.
NOT_LAYERS = ("monitor", "ignore")


def guessed_layer(schema: Column) -> Column:
    """A schema named like a layer is that layer."""
    return F.when(F.upper(schema).isin(*LAYERS), F.upper(schema)).otherwise(UNKNOWN_LAYER)


def resolve_layers(tables: DataFrame, assignments: DataFrame) -> DataFrame:
    """The assigned layer of a schema first, then its name.

    ``tables`` has schema_name, ``assignments`` (schema_name, assigned); schemas
    that are only monitored or ignored have no layer.
    """
    a = assignments.select("schema_name", F.when(F.col("assigned").isin(*NOT_LAYERS), UNKNOWN_LAYER).otherwise(F.col("assigned")).alias("_a"))
    return tables.join(a, "schema_name", "left").withColumn("layer", F.coalesce("_a", guessed_layer(F.col("schema_name")))).drop("_a")


def list_datasets(tables: DataFrame, reports: DataFrame) -> DataFrame:
    """Every table with its latest score and day, and whether it is hot.

    Tables stay rows; group them by schema and layer where they are shown.
    """
    last = latest_reports(reports).select("connection_id", "table_fqn", "quality_score", "run_at", F.col("row_count").alias("profiled_rows"))
    score = F.round(F.coalesce("quality_score", F.lit(0.0)), 0)
    j = tables.join(last, ["connection_id", "table_fqn"], "left")
    return (j.withColumn("score", score).withColumn("rows", F.coalesce("profiled_rows", F.lit(0)))
            .withColumn("profiled", F.coalesce(F.date_format("run_at", "yyyy-MM-dd"), F.lit("—")))
            .withColumn("hot", (F.col("score") > 0) & (F.col("score") < HOT_BELOW))
            .drop("quality_score", "run_at", "profiled_rows"))


def dataset_groups(listing: DataFrame) -> DataFrame:
    """Tables, hot tables and rows per schema and layer."""
    return listing.groupBy("schema_name", "layer").agg(
        F.count(F.lit(1)).alias("tables"), F.count_if("hot").alias("hot_tables"), F.sum("rows").alias("rows"))
