"""Sinks (S11-S14) and whole-table replacement for merges (M1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.text import csv_quoted, json_safe
from assay.operators.relational import merge_keyed

_VERSION = "_version"


def append_table(df: DataFrame, path: str, partition_by: str | None = "connection_id") -> None:
    """Append rows as parquet, one folder per tenant."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def save_reports(base: str, reports: DataFrame, column_stats: DataFrame, risks: DataFrame | None = None) -> None:
    """Reports, column statistics and risks as three tables."""
    append_table(reports, f"{base}/reports")
    append_table(column_stats, f"{base}/column_stats")
    if risks is not None:
        append_table(risks.withColumn("risk_code", F.concat(F.lit("R"), F.col("risk_no").cast("string"))), f"{base}/risks")


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Write a new state of a table next to the old ones.

    The job commit publishes the version folder, so readers see either the old
    or the new state, and a table can be replaced by a plan that reads it.
    """
    df.withColumn(_VERSION, F.lit(version)).write.mode("append").partitionBy(_VERSION).parquet(path)


def read_latest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Newest state of a versioned table and its version."""
    every = spark.read.parquet(path)
    version = every.agg(F.max(_VERSION)).first()[0]
    return every.filter(F.col(_VERSION) == version).drop(_VERSION), version


def merge_into(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], **rules) -> int:
    """M1 on a versioned table; returns the new version."""
    current, version = read_latest(spark, path)
    write_version(merge_keyed(current, updates, keys, **rules), path, version + 1)
    return version + 1


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as quoted CSV lines that a spreadsheet will not run."""
    cells = [csv_quoted(F.col("`" + c.replace("`", "``") + "`")) for c in df.columns]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def export_csv(df: DataFrame, path: str) -> None:
    """The lines as text files, each with a header."""
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    guarded = csv_lines(df).withColumnRenamed("line", header)
    guarded.write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\u0001").csv(path)


def json_samples(df: DataFrame) -> DataFrame:
    """Rows as JSON text with ISO dates, doubles for decimals and hex for bytes."""
    cells = [json_safe(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cells)).alias("sample"))
