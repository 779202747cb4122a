"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILE_FORMATS = ("parquet", "orc", "csv", "json")


def read_table(spark: SparkSession, location: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """A table from files, the session catalog or a database.

    ``fmt`` is one of the file formats, ``table`` for a catalog name, or
    ``jdbc``, where ``location`` is the table and ``options`` hold ``url`` and,
    for a parallel read, ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``.
    """
    if fmt == "table":
        return spark.table(location)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "jdbc":
        return reader.format("jdbc").options(dbtable=location, **options).load()
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    return reader.format(fmt).options(**options).load(location)
