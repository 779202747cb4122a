"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import shared_folder

#: A word: a run without ASCII white space.  ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the table read from there."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that :func:`staged` returned; whatever reads them must have been written before."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of every row; NULL becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small(parts: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a worker makes of a batch stays small."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def lower_words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return text.lower().split()


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_key(text: Column) -> Column:
    """Identity of a text among rows that share an id; NULL and empty differ."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def batches(schema: pa.Schema, columns: Iterable[Iterable]) -> pa.RecordBatch:
    """A record batch from one sequence per field."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def shared_object(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this package by value; ``pickle.loads`` of the broadcast's value restores it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def joined_by_key(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once.

    Keys that hold a thousandth of ``rows`` or more, hence at most a thousand, are
    broadcast; what is left is shuffled.  ``rows`` is read three times.
    """
    counted = rows.groupBy(*key).count()
    total = counted.agg(F.sum("count")).first()[0] or 0
    heavy = staged(counted.where(F.col("count") * 1000 >= total).select(*key), "heavy")
    few = F.broadcast(table.join(F.broadcast(heavy), key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(heavy), key, "left_anti").join(table, key))
