"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate, language_id, line_dedup, mixing, shingle_sets
from assay.llm.common import remainder
from assay.llm.queries import FOLDS, HELD_OUT
from assay.session import shared_folder


#: The columns that stages read or change.
CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with its other columns renamed, lest they clash with what an operator adds, and how to get them back, with columns added."""
    names = {c: c if c in CORE else f"__extra_{i}" for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    renamed = docs.select(*[quoted(c).alias(n) for c, n in names.items()])
    return renamed, lambda result, *more: result.select(*[F.col(n).alias(c) for c, n in names.items() if c not in more], *more)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; one without text or letters goes.

    NULLs in other columns change nothing; repeated rows share their fate.
    """
    rows, restored = _apart(docs)
    parser = language_id.fit(rows.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    found = language_id.identify(rows, parser, names=("__lang", "__score"))
    return restored(found.where(language_id.has_language(F.col("__lang"))))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document of which nothing is left goes.

    ``n_chars`` follows the text where lines went.  Documents without repeated
    windows, NULL and empty texts among them, stay as they are.
    """
    rows, restored = _apart(docs)
    left = line_dedup.dedup_lines(rows).where(~line_dedup.emptied())
    if "n_chars" in docs.columns:
        counted = F.when(F.size("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", counted)
    return restored(left)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, by five-word shingles and a Jaccard similarity of 0.8 or more, the document with the smallest id, of its repeated rows one; wordless texts are one group."""
    rows, restored = _apart(docs)
    return restored(shingle_sets.keep_first(rows))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item; NULL and empty texts are clean."""
    rows, restored = _apart(docs)
    found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return restored(found.where(~decontaminate.contaminated()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and epoch, with its words, its source's size and target.

    Adds ``size``, ``source_size``, ``target``, ``taken``, ``epoch`` and
    ``words``, in place of columns of these names.  Documents without words go.
    """
    rows, restored = _apart(docs)
    return restored(mixing.copies(mixing.mix(rows)), "size", "source_size", "target", "taken", "epoch", "words")


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
]

#: SQL has neither suffix automata nor XXH64, so the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
