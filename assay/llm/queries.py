"""The queries of this subpackage, each applying one operator to a whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import (chat_format, collocation, curve_ann, decontaminate, language_id, lattice_lm, line_dedup, mixing, secret_scan, simhash, spelling, url_filter,
                       warc)
from assay.llm.common import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated three-line windows."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), "text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-model and lattice scores of every document, learned from nine tenths of them."""
    held_out = remainder(F.col("doc_id"), 10) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    return lattice_lm.score(docs, "train").select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Every third document of the language labels is held out.
FOLDS, HELD_OUT = 3, 1


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    parser = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), parser).select("doc_id", "held_out", "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from every formatted conversation, and from one with control strings in its texts."""
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat_format.TRICKY).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    done = chat_format.format_conversations(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    read = done.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_curve_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours of every fiftieth vector."""
    return curve_ann.neighbours(table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    counts = [secret_scan.count(k).alias(f"n_{k}") for k in (*secret_scan.BASE_KINDS, "entropy")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(secret_scan.base_spans()), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents, some of whose occurrences lose a letter."""
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"))
    return spelling.group_variants(spelling.count_words(runs.select(spelling.misspelt(F.col("run"), F.col("doc_id")).alias("word"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language."""
    return collocation.collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives that it was written to."""
    pages = table(spark, sf_dir, "pages")
    return warc.round_trip(pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_lm_score, op4_language_id, op5_mixing, op6_chat_format, op7_simhash, op8_curve_ann, op9_secret_scan,
                                   op10_decontamination, op11_spelling_variants, op12_collocations, op13_warc)}
ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op2_url_filter": url_filter.ORACLE, "op5_mixing": mixing.ORACLE, "op6_chat_format": chat_format.ORACLE, "op10_decontamination": decontaminate.ORACLE,
           "op11_spelling_variants": spelling.ORACLE, "op12_collocations": collocation.ORACLE, "op13_warc": warc.ORACLE}
