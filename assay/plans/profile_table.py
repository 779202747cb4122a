"""Profile one table: statistics, score and risks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.severity import severity_rank
from assay.functions.text import VALUE_FORMATS
from assay.operators import history, integrity, lineage, profile
from assay.session import cut_lineage
from assay.sources.sinks import json_samples, save_reports
from assay.sources.windows import window_condition


@dataclass(frozen=True)
class ForeignKey:
    """A declared or inferred reference to ``parent``."""

    columns: Sequence[str]
    parent: DataFrame
    parent_columns: Sequence[str]
    parent_name: str
    source: str = "declared_fk"


@dataclass(frozen=True)
class TableProfile:
    columns: DataFrame
    scores: DataFrame
    risks: DataFrame
    orphans: DataFrame | None
    is_partial_scan: bool
    drift: DataFrame | None = None


def profile_table(df: DataFrame, *, foreign_keys: Sequence[ForeignKey] = (), keys: Sequence[Sequence[str]] = (),
                  long_text: Sequence[str] = (), approx: bool = False, partition_column: str | None = None,
                  window_from=None, window_to=None, inferred: Mapping[str, DataFrame] | None = None, name: str = "",
                  previous_columns: DataFrame | None = None, samples: int | None = None) -> TableProfile:
    """Profile ``df``, optionally inside a time window.

    The column statistics, a few rows, are materialised once and feed scores
    and risks.  Key duplicates come out of the same value counts; ``keys`` adds
    composite keys.  Columns of ``foreign_keys`` are never taken for keys, and
    the window limits the child side of their orphan checks only.  ``inferred``
    has the sibling tables by name, to which ``name`` may refer by its columns'
    names; ``previous_columns`` are the stored columns of the run before, for
    drift; with ``samples`` every risk shows so many failing rows or keys.
    """
    if inferred is not None:
        foreign_keys = [*foreign_keys, *_guessed(df, name, inferred, foreign_keys)]
    window = window_condition(df, partition_column, window_from, window_to)
    scoped = df if window is None else df.filter(window)
    stats = cut_lineage(profile.profile_columns(scoped, long_text=long_text, approx=approx))
    fk_columns = [c for fk in foreign_keys for c in fk.columns]
    single = profile.key_candidates(stats, fk_columns).select(
        F.monotonically_increasing_id().alias("ordinal"), F.col("column_name").alias("key_columns"), "duplicate_groups", "duplicate_rows")
    duplicates = single
    if keys:
        composite = profile.key_duplicates(scoped, keys).withColumn("ordinal", (F.col("ordinal") + 1_000_000).cast("bigint"))
        duplicates = single.unionByName(composite)
    duplicates = cut_lineage(duplicates)
    worst = profile.worst_key_duplicate(duplicates).select("duplicate_rows").scalar()
    same = profile.duplicate_rows(scoped).select("duplicate_rows").scalar()
    rows = stats.agg(F.max("row_count")).scalar()
    orphans = None
    for fk in foreign_keys:
        part = integrity.orphan_check(scoped, fk.columns, fk.parent, fk.parent_columns, parent_name=fk.parent_name, source=fk.source)
        orphans = part if orphans is None else orphans.unionByName(part)
    risks = profile.column_risks(stats).unionByName(profile.duplicate_key_risk(duplicates, rows))
    if orphans is not None:
        risks = risks.unionByName(profile.orphan_risks(orphans))
    if samples is not None:
        risks = risks.join(_samples(scoped, stats, risks, foreign_keys, samples), ["column_name", "risk_type"], "left")
    drift = None if previous_columns is None else history.schema_drift(previous_columns, stats)
    return TableProfile(stats, profile.score_table(stats, same, worst), risks, orphans, window is not None, drift)


def _guessed(df: DataFrame, name: str, siblings: Mapping[str, DataFrame], declared: Sequence[ForeignKey]) -> list[ForeignKey]:
    """References of ``df`` that the naming rule suggests; columns with a declared one are left out."""
    rows = [("", t, f.name) for t, frame in {**siblings, name: df}.items() for f in frame.schema.fields]
    catalog = df.sparkSession.createDataFrame(rows, "schema_name string, table_name string, column_name string")
    taken = {c for fk in declared for c in fk.columns}
    found = integrity.infer_foreign_keys(catalog).filter(F.col("table_name") == name).collect()  # at most one for each column
    return [ForeignKey([r.column_name], siblings[r.parent_table], [r.parent_column], r.parent_table, "inferred")
            for r in found if r.column_name not in taken and r.parent_table in siblings]


def _samples(df: DataFrame, stats: DataFrame, risks: DataFrame, foreign_keys: Sequence[ForeignKey], n: int) -> DataFrame:
    """(column_name, risk_type, sample): up to ``n`` failing rows or keys of each risk as a JSON array."""
    out = df.sparkSession.createDataFrame([], "column_name string, risk_type string, sample string")
    by_columns = {",".join(fk.columns): fk for fk in foreign_keys}
    for r in risks.select("column_name", "risk_type").collect():  # a few for each column
        quoted = F.col("`" + r.column_name.replace("`", "``") + "`")
        if r.risk_type.startswith("NULL"):
            found = profile.risk_samples(df, quoted.isNull(), n)
        elif r.risk_type == "FORMAT_MIXED":
            known = F.lit(False)
            for _, pattern in VALUE_FORMATS:
                known = known | quoted.rlike(pattern)
            found = profile.risk_samples(df, quoted.isNotNull() & ~known, n)
        elif r.risk_type == "DUPLICATE_KEY":
            found = json_samples(profile.duplicate_key_samples(df, r.column_name.split(",") if r.column_name not in df.columns else [r.column_name], n))
        else:
            fk = by_columns[r.column_name]
            found = json_samples(integrity.orphan_samples(df, fk.columns, fk.parent, fk.parent_columns, n))
        out = out.unionByName(found.select(F.lit(r.column_name).alias("column_name"), F.lit(r.risk_type).alias("risk_type"), "sample"))
    listed = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("sample")), ","), F.lit("]"))
    return out.groupBy("column_name", "risk_type").agg(listed.alias("sample"))


def save_profile(base: str, p: TableProfile, nodes: DataFrame, *, connection_id: str, table_fqn: str, layer: str, run_at: Column) -> DataFrame:
    """Append report, column statistics and risks to the tables under ``base``; returns the nodes with the table's new health."""
    report_id = F.concat_ws("@", F.lit(table_fqn), F.date_format(run_at, "yyyy-MM-dd'T'HH:mm:ss"))
    named = {"report_id": report_id, "connection_id": F.lit(connection_id), "table_fqn": F.lit(table_fqn), "layer": F.lit(layer), "run_at": run_at}
    reports = p.scores.withColumns({**named, "is_partial_scan": F.lit(p.is_partial_scan)})
    nth = F.row_number().over(Window.orderBy(severity_rank(F.col("severity")), "risk_type", "column_name"))  # a few for each column
    save_reports(base, reports, p.columns.withColumns(named), p.risks.withColumns(named).withColumn("risk_no", nth))
    return lineage.upsert_nodes(nodes, lineage.seed_nodes(reports))
