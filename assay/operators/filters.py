"""Scopes and grid filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text

_CHOICES = ("ALL", None)


def visible(df: DataFrame, connections: DataFrame, org_id: str, connection_id: str | None = None,
            table_fqn: str | None = None) -> DataFrame:
    """rows of connections an organisation may see, optionally of one connection or table.

    Connections of the default organisation and without one are shared.
    """
    org = F.col("org_id")
    allowed = connections.filter(org.isNull() | org.isin(org_id, "default")).select("connection_id").distinct()
    out = df.join(allowed, "connection_id", "left_semi")
    if connection_id:
        out = out.filter(F.col("connection_id") == connection_id)
    if table_fqn:
        out = out.filter(F.col("table_fqn") == table_fqn)
    return out


def key_columns(columns: DataFrame) -> DataFrame:
    """columns whose name ends like a key."""
    return columns.filter(F.col("column_name").rlike(text.RELATION_KEY_LIKE))


def _mentions(needle: str, *cols: str) -> Column:
    hits = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower())) for c in cols]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def dictionary_grid(dictionary: DataFrame, *, search: str = "", layer: str = "ALL", status: str = "ALL",
                    is_cde: bool | None = None, is_pii: bool | None = None, sort_by: str = "column_name",
                    descending: bool = False) -> DataFrame:
    """F8: the dictionary as filtered and sorted on screen, tables kept together."""
    out = dictionary
    if search:
        out = out.filter(_mentions(search, "column_name", "description", "business_name"))
    if layer not in _CHOICES:
        out = out.filter(F.col("layer") == layer)
    if status not in _CHOICES:
        out = out.filter(F.col("status") == status)
    if is_cde is not None:
        out = out.filter(F.col("is_cde") == is_cde)
    if is_pii is not None:
        out = out.filter(F.col("is_pii") == is_pii)
    key = F.lower("column_name") if sort_by == "column_name" else F.col(sort_by)
    return out.orderBy("table_fqn", key.desc() if descending else key.asc(), "column_id")


def rule_grid(rules: DataFrame, *, table_fqn: str | None = None, layer: str = "ALL", status: str = "ALL",
              rule_type: str = "ALL", search: str = "") -> DataFrame:
    """rules by table, layer, status, type and text; CROSS_TABLE selects rules with a related table."""
    out = rules
    if table_fqn:
        out = out.filter(F.col("table_fqn") == table_fqn)
    if layer not in _CHOICES:
        out = out.filter(F.col("layer") == layer)
    if status not in _CHOICES:
        out = out.filter(F.col("status") == status)
    if rule_type == "CROSS_TABLE":
        out = out.filter(F.col("related_table_fqn").isNotNull())
    elif rule_type not in _CHOICES:
        out = out.filter(F.col("rule_type") == rule_type)
    return out.filter(_mentions(search, "rule_name", "rule_expression", "table_fqn")) if search else out


def result_grid(results: DataFrame, *, layer: str = "ALL", status: str = "ALL") -> DataFrame:
    """results by layer and status; ``expected`` selects acknowledged failures, FAIL leaves them out."""
    out = results if layer in _CHOICES else results.filter(F.col("layer") == layer)
    expected = F.coalesce("is_expected_failure", F.lit(False))
    if status == "expected":
        return out.filter(expected)
    if status in _CHOICES:
        return out
    out = out.filter(F.col("status") == status)
    return out.filter(~expected) if status == "FAIL" else out
