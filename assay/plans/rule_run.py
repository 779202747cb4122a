"""Run the approved rules of a scope and update what depends on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators import lineage, rules
from assay.operators.rule_results import expire_snoozes

# Rules that are planned and run together.
BATCH_RULES = 500


@dataclass(frozen=True)
class RuleRun:
    results: DataFrame
    summary: DataFrame
    nodes: DataFrame | None


def run_scope(tables: dict[str, DataFrame], rule_table: DataFrame, *, connection_id: str, run_id: str, as_of: Column,
              layer: str | None = None, table_fqn: str | None = None, rule_id: str | None = None,
              nodes: DataFrame | None = None) -> RuleRun:
    """Select, execute and summarise rules; ``nodes`` get their new health.

    Rule texts reach the driver to be analysed, ``BATCH_RULES`` short rows at a
    time, and so does one result row per rule; the tables they run on never do.
    ``rule_type`` and ``check_args`` of a stored rule, if there, run it as key counts.
    """
    chosen = rules.select_rules(expire_snoozes(rule_table, as_of), connection_id, rule_id, layer, table_fqn)
    wanted = [f for f in ("rule_id", "table_fqn", "rule_expression", "rule_name", "layer", "severity", "is_cde_rule", "status", "rule_type", "check_args") if f in chosen.columns]
    parts, batch = [], []
    for row in chosen.select(*wanted).toLocalIterator():
        batch.append(rules.Rule(**row.asDict()))
        if len(batch) == BATCH_RULES:
            parts.append(rules.execute_rules(tables, batch, run_id=run_id, as_of=as_of))
            batch = []
    if batch or not parts:
        parts.append(rules.execute_rules(tables, batch, run_id=run_id, as_of=as_of))
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    results = results.withColumn("connection_id", F.lit(connection_id))
    health = None if nodes is None else lineage.propagate_health(nodes, results, F.lit(run_id))
    return RuleRun(results, rules.run_summary(results), health)
