"""Working with rule results and rule records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text
from assay.functions.exact import ratio, scaled
from assay.functions.severity import LAYERS
from assay.operators.relational import anti_join, latest_per_key, merge_keyed

LIVE = ("approved", "active")
UNIQUE_RATIO = 0.95


def current_state(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Newest result of each live rule, whatever run it came from."""
    live = rules.filter(F.col("status").isin(*LIVE)).select("rule_id")
    newest = latest_per_key(results, ["rule_id"], [F.desc("run_timestamp"), F.desc("result_id")])
    return newest.join(live, "rule_id")


def never_run(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Live rules without any result."""
    return anti_join(rules.filter(F.col("status").isin(*LIVE)), results, ["rule_id"])


def run_results(results: DataFrame, rules: DataFrame, run_id: Column) -> DataFrame:
    """Results of one run with rule names; expected failures are marked apart."""
    names = rules.select("rule_id", F.col("rule_name").alias("_name"))
    out = results.filter(F.col("run_id") == run_id).join(names, "rule_id", "left")
    counted = (F.col("status") == "FAIL") & ~F.coalesce("is_expected_failure", F.lit(False))
    return out.withColumn("rule_name", F.coalesce("_name", F.lit(""))).drop("_name").withColumn("counts_as_failed", counted)


def layer_cards(results: DataFrame) -> DataFrame:
    """One card per known layer that has results."""
    out = results.filter(F.col("layer").isin(*LAYERS)).groupBy("layer").agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "ERROR").alias("errored"),
        ratio(F.sum(scaled(F.col("quality_score"), 1)), F.count("quality_score") * 10, 0).alias("score"))
    return out.withColumn("all_errored", F.col("errored") == F.col("rules"))


def merge_results(existing: DataFrame, scoped: DataFrame) -> DataFrame:
    """Results of a scoped run replace those of the same rules only."""
    return merge_keyed(existing, scoped, ["rule_id"])


def rules_per_table(rules: DataFrame) -> DataFrame:
    """Rules of each connection's tables by state."""
    return rules.filter(F.col("table_fqn").isNotNull()).groupBy("connection_id", "table_fqn").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(*LIVE)).alias("approved"),
        F.count_if(F.col("status") == "draft").alias("pending"), F.count_if(F.col("is_cde_rule")).alias("cde"),
        F.count_if(F.col("related_table_fqn").isNotNull()).alias("cross_table"))


def decide(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply one decision per rule and say what became of it.

    ``decisions`` has (rule_id, decision, decided_by, is_admin, snooze_until,
    edited_expression).  An author may not approve their own rule unless they
    are an administrator, and an approval may not carry an edit.
    """
    renamed = decisions.select("rule_id", "decision", "decided_by", "is_admin",
                               F.col("snooze_until").alias("_until"), F.col("edited_expression").alias("_text"))
    j = rules.join(renamed, "rule_id", "left")
    kind = F.col("decision")
    own = (F.col("created_by") == F.col("decided_by")) & ~F.coalesce("is_admin", F.lit(False))
    outcome = (F.when(kind.isNull(), F.lit(None).cast("string"))
               .when((kind == "approve") & F.col("_text").isNotNull(), "edit_with_approve")
               .when((kind == "approve") & F.coalesce(own, F.lit(False)), "own_rule")
               .when(kind.isin("approve", "reject", "snooze", "edit"), "applied")
               .otherwise("invalid"))
    done = F.coalesce(F.col("outcome") == "applied", F.lit(False))
    moved = (F.when(kind == "approve", "approved").when(kind == "reject", "retired")
             .when(kind == "snooze", "snoozed").otherwise("draft"))
    edited = done & F.col("_text").isNotNull()
    approver = F.col("approved_by") if "approved_by" in rules.columns else F.lit(None).cast("string")
    return (j.withColumn("outcome", outcome)
            .withColumn("status", F.when(done, moved).otherwise(F.col("status")))
            .withColumn("snooze_until", F.when(done & (kind == "snooze"), F.col("_until")).otherwise(F.col("snooze_until")))
            .withColumn("rule_expression", F.when(edited, F.col("_text")).otherwise(F.col("rule_expression")))
            .withColumn("approved_by", F.when(done & (kind == "approve"), F.col("decided_by")).otherwise(approver))
            .drop("_until", "_text", "decided_by", "is_admin", "decision"))


def acknowledge(results: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Mark results as expected failures; ``acknowledgements`` has
    (result_id, is_expected, reason, acknowledged_by)."""
    j = results.join(acknowledgements, "result_id", "left")
    return j.withColumn("is_expected_failure", F.coalesce("is_expected", "is_expected_failure")).drop("is_expected")


def expire_snoozes(rules: DataFrame, as_of: Column) -> DataFrame:
    """snoozed rules whose date has passed are drafts again."""
    due = (F.col("status") == "snoozed") & (F.col("snooze_until") <= as_of)
    return rules.withColumn("status", F.when(due, "draft").otherwise(F.col("status")))


def sibling_keys(stats: DataFrame, latest: DataFrame, max_tables: int | None = None) -> DataFrame:
    """Key-like columns with the uniqueness seen in each table's latest report.

    ``max_tables`` keeps the first tables by name, for callers with a size budget.
    """
    keyed = stats.filter(F.col("column_name").rlike(text.RELATION_KEY_LIKE))
    out = keyed.join(latest.select("report_id"), "report_id", "left_semi").filter(F.col("row_count") > 0).select(
        "table_fqn", "column_name", (F.col("distinct_count") / F.col("row_count") >= UNIQUE_RATIO).alias("is_unique"))
    if max_tables is not None:
        first = out.select("table_fqn").distinct().orderBy("table_fqn").limit(max_tables)
        out = out.join(first, "table_fqn", "left_semi")
    return out


def regenerate_drafts(rules: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Replace a table's undecided machine drafts by new suggestions.

    Rules a person has acted on keep their text: a suggestion of the same name
    may overwrite a draft but nothing else.
    """
    targets = suggestions.select("connection_id", "table_fqn").distinct().withColumn("_t", F.lit(True))
    stale = ((F.col("status") == "draft") & (F.col("created_by") == "AI_AGENT")
             & (F.col("generation_source") == "single_table") & F.col("_t").isNotNull())
    kept = (rules.join(targets, ["connection_id", "table_fqn"], "left")
            .filter(~F.coalesce(stale, F.lit(False))).drop("_t").select(*rules.columns))
    return merge_keyed(kept, suggestions, ["connection_id", "table_fqn", "rule_name"],
                       set_columns=["rule_expression", "rule_description", "generation_source"],
                       replace_when=F.col("o.status") == "draft")


def candidate_rules(stats: DataFrame, enum_limit: int | None = 10) -> DataFrame:
    """Rules a column profile suggests, grounded in its observed values.

    ``check_args`` lets a uniqueness rule run as key counts instead of its text.
    A closed list has at most ``enum_limit`` values, or any number for None, all
    of which the profile must hold.
    """
    col = F.concat(F.lit("`"), F.replace("column_name", F.lit("`"), F.lit("``")), F.lit("`"))
    shown = F.filter("top_values", lambda v: v.isNotNull())
    listed = F.array_join(F.transform(F.sort_array(shown), lambda v: F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'"))), ", ")
    in_list = F.concat(col, F.lit(" IN ("), listed, F.lit(")"))
    closed = (F.col("format_pattern").isin("STRING", "MIXED") & (F.col("distinct_count") > 0)
              & (F.lit(True) if enum_limit is None else F.col("distinct_count") <= enum_limit) & (F.col("distinct_count") == F.size(shown)))

    def rule(when: Column, kind: str, expr: Column, severity: str, args: Column = F.lit(None).cast("string")) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("rule_type"), expr.alias("rule_expression"), F.lit(severity).alias("severity"), args.alias("check_args")))

    found = F.filter(F.array(
        rule(F.col("null_pct") == 0, "NULL_CHECK", F.concat(col, F.lit(" IS NOT NULL")), "HIGH"),
        rule(F.col("min_num").isNotNull(), "RANGE", F.concat(
            col, F.lit(" BETWEEN "), F.col("min_num").cast("string"), F.lit(" AND "), F.col("max_num").cast("string")), "MEDIUM"),
        rule(closed, "ENUM", F.when(F.col("null_pct") > 0, F.concat(col, F.lit(" IS NULL OR "), in_list)).otherwise(in_list), "MEDIUM"),
        rule((F.col("cardinality_ratio") >= 0.9) & F.col("column_name").rlike(text.KEY_LIKE), "UNIQUE",
             F.concat(F.lit("COUNT(*) OVER (PARTITION BY "), col, F.lit(") = 1")), "CRITICAL",
             F.to_json(F.struct(F.array("column_name").alias("columns"))))), lambda r: r.isNotNull())
    return stats.select("column_name", F.inline(found)).withColumn(
        "rule_name", F.lower(F.concat_ws("_", "column_name", "rule_type")))
