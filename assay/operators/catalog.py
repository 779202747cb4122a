"""Data dictionary, critical data elements and table matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.exact import percent
from assay.functions.text import table_tokens
from assay.operators.relational import anti_join, latest_per_key, merge_keyed

_COLUMN = ["connection_id", "table_fqn", "column_name"]
# Keywords that more lists have are compared by kind of list.
COMMON_TABLES = 1000
EXACT_MATCH = 100.0


def enrich_dictionary(dictionary: DataFrame, enriched: DataFrame) -> DataFrame:
    """Describe columns anew; review status and approvals of known columns stay."""
    return merge_keyed(dictionary, enriched, ["column_id"], set_columns=[
        "business_name", "description", "cde_score", "is_cde", "sensitivity_tag"])


def not_enriched(profiled_columns: DataFrame, enriched: DataFrame) -> DataFrame:
    """Profiled columns the update leaves out."""
    return anti_join(profiled_columns, enriched, ["column_id"])


def decide_columns(dictionary: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """Approve or reject columns; ``decisions`` has (column_id, decision, decided_by)."""
    j = dictionary.join(decisions.select("column_id", "decision", "decided_by"), "column_id", "left")
    yes = F.col("decision") == "approve"
    approved_by = F.col("approved_by") if "approved_by" in dictionary.columns else F.lit(None).cast("string")
    approved_at = F.col("approved_at") if "approved_at" in dictionary.columns else F.lit(None).cast("timestamp")
    return (j.withColumn("status", F.when(yes, "approved").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status")))
            .withColumn("approved_by", F.when(yes, F.col("decided_by")).otherwise(approved_by))
            .withColumn("approved_at", F.when(yes, as_of).otherwise(approved_at)).drop("decision", "decided_by"))


def decide_cdes(dictionary: DataFrame, registry: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Promote or demote critical data elements.

    ``actions`` has (column_id, action, decided_by).  Returns the dictionary
    with its flags and the registry with promoted columns added or refreshed
    and demoted ones removed.
    """
    j = dictionary.join(actions.select("column_id", "action", "decided_by"), "column_id", "left")
    act = F.col("action")
    flagged = j.withColumn("is_cde", F.when(act == "promote", True).when(act == "demote", False).otherwise(F.col("is_cde")))
    promoted = j.filter(act == "promote").select(
        *_COLUMN, F.coalesce("cde_score", F.lit(0.0)).alias("cde_score"), F.lit("PASS").alias("health"),
        F.col("decided_by").alias("promoted_by"), F.lit(0).alias("rule_count"))
    kept = anti_join(registry, j.filter(act == "demote"), _COLUMN)
    return (flagged.drop("action", "decided_by"),
            merge_keyed(kept, promoted, _COLUMN, set_columns=["health", "promoted_by", "cde_score"]))


def cde_view(dictionary: DataFrame, registry: DataFrame) -> DataFrame:
    """D3: critical data elements with their registry entry, best score first."""
    reg = registry.select(*_COLUMN, "health", "promoted_by", "rule_count")
    approver = F.col("approved_by") if "approved_by" in dictionary.columns else F.lit(None).cast("string")
    return (dictionary.filter("is_cde").join(reg, _COLUMN, "left")
            .withColumn("health", F.coalesce("health", F.lit("PASS")))
            .withColumn("promoted_by", F.coalesce("promoted_by", approver, F.lit("")))
            .withColumn("rule_count", F.coalesce("rule_count", F.lit(0)))
            .orderBy(F.desc_nulls_last("cde_score"), "column_id"))


def coverage_rollup(dictionary: DataFrame) -> DataFrame:
    """Columns, described and approved columns by table, with layer and overall totals."""
    described = F.coalesce("description", F.lit("")) != ""
    return dictionary.rollup("layer", "table_fqn").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(described).alias("enriched"),
        F.count_if(F.col("status") == "approved").alias("approved"), F.grouping_id().alias("level"))


def backfill_provenance(rules: DataFrame) -> DataFrame:
    """How a rule came to be, from its description and author; known values stay."""
    d = F.coalesce("rule_description", F.lit(""))
    tagged = F.contains(d, F.lit("[Cross-table:"))
    machine = F.col("created_by") == "AI_AGENT"
    low = F.lower(d)
    self_ref = F.contains(low, F.lit("self-referenc")) | F.contains(low, F.lit("same table")) | low.rlike(r"same br.")
    kind = (F.when(tagged, "cross_table").when(machine & (F.col("rule_type") == "FK") & self_ref, "cross_table")
            .when(F.col("nl_source").isNotNull(), "nl").when(machine, "single_table").otherwise("manual"))
    related = F.nullif(F.trim(F.regexp_extract(d, r"\[Cross-table:\s*([^\]]+)\]", 1)), F.lit(""))
    unknown = F.col("generation_source").isNull()
    return rules.withColumn("related_table_fqn", F.when(unknown & tagged, related).otherwise(F.col("related_table_fqn"))).withColumn(
        "generation_source", F.when(unknown, kind).otherwise(F.col("generation_source")))


def match_tables(searches: DataFrame, tables: DataFrame, common: int = COMMON_TABLES) -> DataFrame:
    """Best catalog table per search term; terms without a shared keyword get none.

    ``searches`` has (search), ``tables`` (table_fqn).  Equal keyword lists
    score 100; otherwise shared keywords over the table's keywords.  Names are
    reduced to distinct keyword lists before they meet, and exact matches are
    found by an equi join on the list.  Other terms meet tables over keywords
    that at most ``common`` lists have.  What is left are pairs that share more
    common keywords only: for these, lists with the same common keywords and
    length score alike, so that one of each stands for all.
    """
    s = searches.select("search").distinct().withColumn("s_tokens", table_tokens(F.col("search")))
    t = (tables.select("table_fqn").distinct().withColumn("t_tokens", table_tokens(F.col("table_fqn")))
         .filter(F.size("t_tokens") > 0).groupBy("t_tokens").agg(F.min("table_fqn").alias("table_fqn")))
    lists = s.filter(F.size("s_tokens") > 0).select("s_tokens").distinct()
    exact = lists.join(t, F.col("s_tokens") == F.col("t_tokens")).select("s_tokens", "table_fqn", F.lit(EXACT_MATCH).alias("score"))
    words = lists.join(exact.select("s_tokens"), "s_tokens", "left_anti").select("s_tokens", F.explode(F.array_distinct("s_tokens")).alias("word"))
    names = t.select("table_fqn", "t_tokens", F.explode(F.array_distinct("t_tokens")).alias("word"))
    frequent = names.groupBy("word").count().filter(F.col("count") > common).select("word")
    rare = words.join(frequent, "word", "left_anti").join(names.join(frequent, "word", "left_anti"), "word")
    found = rare.select("s_tokens", "table_fqn", (F.size(F.array_intersect("s_tokens", "t_tokens")) / F.size("t_tokens")).alias("score"))
    kinds = (names.join(frequent, "word").groupBy("table_fqn", F.size("t_tokens").alias("words")).agg(F.sort_array(F.collect_list("word")).alias("shared"))
             .groupBy("shared", "words").agg(F.min("table_fqn").alias("table_fqn")))
    alike = (words.join(frequent, "word").join(kinds.withColumn("word", F.explode("shared")), "word").groupBy("s_tokens", "table_fqn", "words")
             .agg(F.count(F.lit(1)).alias("n")).select("s_tokens", "table_fqn", (F.col("n") / F.col("words")).alias("score")))
    best = latest_per_key(found.unionByName(alike), ["s_tokens"], [F.desc("score"), F.asc("table_fqn")])
    return s.join(exact.unionByName(best), "s_tokens").select("search", "table_fqn", F.round("score", 4).alias("score"))


def known_anywhere(catalog: DataFrame, dictionary: DataFrame, rules: DataFrame) -> DataFrame:
    """Tables of the catalog, and tables only the dictionary or the rules know.

    The latter are grouped under OTHER or their rule's layer.
    """
    c = catalog.select("table_fqn", F.upper("layer").alias("c_layer")).dropDuplicates(["table_fqn"])
    d = dictionary.select("table_fqn").filter(F.col("table_fqn").isNotNull()).distinct().withColumn("in_dictionary", F.lit(True))
    r = rules.filter(F.col("table_fqn").isNotNull()).groupBy("table_fqn").agg(F.min(F.coalesce("layer", F.lit("UNKNOWN"))).alias("r_layer"))
    j = c.join(d, "table_fqn", "full_outer").join(r, "table_fqn", "full_outer")
    return j.select("table_fqn", F.coalesce("c_layer", F.when(F.col("in_dictionary"), F.lit("OTHER")), "r_layer").alias("layer"),
                    F.col("c_layer").isNotNull().alias("in_catalog"), F.coalesce("in_dictionary", F.lit(False)).alias("in_dictionary"),
                    F.col("r_layer").isNotNull().alias("has_rules"))


def layer_totals(coverage: DataFrame) -> DataFrame:
    """Described share per layer, from the roll-up's layer rows."""
    return coverage.filter("level = 1").select("layer", "total", "enriched", percent(F.col("enriched"), F.col("total"), 1).alias("enriched_pct"))
