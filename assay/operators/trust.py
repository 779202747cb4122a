"""Trust roll-ups for dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.exact import mean_of, percent, ratio, scaled
from assay.functions.severity import LAYERS, first_filled, layer_rank, layer_status, severity_rank
from assay.operators.anomaly import by_severity, type_intent, type_label
from assay.operators.history import latest_reports
from assay.operators.relational import anti_join, first_rows, latest_per_key
from assay.operators.rules import overall_score

LIVE = ("approved", "active")
FRESH_HOURS = 24
AGING_HOURS = 72

# List price in dollars per 1000 tokens (input, output) by model name part.
MODEL_PRICE_PER_1K = {
    "claude-sonnet-4-6": (0.003, 0.015),
    "claude-opus": (0.015, 0.075),
    "claude-haiku": (0.0008, 0.004),
    "gpt-4o": (0.0025, 0.01),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gemini-1.5-pro": (0.00125, 0.005),
    "gemini-2.0-flash": (0.0001, 0.0004),
    "gemini": (0.0001, 0.0004),
    "azure/gpt-4o": (0.0025, 0.01),
}
UNKNOWN_MODEL_PRICE = (0.003, 0.012)
LOCAL_MODEL_PREFIXES = ("openai/", "ollama/")


def layers_frame(spark) -> DataFrame:
    """The four layers as rows."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in LAYERS])).alias("layer"))


def latest_runs(results: DataFrame, keys: Sequence[str] = ("connection_id",)) -> DataFrame:
    """Newest run of each connection, or of each value of ``keys``.

    A connection has few runs with many results: these are hashed to one row a run before runs are compared, which sorts.
    """
    runs = results if "table_fqn" in keys else results.groupBy(*keys, "run_id").agg(F.max("run_timestamp").alias("run_timestamp"))
    return runs.groupBy(*keys).agg(F.max_by("run_id", F.struct("run_timestamp", "run_id")).alias("run_id"))


def in_latest_run(results: DataFrame, keys: Sequence[str] = ("connection_id",)) -> DataFrame:
    """Results of the newest run of each connection, or of each value of ``keys``."""
    return results.join(latest_runs(results, keys), [*keys, "run_id"], "left_semi")


def layer_averages(reports: DataFrame) -> DataFrame:
    """Mean of the latest scores of each connection's and layer's tables."""
    return latest_reports(reports).groupBy("connection_id", F.coalesce("layer", F.lit("UNKNOWN")).alias("layer")).agg(
        mean_of(F.col("quality_score"), 1, 4).alias("score"), F.count(F.lit(1)).alias("profiled_tables"))


def issues_by_severity(results: DataFrame) -> DataFrame:
    """Failures of each connection's newest run by severity."""
    return in_latest_run(results).filter("status = 'FAIL'").groupBy("connection_id", "severity").agg(F.count(F.lit(1)).alias("issues"))


def latest_run_health(results: DataFrame) -> DataFrame:
    """Score and error count of each connection's newest run."""
    return in_latest_run(results).groupBy("connection_id", "run_id").agg(
        F.count_if(F.col("status") == "ERROR").alias("errors"), F.max("run_timestamp").alias("run_timestamp"),
        overall_score().alias("overall_quality_score"))


def run_counts(results: DataFrame) -> DataFrame:
    """T4: number of runs of each connection; failures and rules per layer in the newest one."""
    runs = results.groupBy("connection_id").agg(F.count_distinct("run_id").alias("execution_runs"))
    return in_latest_run(results).filter(F.col("layer").isNotNull()).groupBy("connection_id", "layer").agg(
        F.count_if(F.col("status") == "FAIL").alias("open_issues"), F.count(F.lit(1)).alias("rule_count")).join(runs, "connection_id")


def layer_trend(reports: DataFrame) -> DataFrame:
    """T5: mean change of the latest score against the one before, per connection and layer."""
    keys = ["connection_id", "table_fqn"]
    two = latest_per_key(reports, keys, [F.desc("run_at"), F.desc("report_id")], 2, rank="rn")
    cur, prev = F.col("rn") == 1, F.col("rn") == 2
    per_table = two.groupBy(*keys).agg(
        F.max(F.when(cur, F.coalesce("layer", F.lit("UNKNOWN")))).alias("layer"),
        F.max(F.when(cur, scaled(F.coalesce("quality_score", F.lit(0.0)), 1))).alias("cur"),
        F.max(F.when(prev, scaled(F.coalesce("quality_score", F.lit(0.0)), 1))).alias("prev"))
    return per_table.filter(F.col("prev").isNotNull()).groupBy("connection_id", "layer").agg(
        ratio(F.sum(F.col("cur") - F.col("prev")), F.count(F.lit(1)) * 10, 1).alias("trend_delta"))


def connections_of(*frames: DataFrame) -> DataFrame:
    """Every connection that one of the frames mentions."""
    out = frames[0].select("connection_id")
    for f in frames[1:]:
        out = out.unionByName(f.select("connection_id"))
    return out.distinct()


def anomaly_breakdown(anomalies: DataFrame) -> DataFrame:
    """Open anomalies of each connection by type, with label and intent."""
    return (anomalies.filter("status = 'open'").groupBy("connection_id", "anomaly_type").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("label", type_label(F.col("anomaly_type"))).withColumn("intent", type_intent(F.col("anomaly_type")))
            .orderBy("connection_id", F.desc("n"), "anomaly_type"))


def anomalies_by_layer(anomalies: DataFrame) -> DataFrame:
    """Open anomalies of each connection by layer."""
    return anomalies.filter("status = 'open' AND layer IS NOT NULL").groupBy("connection_id", "layer").agg(F.count(F.lit(1)).alias("n"))


def cde_health(registry: DataFrame) -> DataFrame:
    """Share of healthy critical data elements, 100 when there are none."""
    return registry.agg(cde_share().alias("cde_health_pct"))


def cde_share() -> Column:
    total = F.count(F.lit(1))
    return F.when(total == 0, 100.0).otherwise(percent(F.count_if(F.col("health").isin("PASS", "HEALTHY")), total, 1))


def score_delta(history: DataFrame) -> DataFrame:
    """Newest daily score against the day before, one row per connection."""
    two = latest_per_key(history, ["connection_id"], [F.desc("score_date")], 2, rank="rn")
    one = two.groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.max(F.when(F.col("rn") == 1, F.col("overall_score"))).alias("now"),
        F.max(F.when(F.col("rn") == 2, F.col("overall_score"))).alias("before"))
    known = F.when(F.col("days") >= 2, F.col("before")).otherwise(F.col("now"))
    delta = ratio(scaled(F.col("now"), 1) - scaled(F.col("before"), 1), F.lit(10), 1)
    return one.select("connection_id", F.round(known, 1).alias("yesterday_score"),
                      F.when(F.col("days") >= 2, delta).otherwise(0.0).alias("score_delta"))


def layer_health(reports: DataFrame, results: DataFrame) -> DataFrame:
    """One row per connection and layer: score, status, open issues, rules and trend."""
    keys = ["connection_id", "layer"]
    every = connections_of(reports, results).select("connection_id", F.explode(F.array(*[F.lit(x) for x in LAYERS])).alias("layer"))
    return (every.join(layer_averages(reports), keys, "left").join(run_counts(results), keys, "left").join(layer_trend(reports), keys, "left")
            .withColumn("score", F.coalesce("score", F.lit(0.0)))
            .select(*keys, F.round("score", 1).alias("score"), layer_status(F.col("score")).alias("status"),
                    F.coalesce("open_issues", F.lit(0)).alias("open_issues"),
                    F.coalesce("rule_count", F.lit(0)).alias("rule_count"), "trend_delta"))


def trust_summary(reports: DataFrame, results: DataFrame, anomalies: DataFrame, registry: DataFrame) -> DataFrame:
    """The headline row of each connection; the newest run's score wins over profiling scores.

    The registry of critical data elements is shared unless it names connections.
    """
    key = "connection_id"
    failed = lambda sev: F.count_if((F.col("status") == "FAIL") & (F.col("severity") == sev))
    head = in_latest_run(results).groupBy(key).agg(
        overall_score().alias("_run_score"), F.max("run_timestamp").alias("_run_at"),
        failed("CRITICAL").alias("open_critical"), failed("HIGH").alias("open_high"), failed("MEDIUM").alias("open_medium"),
        F.count_if(F.col("status") == "ERROR").alias("open_errors"))
    profiled = layer_averages(reports).groupBy(key).agg(F.round(F.avg("score"), 1).alias("_profiled"), F.sum("profiled_tables").alias("profiled_table_count"))
    last = reports.groupBy(key).agg(F.max("run_at").alias("_profiled_at"))
    open_ = anomalies.filter("status = 'open'").groupBy(key).agg(F.count(F.lit(1)).alias("active_anomalies"))
    out = connections_of(reports, results, anomalies)
    for part in (head, profiled, last, open_):
        out = out.join(part, key, "left")
    if key in registry.columns:
        out = out.join(registry.groupBy(key).agg(cde_share().alias("cde_health_pct")), key, "left").fillna(100.0, ["cde_health_pct"])
    else:
        out = out.withColumn("cde_health_pct", cde_health(registry).scalar())
    out = out.fillna(0, ["open_critical", "open_high", "open_medium", "open_errors", "profiled_table_count", "active_anomalies"])
    return (out.withColumn("overall_score", F.coalesce("_run_score", "_profiled", F.lit(0.0)))
            .withColumn("last_run_at", F.greatest("_profiled_at", "_run_at"))
            .withColumn("pipeline_status", F.when((F.col("open_critical") > 0) | (F.col("open_errors") > 0), "ISSUES")
                        .when(F.col("open_high") > 0, "RECOVERING").otherwise("HEALTHY"))
            .drop("_run_score", "_run_at", "_profiled", "_profiled_at"))


def trust_snapshot(reports: DataFrame, results: DataFrame) -> DataFrame:
    """One row per connection and day: overall and layer scores.

    Overall is the severity-weighted score of the day's newest run; a layer is
    the mean of the reports made that day.
    """
    day = results.withColumn("score_date", F.to_date("run_timestamp"))
    newest = day.groupBy("connection_id", "score_date").agg(F.max_by("run_id", F.struct("run_timestamp", "run_id")).alias("run_id"))
    keys = ["connection_id", "score_date"]
    run = day.join(newest, [*keys, "run_id"], "left_semi")
    overall = run.groupBy(*keys).agg(
        overall_score().alias("overall_score"), F.count(F.lit(1)).alias("rules_total"),
        F.count_if(F.col("status") == "PASS").alias("rules_passed"), F.count_if(F.col("status") == "FAIL").alias("rules_failed"))
    per_layer = reports.groupBy("connection_id", F.to_date("run_at").alias("score_date")).agg(*[
        F.when(F.count_if(F.col("layer") == x) > 0, ratio(
            F.sum(F.when(F.col("layer") == x, scaled(F.col("quality_score"), 1))),
            F.count_if(F.col("layer") == x) * 10, 1)).alias(f"{x.lower()}_score") for x in LAYERS])
    return overall.join(per_layer, keys, "left")


def overdue_tasks(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Unfinished tasks past their date."""
    today = as_of.cast("date")
    return (tasks.filter(F.col("status").isin("open", "in_progress") & (F.col("due_date") < today))
            .withColumn("days_overdue", F.date_diff(today, F.col("due_date"))))


def task_list(tasks: DataFrame) -> DataFrame:
    """Tasks by priority, then newest."""
    return tasks.orderBy(severity_rank(F.col("priority")), F.desc("created_at"), "task_id")


ATTENTION = {"anomaly": 10, "rule": 8, "task": 5}


def attention_queue(anomalies: DataFrame, results: DataFrame, rules: DataFrame, tasks: DataFrame, as_of: Column,
                    size: int | None = 10, per_kind: dict[str, int | None] = ATTENTION) -> DataFrame:
    """What needs a person first, per connection.

    ``size`` and ``per_kind`` limit what is shown; None shows all.  Tasks
    without a connection are nobody's in particular and form a queue of their own.
    """
    key, stamp = F.col("connection_id"), "yyyy-MM-dd HH:mm:ss"
    kind = lambda name: F.lit(name).alias("kind")
    first = lambda df, name, order: latest_per_key(df, ["connection_id"], order, per_kind.get(name))
    a = first(anomalies.filter("status = 'open'"), "anomaly", by_severity(anomalies)).select(
        key, kind("anomaly"), F.col("anomaly_id").alias("entity_id"), F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.coalesce("description", F.lit("Anomaly")).alias("title"),
        F.concat_ws(" / ", F.coalesce("anomaly_type", F.lit("anomaly")), F.coalesce("table_fqn", F.lit("unknown table"))).alias("detail"),
        F.date_format("detected_at", stamp).alias("ts"))
    named = with_rule_names(in_latest_run(results), rules, "unnamed rule")
    failing = named.filter((F.col("status") == "FAIL") & ~F.coalesce("is_expected_failure", F.lit(False)))
    r = first(failing, "rule", [severity_rank(F.col("severity")), F.desc("fail_pct"), F.asc("rule_id")]).select(
        key, kind("rule"), F.col("rule_id").alias("entity_id"), F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.concat(F.lit("Rule failing: "), "shown_name").alias("title"),
        F.concat("table_fqn", F.lit(": "), F.format_number("failed_records", 0), F.lit(" rows failing in the latest run")).alias("detail"),
        F.date_format("run_timestamp", stamp).alias("ts"))
    owned = tasks if "connection_id" in tasks.columns else tasks.withColumn("connection_id", F.lit(None).cast("string"))
    t = first(overdue_tasks(owned, as_of), "task", [F.asc("due_date"), F.asc("task_id")]).select(
        key, kind("task"), F.col("task_id").cast("string").alias("entity_id"), F.coalesce("priority", F.lit("MEDIUM")).alias("severity"),
        F.concat(F.lit("Overdue task: "), "title").alias("title"),
        F.concat(F.lit("due "), F.date_format("due_date", "yyyy-MM-dd"), F.lit(" ("), F.col("days_overdue").cast("string"),
                 F.when(F.col("days_overdue") == 1, " day ago), owner ").otherwise(" days ago), owner "),
                 F.coalesce("owner", F.lit("unassigned"))).alias("detail"),
        F.lit(None).cast("string").alias("ts"))
    order = [severity_rank(F.col("severity"), 9), F.col("ts").isNull(), F.asc("ts"), F.asc("kind"), F.asc("entity_id")]
    return latest_per_key(a.unionByName(r).unionByName(t), ["connection_id"], order, size, rank="place")


def with_rule_names(results: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Result rows with the first filled rule name and the rule's column."""
    names = rules.select("rule_id", F.col("rule_name").alias("_rule_name"), F.col("column_name").alias("rule_column"))
    return results.join(names, "rule_id", "left").withColumn(
        "shown_name", first_filled(F.col("rule_name"), F.col("_rule_name"), default=default)).drop("_rule_name")


def new_anomalies(anomalies: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Anomalies of the last day, of every connection that ever had one."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    return anomalies.groupBy("connection_id").agg(F.count_if((F.col("detected_at") > since) & (F.col("detected_at") <= as_of)).alias("new_anomalies"))


def newly_failing(results: DataFrame) -> DataFrame:
    """Rules that fail in their connection's newest run and did not in the run before; none after a first run."""
    key = ["connection_id"]
    runs = results.groupBy(*key, "run_id").agg(F.max("run_timestamp").alias("ts"))
    two = latest_per_key(runs, key, [F.desc("ts"), F.desc("run_id")], 2, rank="rn").drop("ts")
    at = lambda n: two.filter(F.col("rn") == n).drop("rn")
    failing = results.filter("status = 'FAIL'")
    now = failing.join(at(1), [*key, "run_id"], "left_semi").join(at(2).select(*key), key, "left_semi").select(*key, "rule_id", "table_fqn").distinct()
    return anti_join(now, failing.join(at(2), [*key, "run_id"], "left_semi"), [*key, "rule_id"])


def layer_freshness(reports: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Hours since each of a connection's layers was last profiled or checked; every connection has the four layers."""
    key = ["connection_id", "layer"]
    touched = reports.groupBy(*key).agg(F.max("run_at").alias("ts")).unionByName(
        results.groupBy(*key).agg(F.max("run_timestamp").alias("ts")))
    last = touched.groupBy(*key).agg(F.max("ts").alias("last_checked"))
    every = last.select("connection_id").distinct().select("connection_id", F.explode(F.array(*[F.lit(x) for x in LAYERS])).alias("layer"))
    age = F.round((F.unix_timestamp(as_of) - F.unix_timestamp("last_checked")) / 3600.0, 1)
    return (every.join(last, key, "left").withColumn("age_hours", age)
            .withColumn("state", F.when(F.col("last_checked").isNull(), "never").when(F.col("age_hours") <= FRESH_HOURS, "fresh")
                        .when(F.col("age_hours") <= AGING_HOURS, "aging").otherwise("stale")))


def last_days(df: DataFrame, date_col: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days, oldest first."""
    return df.filter(F.col(date_col) >= F.date_sub(as_of.cast("date"), days)).orderBy(date_col)


def rule_failures_per_day(results: DataFrame) -> DataFrame:
    """Failures per connection and day."""
    return results.groupBy("connection_id", F.to_date("run_timestamp").alias("fail_date")).agg(
        F.count_if(F.col("status") == "FAIL").alias("fail_count"))


def cde_status(dictionary: DataFrame, column_stats: DataFrame, rules: DataFrame, by_table: bool = False) -> DataFrame:
    """NULL rate, live rules and health of critical data elements.

    Statistics and rules are matched on connection and column name; ``by_table``
    matches the table too.
    """
    keys = ["connection_id", *(["table_fqn"] if by_table else []), "column_name"]
    nulls = column_stats.groupBy(*keys).agg(mean_of(F.col("null_pct"), 2, 4).alias("last_null_pct"))
    covered = rules.filter(F.col("status").isin(*LIVE)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rule_coverage"))
    out = dictionary.filter("is_cde").join(nulls, keys, "left").join(covered, keys, "left").fillna(0, ["last_null_pct", "rule_coverage"])
    health = F.when(F.col("last_null_pct") < 1, "HEALTHY").when(F.col("last_null_pct") < 5, "WARN").otherwise("CRIT")
    return out.withColumn("health", health).orderBy(F.desc_nulls_last("cde_score"), "column_id")


def audit_list(audit: DataFrame, limit: int | None = 20) -> DataFrame:
    """Newest audit entries with a composed entity label; ``limit`` None lists all."""
    label = F.concat_ws(" · ", "entity_type", F.coalesce("entity_name", "entity_id"))
    return first_rows(audit.orderBy(F.desc("event_timestamp"), F.desc("audit_id")), limit).select(
        "audit_id", F.date_format("event_timestamp", "HH:mm").alias("time"), F.date_format("event_timestamp", "yyyy-MM-dd").alias("date"),
        F.coalesce("user_name", F.lit("System")).alias("user"), F.coalesce("event_type", F.lit("—")).alias("action"),
        F.when(F.col("entity_type").isNull(), "—").otherwise(label).alias("entity"))


def _token_price(model: Column, side: int) -> Column:
    """Price of a token in units of 1e-8 dollars; the longest matching name wins."""
    unit = lambda dollars_per_1k: round(dollars_per_1k * 1e5)
    expr = F.when(model.isNull(), F.lit(None).cast("bigint"))
    for prefix in LOCAL_MODEL_PREFIXES:
        expr = expr.when(F.startswith(model, F.lit(prefix)), F.lit(0))
    for key in sorted(MODEL_PRICE_PER_1K, key=len, reverse=True):
        expr = expr.when(F.contains(model, F.lit(key)), F.lit(unit(MODEL_PRICE_PER_1K[key][side])))
    return expr.otherwise(F.lit(unit(UNKNOWN_MODEL_PRICE[side])))


def ai_usage(rule_calls: DataFrame, usage_log: DataFrame) -> DataFrame:
    """Calls, tokens, latency and estimated cost per feature over both logs."""
    columns = ["feature", "model", "status", "input_tokens", "output_tokens", "latency_ms"]
    calls = rule_calls.withColumnRenamed("call_type", "feature").select(*columns).unionByName(usage_log.select(*columns))
    g = calls.groupBy("feature", "model", "status").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("lat"), F.count("latency_ms").alias("timed"))
    units = F.col("input_tokens") * _token_price(F.col("model"), 0) + F.col("output_tokens") * _token_price(F.col("model"), 1)
    g = (g.withColumn("cost4", scaled(ratio(units, F.lit(100_000_000), 4), 4))
         .withColumn("weighted", F.when(F.col("timed") == F.col("calls"), F.col("lat").cast("double"))
                     .otherwise(F.col("lat") * F.col("calls") / F.greatest("timed", F.lit(1)))))
    kind = F.when(F.col("status").isin("fallback", "error"), F.col("status")).otherwise("ai")
    per = lambda name: F.coalesce(F.sum(F.when(kind == name, F.col("calls"))), F.lit(0))
    return g.groupBy("feature").agg(
        F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("weighted") / F.sum("calls"), 0).alias("avg_latency_ms"),
        per("ai").alias("ai_calls"), per("fallback").alias("fallback_calls"), per("error").alias("error_calls"),
        (F.coalesce(F.sum("cost4"), F.lit(0)) / F.lit(10000.0)).alias("estimated_cost_usd"),
        F.bool_and(F.col("model").isNotNull()).alias("cost_known")).orderBy(F.desc("calls"), "feature")


def ai_usage_totals(per_feature: DataFrame) -> DataFrame:
    """Totals and rates over all features."""
    calls = F.sum("calls")
    return per_feature.agg(
        calls.alias("total_calls"), F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"),
        percent(F.sum("ai_calls"), calls, 1).alias("ai_success_rate"), percent(F.sum("fallback_calls"), calls, 1).alias("fallback_rate"),
        percent(F.sum("error_calls"), calls, 1).alias("error_rate"),
        ratio(F.sum(scaled(F.col("estimated_cost_usd"), 4)), F.lit(10000), 2).alias("estimated_cost_usd"),
        F.bool_and("cost_known").alias("cost_fully_known"))


def layer_coverage(dictionary: DataFrame, rules: DataFrame) -> DataFrame:
    """Share of described columns and of columns with a live rule, per connection and layer."""
    layer = F.upper(F.coalesce("layer", F.lit("UNKNOWN"))).alias("layer")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    d = dictionary.groupBy("connection_id", layer).agg(F.count(F.lit(1)).alias("total"),
                                                       F.count_if(filled("business_name") | filled("description")).alias("described"))
    r = rules.filter(F.col("status").isin(*LIVE) & filled("column_name")).groupBy("connection_id", layer).agg(
        F.count_distinct("column_name").alias("rule_columns"))
    j = d.join(r, ["connection_id", "layer"], "left").withColumn("rule_columns", F.coalesce("rule_columns", F.lit(0)))
    return j.select("connection_id", "layer", percent(F.col("described"), F.col("total"), 0).alias("dict_pct"),
                    percent(F.least("rule_columns", "total"), F.col("total"), 0).alias("rule_pct")).orderBy("connection_id", layer_rank(F.col("layer")), "layer")


def top_anomalies(anomalies: DataFrame, n: int | None = 3) -> DataFrame:
    """The most severe open anomalies of each connection, newest first."""
    return latest_per_key(anomalies.filter("status = 'open'"), ["connection_id"], by_severity(anomalies), n, rank="place")
