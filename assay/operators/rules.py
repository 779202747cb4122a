"""Rule execution.

A rule is a Spark SQL expression that is TRUE for a passing row; NULL fails.
The table is known as ``t`` inside the expression, so subqueries can correlate.

``run_rules`` evaluates all row-level rules of a table in one scan.  Rules with
windows or subqueries need their own plan; which ones those are is decided by
letting Spark analyse them, not by reading their text.

The typed checks further down (unique, foreign key, ...) count keys first and
look at the counts, where the SQL shape would sort every row of a hot key in a
single window task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.errors import (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException,
                            NumberFormatException, ParseException, SparkRuntimeException)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.exact import percent, ratio, scaled
from assay.functions.severity import UNKNOWN_LAYER, layer_rank, lookup, severity_rank
from assay.functions.text import json_safe
from assay.operators.relational import key_counts, latest_per_key, unmatched_counts

ALIAS = "t"
SAMPLE_ROWS = 20
# Row-level rules counted by one scan; more of them would outgrow generated code.
RULES_PER_SCAN = 200

# What a rule's own text or data can cause; anything else, such as a lost executor, fails the run.
RULE_ERRORS = (AnalysisException, ParseException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException,
               NumberFormatException, SparkRuntimeException)

# Weight of a result in the overall score by severity, doubled so that weighted sums stay whole numbers.
_DOUBLE_WEIGHT = {"CRITICAL": 6, "HIGH": 4, "MEDIUM": 2, "LOW": 1}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    table_fqn: str
    rule_expression: str
    rule_name: str = ""
    layer: str = UNKNOWN_LAYER
    severity: str = "MEDIUM"
    is_cde_rule: bool = False
    status: str = "approved"
    # A kind of ``TYPED`` and its arguments as JSON, run instead of the text.
    rule_type: str | None = None
    check_args: str | None = None
    # Any other check, e.g. ``lambda df, tables: unique(df, ["id"])``.
    check: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] | None = field(default=None, compare=False)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# --- expressions of the row-level shapes ------------------------------------

def not_null(column: str) -> str:
    """R20."""
    return f"{quote(column)} IS NOT NULL"


def in_range(column: str, lo, hi) -> str:
    """Inside observed bounds."""
    return f"{quote(column)} BETWEEN {lo} AND {hi}"


def one_of(column: str, values: Sequence[str], null_passes: bool = False) -> str:
    """Closed list of values."""
    listed = ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    test = f"{quote(column)} IN ({listed})"
    return f"{quote(column)} IS NULL OR {test}" if null_passes else test


def matches(column: str, pattern: str) -> str:
    """Regular expression."""
    return f"{quote(column)} RLIKE r'{pattern}'"


def unique_text(columns: Sequence[str]) -> str:
    """R23 as rule text; :func:`unique` is the plan to prefer on large tables."""
    return f"COUNT(*) OVER (PARTITION BY {', '.join(quote(c) for c in columns)}) = 1"


# --- running rule text -------------------------------------------------------

def pass_flag(expression: str) -> Column:
    return F.expr(f"CASE WHEN ({expression}\n) THEN 1 ELSE 0 END")  # a comment may end the expression


# What a rule's text may hold besides code: strings, quoted names and comments.
_NO_CODE = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/"""
_NAME = r"(?:\w+\s*\.\s*)?(?:\w+|`(?:[^`]|``)+`)"
_COUNT_OVER = re.compile(rf"(?P<skip>{_NO_CODE})|COUNT\s*\(\s*(?:\*|1)\s*\)\s*OVER\s*\(\s*PARTITION\s+BY\s+(?P<keys>{_NAME}(?:\s*,\s*{_NAME})*)\s*\)", re.IGNORECASE | re.DOTALL)
_ROWS = "__assay_rows"


def key_counted(df: DataFrame, expression: str) -> tuple[DataFrame, str] | None:
    """Rule text whose only windows count the rows of a key, over counted groups in place of rows.

    Rows are first counted by the columns that the text mentions, combined on the
    map side, so a hot key costs one row per map task and distinct group.  Counts
    of the keys are summed from these and joined to the groups if the text
    mentions other columns as well.  ``__assay_rows`` says how many rows a group
    stands for.  None for other texts.
    """
    windows: list[tuple[str, ...]] = []

    def named(m: re.Match) -> str:
        if m["skip"] is not None:
            return m[0]
        keys = tuple(re.sub(r"^\w+\s*\.\s*", "", k).strip().strip("`").replace("``", "`").lower() for k in re.findall(_NAME, m["keys"]))
        if keys not in windows:
            windows.append(keys)
        return f"__assay_count_{windows.index(keys)}"

    text = _COUNT_OVER.sub(named, expression)
    columns = {c.lower(): c for c in df.columns}
    if not windows or re.search(r"\bOVER\b|\bSELECT\b", re.sub(_NO_CODE, "''", text), re.IGNORECASE | re.DOTALL) or any(k not in columns for keys in windows for k in keys):
        return None
    words = set(re.findall(r"\w+", expression.lower()))
    used = [c for low, c in columns.items() if low in words or not re.fullmatch(r"\w+", low) or any(low in keys for keys in windows)]
    groups = df.groupBy(*[quote(c) for c in used]).agg(F.count(F.lit(1)).alias(_ROWS))
    for i, keys in enumerate(windows):
        names = [columns[k] for k in dict.fromkeys(keys)]
        if set(names) == set(used):
            groups = groups.withColumn(f"__assay_count_{i}", F.col(_ROWS))
            continue
        totals = groups.groupBy(*[F.col(quote(n)).alias(f"__assay_key_{i}_{j}") for j, n in enumerate(names)]).agg(F.sum(_ROWS).alias(f"__assay_count_{i}"))
        same = [F.col(quote(n)).eqNullSafe(F.col(f"__assay_key_{i}_{j}")) for j, n in enumerate(names)]
        groups = groups.join(totals, same).drop(*[f"__assay_key_{i}_{j}" for j in range(len(names))])
    return groups, text


def check_rule(df: DataFrame, expression: str) -> DataFrame:
    """Rows and failing rows of one rule, in one job."""
    counted = key_counted(df, expression)
    if counted is not None:
        groups, text = counted
        rows, passed = F.col(_ROWS), F.col("passed")
        return groups.alias(ALIAS).select(_ROWS, pass_flag(text).alias("passed")).agg(
            F.coalesce(F.sum(rows), F.lit(0)).alias("total_records"), F.coalesce(F.sum(rows * (1 - passed)), F.lit(0)).alias("failed_records"))
    flags = df.alias(ALIAS).select(pass_flag(expression).alias("passed"))
    return flags.agg(F.count(F.lit(1)).alias("total_records"),
                     F.coalesce(F.sum(1 - F.col("passed")), F.lit(0)).alias("failed_records"))


def check_rules(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """R2: any number of row-level rules in a single scan."""
    return _many(df, [(k, pass_flag(e) == 0) for k, e in expressions.items()])


def _many(df: DataFrame, failing: list[tuple[str, Column]]) -> DataFrame:
    counts = [F.count_if(cond).alias(f"f{i}") for i, (_, cond) in enumerate(failing)]
    one = df.alias(ALIAS).agg(F.count(F.lit(1)).alias("total_records"), *counts)
    cells = [F.struct(F.lit(k).alias("rule_id"), F.col("total_records"), F.col(f"f{i}").alias("failed_records"))
             for i, (k, _) in enumerate(failing)]
    return one.select(F.inline(F.array(*cells)))


def failed_rows(df: DataFrame, expression: str, n: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded sample of failing rows."""
    marked = df.alias(ALIAS).select("*", pass_flag(expression).alias("__passed"))
    return marked.filter(F.col("__passed") == 0).drop("__passed").limit(n)


def _analyses(build) -> bool:
    try:
        build().schema
        return True
    except (AnalysisException, ParseException):
        return False


@contextmanager
def registered(tables: dict[str, DataFrame]) -> Iterator[Callable[[str], str]]:
    """Make tables visible to subqueries; yields how to rewrite a rule's text.

    Every table gets a view of its own, and its full name in a text is replaced
    by that view's, but not in strings and comments.  The last part of a name works as well where it is the only
    one; a text that uses an ambiguous one does not analyse.  Plans are analysed
    while the views exist; afterwards they are dropped and a caller's own views
    of the same names are back.
    """
    if not tables:
        yield lambda text: text
        return
    spark = next(iter(tables.values())).sparkSession
    last = lambda name: name.split(".")[-1]
    counts: dict[str, int] = {}
    for name in tables:
        counts[last(name).lower()] = counts.get(last(name).lower(), 0) + 1
    views = {name: f"assay_rule_table_{i}" for i, name in enumerate(tables)}
    own = {short: spark.table(quote(short)) for short in {last(n) for n in tables} if any(t.isTemporary and t.name == short.lower() for t in spark.catalog.listTables())}
    for short in own:
        spark.catalog.dropTempView(short)
    shorts = [n for n in tables if counts[last(n).lower()] == 1]
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(views[name])
            if name in shorts:
                df.createOrReplaceTempView(quote(last(name)))
        qualified = sorted((n for n in tables if "." in n), key=len, reverse=True)
        names = "|".join(r"(?<![\w.`])" + r"\.".join(f"`?{re.escape(part)}`?" for part in n.split(".")) + r"(?![\w`])" for n in qualified)
        dotted = re.compile(rf"(?P<skip>{_NO_CODE})|{names}", re.IGNORECASE | re.DOTALL)
        by_name = {n.lower(): views[n] for n in qualified}
        yield (lambda text: dotted.sub(lambda m: m[0] if m["skip"] is not None else by_name[m[0].replace("`", "").lower()], text)) if qualified else (lambda text: text)
    finally:
        for name in tables:
            spark.catalog.dropTempView(views[name])
            if name in shorts:
                spark.catalog.dropTempView(last(name))
        for short, df in own.items():
            df.createOrReplaceTempView(quote(short))


def _typed(rule: Rule, tables: dict[str, DataFrame]) -> Callable[[], DataFrame] | None:
    """The check that a rule carries besides its text, if any."""
    df = tables[rule.table_fqn]
    if rule.check is not None:
        return lambda: rule.check(df, tables)
    if rule.check_args is not None and rule.rule_type in TYPED:
        return lambda: _totals(*typed_groups(rule, tables))
    return None


def count_failures(tables: dict[str, DataFrame], rules: Iterable[Rule]) -> DataFrame:
    """(rule_id, total_records, failed_records, errored) for every rule.

    A rule whose table is unknown or whose text does not analyse is marked as
    errored and never stops the others.
    """
    spark = next(iter(tables.values())).sparkSession
    parts, errors, per_table = [], [], {}
    with registered(tables) as rewritten:
        for r in rules:
            df = tables.get(r.table_fqn)
            text = rewritten(r.rule_expression)
            typed = None if df is None else _typed(r, tables)
            if typed is not None and _analyses(typed):
                parts.append(typed().select(F.lit(r.rule_id).alias("rule_id"), "total_records", "failed_records"))
            elif df is None or typed is not None or not _analyses(lambda: check_rule(df, text)):
                errors.append(r)
            elif _analyses(lambda: check_rules(df, {r.rule_id: text})):
                per_table.setdefault(r.table_fqn, {})[r.rule_id] = text
            else:
                parts.append(check_rule(df, text).select(F.lit(r.rule_id).alias("rule_id"), "total_records", "failed_records"))
        for t, exprs in per_table.items():
            items = list(exprs.items())
            parts += [check_rules(tables[t], dict(items[i:i + RULES_PER_SCAN])) for i in range(0, len(items), RULES_PER_SCAN)]
        schema = "rule_id string, total_records bigint, failed_records bigint, errored boolean"
        out = spark.createDataFrame([(r.rule_id, 0, 0, True) for r in errors], schema)
        for p in parts:
            out = out.unionByName(p.withColumn("errored", F.lit(False)))
    return out


def row_digest(df: DataFrame) -> Column:
    """A digest of a row's values, in the order of its columns."""
    cells = [F.col(quote(f.name)).cast("string") if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(quote(f.name))) for f in df.schema.fields]
    return F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cells]).cast("binary"))


def failing_samples(tables: dict[str, DataFrame], rules: Iterable[Rule], n: int = SAMPLE_ROWS) -> DataFrame:
    """(rule_id, sample_failed_records): up to ``n`` failing rows of each rule as a JSON array.

    The rows with the smallest digests are shown, so samples repeat from run to
    run.  All row-level rules of a table share one scan, whose tasks keep ``n``
    rows of each rule.  Rules with a typed check show failing keys with their
    counts; those and rules with subqueries or windows have a scan of their own.
    """
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "rule_id string, sample string")

    def shown(found: DataFrame) -> Column:
        return F.to_json(F.struct(*[json_safe(F.col(quote(f.name)), f.dataType).alias(f.name) for f in found.schema.fields]))

    with registered(tables) as rewritten:
        shared: dict[str, list[tuple[str, str]]] = {}
        for r in rules:
            if r.table_fqn not in tables or r.check is not None:
                continue
            df, text = tables[r.table_fqn], rewritten(r.rule_expression)
            if _typed(r, tables) is not None:
                groups, failing = typed_groups(r, tables)[:2]
                found = groups.filter(failing)
            elif _analyses(lambda: check_rules(df, {r.rule_id: text})):
                shared.setdefault(r.table_fqn, []).append((r.rule_id, text))
                continue
            else:
                found = df.alias(ALIAS).select("*", pass_flag(text).alias("__passed")).filter("__passed = 0").drop("__passed")
            out = out.unionByName(found.orderBy(row_digest(found)).limit(n).select(F.lit(r.rule_id).alias("rule_id"), shown(found).alias("sample")))
        for name, several in shared.items():
            for at in range(0, len(several), RULES_PER_SCAN):
                df = tables[name].alias(ALIAS)
                failing = F.array_compact(F.array(*[F.when(pass_flag(text) == 0, F.lit(rule_id)) for rule_id, text in several[at:at + RULES_PER_SCAN]]))
                marked = df.select("*", row_digest(tables[name]).alias("__digest"), failing.alias("__failing")).withColumn("__rule", F.explode("__failing"))
                first = latest_per_key(marked, ["__rule"], [F.asc("__digest")], n)
                out = out.unionByName(first.select(F.col("__rule").alias("rule_id"), shown(tables[name]).alias("sample")))
    listed = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("sample")), ","), F.lit("]"))
    return out.groupBy("rule_id").agg(listed.alias("sample_failed_records"))


def rules_frame(spark, rules: Iterable[Rule]) -> DataFrame:
    schema = ("rule_id string, table_fqn string, rule_expression string, rule_name string, layer string, "
              "severity string, is_cde_rule boolean, status string")
    return spark.createDataFrame([tuple(getattr(r, f.split()[0]) for f in schema.split(", ")) for r in rules], schema)


def score_results(counted: DataFrame) -> DataFrame:
    """Percentage, status and score; critical data elements lose twice as fast."""
    errored = F.coalesce("errored", F.lit(False)) if "errored" in counted.columns else F.lit(False)
    out = counted.withColumn("fail_pct", percent(F.col("failed_records"), F.col("total_records")))
    lost = scaled(F.col("fail_pct"), 2) * F.when(F.col("is_cde_rule"), 2).otherwise(1)
    score = ratio(F.greatest(F.lit(0), F.lit(10000) - lost), F.lit(100), 1)
    return (out.withColumn("status", F.when(errored, "ERROR").when(F.col("failed_records") > 0, "FAIL").otherwise("PASS"))
            .withColumn("quality_score", F.when(errored, 0.0).otherwise(score)))


def run_rules(tables: dict[str, DataFrame], rules: Sequence[Rule], *, run_id: str, as_of: Column) -> DataFrame:
    """Result rows of a run over many tables, as one plan."""
    spark = next(iter(tables.values())).sparkSession
    attributes = rules_frame(spark, rules).drop("rule_expression", "status")
    scored = score_results(count_failures(tables, rules).join(attributes, "rule_id"))
    return scored.drop("errored").withColumns({
        "sample_failed_records": F.lit(None).cast("string"), "run_id": F.lit(run_id), "run_timestamp": as_of,
        "result_id": F.concat_ws("/", F.lit(run_id), "rule_id"), "is_expected_failure": F.lit(False)})


def execute_rules(tables: dict[str, DataFrame], rules: Sequence[Rule], *, run_id: str, as_of: Column, sample: int = SAMPLE_ROWS) -> DataFrame:
    """R7 with run-time isolation and samples: a rule that fails while running becomes ERROR.

    The shared scan is tried first.  If a rule breaks it, the rules are halved
    until the broken ones stand alone.  What comes back to the driver is one row
    per rule; failing rules then get a sample of failing rows.
    """
    spark = next(iter(tables.values())).sparkSession
    whole = run_rules(tables, rules, run_id=run_id, as_of=as_of)
    schema = whole.schema

    def rows(part: Sequence[Rule], plan: DataFrame) -> list:
        try:
            return plan.collect()
        except RULE_ERRORS:
            if len(part) == 1:
                broken = run_rules(tables, [replace(part[0], table_fqn="", check=None, check_args=None)], run_id=run_id, as_of=as_of)
                return broken.withColumn("table_fqn", F.lit(part[0].table_fqn)).select(*schema.names).collect()
            half = len(part) // 2
            return [r for p in (part[:half], part[half:]) for r in rows(p, run_rules(tables, p, run_id=run_id, as_of=as_of))]

    found = rows(list(rules), whole)
    results = spark.createDataFrame(found, schema)
    failed = {r["rule_id"] for r in found if r["status"] == "FAIL"}
    if not failed or not sample:
        return results
    samples = failing_samples(tables, [r for r in rules if r.rule_id in failed], sample)
    return results.drop("sample_failed_records").join(samples, "rule_id", "left").select(*schema.names)


def select_rules(rules: DataFrame, connection_id: str, rule_id: str | None = None, layer: str | None = None,
                 table_fqn: str | None = None) -> DataFrame:
    """approved and active rules of a scope, in execution order."""
    out = rules.filter((F.col("connection_id") == connection_id) & F.col("status").isin("approved", "active"))
    if rule_id:
        out = out.filter(F.col("rule_id") == rule_id)
    else:
        if layer and layer != "ALL":
            out = out.filter(F.col("layer") == layer)
        if table_fqn:
            out = out.filter(F.col("table_fqn") == table_fqn)
    return out.orderBy(layer_rank(F.col("layer")), severity_rank(F.col("severity")), "rule_id")


def overall_score() -> Column:
    """R6 as an aggregate: severity-weighted mean of the scores; 0 without results."""
    weight = lookup(F.col("severity"), _DOUBLE_WEIGHT, 2)
    return F.coalesce(ratio(F.sum(scaled(F.col("quality_score"), 1) * weight), F.sum(weight) * 10, 1), F.lit(0.0))


def weighted_score(results: DataFrame, *keys: str) -> DataFrame:
    """R6 per group."""
    return results.groupBy(*keys).agg(overall_score().alias("overall_quality_score"))


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of each run."""
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_rules"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "ERROR").alias("errors"),
        overall_score().alias("overall_quality_score"))


# --- typed checks ------------------------------------------------------------

def _totals(groups: DataFrame, failing: Column, rows: str = "n") -> DataFrame:
    return groups.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("total_records"),
                      F.coalesce(F.sum(F.when(failing, F.col(rows))), F.lit(0)).alias("failed_records"))


def row_check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` is not TRUE."""
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.count_if(~F.coalesce(condition, F.lit(False))).alias("failed_records"))


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row of a repeated key fails; NULL is a key value like any other."""
    return _totals(*_unique_groups(df, columns))


def _unique_groups(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Column]:
    return key_counts(df, columns), F.col("n") > 1


def exactly_one(df: DataFrame, keys: Sequence[str], current: Column) -> DataFrame:
    """Exactly one current row per key, or all rows of the key fail."""
    return _totals(*_current_groups(df, keys, current))


def _current_groups(df: DataFrame, keys: Sequence[str], current: Column) -> tuple[DataFrame, Column]:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(current).alias("current")), F.col("current") != 1


def depends_on(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One value per key, NULLs aside, without a distinct window."""
    return _totals(*_dependent_groups(df, keys, value))


def _dependent_groups(df: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, Column]:
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return groups, F.coalesce(F.col("lo") != F.col("hi"), F.lit(True))


def min_volume(df: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    """Batches with too few rows."""
    return _totals(*_volume_groups(df, keys, at_least))


def _volume_groups(df: DataFrame, keys: Sequence[str], at_least: int) -> tuple[DataFrame, Column]:
    return key_counts(df, keys), F.col("n") < at_least


def _reference_groups(df: DataFrame, columns: Sequence[str], ref: DataFrame, ref_columns: Sequence[str]) -> tuple[DataFrame, Column]:
    names = [f"_p{i}" for i in range(len(ref_columns))]
    parents = ref.select(*[F.col(c).alias(n) for c, n in zip(ref_columns, names)]).dropna().distinct().withColumn("_hit", F.lit(True))
    counted = key_counts(df, columns).join(parents, [F.col(c) == F.col(n) for c, n in zip(columns, names)], "left")
    filled = F.lit(True)
    for c in columns:
        filled = filled & F.col(c).isNotNull()
    return counted.select(*columns, "n", "_hit"), filled & F.col("_hit").isNull()


# Kinds of stored rules that are run as key counts instead of text, with what ``check_args`` names.
TYPED = {
    "UNIQUE": lambda df, tables, a: _unique_groups(df, a["columns"]),
    "SINGLE_CURRENT": lambda df, tables, a: _current_groups(df, a["columns"], F.expr(a["current"])),
    "DEPENDENCY": lambda df, tables, a: _dependent_groups(df, a["columns"], a["value"]),
    "VOLUME": lambda df, tables, a: _volume_groups(df, a["columns"], a["at_least"]),
    "FK": lambda df, tables, a: _reference_groups(df, a["columns"], tables[a["ref"]], a["ref_columns"]),
}


def typed_groups(rule: Rule, tables: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    """Key counts of a stored rule and which of them fail; arguments that do not fit are an analysis error."""
    try:
        return TYPED[rule.rule_type](tables[rule.table_fqn], tables, json.loads(rule.check_args))
    except (KeyError, TypeError, ValueError) as wrong:
        raise AnalysisException(f"arguments of rule {rule.rule_id}: {wrong!r}") from wrong


def foreign_key(df: DataFrame, columns: Sequence[str], ref: DataFrame, ref_columns: Sequence[str]) -> DataFrame:
    """Key is NULL or exists in ``ref`` (which may be ``df`` itself)."""
    failed = unmatched_counts(df, columns, ref, ref_columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed_records"))
    return failed.select(df.agg(F.count(F.lit(1)).alias("c")).scalar().alias("total_records"), "failed_records")


def header_matches_detail(header: DataFrame, key: str, total: Column, detail: DataFrame, detail_key: str,
                          amount: Column, tolerance: float) -> DataFrame:
    """Header total against the sum of its details; no detail counts as failing."""
    sums = detail.groupBy(F.col(detail_key).alias("_k")).agg(F.sum(amount).alias("_s"))
    joined = header.join(sums, header[key] == sums["_k"], "left")
    return row_check(joined, F.abs(total - F.col("_s")) <= tolerance)


def has_child(parent: DataFrame, keys: Sequence[str], child: DataFrame, child_keys: Sequence[str]) -> DataFrame:
    """Reverse existence; a parent with a NULL key has no child.

    Parents are counted per key first, so NULL keys are joined once.
    """
    names = [f"_c{i}" for i in range(len(keys))]
    present = child.select(*[F.col(c).alias(n) for c, n in zip(child_keys, names)]).dropna().distinct().withColumn("_hit", F.lit(True))
    cond = [F.col(k) == F.col(n) for k, n in zip(keys, names)]
    return _totals(key_counts(parent, keys).join(present, cond, "left"), ~F.coalesce("_hit", F.lit(False)))


def ordered_with_parent(child: DataFrame, key: str, value: str, parent: DataFrame, parent_key: str,
                        parent_value: str) -> DataFrame:
    """R25 across tables: child value not before its parent's.

    Children are counted per (key, value) first, so a hot key is joined once
    per distinct value rather than once per row.
    """
    counted = key_counts(child, [key, value])
    p = parent.select(F.col(parent_key).alias("_k"), F.col(parent_value).alias("_v"))
    joined = counted.join(p, F.col(key) == F.col("_k"), "left")
    return _totals(joined, ~F.coalesce(F.col(value) >= F.col("_v"), F.lit(False)))
