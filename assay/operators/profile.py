"""Column and table profiling.

A profile needs two scans, whatever the number of columns:

* ``column_aggregates``: counts, NULLs and numeric moments of every column in
  one aggregate;
* ``value_frequencies``: (column, value) counts, combined on the map side, from
  which distinct counts, top values, formats and key duplicates all follow.
  Spark shuffles each distinct value once and reuses that exchange.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import text
from assay.functions.exact import percent, ratio, scaled
from assay.operators.relational import first_rows, latest_per_key

NULL_CRITICAL_PCT = 20
NULL_WARN_PCT = 5

_SKIPPED = (T.MapType, T.VariantType)


def profiled_fields(df: DataFrame) -> list[T.StructField]:
    """Columns that can be grouped; MAP and VARIANT columns cannot."""
    return [f for f in df.schema.fields if not isinstance(f.dataType, _SKIPPED)]


def _is_numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def _is_text(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)


def _quoted(name: str) -> Column:
    return F.col(_sql_name(name))


def row_count(df: DataFrame) -> DataFrame:
    """P1."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def column_aggregates(df: DataFrame, approx: bool = False, full_format: bool = False) -> DataFrame:
    """P1, P2, P5 in one pass: one row per column.

    ``approx`` adds a HyperLogLog distinct count and ``full_format`` counts
    format matches over every row, both inside the same aggregate.
    """
    fields = profiled_fields(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = _quoted(f.name)
        aggs.append(F.count_if(c.isNull()).alias(f"nulls_{i}"))
        if _is_numeric(f):
            d = text.comparable(c.cast("double"), T.DoubleType())
            aggs += [F.min(d).alias(f"min_{i}"), F.max(d).alias(f"max_{i}"),
                     F.avg(d).alias(f"mean_{i}"), F.stddev_samp(d).alias(f"sd_{i}")]
        if approx:
            aggs.append(F.approx_count_distinct(text.comparable(c, f.dataType)).alias(f"ndv_{i}"))
        if full_format and _is_text(f):
            aggs += [F.count_if(c.rlike(p)).alias(f"fmt_{i}_{n}") for n, p in text.VALUE_FORMATS]
    one = df.agg(*aggs)
    nothing = F.lit(None).cast("double")
    rows = []
    for i, f in enumerate(fields):
        num = _is_numeric(f)
        filled = F.col("rows") - F.col(f"nulls_{i}")
        matches = {n: F.col(f"fmt_{i}_{n}") for n, _ in text.VALUE_FORMATS} if full_format and _is_text(f) else None
        rows.append(F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(_is_text(f)).alias("is_text"),
            F.col("rows").alias("row_count"),
            F.col(f"nulls_{i}").alias("null_count"),
            (F.col(f"min_{i}") if num else nothing).alias("min_num"),
            (F.col(f"max_{i}") if num else nothing).alias("max_num"),
            (F.round(f"mean_{i}", 4) if num else nothing).alias("mean_val"),
            (F.round(f"sd_{i}", 4) if num else nothing).alias("std_dev"),
            (F.col(f"ndv_{i}") if approx else F.lit(None).cast("bigint")).alias("approx_distinct"),
            (text.format_from_counts(matches, filled) if matches else F.lit(None).cast("string")).alias("full_format"),
        ))
    return one.select(F.inline(F.array(*rows))).withColumn("null_pct", percent(F.col("null_count"), F.col("row_count")))


def null_stats(df: DataFrame) -> DataFrame:
    """NULL count and percentage of every column."""
    return column_aggregates(df).select("column_name", "null_count", "null_pct")


def numeric_stats(df: DataFrame) -> DataFrame:
    """P5: min, max, mean and sample deviation of numeric columns."""
    numeric = [f.name for f in profiled_fields(df) if _is_numeric(f)]
    return column_aggregates(df.select(*[_quoted(n) for n in numeric])).select(
        "column_name", "min_num", "max_num", "mean_val", "std_dev")


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None,
                      long_text: Iterable[str] = ()) -> DataFrame:
    """(ordinal, column_name, value, n) for every distinct value, NULL included.

    Values keep their type until they are counted; only distinct values are
    turned into strings.  String columns named in ``long_text`` are counted by
    digest and their ``value`` is the digest, so whole documents are not shuffled.
    """
    long_text = set(long_text)
    fields = [f for f in profiled_fields(df) if columns is None or f.name in columns]
    cells = []
    for i, f in enumerate(fields):
        c, t = _quoted(f.name), f.dataType
        is_time = isinstance(t, (T.TimestampType, T.TimestampNTZType))
        is_float = isinstance(t, (T.DoubleType, T.FloatType))
        is_whole = isinstance(t, T.IntegralType)
        as_text = text.shuffle_key(c, t) if f.name in long_text else text.comparable(c, t)
        cells.append(F.struct(
            F.lit(i).alias("ordinal"),
            (F.lit(None) if is_time or is_float or is_whole else as_text).cast("string").alias("_s"),
            (c if is_whole else F.lit(None)).cast("bigint").alias("_l"),
            (text.comparable(c, t) if is_float else F.lit(None)).cast("double").alias("_d"),
            (c if is_time else F.lit(None)).cast("timestamp_ntz").alias("_t"),
        ))
    keys = ["ordinal", "_s", "_l", "_d", "_t"]
    name = F.get(F.array(*[F.lit(f.name) for f in fields]), F.col("ordinal"))
    counted = df.select(F.inline(F.array(*cells))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    value = F.coalesce("_s", F.col("_l").cast("string"), F.col("_d").cast("string"), F.col("_t").cast("string"))
    return counted.select("ordinal", name.alias("column_name"), value.alias("value"), "n")


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-NULL values per column and their share of the rows."""
    if approx:
        counted = column_aggregates(df, approx=True).select(
            "column_name", F.col("approx_distinct").alias("distinct_count"), "row_count")
    else:
        fields = profiled_fields(df)
        keyed = value_frequencies(df, long_text=[f.name for f in fields if _is_text(f)])
        counted = keyed.groupBy("column_name").agg(
            F.count("value").alias("distinct_count"), F.sum("n").alias("row_count"))
    return counted.withColumn("cardinality_ratio", ratio(F.col("distinct_count"), F.col("row_count"), 4)).drop("row_count")


def _top(df: DataFrame, freq: DataFrame, n: int | None, long_text: Sequence[str]) -> DataFrame:
    """(column_name, rank, value, n): the ``n`` most frequent values of each column, ties by value, NULL last."""
    order = [F.desc("n"), F.asc_nulls_last("value")]
    if not long_text:
        return latest_per_key(freq, ["column_name"], order, n, rank="rank")
    is_long = F.col("column_name").isin(*long_text)
    short = freq.filter(~is_long).select("column_name", "value", "n")
    return latest_per_key(short.unionByName(_contending_texts(df, freq.filter(is_long), n, long_text)), ["column_name"], order, n, rank="rank")


def _contending_texts(df: DataFrame, freq: DataFrame, n: int | None, names: Sequence[str]) -> DataFrame:
    """(column_name, value, n) with whole texts for every digest whose count may be among the ``n`` largest.

    The n-th largest count of a column is known from digests alone.  A second
    pass fetches one text for each digest with at least that count, all ties
    included, so that ties are broken by the texts themselves.
    """
    if n is None:
        contenders = freq
    else:
        least = latest_per_key(freq, ["column_name"], [F.desc("n"), F.asc_nulls_last("value")], n).groupBy("column_name").agg(F.min("n").alias("_least"))
        contenders = freq.join(least, "column_name").filter(F.col("n") >= F.col("_least"))
    contenders = contenders.select("column_name", "value", "n")
    cells = [F.struct(F.lit(c).alias("column_name"), text.shuffle_key(_quoted(c), T.StringType()).alias("value"), _quoted(c).alias("_text")) for c in names]
    texts = (df.select(F.inline(F.array(*cells))).join(contenders.filter(F.col("value").isNotNull()), ["column_name", "value"])
             .groupBy("column_name", "value", "n").agg(F.any_value("_text").alias("_text")))
    found = texts.select("column_name", F.col("_text").alias("value"), "n")
    return found.unionByName(contenders.filter(F.col("value").isNull()))


def top_values(df: DataFrame, n: int | None = 10, columns: Sequence[str] | None = None,
               long_text: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most frequent values per column, ties by value, NULL included; None lists all.

    ``long_text`` names string columns whose values are too long to shuffle
    while they are counted; the result is the same.
    """
    freq = value_frequencies(df, columns, long_text)
    return _top(df, freq, n, list(long_text)).select("column_name", "rank", "value", F.col("n").alias("frequency"))


def formats(df: DataFrame, top_values_only: int | None = None) -> DataFrame:
    """Dominant format per column, from every row, or from so many of the most frequent values."""
    fields = profiled_fields(df)
    names = [f.name for f in fields if _is_text(f)]
    others = {f.name: f.dataType.simpleString().upper() for f in fields if not _is_text(f)}
    catalog = F.array(*[F.struct(F.lit(f.name).alias("column_name"),
                                 F.lit(others.get(f.name)).cast("string").alias("type_name")) for f in fields])
    if top_values_only is None:
        found = column_aggregates(df, full_format=True).select("column_name", F.col("full_format").alias("found"))
    else:
        found = formats_of_top_values(top_values(df, top_values_only, columns=names, long_text=names))
    every = df.sparkSession.range(1).select(F.inline(catalog))
    return every.join(found, "column_name", "left").select(
        "column_name", F.coalesce("type_name", "found", F.lit("UNKNOWN")).alias("format_pattern"))


def formats_of_top_values(top: DataFrame) -> DataFrame:
    matches = {n: F.count_if(F.col("value").rlike(p)) for n, p in text.VALUE_FORMATS}
    return top.groupBy("column_name").agg(
        text.format_from_counts(matches, F.count("value")).alias("found"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows, compared by a 256-bit digest of the whole row."""
    cells = [text.comparable(_quoted(f.name), f.dataType).alias(f"k{i}") for i, f in enumerate(profiled_fields(df))]
    row = F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)
    groups = df.select(row.alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def key_candidates(stats: DataFrame, fk_like: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Columns that look like keys, id-like names first; all of them unless ``limit`` is given."""
    id_like = F.col("column_name").rlike(text.KEY_LIKE)
    ratio_ok = (id_like & (F.col("cardinality_ratio") >= 0.6)) | (F.col("cardinality_ratio") >= 0.9)
    known_fk = F.lower("column_name").isin([c.lower() for c in fk_like]) if fk_like else F.lit(False)
    found = stats.filter(ratio_ok & ~known_fk & (F.col("row_count") > 1)).withColumn("id_like", id_like)
    return first_rows(found.orderBy(F.desc("id_like"), F.desc("cardinality_ratio"), "ordinal"), limit)


def key_duplicates(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """Duplicate groups and the rows in them, per single or composite key.

    Each key reads its own columns only and is counted on the map side; one pass
    over all keys would have to copy every row once for each of them.
    """
    parts = []
    for i, key in enumerate(candidates):
        groups = df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        parts.append(groups.agg(
            F.lit(i).alias("ordinal"), F.lit(",".join(key)).alias("key_columns"),
            F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicate_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_key_samples(df: DataFrame, key: Sequence[str], n: int | None = 5) -> DataFrame:
    """The most repeated values of a key."""
    groups = df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return first_rows(groups.orderBy(F.desc("n"), *[F.asc(k) for k in key]), n)


def worst_key_duplicate(duplicates: DataFrame) -> DataFrame:
    """The candidate with most duplicate rows, the first one on ties."""
    return duplicates.filter(F.col("duplicate_rows") > 0).orderBy(F.desc("duplicate_rows"), "ordinal").limit(1)


def column_health(null_pct: Column, format_pattern: Column) -> Column:
    """P13."""
    return (F.when(null_pct > NULL_CRITICAL_PCT, "CRIT")
            .when((null_pct > NULL_WARN_PCT) | (format_pattern == "MIXED"), "WARN")
            .otherwise("HEALTHY"))


def column_quality(null_pct: Column) -> Column:
    """100 minus twice the NULL percentage, floor 0, one decimal."""
    hundredths = F.greatest(F.lit(0), F.lit(10000) - scaled(null_pct, 2) * 2)
    return ratio(hundredths, F.lit(100), 1)


def profile_columns(df: DataFrame, *, top_n: int | None = 10, approx: bool = False, long_text: Sequence[str] = (),
                    format_of_top: int | None = None) -> DataFrame:
    """One row of statistics per column.

    Formats are found over every row, or over ``format_of_top`` of the most
    frequent values.  ``approx`` is the cheap path: a single aggregate with a
    sketch for distinct counts and one for frequent values, no shuffle of
    values; duplicate groups are then unknown (NULL) and duplicates follow from
    the distinct count.
    """
    if approx:
        return _approximate_columns(df, 10 if top_n is None else top_n)
    base = column_aggregates(df, full_format=format_of_top is None)
    freq = value_frequencies(df, long_text=long_text)
    repeated = F.col("n") > 1
    per_column = freq.groupBy("column_name").agg(
        F.count("value").alias("exact_distinct"),
        F.count_if(repeated & F.col("value").isNotNull()).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(repeated & F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("duplicate_rows"))
    depth = top_n if top_n is None or format_of_top is None else max(top_n, format_of_top)
    top = _top(df, freq, depth, list(long_text))
    within = lambda limit: F.lit(True) if limit is None else F.col("rank") <= limit
    matches = {n: F.count_if(within(format_of_top) & F.col("value").rlike(p)) for n, p in text.VALUE_FORMATS}
    listed = F.transform(F.sort_array(F.collect_list(F.when(within(top_n), F.struct("rank", "value")))), lambda s: s["value"])
    shown = top.groupBy("column_name").agg(
        listed.alias("top_values"), text.format_from_counts(matches, F.count_if(within(format_of_top) & F.col("value").isNotNull())).alias("top_format"))
    joined = base.join(per_column, "column_name", "left").join(shown, "column_name", "left")
    found = F.coalesce("full_format" if format_of_top is None else "top_format", F.lit("UNKNOWN"))
    rows = (joined.withColumn("distinct_count", F.coalesce("exact_distinct", F.lit(0)))
            .withColumn("has_duplicates", F.coalesce(F.col("duplicate_groups") > 0, F.lit(False)))
            .withColumn("duplicate_groups", F.coalesce("duplicate_groups", F.lit(0)))
            .withColumn("duplicate_rows", F.coalesce("duplicate_rows", F.lit(0))))
    return _finished(rows, found)


def _approximate_columns(df: DataFrame, top_n: int) -> DataFrame:
    """The ``approx`` path of :func:`profile_columns`: sketches inside one aggregate each, over the same scan."""
    base = column_aggregates(df, approx=True, full_format=True)
    fields = profiled_fields(df)
    shown = lambda f: F.expr(f"approx_top_k({text_of(f)}, {top_n})").alias(f.name)
    text_of = lambda f: f"CAST({_sql_name(f.name)} AS STRING)"
    cells = [F.struct(F.lit(f.name).alias("column_name"), F.transform(_quoted(f.name), lambda x: x["item"]).alias("top_values")) for f in fields]
    top = df.agg(*[shown(f) for f in fields]).select(F.inline(F.array(*cells)))
    filled = F.col("row_count") - F.col("null_count")
    rows = (base.join(top, "column_name", "left").withColumn("distinct_count", F.least("approx_distinct", filled))
            .withColumn("has_duplicates", F.col("distinct_count") < filled)
            .withColumn("duplicate_groups", F.lit(None).cast("bigint")).withColumn("duplicate_rows", filled - F.col("distinct_count")))
    return _finished(rows, F.coalesce("full_format", F.lit("UNKNOWN")))


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _finished(joined: DataFrame, found: Column) -> DataFrame:
    """Ratios, health and scores of gathered column statistics."""
    return (joined
            .withColumn("format_pattern", F.when(F.col("is_text"), found).otherwise(F.upper("data_type")))
            .withColumn("cardinality_ratio", ratio(F.col("distinct_count"), F.col("row_count"), 4))
            .withColumn("health", column_health(F.col("null_pct"), F.col("format_pattern")))
            .withColumn("health_reasons", F.filter(F.array(
                F.when(F.col("null_pct") > NULL_WARN_PCT, F.format_string("NULL share %.1f%%, above %d%%", "null_pct", F.when(
                    F.col("null_pct") > NULL_CRITICAL_PCT, NULL_CRITICAL_PCT).otherwise(NULL_WARN_PCT))),
                F.when(F.col("format_pattern") == "MIXED", "Values follow no single format")), lambda r: r.isNotNull()))
            .withColumn("quality_score", column_quality(F.col("null_pct")))
            .select("ordinal", "column_name", "data_type", "row_count", "null_count", "null_pct", "distinct_count",
                    "cardinality_ratio", "has_duplicates", "duplicate_groups", "duplicate_rows", "min_num", "max_num",
                    "mean_val", "std_dev", "format_pattern", "top_values", "health", "health_reasons", "quality_score"))


def score_table(stats: DataFrame, duplicate_count: Column, key_duplicate_rows: Column,
                freshness: float = 100.0) -> DataFrame:
    """Completeness, uniqueness, consistency, freshness and overall score.

    The duplicate counts are one-row scalars, e.g. ``df.scalar()`` of
    :func:`duplicate_rows` and :func:`worst_key_duplicate`.
    """
    known = ~F.col("format_pattern").isin("MIXED", "UNKNOWN", "")
    per_table = stats.agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("columns"),
        F.sum(scaled(F.col("null_pct"), 2)).alias("null_hundredths"),
        F.count_if(known).alias("known"))
    lost = F.coalesce(duplicate_count, F.lit(0)) + F.coalesce(key_duplicate_rows, F.lit(0))
    columns = F.greatest("columns", F.lit(1))
    spare = F.greatest(F.lit(0), columns * 10000 - F.coalesce("null_hundredths", F.lit(0)))
    rows = F.greatest("row_count", F.lit(1))
    unique = F.greatest(F.lit(0), rows - lost)
    completeness = spare / (columns * F.lit(100.0))
    uniqueness = unique * F.lit(100.0) / rows
    return (per_table
            .withColumn("completeness_score", ratio(spare, columns * 100, 1))
            .withColumn("uniqueness_score", percent(unique, rows, 1))
            .withColumn("consistency_score", percent(F.col("known"), F.col("columns"), 1))
            .withColumn("freshness_score", F.lit(float(freshness)))
            .withColumn("quality_score", F.round(
                completeness * 0.35 + uniqueness * 0.25 + F.col("consistency_score") * 0.25
                + F.col("freshness_score") * 0.15, 1))
            .select("row_count", "completeness_score", "uniqueness_score", "consistency_score",
                    "freshness_score", "quality_score"))


def freshness_score(newest: Column, as_of: Column, sla_hours: float) -> Column:
    """Optional freshness for P12: 100 inside the SLA, then falling to 0 over one more SLA."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(newest)) / 3600.0
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(200.0) - age / sla_hours * 100.0)), 1)


def column_risks(stats: DataFrame) -> DataFrame:
    """NULL and format risks of a column profile."""
    entries = F.filter(F.array(
        F.when(F.col("null_pct") > NULL_CRITICAL_PCT, F.struct(
            F.lit("NULL_HIGH").alias("risk_type"), F.lit("CRITICAL").alias("severity"),
            F.format_string("NULL share of %s: %.1f%%", "column_name", "null_pct").alias("description")))
        .when(F.col("null_pct") > NULL_WARN_PCT, F.struct(
            F.lit("NULL_MODERATE").alias("risk_type"), F.lit("HIGH").alias("severity"),
            F.format_string("NULL share of %s: %.1f%%", "column_name", "null_pct").alias("description"))),
        F.when(F.col("format_pattern") == "MIXED", F.struct(
            F.lit("FORMAT_MIXED").alias("risk_type"), F.lit("HIGH").alias("severity"),
            F.concat(F.lit("Values of "), "column_name", F.lit(" follow no single format")).alias("description")))),
        lambda e: e.isNotNull())
    return stats.select("column_name", F.inline(entries))


def duplicate_key_risk(duplicates: DataFrame, row_count: Column) -> DataFrame:
    """Risk of the worst duplicated key; 1 % of the rows makes it critical."""
    pct = percent(F.col("duplicate_rows"), row_count)
    return worst_key_duplicate(duplicates).select(
        F.col("key_columns").alias("column_name"), F.lit("DUPLICATE_KEY").alias("risk_type"),
        F.when(pct >= 1, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.format_string("%s is not unique: %d values repeat, in %d rows or %s%%",
                        "key_columns", "duplicate_groups", "duplicate_rows", pct.cast("string")).alias("description"))


def orphan_risks(orphans: DataFrame) -> DataFrame:
    """Risks from orphan checks; 5 % is critical, 1 % high."""
    note = F.when(F.col("source") == "declared_fk", "").otherwise("; the reference is a guess from names")
    return orphans.filter(F.col("orphan_count") > 0).select(
        F.col("fk_column").alias("column_name"), F.lit("REFERENTIAL_ORPHAN").alias("risk_type"),
        F.when(F.col("orphan_pct") >= 5, "CRITICAL").when(F.col("orphan_pct") >= 1, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.concat(F.format_string("%s: %d rows or %s%% point to nothing in %s.%s", "fk_column", "orphan_count",
                                 F.col("orphan_pct").cast("string"), "parent_table_fqn", "parent_column"), note).alias("description"))


def risk_samples(df: DataFrame, condition: Column, n: int = 10, window: Column | None = None) -> DataFrame:
    """A bounded sample of failing rows as JSON."""
    failing = df.filter(condition) if window is None else df.filter(condition & window)
    cells = [text.json_safe(_quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return failing.limit(n).select(F.to_json(F.struct(*cells)).alias("sample"))


def health_counts(stats: DataFrame, rules: DataFrame) -> DataFrame:
    """Columns by health, and columns no rule looks at, per connection and table."""
    key = ["connection_id", "table_fqn"]
    covered = rules.select(*key, "column_name").distinct().withColumn("_r", F.lit(1))
    return stats.join(covered, [*key, "column_name"], "left").groupBy(*key).agg(
        F.count_if(F.col("health") == "CRIT").alias("crit_columns"),
        F.count_if(F.col("health") == "WARN").alias("warn_columns"),
        F.count_if(F.col("_r").isNull()).alias("columns_without_rules"))


def profile_all(tables: dict[str, DataFrame], *, long_text: Sequence[str] = (), **options) -> DataFrame:
    """Column profiles of many tables as one frame, hence one Spark job; ``long_text`` counts where a table has the column."""
    out = None
    for name, df in tables.items():
        part = profile_columns(df, long_text=[c for c in long_text if c in df.columns], **options).withColumn("table_fqn", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
