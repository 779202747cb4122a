"""Referential checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.exact import percent
from assay.operators.relational import latest_per_key, unmatched_counts

# Fixed value: a key column is a name followed by id or key.
KEY_SUFFIX = r"(?i)^(.*?)_?(id|key)$"


def orphan_check(child: DataFrame, child_cols: Sequence[str], parent: DataFrame, parent_cols: Sequence[str], *,
                 window: Column | None = None, parent_name: str = "", source: str = "declared_fk") -> DataFrame:
    """P10: child rows whose key has no parent; NULL keys are not orphans.

    The window limits the child side only.  Child rows are counted per key
    before the anti join, so a hot key costs one row per map task.
    """
    scoped = child if window is None else child.filter(window)
    lost = unmatched_counts(scoped, child_cols, parent, parent_cols).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_count"))
    total = scoped.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return lost.select(
        F.lit(",".join(child_cols)).alias("fk_column"), F.lit(parent_name).alias("parent_table_fqn"),
        F.lit(",".join(parent_cols)).alias("parent_column"), "orphan_count",
        percent(F.col("orphan_count"), total).alias("orphan_pct"), F.lit(source).alias("source"))


def orphan_samples(child: DataFrame, child_cols: Sequence[str], parent: DataFrame, parent_cols: Sequence[str],
                   n: int = 5) -> DataFrame:
    """P10: the smallest orphan keys."""
    return unmatched_counts(child, child_cols, parent, parent_cols).select(*child_cols).orderBy(*child_cols).limit(n)


def infer_foreign_keys(catalog: DataFrame) -> DataFrame:
    """Child column -> parent column pairs that the naming rule suggests.

    ``catalog`` has (schema_name, table_name, column_name).  The base name is
    the column without its id/key suffix; the parent is a table of the same
    schema called base, base+s or base+es that has the same column or ``id``.
    """
    base = F.lower(F.regexp_replace(F.regexp_extract("column_name", KEY_SUFFIX, 1), "^_+|_+$", ""))
    own = F.lower(F.regexp_replace("table_name", "[sS]+$", ""))
    keyed = (catalog.filter(F.col("column_name").rlike(KEY_SUFFIX)).withColumn("base", base)
             .filter((F.col("base") != "") & (F.col("base") != own) & (F.col("base") != F.lower("table_name"))))
    wanted = keyed.select("schema_name", "table_name", "column_name", F.posexplode(
        F.array("base", F.concat("base", F.lit("s")), F.concat("base", F.lit("es")))).alias("choice", "parent_key"))
    parents = catalog.select(
        "schema_name", F.lower("table_name").alias("parent_key"), F.col("table_name").alias("parent_table"),
        F.col("column_name").alias("parent_column"))
    found = wanted.join(parents, ["schema_name", "parent_key"])
    child = ["schema_name", "table_name", "column_name"]
    # The first existing table decides, even if it lacks a usable column.
    first = found.groupBy(*child).agg(F.min("choice").alias("choice"))
    same = F.lower("parent_column") == F.lower("column_name")
    usable = found.join(first, child + ["choice"], "left_semi").filter(same | (F.lower("parent_column") == "id"))
    best = latest_per_key(usable, child, [F.when(same, 0).otherwise(1), F.col("parent_column")])
    return best.select(*child, "parent_table", F.when(same, F.col("column_name")).otherwise(F.col("parent_column")).alias("parent_column"))


Name = tuple[str, str, str]


def _values(tables: dict[tuple[str, str], DataFrame], columns: Sequence[Name]) -> DataFrame:
    """(value, column, n): how often each value occurs in each of ``columns`` (schema, table, column), known by its place in the list.

    Each table is read once.  Whole numbers agree across types; NULL is no value.
    """
    parts = []
    for name, df in tables.items():
        mine = [(i, c) for i, (s, t, c) in enumerate(columns) if (s, t) == name]
        if mine:
            cells = [F.struct(F.lit(i).alias("column"), _comparable(df, c).alias("value")) for i, c in mine]
            parts.append(df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull()).groupBy("value", "column").agg(F.count(F.lit(1)).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _comparable(df: DataFrame, column: str) -> Column:
    """A column's value as a string that equal values of other columns share."""
    c, kind = F.col("`" + column.replace("`", "``") + "`"), df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        if isinstance(kind, T.IntegralType):
            return c.cast("string")
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("double").cast("string"))
    return F.concat(F.lit("="), c.cast("string"))


def _words(columns: int) -> int:
    return -(-columns // 63)


def _holders(values: DataFrame, columns: int) -> DataFrame:
    """For every value its columns: ``held`` (column, n), at most one entry for each column, and bit sets ``w0``, ``w1``, ... of 63 columns each."""
    bits = [F.bit_or(F.when(F.floor(F.col("column") / 63) == w, F.expr("shiftleft(1L, column % 63)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(_words(columns))]
    return values.groupBy("value").agg(F.collect_list(F.struct("column", "n")).alias("held"), *bits)


def check_inclusions(tables: dict[tuple[str, str], DataFrame], references: Sequence[tuple[Name, Name]]) -> DataFrame:
    """Child rows and values without a parent for each of ``references`` (child, parent), all tested in one pass.

    Columns are (schema, table, column).  Values are counted per column, brought
    together once, and each value's set of columns answers every reference that
    starts at one of them; a hot value is one row per map task.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = sorted({c for pair in references for c in pair})
    place = {c: i for i, c in enumerate(columns)}
    asked = spark.createDataFrame([(*child, *parent, place[child], place[parent]) for child, parent in references],
                                  "schema_name string, table_name string, column_name string, parent_schema string, parent_table string, parent_column string, child int, parent int")
    if not references:
        return asked.select(*asked.columns[:6], *[F.lit(0).cast("bigint").alias(n) for n in ("child_rows", "orphan_count", "orphan_values")])
    sets = _holders(_values(tables, columns), len(columns))
    words = F.array(*[F.col(f"w{w}") for w in range(_words(len(columns)))])
    each = sets.select(words.alias("words"), F.inline("held")).withColumnRenamed("column", "child")
    has = F.expr("shiftrightunsigned(words[CAST(floor(parent / 63) AS INT)], parent % 63) & 1") == 1
    counted = each.join(asked.select("child", "parent").distinct(), "child").groupBy("child", "parent").agg(
        F.sum("n").alias("child_rows"), F.sum(F.when(has, 0).otherwise(F.col("n"))).alias("orphan_count"), F.count_if(~has).alias("orphan_values"))
    return asked.join(counted, ["child", "parent"], "left").fillna(0, ["child_rows", "orphan_count", "orphan_values"]).drop("child", "parent")


def inclusion_dependencies(tables: dict[tuple[str, str], DataFrame], columns: Sequence[Name]) -> DataFrame:
    """Every (child, parent) among ``columns`` such that each value of the child column occurs in the parent column.

    The sets of columns that hold each value are intersected, as bits, over the
    values of every column.  Columns without values are left out.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = list(columns)
    sets = _holders(_values(tables, columns), len(columns))
    words = [f"w{w}" for w in range(_words(len(columns)))]
    always = sets.select(*words, F.explode("held.column").alias("child")).groupBy("child").agg(*[F.bit_and(w).alias(w) for w in words], F.count("*").alias("child_values"))
    every = F.sequence(F.lit(0), F.lit(len(columns) - 1))
    pairs = always.select("child", "child_values", F.array(*words).alias("words"), F.explode(every).alias("parent")).filter(
        (F.col("child") != F.col("parent")) & (F.expr("shiftrightunsigned(words[CAST(floor(parent / 63) AS INT)], parent % 63) & 1") == 1))
    names = spark.createDataFrame([(i, *c) for i, c in enumerate(columns)], "place int, schema_name string, table_name string, column_name string")
    child = names.withColumnRenamed("place", "child")
    parent = names.select(F.col("place").alias("parent"), F.col("schema_name").alias("parent_schema"), F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"))
    return pairs.drop("words").join(child, "child").join(parent, "parent").drop("child", "parent")


def check_inferred_keys(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Orphan counts of every inferred relationship, those without orphans left out.

    Inference runs on the column catalog; only its result, at most one row per
    catalog column, comes back to the driver to name the columns to read.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = [(s, t, f.name) for (s, t), df in tables.items() for f in df.schema.fields]
    catalog = spark.createDataFrame(rows, "schema_name string, table_name string, column_name string")
    references = [((r.schema_name, r.table_name, r.column_name), (r.schema_name, r.parent_table, r.parent_column)) for r in infer_foreign_keys(catalog).toLocalIterator()]
    return check_inclusions(tables, references).filter("orphan_count > 0").select("schema_name", "table_name", "column_name", "parent_table", "parent_column", "orphan_count")
