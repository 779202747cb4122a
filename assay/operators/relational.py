"""Join and merge shapes used across the families.

Two habits keep these shapes safe when one key holds a large share of the rows:

* keys are counted before they are joined, so a hot key crosses the shuffle as
  one row per map task instead of as all its rows;
* "newest n per key" is ``row_number() <= n``, which Spark trims to n rows per
  key on the map side (WindowGroupLimit) before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows, or all for None."""
    return df if n is None else df.limit(n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None = 1,
                   rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, or all for None; ``order`` must be total."""
    if n is None and not rank:
        return df
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked if n is None else ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def key_counts(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key, combined on the map side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def unmatched_counts(child: DataFrame, child_keys: Sequence[str], parent: DataFrame,
                     parent_keys: Sequence[str]) -> DataFrame:
    """Child keys (none of them NULL) without a parent, with their row counts."""
    filled = child.dropna(subset=list(child_keys))
    counted = key_counts(filled, child_keys)
    names = [f"_p{i}" for i in range(len(parent_keys))]
    parents = parent.select(*[F.col(p).alias(n) for p, n in zip(parent_keys, names)]).dropna().distinct()
    cond = [F.col(c) == F.col(n) for c, n in zip(child_keys, names)]
    return counted.join(parents, cond, "left_anti")


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def exists_flag(left: DataFrame, right: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Existence as a projected flag; ``left`` keeps its row count."""
    hits = right.select(*keys).distinct().withColumn(out, F.lit(True))
    return left.join(hits, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def newest_values(history: DataFrame, keys: Sequence[str], order: Sequence[Column], sort_by: str,
                  value: str, n: int, out: str) -> DataFrame:
    """The newest ``n`` values of each key as an array, oldest first."""
    newest = latest_per_key(history, keys, order, n)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(sort_by), F.col(value))))
    return newest.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(out))


def touching(nodes: DataFrame, node_key: str, edges: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes at either end of an edge, as two equi joins instead of an OR."""
    ends = edges.select(F.col(source).alias(node_key)).unionByName(edges.select(F.col(target).alias(node_key)))
    return nodes.join(ends.distinct(), node_key, "left_semi")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Each row next to its predecessor's values (``prev_<name>``).

    For frames with a bounded number of rows per key; :func:`previous_run`
    takes a whole history.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev_{v}": F.lag(v).over(w) for v in values})


def previous_run(history: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """J9 over a history of any length."""
    return trailing(history, keys, ts, 1, {f"prev_{v}": (lambda w, v=v: F.last(v).over(w)) for v in values})


def trailing(df: DataFrame, keys: Sequence[str], ts: str, n: int, exprs: dict[str, Callable[[WindowSpec], Column]],
             unit: str = "month") -> DataFrame:
    """Expressions over the ``n`` rows before each row of a key, in order of ``ts``.

    The result is that of one window per key, but no task sees a whole key:
    rows are windowed per key and ``unit`` of time.  Only the first ``n`` rows
    of a unit look back further; they are computed from the first and last
    ``n`` rows of each unit, which is all they can reach.  ``ts`` must be
    unique within a key.
    """
    unit_keys = [*keys, "_unit"]
    parts = df.withColumn("_unit", F.date_trunc(unit, F.col(ts)))
    forward = Window.partitionBy(*unit_keys).orderBy(ts)
    numbered = parts.withColumns({"_pos": F.row_number().over(forward), "_size": F.count(F.lit(1)).over(Window.partitionBy(*unit_keys))})
    # Units without inner rows, all of them if runs are rare, take no part in the windows inside units.
    inner = numbered.filter(F.col("_size") > n).withColumns({name: make(forward.rowsBetween(-n, -1)) for name, make in exprs.items()}).filter(F.col("_pos") > n)
    edges = numbered.filter((F.col("_pos") <= n) | (F.col("_pos") > F.col("_size") - n))
    across = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-n, -1)
    heads = edges.withColumns({name: make(across) for name, make in exprs.items()}).filter(F.col("_pos") <= n)
    return inner.unionByName(heads).drop("_unit", "_pos", "_size")


def merge_keyed(existing: DataFrame, updates: DataFrame, keys: Sequence[str],
                set_columns: Sequence[str] | None = None, insert_only: bool = False,
                replace_when: Column | None = None) -> DataFrame:
    """M1: keyed upsert of ``updates`` into ``existing``.

    ``set_columns`` limits what an update may overwrite (default: every
    non-key column), ``insert_only`` leaves matched rows alone, and
    ``replace_when`` is a condition on the existing row, e.g. ``status = draft``.
    NULL keys match NULL keys.  ``updates`` must hold one row per key.
    """
    values = [c for c in existing.columns if c not in keys]
    overwrite = set() if insert_only else set(values if set_columns is None else set_columns)
    left = existing.withColumn("_old", F.lit(True)).alias("o")
    right = updates.withColumn("_new", F.lit(True)).alias("u")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    joined = left.join(right, cond, "full_outer")
    inserted = F.col("o._old").isNull()
    allowed = F.col("u._new").isNotNull()
    if replace_when is not None:
        allowed = allowed & F.coalesce(replace_when, F.lit(False))
    out = [F.when(inserted, F.col(f"u.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys]
    for v in values:
        has_new = v in updates.columns
        new = F.col(f"u.{v}") if has_new else F.lit(None).cast(existing.schema[v].dataType)
        take_new = inserted | allowed if v in overwrite and has_new else inserted
        out.append(F.when(take_new, new).otherwise(F.col(f"o.{v}")).alias(v))
    return joined.select(*out).select(*existing.columns)


def changed_columns(previous: DataFrame, current: DataFrame, keys: Sequence[str] = (), name: str = "column_name",
                    value: str = "data_type") -> DataFrame:
    """Full-outer comparison of two (name, type) sets, within ``keys`` if given; unchanged names are left out."""
    key = [*keys, name]
    p = previous.select(*key, F.upper(F.coalesce(F.col(value), F.lit(""))).alias("old_type"))
    c = current.select(*key, F.upper(F.coalesce(F.col(value), F.lit(""))).alias("new_type"))
    both = p.join(c, key, "full_outer")
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "dropped")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull())
