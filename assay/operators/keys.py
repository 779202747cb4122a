"""Composite keys and dependencies that the data shows.

Sets of columns are searched level by level, one more column at a time.  A set
partitions the rows into groups of equal values; adding a column refines the
partition, so only the numbers of groups matter: a set is a key if it has as
many groups as there are rows, and X determines A if adding A makes no new ones.
For dependencies, HyperLogLog counts of all sets of a level come from one scan
and rule out most; only what they leave open is counted exactly, all in one pass.
For keys only single columns are sketched: two rows that agree in a slice of the
values refute most sets, and all rows are looked at for the rest.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text
from assay.operators.profile import profiled_fields
from assay.session import staged_table

# log2 of the registers of a sketch, its relative standard deviation, and how many of these an estimate may be off.
SKETCH_LG = 13
ERROR, SIGMAS = 1.04 / 2 ** (SKETCH_LG / 2), 5
# Sets estimated by one scan; more of them would outgrow generated code.
SETS_PER_SCAN = 100
# Slices of the values that are searched for two equal ones before all are: one in so many.
SLICES = (512, 16)
# Rows that are compared on every set beside those of a slice: one in so many times the slices.
ALL_SETS = 8
# Hashes that one task looks through for some that come twice.
HASHES_PER_TASK = 2**20
# Share of rows up to which the rows that agree with others on a set are few.
NEAR = 0.001

_Set = tuple[str, ...]


def _cells(df: DataFrame) -> dict[str, Column]:
    """Every column that can be grouped, in a form that equal values share."""
    return {f.name: text.comparable(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in profiled_fields(df)}


def estimated_groups(df: DataFrame, sets: Sequence[_Set]) -> dict[_Set, int]:
    """About how many groups each set of columns makes, NULL being a value."""
    cells, out = _cells(df), {}
    for at in range(0, len(sets), SETS_PER_SCAN):
        some = sets[at:at + SETS_PER_SCAN]
        row = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[cells[c] for c in s]), SKETCH_LG)).alias(f"n{i}") for i, s in enumerate(some)]).first()
        out.update(zip(some, row))
    return out


def exact_groups(df: DataFrame, sets: Sequence[_Set]) -> dict[_Set, int]:
    """How many groups each set of columns makes, NULL being a value; one pass for all sets."""
    if not sets:
        return {}
    cells = _cells(df)
    spread = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("set"), _digest(cells, s).alias("digest")) for i, s in enumerate(sets)])))
    counted = {r["set"]: r["n"] for r in spread.groupBy("set", "digest").agg(F.lit(1)).groupBy("set").agg(F.count("*").alias("n")).toLocalIterator()}
    return {s: counted.get(i, 0) for i, s in enumerate(sets)}


def _digest(cells: dict[str, Column], columns: _Set) -> Column:
    return F.sha2(F.to_json(F.struct(*[cells[c].alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def _agreeing(rows: DataFrame, cells: dict[str, Column], picks: Column, sets: Sequence[_Set]) -> dict[_Set, tuple[int, int]]:
    """Rows and groups of each of ``sets``, all of one size, among the ``rows`` that ``picks`` deals to it.

    ``picks`` lists numbers of sets with the places of their columns in ``cells``, see ``_members``.
    Values are equal if two hashes of them are, 128 bits in all.
    """
    hashes = [F.array(*[F.xxhash64(F.lit(seed), c) for c in cells.values()]).alias(f"_hash{seed}") for seed in (1, 2)]
    spread = rows.select(*hashes, F.explode(picks).alias("_pick"))
    parts = [F.xxhash64(F.lit(seed), *[F.get(f"_hash{seed}", F.get("_pick", F.lit(k))) for k in range(1, len(sets[0]) + 1)]).alias(f"part{seed}") for seed in (1, 2)]
    groups = spread.select(F.get("_pick", F.lit(0)).alias("set"), *parts).groupBy("set", "part1", "part2").agg(F.count("*").alias("n"))
    counted = groups.groupBy("set").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))
    return {sets[r["set"]]: (r["rows"], r["groups"]) for r in counted.toLocalIterator()}


def _members(numbers: Iterable[int], sets: Sequence[_Set], names: Sequence[str]) -> Column:
    """For each of the numbered sets: its number and the places of its columns in ``names``."""
    return F.lit([[i, *[names.index(c) for c in sets[i]]] for i in numbers])


def _in_slice(df: DataFrame, sets: Sequence[_Set], parts: int, single: dict[_Set, int]) -> dict[_Set, tuple[int, int]]:
    """Rows and groups of each of ``sets`` in one of ``parts`` slices of the values of its column with most of them.

    Rows that agree on a set are in the same slice, and only rows of the slices are hashed set by set.  Fewer rows,
    picked by all their values, are compared on every set: they show the values that a large share of the rows has.
    """
    cells = _cells(df)
    names = sorted({c for s in sets for c in s})
    leads: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        leads.setdefault(max(s, key=lambda c: single[c,]), []).append(i)
    inside = {c: F.pmod(F.xxhash64(cells[c]), F.lit(parts)) == 0 for c in leads}
    chosen = F.pmod(F.xxhash64(*[cells[c] for c in names]), F.lit(parts * ALL_SETS)) == 0
    sliced = F.flatten(F.array_compact(F.array(*[F.when(inside[c], _members(some, sets, names)) for c, some in leads.items()])))
    picks = F.when(chosen, _members(range(len(sets)), sets, names)).otherwise(sliced)
    return _agreeing(df.filter(functools.reduce(Column.__or__, inside.values(), chosen)), {c: cells[c] for c in names}, picks, sets)


def _bases(sets: Sequence[_Set], near: dict[_Set, float]) -> dict[_Set, list[int]]:
    """Few sets out of ``near`` (set, groups per row) of which each of ``sets`` contains one, itself if need be, and the numbers of those."""
    left, out = dict(enumerate(sets)), {}
    while left:
        best = max([*left.values(), *near], key=lambda b: (sum(set(b) <= set(s) for s in left.values()), near.get(b, 1)))
        out[best] = [i for i, s in left.items() if set(best) <= set(s)]
        left = {i: s for i, s in left.items() if i not in out[best]}
    return out


def shared_sets(df: DataFrame, rows: int, sets: Sequence[_Set], single: dict[_Set, int], near: dict[_Set, float]) -> set[_Set]:
    """Those of ``sets``, all of one size, on which two rows agree; ``near`` gains those that nearly all rows differ on.

    Slices of the values show this of most of them.  Rows that agree on one of
    the rest also agree on any part of it, so that for all rest that share a part
    with nearly as many groups as rows (``near``) only rows are compared whose
    part comes twice, which are few.
    """
    found: set[_Set] = set()
    close: dict[_Set, float] = {}
    for parts in SLICES:
        if left := [s for s in sets if s not in found]:
            seen = _in_slice(df, left, parts, single)
            found |= {s for s, (n, groups) in seen.items() if groups < n}
            close.update((s, groups / n) for s, (n, groups) in seen.items() if groups >= n * (1 - NEAR))
    left = [s for s in sets if s not in found]
    if left:
        found |= _shared_at_all(df, rows, left, near)
    near.update((s, share) for s, share in close.items() if s in found)
    return found


def _shared_at_all(df: DataFrame, rows: int, sets: Sequence[_Set], near: dict[_Set, float]) -> set[_Set]:
    """Those of ``sets`` on which two rows agree, all ``rows`` looked at.

    Nearly all hashes come once, so that counting them before the shuffle would only fill memory.
    """
    cells, bases = _cells(df), _bases(sets, near)
    parts = F.array(*[F.struct(F.lit(j).alias("base"), F.xxhash64(F.lit(j), *[cells[c] for c in b]).alias("hash")) for j, b in enumerate(bases)])
    hashes = df.select(F.inline(parts)).select("hash").repartition(rows * len(bases) // HASHES_PER_TASK + 1, "hash")
    twice = staged_table(hashes.groupBy("hash").count().filter("count > 1").select("hash"))
    if twice.isEmpty():
        return set()
    names = sorted({c for s in sets for c in s})
    few = df.select(*[cells[c].alias(f"_{i}") for i, c in enumerate(names)], F.inline(parts)).join(twice, "hash", "left_semi")
    picks = F.get(F.array(*[_members(some, sets, names) for some in bases.values()]), F.col("base"))
    seen = _agreeing(few, {c: F.col(f"_{i}") for i, c in enumerate(names)}, picks, sets)
    return {s for s, (n, groups) in seen.items() if groups < n}


def minimal_keys(df: DataFrame, max_columns: int = 3, columns: Iterable[str] | None = None) -> list[_Set]:
    """The sets of at most ``max_columns`` columns without NULLs that no two rows agree on, and that need all of their columns.

    Sets that contain a key are not looked at again, nor are those whose columns
    have too few values between them.  A table with fewer than two rows has no keys to show.
    """
    names = [c for c in _cells(df) if columns is None or c in set(columns)]
    first = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("`" + c.replace("`", "``") + "`").isNull()).alias(f"nulls_{i}") for i, c in enumerate(names)]).first()
    rows, filled = first["rows"], [c for i, c in enumerate(names) if first[f"nulls_{i}"] == 0]
    if rows < 2:
        return []
    least = rows * (1 - SIGMAS * ERROR)
    found: list[_Set] = []
    near: dict[_Set, float] = {}
    single = estimated_groups(df, [(c,) for c in filled])
    for size in range(1, min(max_columns, len(filled)) + 1):
        level = [s for s in itertools.combinations(filled, size) if not any(set(k) <= set(s) for k in found) and _product(single, s) >= least]
        shared = shared_sets(df, rows, level, single, near)
        found += [s for s in level if s not in shared]
    return found


def _product(single: dict[_Set, int], columns: _Set) -> float:
    """How many groups the columns can make at most, allowing for the error of their estimates."""
    out = 1.0
    for c in columns:
        out *= single[c,] * (1 + SIGMAS * ERROR) + 1
    return out


def dependencies(df: DataFrame, max_left: int = 1, columns: Iterable[str] | None = None) -> list[tuple[_Set, str]]:
    """(columns, value): what at most ``max_left`` columns determine, in the least form; keys and constant columns are left out.

    NULL is a value like any other.
    """
    names = [c for c in _cells(df) if columns is None or c in set(columns)]
    rows = df.count()
    if rows < 2:
        return []
    single = estimated_groups(df, [(c,) for c in names])
    constant = {s[0] for s, n in exact_groups(df, [s for s, n in single.items() if n <= 2]).items() if n == 1}
    names = [c for c in names if c not in constant]
    known: list[tuple[_Set, str]] = []
    keys: list[_Set] = []
    for size in range(1, max_left + 1):
        lefts = [s for s in itertools.combinations(names, size) if not any(set(k) <= set(s) for k in keys)]
        pairs = [(s, a) for s in lefts for a in names if a not in s and not any(v == a and set(x) <= set(s) for x, v in known)]
        joint = {(s, a): tuple(sorted((*s, a))) for s, a in pairs}
        guessed = estimated_groups(df, sorted({*lefts, *joint.values()}))
        close = [p for p in pairs if guessed[joint[p]] <= guessed[p[0]] * (1 + SIGMAS * ERROR) / (1 - SIGMAS * ERROR) + 1]
        unsure = [s for s in lefts if guessed[s] >= rows * (1 - SIGMAS * ERROR)]
        exact = exact_groups(df, sorted({*unsure, *[s for s, _ in close], *[joint[p] for p in close]}))
        keys += [s for s in unsure if exact[s] == rows]
        known += [(s, a) for s, a in close if exact[s] == exact[joint[s, a]] and s not in keys]
    return known


def key_rules(spark, keys: Sequence[_Set], found: Sequence[tuple[_Set, str]] = ()) -> DataFrame:
    """Typed rules (R23, R27) for keys and dependencies: rule_type, columns, check_args."""
    rows = [("UNIQUE", ",".join(k), json.dumps({"columns": list(k)})) for k in keys]
    rows += [("DEPENDENCY", ",".join(x), json.dumps({"columns": list(x), "value": a})) for x, a in found]
    return spark.createDataFrame(rows, "rule_type string, columns string, check_args string")
