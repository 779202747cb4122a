"""Minimal keys without a digest of every row."""

import datetime
import itertools
import random

import pytest

from assay.operators import keys


@pytest.mark.parametrize("slices", [(64, 8), ()])
def test_keys_are_found_without_grouping_all_rows(spark, monkeypatch, slices):
    """Sets refuted by slices, or all compared on the rows whose part comes twice; one pair of rows spoils (a, b) and (a, b, c)."""
    def whole(*_):
        raise AssertionError("all rows were grouped")

    monkeypatch.setattr(keys, "SLICES", slices)
    monkeypatch.setattr(keys, "exact_groups", whole)
    rng = random.Random(3)
    rows = [(i // 4, i % 4, rng.randrange(3), rng.randrange(10**6), i % 4 if i != 7 else 2) for i in range(800)]
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    unique = []
    for size in (1, 2, 3):
        for s in itertools.combinations(range(5), size):
            if not any(set(k) <= set(s) for k in unique) and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                unique.append(s)
    assert keys.minimal_keys(df) == [tuple(names[i] for i in s) for s in unique] and ("a", "b") in keys.minimal_keys(df)


def test_only_single_columns_are_sketched_and_slices_tell_near_keys(spark, monkeypatch):
    """Sets of more columns are refuted by slices; what is left is compared on parts that nearly all rows differ on."""
    sketched, based, estimate, bases = [], [], keys.estimated_groups, keys._bases

    def estimated(df, sets):
        sketched.extend(sets)
        return estimate(df, sets)

    def chosen(sets, near):
        based.append(list(bases(sets, near)))
        return dict(zip(based[-1], bases(sets, near).values()))

    monkeypatch.setattr(keys, "SLICES", (8, 4))
    monkeypatch.setattr(keys, "NEAR", 0.2)
    monkeypatch.setattr(keys, "estimated_groups", estimated)
    monkeypatch.setattr(keys, "_bases", chosen)
    rng = random.Random(5)
    rows = [(i // 2, i // 2 % 150 * 3 + i % 2 * (i % 40 > 1), rng.randrange(50), i % 2, i // 300) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, e long").repartition(4)
    names, unique = df.columns, []
    for size in (1, 2, 3):
        unique += [s for s in itertools.combinations(range(5), size) if not any(set(k) <= set(s) for k in unique) and len({tuple(r[i] for i in s) for r in rows}) == len(rows)]
    assert keys.minimal_keys(df) == [tuple(names[i] for i in s) for s in unique] and unique
    assert sketched == [(n,) for n in names] and based


@pytest.mark.parametrize("slices", [(4, 2), ()])
def test_times_that_differ_by_microseconds_and_common_values(spark, monkeypatch, slices):
    """One key of times and numbers; a value that a third of the rows has spoils the text."""
    monkeypatch.setattr(keys, "SLICES", slices)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(microseconds=i), f"v{i}" if i % 3 else "0", -0.0 if i % 2 else 0.0) for i in range(90)]
    for some, unique in ((rows, [("at",)]), (rows + rows[:1], [])):
        assert keys.minimal_keys(spark.createDataFrame(some, "at timestamp, text string, zero double").repartition(3)) == unique
