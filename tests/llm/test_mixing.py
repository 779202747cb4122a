"""Mixing against exact fractions and a direct walk over the documents."""

import hashlib
import random
import re
from fractions import Fraction

import pytest

from assay.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, weights=(5, 2, 1), epochs=2, share=Fraction(3, 2)):
    """Excess over a bound goes to the rest by weight, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, bound = share * sum(sizes.values()), {s: epochs * n for s, n in sizes.items()}
    target = {s: total * weight[s] / sum(weight.values()) for s in order}
    while over := [s for s in order if target[s] > bound[s]]:
        excess = sum(target[s] - bound[s] for s in over)
        for s in over:
            target[s] = Fraction(bound[s])
        rest = [s for s in order if target[s] < bound[s]]
        if not rest:
            break
        for s in rest:
            target[s] += excess * weight[s] / sum(weight[r] for r in rest)
    return target


def check(spark, rows):
    df = spark.createDataFrame([(d, t, s, 5, "k") for d, t, s in rows], "doc_id long, text string, source string, size int, n string").repartition(5)
    found = mixing.mix(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = slow_targets(sizes)
    assert len(found) == len(rows)
    for s in sizes:
        mine = [r for r in found if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert mine[0]["target"] == pytest.approx(float(target[s]))
        assert sum(r["taken"] for r in mine) == int(target[s])
        # Full rounds first, then documents in the order of their keys.
        rounds = 0 if not sizes[s] else int(target[s]) // sizes[s]
        left = int(target[s]) - rounds * sizes[s]
        for r in sorted(mine, key=lambda r: hashlib.md5(b"|".join([b"mix", *([str(r["doc_id"]).encode()] if r["doc_id"] is not None else [])])).hexdigest()):
            part = min(left, r["size"])
            left -= part
            if sum(x["doc_id"] == r["doc_id"] for x in mine) == 1:
                assert r["taken"] == rounds * r["size"] + part
            assert 0 <= r["taken"] <= 2 * r["size"] == 2 * size(r["text"])
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    return found


def test_sources_of_all_kinds(spark):
    rng = random.Random(1)
    names = ["b", "a", None, "é", "", "Z", "\U0001d11e", "￮"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(names[: 1 + i % 8])) for i in range(300)]
    check(spark, rows + [(900, None, "a"), (901, "", None), (902, " \n", "empty"), (7, rows[7][1], rows[7][2]), (None, "x y", "a"), (None, "x y z", "a"), (903, "w " * 50_000, "Z")])


def test_small_tables(spark):
    check(spark, [(1, None, "a"), (2, "", None)])
    check(spark, [(1, "a b c", "x")])
    check(spark, [(1, "a b c", "x"), (2, "a " * 100, "y"), (3, "d", "z"), (4, "d", "zz")])
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_copies_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 9)), "ab"[i % 5 == 0]) for i in range(60)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    copies = mixing.copies(mixed).collect()
    words = {}
    for r in copies:
        assert len(WORD.findall(r["text"])) == r["words"] > 0
        assert rows[r["doc_id"]][1].startswith(r["text"])
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["words"]
    assert words == {d: n for d, n in taken.items() if n}
