"""Spelling variants against brute force over all pairs."""

import itertools
import random
import zlib

import numpy as np
import pytest

from assay.llm import bloom, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow(counts, ratio=10):
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def vocabulary():
    rng = random.Random(5)
    words = {"".join(rng.choices("abcéÿ", k=rng.choice([1, 2, 7, 8, 9]))) for _ in range(300)}
    for w in list(words)[:200]:
        at = rng.randrange(len(w))
        words |= {w[:at] + w[at + 1:], w[:at] + rng.choice("abcdé÷") + w[at + 1:], w[:at] + rng.choice("abcz") + w[at:]}
    long = "".join(rng.choices("abc", k=130))
    words |= {long, long[:-1], long[1:], "b" + long, long[:64], long[:63], "aaaaaaaa", "aaaaaaaaa", "aaaaaaa"}
    chain = ["wwwwwwww", "wwwwwwwx", "wwwwwwyx", "wwwwwzyx", "wwwwvzyx", "wwwuvzyx"]
    counts = {w: rng.choice([2, 3, 20, 30, 200, 300, 5000]) for w in words - {""}}
    return counts | {w: 10 ** i for i, w in enumerate(chain, 1)}


@pytest.mark.parametrize(("unit", "room"), [(1 << 22, 32 << 20), (40, 128)])
def test_variants_equal_brute_force(spark, monkeypatch, unit, room):
    """In one pass, and with many small filters in many passes."""
    monkeypatch.setattr(spelling, "UNIT_WORDS", unit)
    monkeypatch.setattr(spelling, "PASS_BYTES", room)
    counts = vocabulary()
    if unit == 40:
        counts = {w: n for w, n in counts.items() if len(w) in (1, 2, 9)}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    assert len(spelling._passes({7: 10, 8: 100})) == (1 if unit > 100 else 4)
    found = spelling.group_variants(df)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect())) == slow(counts)


def test_empty_and_odd_tables(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert [tuple(r) for r in spelling.group_variants(spark.createDataFrame([("a", 2)], "word string, n long")).collect()] == [("a", None, "a", 2, 0, None)]


def test_runs_counts_and_errors(spark):
    import re

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Straßen", "ABCDEFGH", "éléphants", "ÉLÉPHANTS", "short", "xylophonist", "a×b÷cdefg"]) + rng.choice(["", "1", "_x", "ABCDEFG"]) for _ in range(300)) for _ in range(5)]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (7, None), (8, ""), (9, "z" * 300_000 + " " + "z" * 300_000)]
    runs = spelling.letter_runs(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, run string"))
    counted = spelling.count_words(runs.select(spelling.misspelt(runs["run"], runs["doc_id"]).alias("word")))
    counts = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    assert dict(map(tuple, counted.collect())) == {w: n for w, n in counts.items() if n >= 2}


def test_bloom_filters_hold_their_keys(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-1 << 63, (1 << 63) - 1, 20_000)
    df = spark.createDataFrame([(int(k % 3), int(k)) for k in keys], "unit int, hash long")
    blocks = {u: bloom.blocks_for(7000) for u in range(3)}
    table, starts = bloom.build(df, lambda batch: (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)), blocks)
    for u in range(3):
        mine = keys[keys % 3 == u].view(np.uint64)
        assert bloom.contains(table, mine, blocks[u], starts[u]).all()
    strangers = rng.integers(-1 << 63, (1 << 63) - 1, 100_000).view(np.uint64)
    assert bloom.contains(table, strangers, blocks[1], starts[1]).mean() < 0.01
