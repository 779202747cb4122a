"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assay.llm import collocation


def slow(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        dropped = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner = p[i:i + k]
                    if 100 * a >= 80 * candidates.get(inner, 1 << 60):
                        dropped.add(inner)
        ranked = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, l, r = min((2_000_000 * a // (counts[p[:c]] + counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def documents():
    rng = random.Random(9)
    words = ["the", "of", "New", "york", "city", "a", "Été", "x\x1cy", "big", "apple", *[f"w{i}" for i in range(40)]]
    weights = [30, 25, 8, 8, 6, 20, 5, 3, 4, 4, *[1] * 40]

    def text():
        out = []
        for _ in range(rng.randrange(60)):
            out += rng.choice([["new", "York", "city"], ["new", "york"], ["big", "apple", "of", "the"], rng.choices(words, weights, k=4)])
            out.append(rng.choice(["", "", ".", "!", "\n", " \t "]))
        return " ".join(out)

    rows = [(i, text(), rng.choice(["en", "en", "fr", None, "und"])) for i in range(150)]
    rows += [(200, None, "en"), (201, "", "en"), (None, text(), "en"), rows[0], rows[0], (202, "only once here", "zz"), (203, "....", "yy"), (204, "la la la la la la la la la la la la", "it")]
    return rows


@pytest.mark.parametrize(("support", "sample", "blocks", "chunk"), [(6, 4, 1 << 17, 8 << 20), (6, 40, 1 << 17, 500), (3, 4, 1, 100)])
def test_equals_brute_force(spark, monkeypatch, support, sample, blocks, chunk):
    """With a good sample, with one that misses much of the border, and with filters that hold almost anything."""
    monkeypatch.setattr(collocation, "SAMPLE", sample)
    monkeypatch.setattr(collocation, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(collocation, "CHUNK", chunk)
    rows = documents()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, phrase string").repartition(5)
    found = sorted(map(tuple, collocation.collocations(df, support, 40).collect()))
    assert found == slow(rows, support, 40)


def test_border_failures_are_expanded(spark, monkeypatch):
    """Phrases that the sampled documents lack altogether are found all the same."""
    rows = [(i, "alpha beta gamma delta. ", "en") for i in range(40)] + [(100, "one word more", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(collocation, "SAMPLE", 1 << 40)
    assert sorted(map(tuple, collocation.collocations(df, 30).collect())) == slow(rows, 30, 2000)


def test_a_pair_held_by_mistake_hides_no_longer_phrase():
    """A first pass whose filter holds two words, and by mistake every pair, meets neither of the longer phrases."""
    words = collocation._word_hashes([b"beta", b"gamma"], "en")
    before = lambda k, hashes: np.isin(hashes, words) if k == 1 else np.ones(len(hashes), dtype=bool)
    met = lambda known, old: {p.decode() for _, phrases, _ in collocation._counts(b"alpha beta gamma\xff", "en", range(2, 5), known, old) for p in phrases.to_pylist()}
    assert met(before, None) == {"beta gamma"}
    assert met(lambda k, hashes: np.ones(len(hashes), dtype=bool), before) == {"alpha beta", "alpha beta gamma"}


def test_products_beyond_64_bits(spark):
    big = 1 << 62
    counted = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1)], "lang string, k int, phrase string, f long")
    candidates = spark.createDataFrame([("en", 2, "a b", big - 2)], "lang string, k int, phrase string, a long")
    row = collocation._cuts(candidates, counted).first()
    assert row["score"] == 2_000_000 * (big - 2) // (2 * big - 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocation.collocations(df).collect() == []
