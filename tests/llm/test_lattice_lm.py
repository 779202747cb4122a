"""Lattice sums against enumerated segmentations, and the query against direct counts."""

import math
import os
import random
import zlib

import numpy as np
import pytest

from assay.llm import lattice_lm as lm
from assay.llm.queries import QUERIES

BYTES = [f"<0x{b:02X}>" for b in range(256)]
PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab", "c", "▁cab", *BYTES]


def lattice():
    rng = np.random.default_rng(1)
    p = rng.random(len(PIECES) + 1) + 0.05
    return lm.Lattice(PIECES, np.log(p / p.sum()))


def segmentations(text, table):
    """Every way to write ``text``: lists of pieces; a character without a piece is spelled in bytes."""
    if not text:
        yield []
        return
    for n in range(1, len(text) + 1):
        if text[:n] in table.ids:
            first = [table.ids[text[:n]]]
        elif n == 1:
            first = [PIECES.index(f"<0x{b:02X}>") for b in text[0].encode()]
        else:
            continue
        for rest in segmentations(text[n:], table):
            yield first + rest


WORDS = ["a", "ab", "abab", "cabab", "babbab", "x", "axb", "é中", "", "c" * 9, "abcabcabca"]


@pytest.mark.parametrize("word", WORDS)
def test_sum_over_all_segmentations(word):
    table = lattice()
    ways = [math.exp(table.logs[w].sum()) for w in segmentations("▁" + word, table)]
    expected = np.zeros(len(table.logs))
    for w, p in zip(segmentations("▁" + word, table), ways):
        for i in w:
            expected[i] += 3.0 * p / sum(ways)
    for run in ("many", "one"):
        counts = np.zeros(len(table.logs))
        if run == "many":
            sums, counts = table.log_sums([word, "ab"], np.array([3.0, 0.0]))
            total = sums[0]
        else:
            total = table._one(word, counts, 3.0)
        assert total == pytest.approx(math.log(sum(ways)))
        assert counts == pytest.approx(expected)


def test_probabilities_of_short_texts_sum_to_less_than_one():
    table = lattice()
    words = ["".join(w) for n in range(4) for w in __import__("itertools").product("abc", repeat=n)]
    assert sum(math.exp(x) for x in table.log_sums(words)[0]) < 1


def test_estimation_raises_the_likelihood():
    rng = random.Random(4)
    words = ["".join(rng.choices("abc", weights=(5, 3, 1), k=rng.randrange(1, 8))) for _ in range(200)]
    weights, logs, last = np.ones(len(words)), lattice().logs, -math.inf
    for _ in range(4):
        sums, counts = lm.Lattice(PIECES, logs).log_sums(words, weights)
        now = sums.sum() + len(words) * logs[-1]
        assert now > last
        last, counts[-1] = now, len(words)
        logs = np.log(np.maximum(counts, 1e-300) / counts.sum())


needs_vocabulary = pytest.mark.skipif(not os.path.exists(lm.VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_odd_rows(spark):
    rows = [(1, None, True), (2, "", True), (3, "One two two", True), (3, "One two two", True), (4, "one ｔｈree 中文 x" + "y" * 20_000, False), (None, " \n", None), (5, "two", True)]
    df = spark.createDataFrame([(d, t, h, "s", 1) for d, t, h in rows], "doc_id long, text string, train boolean, token string, n int").repartition(3)
    wide = lm.score(df, "train", frequent=1_000_000).collect()
    joined = lm.score(df, "train", frequent=1).collect()
    assert len(wide) == len(rows) and [r["doc_id"] for r in wide].count(3) == 2
    for a, b in zip(sorted(wide, key=str), sorted(joined, key=str)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    n = 4 + 1 + 4 + 4 + 2 - 3  # words and ends of the training rows
    found = {r["doc_id"]: r for r in wide}
    assert {r["train_tokens"] for r in wide} == {n}
    assert found[1]["n_tokens"] == found[2]["n_tokens"] == found[None]["n_tokens"] == 1
    assert found[4]["n_tokens"] == 5 and found[4]["n_known"] == 2
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in wide)


@needs_vocabulary
def test_empty_and_untrained_tables(spark):
    df = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")
    assert lm.score(df.limit(0), "train").count() == 0
    only = lm.score(df, "train").first()
    assert (only["n_tokens"], only["n_known"], only["train_tokens"]) == (3, 0, 0) and math.isfinite(only["base_score"])


@needs_vocabulary
def test_whole_table(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts, total = {}, 0
    for d, tokens in docs.items():
        if zlib.crc32(str(d).encode()) % 10:
            total += len(tokens)
            for t in tokens:
                counts[t] = counts.get(t, 0) + 1
    found = QUERIES["op3_lm_score"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        tokens = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(t in counts for t in tokens), total)
        base = sum(math.log10((counts.get(t, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for t in tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    # Real words are likelier than their letters in another order.
    pieces, scores = lm.vocabulary(lm.VOCABULARY)
    words = [t.decode() for t in sorted(counts, key=counts.get, reverse=True)[1:200] if len(t) > 3]
    table = lm.Lattice(pieces, lm.initial(pieces, scores))
    assert np.mean(table.log_sums(words)[0]) > np.mean(table.log_sums([w[::-1] for w in words])[0])
