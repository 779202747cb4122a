"""Jaccard near-duplicates against brute force."""

import itertools
import random

import numpy as np
import pytest

from assay.llm import shingle_sets, simhash

WORDS = [f"w{i}" for i in range(400)]


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """Smallest id of each component, by comparing every pair."""
    sets, parent = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return sorted(min(d for d in g if d is not None) for g in groups.values() if any(d is not None for d in g))


def documents():
    rng = random.Random(11)
    base = [rng.choices(WORDS, k=rng.choice([3, 5, 6, 40, 120, 300])) for _ in range(30)]
    line = rng.choices(WORDS, k=30)
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(160):  # some words changed: similarities on both sides of 0.8
        words = list(rng.choice(base))
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((100 + i, " ".join(words + (line if i % 3 == 0 else []))))
    rows += [(300, None), (301, ""), (302, " \n"), (303, rows[4][1].upper()), (3, rows[3][1]), (None, rows[5][1]), (None, "no id at all")]
    return rows


@pytest.mark.parametrize(("rows_", "pivots", "sample"), [(4096, 16, 16), (3, 1, 1), (5, 0, 16)])
def test_kept_rows_equal_brute_force(spark, monkeypatch, rows_, pivots, sample):
    """With whole buckets and groups, and with ones cut into many small parts."""
    for name in ("BUCKET_ROWS", "PART_ROWS"):
        monkeypatch.setattr(shingle_sets, name, rows_)
    monkeypatch.setattr(shingle_sets, "PIVOTS", pivots)
    monkeypatch.setattr(shingle_sets, "SAMPLE", sample)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = shingle_sets.keep_first(df).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == slow_kept(rows)
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id at all"]
    assert shingle_sets.keep_first(df.limit(0)).count() == 0


def test_stage_takes_copies_beyond_the_fingerprint_radius(spark, sf):
    """A pair with a similarity of at least 0.8 whose fingerprints differ in more than four bits."""
    import corpus_pipeline

    rng = random.Random(1)
    while True:
        words = rng.choices(WORDS, k=120)
        other = words[:20] + ["x"] + words[21:60] + ["y"] + words[61:]
        a, b = (" ".join(w) for w in (words, other))
        if (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 4:
            break
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, df, sf).collect()] == [1]


def test_a_bucket_of_dissimilar_texts(spark, monkeypatch):
    """Texts of one passage and two own words each, none similar to another, with a few copies among them."""
    rng = random.Random(4)
    passage = rng.choices(WORDS, k=17)
    rows = [(i, " ".join([*passage, f"own{i}", f"too{i}"])) for i in range(300)]
    rows += [(1000, rows[7][1] + " end"), (1001, "start " + rows[250][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    expected = slow_kept(rows)
    for part in (4096, 40):
        for name in ("BUCKET_ROWS", "PART_ROWS"):
            monkeypatch.setattr(shingle_sets, name, part)
        assert sorted(r["doc_id"] for r in shingle_sets.keep_first(df).collect()) == expected


def test_screening_loses_no_pair_at_the_similarity():
    """Fingerprints of 3 000 pairs of sets at 0.8 are all within the radius."""
    rng = np.random.default_rng(8)
    worst = 0
    for _ in range(3000):
        n = int(rng.choice([9, 18, 45, 180, 900]))
        values = rng.integers(0, 1 << 62, n + n // 9, dtype=np.uint64)
        a, b = values[:n], values[n // 9:]
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
        worst = max(worst, int(shingle_sets._fingerprint(a) ^ shingle_sets._fingerprint(b)).bit_count())
    assert worst <= shingle_sets.RADIUS


def test_shingles_do_not_depend_on_windows(monkeypatch):
    text = " ".join(random.Random(3).choices(WORDS, k=500)).encode()
    whole = shingle_sets.shingles(text, shingle_sets._Hasher())
    monkeypatch.setattr(shingle_sets, "_WINDOW", 7)
    assert (shingle_sets.shingles(text, shingle_sets._Hasher()) == whole).all() and len(whole) == 496
