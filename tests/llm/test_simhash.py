"""SimHash near-duplicates against brute force."""

import random
import itertools

import numpy as np
import pytest
import xxhash

from assay.llm import simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    """doc_id to the smallest id reachable, by comparing every pair."""
    prints = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return [(doc, f"{prints[i]:016x}", min((d for d in groups[root(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def near(bits, centre, rng):
    for b in rng.sample(range(64), bits):
        centre ^= 1 << b
    return centre


@pytest.mark.parametrize("n", [1, 31, 64, 65, 700])
def test_bit_sliced_hits_equal_direct_distances(n):
    rng = random.Random(n)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = np.array([near(rng.randrange(12), rng.choice(centres), rng) for _ in range(n)], dtype=np.uint64)
    sliced = simhash.planes(values)
    for radius in (0, 3, 4, 7):
        hits = simhash.near(values, sliced, radius)
        lanes = np.unpackbits(hits.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, :n]
        expected = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in values] for a in values])
        assert (lanes.astype(bool) == expected).all()


def test_every_close_pair_shares_a_mask():
    rng = random.Random(5)
    for n in (10, 10**5, 10**8, 10**11):
        masks = simhash.block_masks(n)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = near(4, a, rng)
            assert any(a & m == b & m for m in masks)


def documents(seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 60))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):  # one word more at the end of a long text
        rows.append((100 + i, base[i % 7] * 6 + " " + rng.choice(WORDS)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "oNE"), (305, "x" * 100_000), (7, base[7]), (7, base[7]), (None, base[3]), (None, "zz yy")]
    return rows


def test_query_equals_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(t, d, "c", "f") for d, t in rows], "text string, doc_id long, component_id string, fingerprint string").repartition(5)
    found = simhash.near_duplicates(df).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, slow_components(rows)))


def test_large_bucket_is_cut_without_losing_a_link(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = sorted({near(rng.randrange(9), centre, rng) for _ in range(400)})
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "print long")

    def roots(bucket_rows):
        parent = {v: v for v in values}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in simhash.near_links(df, bucket_rows=bucket_rows).collect():
            parent[root(a % 2**64)] = root(b % 2**64)
        return {frozenset(v for v in values if root(v) == r) for r in map(root, values)}

    whole = roots(4096)
    assert roots(40) == whole
    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            assert any(a in g and b in g for g in whole)


def test_one_row_of_each_component_stays(spark):
    rows = documents()
    df = spark.createDataFrame([(d, t, "s", 5) for d, t in rows], "doc_id long, text string, source string, n_chars int").repartition(4)
    kept = simhash.keep_first(df).collect()
    expected = {c for _, _, c in slow_components(rows) if c is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(expected)
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["zz yy"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "source", "n_chars"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_first(df).count() == 0


def test_whole_table(spark, sf):
    from assay.llm.queries import QUERIES

    found = QUERIES["op7_simhash"](spark, sf).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, found)) == sorted(slow_components(rows))
