"""Nearest neighbours against brute force."""

import itertools
import math

import numpy as np
import pytest

from assay.llm import curve_ann as ann
from assay.llm.queries import QUERIES


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    place = ann.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute_force(rows, k=5, every=50):
    """query: [(vec_id, score)] over all rows."""
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            scores = [(-(v * w).sum() / (math.sqrt((v * v).sum()) * math.sqrt((w * w).sum())), i) for i, w in ok if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def answers(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(found, exact):
    hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in best}) for q, best in exact.items())
    return hits / sum(map(len, exact.values()))


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(260)]
    common = rows[7][1]
    rows += [(i, common) for i in range(300, 420)] + [(500, common), (501, [x * 2 for x in rows[3][1]])]  # copies
    rows += [(600, None), (601, []), (602, [0.0] * 6), (603, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (604, [float("nan")] * 6), (605, [float("inf")] + [0.0] * 5), (None, common)]
    rows += [(650, [1.0, 2.0]), (651, [2.0, 1.0]), (700, [1.0, 2.0, 3.0])]  # other lengths: fewer candidates, none
    rows += [(50, rows[50][1]), (1001, [1e-3] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, rank int").repartition(4)
    found = answers(ann.neighbours(df, block_rows=32).collect())
    exact = brute_force({i: (i, v) for i, v in rows if i is not None}.values())
    assert found.keys() == {q for q in exact if exact[q]}
    assert [i for i, _ in found[300]] == [7, 301, 302, 303, 304]
    assert [i for i, _ in found[650]] == [651]
    assert recall(found, exact) >= 0.9
    for q, best in found.items():
        scores = dict(exact[q])
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in best if i in scores)
    assert ann.neighbours(df.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [-1.0, 0.5]), (1, [1.0, 0.1]), (1, [0.0, -1.0]), (2, [0.0, -1.0]), (50, [1.0, 0.0])]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    table = [(i, v) for i, v in {(i, tuple(v)) for i, v in rows}]
    expected = []
    for q in [r for r in table if r[0] % 50 == 0]:
        near = sorted((-cosine(q[1], v), i) for i, v in table if (i, v) != q)[:3]
        expected += [(q[0], n, i, pytest.approx(-s)) for n, (s, i) in enumerate(near, 1)]
    got = [tuple(r) for r in found]
    assert len(got) == len(expected) == 9
    assert all(e in got for e in expected)


def test_extreme_components(spark):
    rows = [(0, [1e200, 2e200]), (1, [1e200, 1e200]), (2, [3e-200, 6e-200]), (3, [2.0, -1.0]), (4, [1e308, 1.7e308])]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [2, 4, 1, 3]
    assert [r["score"] for r in found] == pytest.approx([1, 4.4 / math.sqrt(3.89 * 5), 3 / math.sqrt(10), 0])


def test_one_block_is_exact(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = answers(QUERIES["op8_curve_ann"](spark, sf).collect())
    exact = brute_force(rows)
    assert {q: [i for i, _ in b] for q, b in found.items()} == {q: [i for i, _ in b] for q, b in exact.items()}
    for q, best in found.items():
        assert [s for _, s in best] == pytest.approx([s for _, s in exact[q]], abs=1e-12)


def test_recall_of_small_windows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.4
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(answers(ann.neighbours(df, block_rows=64).collect()), brute_force(rows)) >= 0.9
