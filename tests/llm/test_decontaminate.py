"""Word windows of benchmark items against a direct search."""

import random
import re

import pytest

from assay.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items, window=13):
    mine, hit, found = words(text), set(), set()
    for item, t in items:
        theirs = words(t)
        size = min(window, len(theirs))
        wins = {tuple(theirs[i:i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(mine) - size + 1 if size else 0):
            if tuple(mine[i:i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(mine), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(mine)


def rows_and_items():
    rng = random.Random(3)
    pool = "a b c d e".split()
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 12, 13, 14, 30])))) for i in range(2, 14)]
    items = [x for x in items if len(x[1].split()) > 3] + [(20, "Zeta, eta-THETA"), (21, "solo"), (22, None), (23, ""), (24, "?!"), (None, "naught here"), (25, items[0][1]), (25, "solo"), (26, "é中 x1")]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(60)))) for i in range(40)]
    rows += [(100 + i, f"{' '.join(rng.choices(pool, k=rng.randrange(30)))} {t or ''}. {' '.join(rng.choices(pool, k=rng.randrange(90)))}") for i, (_, t) in enumerate(items)]
    rows += [(200, None), (201, ""), (202, "--"), (203, "zeta_eta_theta ZETA\x00eta\x7fTheta solo"), (203, "zeta_eta_theta ZETA\x00eta\x7fTheta solo"), (None, "É中 é中 X1"), (204, "q " * 60_000 + "solo")]
    return rows, items


@pytest.mark.parametrize("pass_words", [dc.PASS_WORDS, 20])
def test_hits_equal_direct_search(spark, pass_words):
    rows, items = rows_and_items()
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, items string, n_words int").repartition(3)
    bench = spark.createDataFrame([(t, i, 0) for i, t in items], "text string, item_id long, spans int")
    found = dc.contamination(df, bench, pass_words=pass_words).select("doc_id", "text", "n_words", dc.n_hit().alias("n_hit"), "items", dc.contaminated().alias("contaminated")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == slow(r["text"], items), r["text"]
    assert sum(r["contaminated"] for r in found) > 10


def test_passes_are_apart_and_bounded(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(n))) for i, n in enumerate([40] * 20 + [5, 0, 13, 700])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    groups = list(dc.item_texts(bench, "item_id", "text", 100))
    assert len(groups) > 9 and all(sum(len(t.split()) for _, t in g) <= 100 for g in groups)
    windows = lambda rows: {(s.length, w): x for s in dc.searchers(rows) for w, x in s.windows.items()}
    together = {}
    for g in groups:
        for w, x in windows(g).items():
            together[w] = together.get(w, set()) | x
    assert together == windows([(i, t.encode()) for i, t in items])
    docs = spark.createDataFrame([(1, items[-1][1]), (2, "w1 w2"), (3, None)], "doc_id long, text string")
    found = dc.contamination(docs, bench, pass_words=100)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: (r["n_words"], len(r["items"]), sum(b - a for a, b in r["spans"])) for r in found.collect()} == {1: (700, 1, 700), 2: (2, 0, 0), 3: (0, 0, 0)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(docs, bench).first()["items"] == []
    assert dc.contamination(docs.limit(0), bench.union(spark.createDataFrame([(1, "some words")], bench.schema))).count() == 0


def test_search_skips(monkeypatch):
    """Far from any window the search looks at one block in twelve words."""
    table = dc.searchers([(1, b" ".join(b"w%d" % i for i in range(13)))])[0]
    looked = []
    monkeypatch.setattr(table, "shift", type("Counted", (dict,), {"get": lambda self, k, d: looked.append(k) or dict.get(self, k, d)})(table.shift))
    assert not list(table.find([b"x"] * 1200))
    assert len(looked) == 99
