"""Line deduplication against a direct scan."""

import random

from assay.llm import line_dedup as ld


def slow(rows, key):
    """Text and removed positions of each row; rows with equal id and text are one document."""
    order = sorted({(d is not None, d, key[t], t) for d, t in rows if t is not None}, key=lambda x: (x[0], x[1] if x[0] else 0, x[2]))
    first, covered = {}, {}
    for _, d, _, t in order:
        lines = [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")]
        covered[d, t] = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i:i + 3])
            if any(window) and first.setdefault(window, (d, t, i)) != (d, t, i):
                covered[d, t] |= {i, i + 1, i + 2}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, []))
        else:
            lines, gone = t.split("\n"), covered[d, t]
            out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), sorted(gone)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 3, "x") for d, t in rows], "doc_id long, text string, n_lines int, digest string").repartition(4)
    found = ld.dedup_lines(df)
    assert found.columns == ["doc_id", "text", "digest", "n_lines", "removed"]
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    got = [(r["doc_id"], r["text"], r["n_lines"], r["removed"]) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, slow(rows, hashes)))


def test_windows(spark):
    a, b = "one\ntwo\nthree", "x\none\ntwo \nthree\ny"
    check(spark, [(1, a), (2, b), (3, "two\nthree\nfour"), (4, "a\na\na\na\na"), (5, "\n\n\n\n"), (6, "\n\n\n\nq"), (7, "one\ntwo"), (8, ""), (9, None), (10, "one\r\ntwo\r\nthree\r\nlast")])


def test_ties_and_repeated_rows(spark):
    text = "one\ntwo\nthree\nfour"
    check(spark, [(1, text), (1, text), (1, text + "\nfive"), (None, text), (None, text), (2, text), (None, None), (2, None)])


def test_random_documents(spark):
    rng = random.Random(6)
    pool = ["alpha", "beta", " gamma", "delta ", "", "eps"]
    check(spark, [(rng.randrange(90), "\n".join(rng.choices(pool, weights=(9, 4, 2, 2, 3, 1), k=rng.randrange(0, 25)))) for _ in range(120)])


def test_very_long_text_and_empty_table(spark):
    lines = [f"line {i}" for i in range(20_000)]
    check(spark, [(1, "\n".join(lines)), (2, "\n".join(lines[5_000:])), (3, "w" * 300_000)])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup_lines(df).count() == 0


def test_emptied(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, " \n"), (4, None), (5, "\na\nb\nc\n"), (6, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ld.dedup_lines(df).where(ld.emptied()).collect()) == [2, 5]
