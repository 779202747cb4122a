"""Secret scan against Python's regular expressions and direct entropies."""

import hashlib
import math
import random
import re
from collections import Counter

from assay.llm import secret_scan as ss
from assay.llm.queries import QUERIES

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def slow_entropy(run):
    best = 0.0
    for at in range(len(run) - 19):
        best = max(best, -sum(c / 20 * math.log2(c / 20) for c in Counter(run[at:at + 20]).values()))
    return best


def slow_spans(text):
    base, more = slow_base(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
        if any(a < m.end() and m.start() < b for a, _, b, _ in base):
            continue
        parts, at = [], 0
        for gone in re.finditer("|".join(ss.ALLOWED), m[0]):
            parts.append(m[0][at:gone.start()])
            at = gone.end()
        if any(map(slow_high, [*parts, m[0][at:]])):
            more.append((m.start(), 3, m.end(), "entropy"))
    return sorted(base + more)


def slow_high(part):
    for _, pattern, bits in ss.CLASSES:
        if re.search(pattern, part):
            return len(part) >= 20 and slow_entropy(part) >= bits - 1e-9
    return False


KEY = "q7Zp1Xk9Lw3Vt8Rb2Nc6"


def test_allowed_parts_do_not_hide_their_neighbours(spark):
    hidden = ["123e4567-e89b-12d3-a456-426614174000", "2024-01-02-03-04-05", f"EXAMPLE{KEY}", f"{KEY}sample"]
    shown = [KEY, f"2024-01-15-{KEY}", f"https://h/sample/{KEY}", f"{KEY}/example/x", f"dummy_{KEY}", f"123e4567-e89b-12d3-a456-426614174000/{KEY}", f"x{KEY}" + "z" * 40]
    df = spark.createDataFrame([(t,) for t in hidden + shown], "text string")
    found = {r["text"]: [s["name"] for s in r["secrets"]] for r in ss.scan(df).collect()}
    assert found == {t: [] for t in hidden} | {t: ["entropy"] for t in shown}
    assert all(r["secrets"] for r in ss.scan(df, allowed=()).collect()[2:])


def test_positions_over_many_matches(spark):
    text = " ".join(["é token=abcdefgh", "AKIA" + "A1" * 9, "0123456789abcdef" * 2, KEY] * 400)
    for t in (text, " ".join(["token=abcdefgh"] * ss.CHUNK), " ".join(["token=abcdefgh"] * (ss.CHUNK + 1))):
        assert [tuple(s) for s in ss.scan(spark.createDataFrame([(t,)], "text string")).first()["secrets"]] == slow_spans(t)


def texts():
    rng = random.Random(8)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = ["password = 'hunter2hunter'", "PASSWD:abc", "secret=token: abcdefgh", "Api_Key=\"x-1234567\"", "AKIA" + "A1" * 8, "AKIA12", "AKIAAKIA" + "Z" * 9, "0123456789abcdef" * 2,
             "é" * 3, "𝄞𝄞", "\n", "token==abcdefg", "enenlichschverkeitheitung", "2024-01-02-03-04-05-report", "123e4567-e89b-12d3-a456-426614174000", "EXAMPLEa8f7d6s5a4f3d2s1k9"]
    out = [None, "", " ", "a" * 50_000 + " password=" + "q" * 70_000]
    for _ in range(60):
        words = rng.choices(parts, k=rng.randrange(1, 7)) + ["".join(rng.choices(alnum + "+/_-", k=rng.randrange(15, 60))), "".join(rng.choices(alnum[:20], k=24)),
                                                             "".join(rng.choices("0123456789ABCDEF", k=rng.randrange(18, 40))), "".join(rng.choices("ab1", k=25))]
        rng.shuffle(words)
        out.append(rng.choice([" ", "", "; ", "\n"]).join(words))
    return out + out[4:6]


def test_spans_equal_direct_search(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(rows)], "doc_id long, text string, secrets string, found int")
    found = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in ss.scan(df).collect()}
    assert len(found) == len(rows)
    kinds = Counter()
    for i, t in enumerate(rows):
        assert found[i] == slow_spans(t), t
        kinds.update(s[3] for s in found[i])
    assert min(kinds[k] for k in ("assign", "access", "hex", "entropy")) > 3


def test_empty_table(spark):
    assert ss.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_without_python(spark, sf):
    query = QUERIES["op9_secret_scan"](spark, sf)
    assert "Python" not in query._jdf.queryExecution().toString() and "Arrow" not in query._jdf.queryExecution().toString()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in query.collect():
        spans = slow_spans(docs[r["doc_id"]])
        base = [s for s in spans if s[1] < 3]
        show = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, b, k in x)
        assert r["spans"] == show(spans)
        assert r["base_sha256"] == hashlib.sha256(show(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[3] == k for s in base) for k in ("assign", "access", "hex")]
