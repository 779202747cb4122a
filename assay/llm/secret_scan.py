"""Secret scan: known forms, and candidate strings whose sliding-window entropy is high."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, with their patterns; a match that is too short is dropped after matching.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE_KINDS = ("assign", "access", "hex")
#: Runs of these characters are candidates from so many characters; the window has as many.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_-]{20,}={0,2}", 20
ALPHABET = string.ascii_letters + string.digits + "+/_-="
#: Class, its pattern, and the bits per character that a window must reach.  A random window of 20 has about 3.3, 4.0 and 4.0.
#: Runs of letters only are words and in no class.
CLASSES = (("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0), ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", 3.6),
           ("symbols", r"^(?=.*[0-9])(?=.*[A-Za-z])(?=.*[+/_=-]).*$", 3.8))
#: Parts of candidates that no reported window may touch: UUIDs, dates with or without a time, and runs around a word for an example.
ALLOWED = (r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])", r"(?<![0-9A-Za-z])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[-_][0-9]{2}){0,3}(?![0-9A-Za-z])",
           "[0-9A-Za-z]*(?i:example|placeholder|dummy|sample)[0-9A-Za-z]*")
#: Matches whose positions are added up together.
CHUNK = 64
#: Counts of a window share longs, so many bits each.
_BITS, _EACH = 5, 12


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, found) of the leftmost non-overlapping matches, in code points; ``found`` is the ``group``.

    The text between matches and the matches alternate, so their lengths add up
    to positions, first within chunks and then over the chunks.
    """
    gaps, hits, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), found.alias("found"))
    kind = "array<struct<start:int,end:int,found:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + F.length(r["gap"])
        end = start + F.length(r["hit"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), r["found"].alias("found"))).alias("spans"))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["found"].alias("found")))

    many = F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(CHUNK))
    chunks = F.transform(many, lambda at: F.aggregate(F.slice(rows, at, F.lit(CHUNK)), zero, step))
    starts = F.aggregate(chunks, start, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")))["starts"]
    whole = F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), starts.alias("by")), lambda c: moved(c["chunk"]["spans"], c["by"])))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast(kind))


def peak_entropy(run: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits per character, of the windows of a string; 0 for a shorter one.

    Moving the window changes two counts.  With S the sum of c log2 c over the
    counts c, the entropy of a window of w characters is log2 w - S / w.  The
    counts, below 32 for windows of up to 30, are packed in a few longs.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    symbol = F.create_map(*[x for i, c in enumerate(ALPHABET) for x in (F.lit(c), F.lit(i))])
    codes = F.transform(F.split(run, ""), lambda c: F.coalesce(symbol[c], F.lit(len(ALPHABET))))
    moves = F.transform(codes, lambda c, i: F.struct(c.alias("enter"), F.when(i >= window, F.get(codes, i - window)).otherwise(-1).alias("leave"), i.alias("at")))
    words = len(ALPHABET) // _EACH + 1
    names = [f"w{k}" for k in range(words)]
    zero = F.struct(*[F.lit(0).cast("long").alias(w) for w in names], F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    units = F.array(*[F.lit(1 << _BITS * (c % _EACH)).cast("long") for c in range(words * _EACH)])

    def counted(acc: Column, code: Column) -> Column:
        packed = acc[names[-1]]
        for k in reversed(range(words - 1)):
            packed = F.when(code < (k + 1) * _EACH, acc[names[k]]).otherwise(packed)
        return F.call_function("mod", F.call_function("div", packed, F.get(units, code)), F.lit(1 << _BITS)).cast("int")

    def step(acc: Column, m: Column) -> Column:
        more, less = counted(acc, m["enter"]), counted(acc, F.greatest(m["leave"], F.lit(0)))
        same = m["enter"] == m["leave"]
        change = (F.get(weight, more + 1) - F.get(weight, more)) + F.when(m["leave"] >= 0, F.get(weight, less - 1) - F.get(weight, less)).otherwise(0.0)
        s = acc["s"] + F.when(same, 0.0).otherwise(change)
        inside = lambda code, k: (code >= k * _EACH) & (code < (k + 1) * _EACH)
        counts = [acc[w] + F.when(inside(m["enter"], k), F.get(units, m["enter"])).otherwise(0) - F.when(inside(m["leave"], k), F.get(units, m["leave"])).otherwise(0)
                  for k, w in enumerate(names)]
        bits = F.when(m["at"] >= window - 1, F.lit(math.log2(window)) - s / window).otherwise(0.0)
        return F.struct(*[c.alias(w) for c, w in zip(counts, names)], s.alias("s"), F.greatest(acc["best"], bits).alias("best"))

    return F.aggregate(moves, zero, step)["best"]


def _suspicious(run: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a window between the allowed parts of a candidate reaches its class's entropy."""

    def high(part: Column) -> Column:
        least = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            least = F.when(part.rlike(pattern), F.lit(bits)).otherwise(least)
        return F.when(least.isNull(), F.lit(False)).otherwise(peak_entropy(part) >= least)

    parts = F.split(run, "|".join(f"(?:{p})" for p in allowed), -1) if allowed else F.array(run)
    return F.exists(F.filter(parts, lambda p: F.length(p) >= WINDOW), high)


def scan(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` plus ``secrets``: (start, kind, end, name) by start, then kind.

    Kinds 0 to 2 are the known forms; kind 3 has the candidates that touch none
    of their spans and reach their class's entropy in a window clear of the parts
    that the allow-list names; the class is that of what lies between such parts.  Positions count code points, ends are exclusive.  NULL
    and empty texts have none.  Whole texts are searched; repeated rows are
    searched alike.  An input column named ``secrets`` is replaced.
    """
    keep = [c for c in docs.columns if c != "secrets"]
    body = F.coalesce(F.col(text), F.lit(""))
    long = lambda spans, kind: F.filter(spans, lambda s: F.length(s["found"]) >= LEAST[kind])
    found = docs.select(*keep, body.alias("__text")).select(
        *keep, long(located(F.col("__text"), ASSIGN, group=2), "assign").alias("__0"),
        # Runs are maximal, so asking for the least length while matching finds what dropping short ones afterwards leaves.
        located(F.col("__text"), ACCESS[:-1] + "{%d,}" % (LEAST["access"] - 4)).alias("__1"),
        located(F.col("__text"), HEX[:-1] + "{%d,}" % LEAST["hex"]).alias("__2"), located(F.col("__text"), CANDIDATE).alias("__3"))

    def named(kind: int, spans: Column) -> Column:
        name = (*BASE_KINDS, "entropy")[kind]
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(name).alias("name")))

    base = found.select(*keep, F.concat(*[named(k, F.col(f"__{k}")) for k in range(3)]).alias("__base"), "__3")
    free = F.filter("__3", lambda c: ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    more = F.when(F.size("__3") > 0, F.filter(free, lambda c: _suspicious(c["found"], allowed))).otherwise(F.slice("__3", 1, 0))
    return base.select(*keep, "__base", more.alias("__more")).select(*keep, F.sort_array(F.concat("__base", named(3, F.col("__more")))).alias("secrets"))


def count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["name"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans() -> Column:
    return F.filter("secrets", lambda s: s["kind"] < len(BASE_KINDS))
