"""Benchmark decontamination by Wu-Manber search over words.

All windows of equal length form one searcher.  A shift table, keyed by a block
of two words, says how far the search may jump; where the shift is zero, the
block's bucket holds the windows that end with it, and a direct comparison
confirms each occurrence.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import batches, discard, raw_texts, shared_object, staged

WINDOW = 13
#: Words of benchmark text in one broadcast; more are searched for in several passes.
PASS_WORDS = 2_000_000
#: Contaminated from one hit word in so many.
SHARE = 20
#: Letters and digits of ASCII, lower-cased, and all other code points make up words.
_FOLD = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Searcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set]):
        self.windows = windows
        self.length = len(next(iter(windows)))
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for window in windows:
            for end in range(self.block, self.length + 1):
                block = window[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, self.jump), self.length - end)
            self.buckets[window[-self.block:]].append(window)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, window) of every occurrence."""
        end, n, block, jump, shift, length = self.length, len(words), self.block, self.jump, self.shift.get, self.length
        while end <= n:
            last = tuple(words[end - block:end])
            step = shift(last, jump)
            if not step:
                found = words[end - length:end]
                for window in self.buckets[last]:
                    if found[0] == window[0] and found == list(window):
                        yield end - length, window
                step = 1
            end += step


def searchers(items: list[tuple[object, bytes]], window: int = WINDOW) -> list[Searcher]:
    """One searcher for each length: ``window`` consecutive words, or a whole shorter item."""
    found: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1) if size else ():
            found[size][tuple(words[at:at + size])].add(item)
    return [Searcher(dict(found[k])) for k in sorted(found)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans [from, to) that cover the same positions."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def occurrences(words: list[bytes], tables: list[Searcher]) -> tuple[list[tuple[int, int]], set]:
    """Merged spans of hit words, and the items found."""
    spans, items = [], set()
    for table in tables:
        for start, window in table.find(words):
            spans.append((start, start + table.length))
            items |= table.windows[window]
    return merge(spans), items


def item_texts(benchmark: DataFrame, item_id: str, text: str, pass_words: int, window: int = WINDOW) -> Iterator[list[tuple[object, bytes]]]:
    """The items in groups of at most ``pass_words`` words (at least a window), one group and one partition on the driver at a time.

    A longer item is cut into pieces that overlap by a window less one word, so that no window is lost.
    """
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    step = max(1, pass_words - window + 1)
    group, held = [], 0
    for r in items.toLocalIterator():
        words = words_of(r["text"].encode())
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at:at + step + window - 1]
            if group and held + len(piece) > pass_words:
                yield group
                group, held = [], 0
            group.append((r["item"], b" ".join(piece)))
            held += len(piece)
    yield group


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """``docs`` plus ``spans`` (array of [from, to) word positions), ``n_words`` and ``items`` (ids as strings, sorted).

    Whole texts are searched.  NULL, empty and wordless texts have no words;
    items without words have no windows; repeated items count once by id, a NULL
    id is the empty string.  A benchmark beyond ``pass_words`` words is searched
    for in several passes over the documents, each of which is written before the
    next begins and adds to what was found: no worker holds the tables of two
    passes, and a broadcast has at most ``pass_words`` words.  Input columns with
    the names of the new ones are replaced.
    """
    new = ("spans", "n_words", "items")
    keep = [c for c in docs.columns if c not in new]
    frame, spark = docs.select(*keep), docs.sparkSession
    written = None
    for k, group in enumerate(item_texts(benchmark, item_id, item_text, pass_words, window)):
        if k:
            before, written = written, staged(frame, "searched")
            frame = written
            if before is not None:
                discard(before)
        shared = shared_object(spark, searchers([("" if i is None else str(i), t) for i, t in group], window))
        frame = _search(frame, shared, text, first=k == 0)
    return frame


def _search(frame: DataFrame, shared, text: str, first: bool) -> DataFrame:
    """Add one group of items to what the rows have found so far."""
    names = frame.columns if first else frame.columns[:-3]
    base = frame.select(*names).schema
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    kinds = pa.schema([("spans", span), ("n_words", pa.int64()), ("items", pa.list_(pa.string()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pickle.loads(shared.value)
        for part in parts:
            texts = raw_texts(part.column(names.index(text)))
            had = ([], []) if first else (part.column(len(names)).to_pylist(), part.column(len(names) + 2).to_pylist())
            rows = []
            for i, t in enumerate(texts):
                words = words_of(t)
                merged, items = occurrences(words, tables)
                if not first:
                    merged = merge(merged + [(s["from"], s["to"]) for s in had[0][i]])
                    items = items | set(had[1][i])
                rows.append(([{"from": a, "to": b} for a, b in merged], len(words), sorted(items)))
            found = batches(kinds, zip(*rows)) if rows else batches(kinds, ([], [], []))
            yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], *found.columns], names=[*names, *kinds.names])

    added = T.StructType.fromDDL("spans array<struct<`from`: bigint, `to`: bigint>>, n_words bigint, items array<string>")
    return frame.mapInArrow(run, T.StructType([*base.fields, *added.fields]))


def n_hit():
    """Words inside the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def contaminated():
    """The contamination rule: at least one word in ``SHARE`` is hit."""
    return (n_hit() > 0) & (SHARE * n_hit() >= F.col("n_words"))


ORACLE = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
), items AS (
    SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)
), wins AS (
    SELECT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
    FROM items, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0
), found AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM docs, (SELECT DISTINCT size FROM wins) s, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size
), occ AS (
    SELECT DISTINCT f.doc_id, f.size, f.i, k.item_id FROM found f JOIN wins k ON k.size = f.size AND k.win = f.win
), hits AS (
    SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM occ, unnest(range(0, size)) AS t(o) GROUP BY doc_id
), its AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN its i ON i.doc_id = d.doc_id
"""
