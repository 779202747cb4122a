"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits, each the majority of that bit over the hashes of all
word shingles.  Distinct fingerprints that share some of their blocks of bits
(by the pigeonhole principle every pair within the radius does) meet in a
bucket.  There they are stored as bit planes, 64 fingerprints to a word, so
that one carry-save counter adds up the distances to 64 of them at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import lower_words, raw_texts, staged, text_key
from assay.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a bucket that one task compares with each other; larger buckets are cut and their parts paired.
BUCKET_ROWS = 4096
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = np.arange(64, dtype=np.uint64)


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of every ``size`` consecutive words, in order; fewer words, at least one, are one shingle."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - size + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[len(words) - n:].tolist())], dtype="<u8")


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of one text; 0 if it has no word."""
    words = lower_words(text)
    if not words:
        return 0
    hashes = shingle_hashes(words, size)
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, fingerprint as a signed long) of every row; ``key`` tells texts under one id apart."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints = np.fromiter((fingerprint(t) for t in raw_texts(part.column(2))), dtype=np.uint64, count=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "key", "print"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, print long")


def block_masks(n: int, radius: int = RADIUS, bucket: int = 2) -> list[int]:
    """Bit masks of which every pair within ``radius`` agrees on at least one.

    64 bits are cut into ``radius + k`` blocks; of those at least k are equal.
    k is the smallest that leaves about ``bucket`` of ``n`` evenly spread
    fingerprints in a bucket.  The pairs found are the same for every k.
    """
    for k in (1, 2, 3, 4):
        blocks = radius + k
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        masks = [sum(((1 << (b - a)) - 1) << a for a, b in pick) for pick in itertools.combinations(list(itertools.pairwise(cuts)), k)]
        if n / 2.0 ** (64 * k / blocks) <= bucket:
            break
    return masks


def planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane b is bit b of fingerprint 64 w + i; the tail is padded with zeros."""
    padded = np.zeros((len(prints) + 63) // 64 * 64, dtype="<u8")
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def near(queries: np.ndarray, sliced: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """(queries, words): bit i of [q, w] is set if fingerprint 64 w + i is within ``radius`` of query q.

    Distances are counted in binary across planes: two difference planes at a
    time go with the lowest digit through a carry-save adder whose carry ripples
    into the higher digits.  After every eighth plane the words, and then the
    queries, for which all distances have passed the radius are dropped.
    """
    words, rows = np.arange(sliced.shape[1]), np.arange(len(queries))
    flips = np.where(queries[None, :] >> _BITS[:, None] & np.uint64(1), _ONES, np.uint64(0))
    top = max(3, radius.bit_length())
    digits = np.zeros((top + 1, len(rows), len(words)), dtype=np.uint64)  # 1, 2, 4, ..., and the first power of two beyond the radius or more, which stays set
    out = np.zeros((len(rows), len(words)), dtype=np.uint64)
    for at in range(0, 64, 2):
        a, b = (sliced[p, words][None, :] ^ flips[p, rows][:, None] for p in (at, at + 1))
        half = digits[0] ^ a
        carry = (digits[0] & a) | (half & b)
        digits[0] = half ^ b
        for d in range(1, top):
            digits[d], carry = digits[d] ^ carry, digits[d] & carry
        digits[top] |= carry
        if at % 8 == 6 and at < 62:
            alive = ~_beyond(digits, radius) != 0
            columns, lines = alive.any(axis=0), alive.any(axis=1)
            if not (columns.all() and lines.all()):
                words, rows = words[columns], rows[lines]
                digits = digits[:, lines][:, :, columns]
                if not len(words):
                    return out
    out[np.ix_(rows, words)] = ~_beyond(digits, radius)
    return out


def _beyond(digits: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count exceeds ``radius``."""
    above, equal = digits[-1].copy(), ~digits[-1]
    for d in range(len(digits) - 2, -1, -1):
        if radius >> d & 1:
            equal &= digits[d]
        else:
            above |= equal & digits[d]
            equal &= ~digits[d]
    return above


def links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``radius`` among ``prints``: at most one for each fingerprint."""
    n = len(prints)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found, values = [], prints.tolist()

    def link(i: int, j: int) -> None:
        if (a := root(i)) != (b := root(j)):
            parent[max(a, b)] = min(a, b)
            found.append((values[i], values[j]))

    if n <= 32:
        for i, j in itertools.combinations(range(n), 2):
            if (values[i] ^ values[j]).bit_count() <= radius:
                link(i, j)
        return found
    sliced = planes(prints)
    for at in range(0, n, 64):
        hits = near(prints[at:at + 64], sliced[:, at // 64:], radius)
        q, w = np.nonzero(hits)
        lanes = np.unpackbits(hits[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, lane = np.nonzero(lanes)
        for i, j in zip((at + q[k]).tolist(), (at + 64 * w[k] + lane).tolist()):
            if i < j < n:
                link(i, j)
    return found


def near_links(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints of ``prints`` to connect all within ``radius``.

    Buckets with more than ``bucket_rows`` are cut by a hash of the fingerprint
    and every two parts meet in a task, so no pair is lost and no task grows
    with the largest bucket.
    """
    masks = block_masks(prints.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    each = F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "bits")
    dealt = prints.select("print", each)
    counts = dealt.groupBy("mask", "bits").count().where("count > 1")
    parts = F.ceil(F.col("count") / bucket_rows).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, own).alias("x"), F.greatest(p, own).alias("y")))
    tasks = (dealt.join(counts, ["mask", "bits"]).select("mask", "bits", "print", parts.alias("parts"))
             .select("print", F.explode(F.transform(pairs, lambda p: F.xxhash64(F.col("mask"), F.col("bits"), p["x"], p["y"]))).alias("task")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def done(groups: list[np.ndarray]) -> pa.RecordBatch:
            found = [x for g in groups for x in links(np.unique(g.view(np.uint64)), radius)]
            pair = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            runs = list(zip(keys[np.concatenate(([0], edges))].tolist(), np.split(values, edges))) if len(keys) else []
            ready = []
            for key, value in runs:
                if key != task and held:
                    ready.append(np.concatenate(held))
                    held = []
                task = key
                held.append(value)
            yield done(ready)
        if held:
            yield done([np.concatenate(held)])

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.select("task", "print").repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, text: str, doc_id: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """Every row's fingerprint, and for each fingerprint the first (id, key) of its component, NULL ids last."""
    marked = staged(fingerprints(docs, text, doc_id), "prints")
    return marked, group_firsts(marked, near_links(marked.select("print").distinct(), radius))


def group_firsts(marked: DataFrame, links: DataFrame) -> DataFrame:
    """(node, first): for each print of ``marked`` (doc_id, key, print) the first (id, key) of its component over ``links``, NULL ids last."""
    nodes = staged(marked.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("least")), "nodes")
    groups = components(links, "a", "b")
    labelled = nodes.join(groups, nodes["print"] == groups["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    first = labelled.groupBy("root").agg(F.min("least").alias("first"))
    return labelled.join(first, "root").select(F.col("print").alias("node"), "first")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Fingerprints are linked if they differ in at most ``radius`` bits; the
    component is the smallest id that can be reached, the row's own included.
    NULL, empty and wordless texts have fingerprint zero and are linked like any
    other.  A NULL id names a component only if no other id can be reached.
    Repeated rows stay.  Other columns of ``docs`` are not read.
    """
    marked, groups = _grouped(docs, text, doc_id, radius)
    return marked.join(groups, marked["print"] == groups["node"]).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row with the smallest id stays, NULL ids last.

    Among rows of that id the text with the smallest hash decides; of rows with
    equal id and text the least stays, compared by the columns that have an order.
    """
    return keep_rows(docs, _grouped(docs, text, doc_id, radius)[1], text, doc_id)


def keep_rows(docs: DataFrame, groups: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Of each component of ``groups`` (of ``group_firsts``) the one row that stays."""
    first = groups.select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key")).distinct()
    kept = docs.withColumn("__text", text_key(F.col(text))).join(
        first, F.col(doc_id).eqNullSafe(F.col("__id")) & F.col("__text").eqNullSafe(F.col("__key")), "left_semi")
    ordered = [F.col(f.name) for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in (text, doc_id)]
    nth = F.row_number().over(W.partitionBy(doc_id, "__text").orderBy(*ordered, F.lit(0)))
    return kept.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
