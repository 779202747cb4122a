"""Approximate nearest neighbours by shifted space-filling curves.

Distinct vectors are projected to a few dimensions by several random bases, and
each projection is shifted and ordered along a Hilbert curve.  The orderings are
range-partitioned; a query meets the rows of the blocks around its own place in
each, and the best of all orderings are ranked by the exact measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.llm.common import staged

#: Orderings, projected dimensions and bits per dimension (at most 63 in all).
CURVES, DIMENSIONS, BITS = 12, 4, 12
#: A query meets at least this share of an ordering on either side, in whole blocks of so many rows.
WINDOW_SHARE, BLOCK_ROWS = 1 / 20, 1024
SEED = 42


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place of every row of non-negative coordinates (n, dimensions) along the Hilbert curve of ``bits`` bits.

    From the highest bit down, each axis exchanges or inverts the lower bits of
    the first axis; a Gray code over the axes of each bit then gives the place.
    """
    x = axes.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            inverted = (x[i] >> bit & 1).astype(bool)
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swapped)
            x[i] ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    twist = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        twist ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= twist
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | axis >> bit & 1
    return place


def bases(width: int, curves: int = CURVES, dimensions: int = DIMENSIONS, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(projection, shift) of every ordering of vectors with ``width`` components."""
    out = []
    for k in range(curves):
        draw = np.random.default_rng([seed, width, k])
        basis = np.linalg.qr(draw.normal(size=(max(width, dimensions), dimensions)))[0][:width]
        out.append((basis, draw.uniform(-0.5, 0.5, dimensions)))
    return out


def places(vectors: np.ndarray, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """(n, curves) places of unit vectors, whose projections mostly lie within four deviations."""
    scale, top = np.sqrt(vectors.shape[1]), (1 << bits) - 1
    cells = [np.clip(np.floor((vectors @ basis * scale + shift + 4.5) / 9 * (top + 1)), 0, top) for basis, shift in bases(vectors.shape[1], curves, dimensions, seed)]
    return np.stack([hilbert(c.astype(np.int64), bits) for c in cells], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of one length as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def valid_vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): the distinct rows as doubles, without NULL, zero and non-finite vectors.

    Several vectors under one id are as many rows; a NULL id takes no part.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.distinct()


def index(vectors: DataFrame, copies: int) -> DataFrame:
    """(node, width, v, ids) of every distinct vector: its number by smallest id, and its ``copies`` smallest ids in order.

    Vectors may share their smallest id, so the number counts (smallest id, vector) in order, range by range.
    """
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    least = vectors.withColumn("nth", nth).where(F.col("nth") <= copies)
    grouped = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("least", F.get("ids", F.lit(0)))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(grouped.repartitionByRange(n, "least", "v").withColumn("part", F.spark_partition_id()), "vectors")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    offset = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("least", "v"))
    numbered = ranged.withColumn("inside", inside).join(F.broadcast(offset), "part")
    return staged(numbered.select((F.col("offset") + F.col("inside")).alias("node"), F.size("v").alias("width"), "v", "ids"), "nodes")


def orderings(nodes: DataFrame, curves: int, dimensions: int, bits: int, seed: int) -> DataFrame:
    """(width, curve, node, rank): the place from 0 of every node in each ordering, ties by node."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            widths, ids = part.column(1).to_numpy(), part.column(0).to_numpy()
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                unit = _matrix(part.column(2).take(pa.array(rows)))
                unit = unit / np.abs(unit).max(axis=1, keepdims=True)  # no overflow in the norm
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                key = places(unit, curves, dimensions, bits, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(key.size, width, dtype=np.int32)), pa.array(np.tile(np.arange(curves, dtype=np.int32), len(rows))),
                                                  pa.array(key.reshape(-1)), pa.array(np.repeat(ids[rows], curves))], names=["width", "curve", "place", "node"])

    keys = nodes.select("node", "width", "v").mapInArrow(run, "width int, curve int, place long, node long")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["width", "curve", "place", "node"]
    ranged = staged(keys.repartitionByRange(n, *order).select(*order, F.spark_partition_id().alias("part")), "orderings")
    before = W.partitionBy("width", "curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    offset = ranged.groupBy("width", "curve", "part").count().select("width", "curve", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("width", "curve", "part").orderBy("place", "node"))
    return ranged.withColumn("inside", inside).join(offset, ["width", "curve", "part"]).select("width", "curve", "node", (F.col("offset") + F.col("inside") - 1).alias("rank"))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: no product overflows, and no digit of a cosine changes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _best(queries: np.ndarray, names: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, node, cosine) of the ``k`` nearest rows of each query, ties to the smaller id."""
    queries, rows = _scaled(queries), _scaled(rows)
    norms = np.sqrt((rows * rows).sum(axis=1))
    out = []
    for at in range(0, len(queries), 256):
        block = queries[at:at + 256]
        own = np.sqrt((block * block).sum(axis=1))
        rough = block @ rows.T / own[:, None] / norms
        kth = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(block), -np.inf)
        q, c = np.nonzero(rough >= kth[:, None] - 1e-9)
        exact = (block[q] * rows[c]).sum(axis=1) / (own[q] * norms[c])
        order = np.lexsort((ids[c], -exact, q))
        q, c, exact = q[order], c[order], exact[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        out += zip(names[at + q[keep]].tolist(), ids[c[keep]].tolist(), exact[keep].tolist())
    return out


def neighbours(table: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", curves: int = CURVES,
               dimensions: int = DIMENSIONS, bits: int = BITS, window_share: float = WINDOW_SHARE, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest cosine found for each id divisible by ``every``.

    The exact measure in double precision ranks what was found; ties go to the
    smaller id.  Copies of a vector are one row of the index, so a vector of any
    frequency costs one place, and as candidates its smallest ids stand for it.
    Rows equal in id and vector are one row; an id with several vectors asks once
    for each of them, and its other rows are candidates.
    NULL, zero and non-finite vectors take no part; vectors are compared with
    those of the same length.  Each task holds one block of an ordering and the
    queries near it.  What a query meets grows with the table, as ``window_share``
    says; fewer curves or a smaller share cost recall.  Other columns are not read.
    """
    vectors = valid_vectors(table, vec_id, vector)
    nodes = index(vectors, k + 1)
    asked = staged(vectors.where(F.pmod("vec_id", F.lit(every)) == 0).join(nodes, "v").select(F.col("vec_id").alias("query_id"), "node"), "queries")
    ranks = orderings(nodes, curves, dimensions, bits, seed)
    sizes = nodes.groupBy("width").count().withColumn("reach", F.ceil(F.col("count") * window_share / block_rows))
    spots = ranks.join(sizes, "width").select("node", "width", "curve", F.floor(F.col("rank") / block_rows).alias("block"), "reach", "count")
    spots = staged(spots, "spots")
    rows = spots.join(nodes.select("node", "v"), "node").select("width", "curve", "block", F.lit(1).alias("kind"), "node", "v")
    last = F.floor((F.col("count") - 1) / block_rows)
    around = F.sequence(F.greatest(F.lit(0), F.col("block") - F.col("reach")), F.least(last, F.col("block") + F.col("reach")))
    met = spots.join(asked.select("node").distinct(), "node").select("node", "width", "curve", F.explode(around).alias("block"))
    queries = met.join(nodes.select("node", "v"), "node").select("width", "curve", "block", F.lit(0).alias("kind"), "node", "v")
    tasks = rows.unionByName(queries).withColumn("task", F.xxhash64("width", "curve", "block")).select("task", "width", "kind", "node", "v")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
            kind, ids, v = whole.column(2).to_numpy(), whole.column(3).to_numpy(), _matrix(whole.column(4))
            found = _best(v[kind == 0], ids[kind == 0], v[kind == 1], ids[kind == 1], k + 1) if (kind == 0).any() and (kind == 1).any() else []
            q, c, s = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["node", "near", "score"])

        task, held = None, []
        for part in parts:
            keys = part.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and keys[a] != task:
                    yield done(held)
                    held = []
                task = keys[a]
                held.append(part.slice(a, b - a))
        if held:
            yield done(held)

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.repartition(n, "task").sortWithinPartitions("task")
    found = dealt.mapInArrow(run, "node long, near long, score double").groupBy("node", "near").agg(F.max("score").alias("score"))
    first = W.partitionBy("node").orderBy(F.desc("score"), "near")
    best = found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    named = best.join(nodes.select(F.col("node").alias("near"), "ids"), "near").select("node", "near", "score", "ids")
    pairs = asked.join(named, "node").select("query_id", "node", "near", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id OR near <> node")
    final = F.row_number().over(W.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id", "near"))
    return pairs.withColumn("rank", final).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
