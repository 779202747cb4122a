"""Blocked Bloom filters over 64-bit hashes, built by Spark in pieces of 64 KB and probed with numpy.

A hash sets four bits in each of two words of one block of 512 bits, so that a
probe touches one cache line, and mostly a single word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: Bits for each key; 64-bit words in a block; blocks that one task fills at a time.
BITS, WORDS, PIECE = 16, 8, 1024
_ONE, _LANE = np.uint64(1), np.uint64(63)


def blocks_for(keys: int) -> int:
    """Blocks that give every key ``BITS`` bits."""
    return max(1, -(-keys * BITS // (64 * WORDS)))


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with every bit depending on all bits (splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block(m: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    return ((m >> np.uint64(32)) * np.asarray(blocks, dtype=np.uint64)) >> np.uint64(32)


def _bits(m: np.ndarray) -> np.ndarray:
    mask = _ONE << (m >> np.uint64(3) & _LANE)
    for shift in (9, 15, 21):
        mask |= _ONE << (m >> np.uint64(shift) & _LANE)
    return mask


def _word(m: np.ndarray, block: np.ndarray) -> np.ndarray:
    return (block * np.uint64(WORDS) + (m & np.uint64(WORDS - 1))).astype(np.int64)


def add(table: np.ndarray, m: np.ndarray, block: np.ndarray) -> None:
    """Set the bits of mixed hashes whose blocks are given."""
    for part in (m, mixed(m)):
        np.bitwise_or.at(table, _word(part, block), _bits(part))


def contains(table: np.ndarray, h: np.ndarray, blocks: np.ndarray | int, offset: np.ndarray | int = 0) -> np.ndarray:
    """Whether each hash may be in its filter, which starts at block ``offset`` of ``table`` and has ``blocks`` blocks."""
    m = mixed(h)
    block = _block(m, blocks) + np.asarray(offset, dtype=np.uint64)
    bits = _bits(m)
    found = table[_word(m, block)] & bits == bits
    at = np.flatnonzero(found)
    again = mixed(m[at])
    bits = _bits(again)
    found[at] = table[_word(again, block[at])] & bits == bits
    return found


def build(keys: DataFrame, hashed: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], blocks: dict[int, int]) -> tuple[np.ndarray, dict[int, int]]:
    """One table with a filter for each unit, and the block at which each begins; ``hashed`` gives units and hashes of a batch of ``keys``.

    The table has as many blocks as ``blocks`` adds up to, whatever the number of hashes: the caller bounds it.
    """
    starts, total = {}, 0
    for unit, count in sorted(blocks.items()):
        starts[unit], total = total, total + count

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, counts = (np.array(x, dtype=np.uint64) for x in (sorted(blocks), [blocks[u] for u in sorted(blocks)]))
        first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names, hashes = hashed(batch)
            unit = np.searchsorted(units, names.astype(np.uint64))
            m = mixed(hashes)
            block = first[unit] + _block(m, counts[unit])
            yield pa.RecordBatch.from_arrays([pa.array((block // np.uint64(PIECE)).astype(np.int64)), pa.array((block % np.uint64(PIECE)).astype(np.int32)), pa.array(m.view(np.int64))],
                                             names=["piece", "block", "mixed"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(PIECE * WORDS, dtype=np.uint64)
        add(table, rows["mixed"].to_numpy().view(np.uint64), rows["block"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "bits": [table.tobytes()]})

    table = np.zeros(-(-max(total, 1) // PIECE) * PIECE * WORDS, dtype=np.uint64)
    placed = keys.mapInArrow(place, "piece long, block int, mixed long")
    for row in placed.groupBy("piece").applyInPandas(fill, "piece long, bits binary").toLocalIterator():
        at = row["piece"] * PIECE * WORDS
        table[at:at + PIECE * WORDS] = np.frombuffer(row["bits"], dtype=np.uint64)
    return table, starts
