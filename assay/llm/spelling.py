"""Spelling variants: words that differ by one edit, found through Bloom-guided neighbourhoods.

Every deletion and replacement of a word is hashed from the word's own hash and
probed against blocked Bloom filters of the vocabulary, sharded by length.  Only
positives become rows; an exact join with the vocabulary removes the false ones.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import bloom
from assay.llm.common import shared_object, staged

RATIO = 10
#: Lengths from ``LONG`` on share as many shards.  Words in a filter; bytes of all filters that are broadcast at once.
LONG, UNIT_WORDS, PASS_BYTES = 64, 1 << 22, 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)


def _shards(lengths: np.ndarray) -> np.ndarray:
    """Shard of each word length; neighbouring lengths are in different shards."""
    return np.where(lengths < LONG, lengths, LONG + lengths % LONG)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Letters:
    """The code points of some words side by side, and hashes of the words as sums over positions."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        self.at = np.arange(len(self.points)) - self.starts[self.word]
        self.power = _powers(int(self.lengths.max(initial=1)))
        self.values = bloom.mixed(self.points)
        self.terms = self.values * self.power[self.at]
        self.hashes = self._sums(self.terms)

    def _sums(self, terms: np.ndarray) -> np.ndarray:
        running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
        return running[self.starts + self.lengths] - running[self.starts]

    def without(self) -> tuple[np.ndarray, np.ndarray]:
        """Places whose letter can go, one for each different result, and the hashes of what is left."""
        running = np.cumsum(self.terms, dtype=np.uint64)
        before = running - self.terms - (running - self.terms)[self.starts][self.word]
        moved = np.where(self.at > 0, self.values * self.power[np.maximum(self.at - 1, 0)], np.uint64(0))
        upto = np.cumsum(moved, dtype=np.uint64)
        behind = upto[(self.starts + self.lengths - 1)[self.word]] - upto
        differs = np.ones(len(self.points), dtype=bool)
        differs[:-1] = (self.points[:-1] != self.points[1:]) | (self.word[:-1] != self.word[1:])
        places = np.flatnonzero(differs)
        return places, (before + behind)[places]

    def with_letter(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of lesser letters, and the hashes of the words with ``letter`` there."""
        places = np.flatnonzero(self.points < letter)
        value = bloom.mixed(np.array([letter], dtype=np.uint64))[0]
        return places, self.hashes[self.word[places]] + (value - self.values[places]) * self.power[self.at[places]]


def _slice(hashes: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Which of its shard's filters a hash belongs to."""
    return (bloom.mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) % slices.astype(np.uint64)).astype(np.int64)


def _passes(counts: dict[int, int]) -> list[dict[tuple[int, int], int]]:
    """Filters (shard, slice) and their blocks, grouped so that each group is at most ``PASS_BYTES`` or one filter."""
    groups, room = [], 0
    for shard, n in sorted(counts.items()):
        slices = -(-n // UNIT_WORDS)
        size = bloom.blocks_for(-(-n // slices))
        for k in range(slices):
            if not groups or room < size * 64:
                groups.append({})
                room = PASS_BYTES
            groups[-1][shard, k] = size
            room -= size * 64
    return groups


def _hits(vocabulary: DataFrame, letters: list[int], slices: dict[int, int], filters: dict[tuple[int, int], int]) -> DataFrame:
    """(word, n, near): edits of words of ``vocabulary`` that the filters of one pass may hold, written to the shared folder."""
    names = sorted(filters)
    shards = sorted({s for s, _ in names})
    many = np.zeros(2 * LONG, dtype=np.int64)
    many[list(slices)] = list(slices.values())
    unit = np.full((2 * LONG, max(slices.values())), -1, dtype=np.int64)
    for i, name in enumerate(names):
        unit[name] = i

    def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        all_ = Letters(batch.column(0).to_pylist())
        shard = _shards(all_.lengths)
        units = unit[shard, _slice(all_.hashes, many[shard])]
        return units[units >= 0], all_.hashes[units >= 0]

    def shard_in(length, wanted: list[int]):
        return F.when(length < LONG, length).otherwise(LONG + length % LONG).isin(wanted)

    size = F.length("word")
    table, starts = bloom.build(vocabulary.where(shard_in(size, shards)).select("word"), hashed, {i: filters[name] for i, name in enumerate(names)})
    held = shared_object(vocabulary.sparkSession, (table, np.array([starts[i] for i in range(len(names))]), np.array([filters[n] for n in names])))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, start, blocks = pickle.loads(held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            all_ = Letters(batch.column(0).to_pylist())
            picked, near = [], []
            for letter in [None, *letters]:
                places, hashes = all_.without() if letter is None else all_.with_letter(letter)
                words = all_.word[places]
                shard = _shards(all_.lengths[words] - (letter is None))
                known = many[shard] > 0
                units = np.where(known, unit[shard, np.where(known, _slice(hashes, np.maximum(many[shard], 1)), 0)], -1)
                here = np.flatnonzero(units >= 0)
                here = here[bloom.contains(table, hashes[here], blocks[units[here]], start[units[here]])]
                put = "" if letter is None else chr(letter)
                for w, at in zip(words[here].tolist(), all_.at[places[here]].tolist()):
                    word = all_.words[w]
                    picked.append(w)
                    near.append(word[:at] + put + word[at + 1:])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(picked, pa.int64())), batch.column(1).take(pa.array(picked, pa.int64())), pa.array(near, pa.string())],
                                             names=["word", "n", "near"])

    asked = vocabulary.where(shard_in(size, shards) | shard_in(size - 1, shards)).select("word", "n")
    found = staged(asked.mapInArrow(probed, "word string, n long, near string"), "edits")
    held.destroy()
    return found


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words of ``vocabulary`` (word, n) one edit apart, once.

    An edit inserts, deletes or replaces one code point.  Of a pair the longer
    word, or the one with the lesser code point, is ``word``.  The work grows
    with the number of different code points in the vocabulary, so this is for
    alphabetic scripts.  Filters beyond ``PASS_BYTES`` take further passes, each
    over the words of the lengths it needs.
    """
    shard = F.when(F.length("word") < LONG, F.length("word")).otherwise(LONG + F.length("word") % LONG)
    counts = {r["shard"]: r["count"] for r in vocabulary.groupBy(shard.alias("shard")).count().toLocalIterator()}
    letters = sorted(ord(r["letter"]) for r in vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter != ''").distinct().toLocalIterator())
    slices = {s: -(-n // UNIT_WORDS) for s, n in counts.items()}
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = vocabulary.sparkSession.createDataFrame([], "word string, n long, near string")
    for filters in _passes(counts):
        found = found.unionByName(_hits(vocabulary, letters, slices, filters))
    return found.join(known, "near").select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends.  The steps followed double in each round."""
    now, more = staged(forms.select("word", F.col("form").alias("root")), "roots"), True
    while more:
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = staged(now.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        more = not after.where("moved").isEmpty()
        now = after.select("word", "root")
    return now


def group_variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``vocabulary`` (word string, n long; words distinct and not empty).

    ``form`` is the word's most frequent near word, of equal ones the first by
    code point, if it is at least ``ratio`` times as frequent; else NULL.
    ``root`` is where following forms ends.  Frequencies grow along the way, so
    it has no cycles and few steps.
    """
    words = staged(vocabulary.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pairs = staged(near_pairs(words), "pairs")
    both = pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    likely = -F.col("best.less") >= ratio * F.col("n")
    formed = staged(words.join(best, "word", "left").select("word", F.when(likely, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                            F.when(likely, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def count_words(words: DataFrame, word: str = "word", min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) of the values with at least ``min_chars`` code points that occur ``min_count`` times; NULL is none."""
    return words.where(F.length(word) >= min_chars).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 7) -> DataFrame:
    """(doc_id, run): maximal runs of Latin letters with at least ``min_chars`` code points, A-Z lower-cased; NULL and empty texts have none.

    Repeated rows count again.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([A-Za-zÀ-ÿ]{{{min_chars},}})"), 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))


def misspelt(run, doc_id, every: int = 31):
    """``run`` without one code point where ``every`` divides the crc32 of ``<doc_id>:<run>``: a repeatable sprinkling of errors."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


ORACLE = """
WITH table256 AS MATERIALIZED (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
                              lambda c, x : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) r(i))
), runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), spelt AS (
    SELECT doc_id, run, count(*) AS k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs GROUP BY doc_id, run
), bytes AS (
    SELECT run, k, list_transform(range(1, 2 * strlen(s), 2), lambda i : CAST('0x' || substr(hex(s), i, 2) AS BIGINT)) AS b FROM spelt
), sums AS (
    SELECT run, k, xor(list_reduce(list_concat([4294967295], b), lambda c, x : xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, table256
), words AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM sums
), vocabulary AS MATERIALIZED (
    SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), holes AS (
    SELECT DISTINCT word, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail FROM vocabulary, range(1, length(word) + 1) r(i)
), pairs AS (
    SELECT a.word, b.word AS near FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION
    SELECT h.word, v.word FROM holes h JOIN vocabulary v ON v.word = h.head || h.tail
    UNION
    SELECT v.word, h.word FROM holes h JOIN vocabulary v ON v.word = h.head || h.tail
), best AS (
    SELECT p.word, count(*) AS n_near, first(p.near ORDER BY v.n DESC, p.near) AS near, max(v.n) AS near_n FROM pairs p JOIN vocabulary v ON v.word = p.near GROUP BY p.word
), formed AS MATERIALIZED (
    SELECT v.word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
    FROM vocabulary v LEFT JOIN best b ON b.word = v.word
), steps AS (
    WITH RECURSIVE s AS (
        SELECT word, word AS root, form AS next, 0 AS depth FROM formed
        UNION ALL
        SELECT s.word, f.word, f.form, depth + 1 FROM s JOIN formed f ON f.word = s.next)
    SELECT word, arg_max(root, depth) AS root FROM s GROUP BY word
)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN steps s ON s.word = f.word
"""
