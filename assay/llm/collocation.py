"""Collocations by Toivonen's method: a sample proposes, full passes count.

Phrases that are frequent in a sample of the documents are held in Bloom
filters.  A full pass counts, exactly, every phrase whose parts are all held:
the proposed ones and their negative border.  Where phrases of the border turn
out to be frequent, a further pass counts what lies beyond them, following the
phrases that it meets for the first time, so that afterwards no frequent phrase
is left uncounted.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assay.llm import bloom
from assay.llm.common import joined_by_key, raw_texts, shared_object, small, staged

LONGEST, SUPPORT, CONTAINED, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
#: One document in ``SAMPLE`` proposes; of the support expected there this share is asked for, lest phrases near the support be missed.
SAMPLE, LOWERED = 4, 0.6
#: Blocks of the filter for each phrase length, at most: 8 MB.  Fuller filters let more phrases be counted than need be, no fewer.
MOST_BLOCKS = 1 << 17
#: Bytes of text that are encoded at once; a longer piece without punctuation is one.
CHUNK = 2 << 20
_CUT = b"\xff"
_TABLE = bytes.maketrans(b".,;:!?\n\v\f\r\t", _CUT * 10 + b" ")
_NEXT = np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "lang string, k int, phrase string, f long"


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)) ^ np.uint64(xxhash.xxh64_intdigest(lang))


def _joined(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of all but its last word and of that word."""
    return bloom.mixed(head) * _NEXT + last


def _phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of phrases (lang, k, phrase), as ``_counts`` makes them from those of their words."""
    langs, lengths = (batch.column(i).dictionary_encode() for i in (0, 1))
    phrases, out = batch.column(2).cast(pa.binary()).to_pylist(), np.zeros(batch.num_rows, dtype=np.uint64)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        for j, k in enumerate(lengths.dictionary.to_pylist()):
            rows = np.flatnonzero((langs.indices.to_numpy() == i) & (lengths.indices.to_numpy() == j))
            parts = _word_hashes([w for r in rows.tolist() for w in phrases[r].split(b" ")], lang).reshape(-1, k)
            h = parts[:, 0]
            for n in range(1, k):
                h = _joined(h, parts[:, n])
            out[rows] = h
    return out


class Filters:
    """Filters of the phrases of each length, one after the other in one table."""

    def __init__(self, table: np.ndarray, starts: dict[int, int], blocks: dict[int, int]):
        self.table, self.starts, self.blocks = table, starts, blocks

    def __call__(self, k: int, hashes: np.ndarray) -> np.ndarray:
        if k not in self.blocks:
            return np.zeros(len(hashes), dtype=bool)
        return bloom.contains(self.table, hashes, self.blocks[k], self.starts[k])


def _filters(phrases: DataFrame) -> Filters:
    """Filters of ``phrases`` (lang, k, phrase) shorter than the longest."""
    wanted = phrases.where(F.col("k") < LONGEST).select("lang", "k", "phrase")
    blocks = {r["k"]: min(bloom.blocks_for(r["count"]), MOST_BLOCKS) for r in wanted.groupBy("k").count().toLocalIterator()}

    return Filters(*bloom.build(wanted, lambda batch: (batch.column(1).to_numpy(), _phrase_hashes(batch)), blocks), blocks)


def _chunks(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """(language, text) in chunks that end with a cut; whenever two chunks' worth of text is held, the language with most of it is given out."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter[str] = Counter()
    for lang, text in rows:
        text = text.lower().translate(_TABLE)
        at = 0
        while len(text) - at > CHUNK and (cut := text.find(_CUT, at + CHUNK)) >= 0:
            yield lang, text[at:cut + 1]
            at = cut + 1
        held.setdefault(lang, []).append(text[at:] + _CUT)
        sizes[lang] += len(held[lang][-1])
        while sizes.total() > 2 * CHUNK:
            most = sizes.most_common(1)[0][0]
            del sizes[most]
            yield most, b"".join(held.pop(most))
    for lang in held:
        yield lang, b"".join(held[lang])


def _counts(chunk: bytes, lang: str, lengths: range, known: Filters | None, before: Filters | None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, phrases, occurrences in ``chunk``) of every length in ``lengths``.

    A phrase of two or more words is counted if both phrases that are one word
    shorter are held by ``known``.  With ``before`` phrases that a pass with those
    filters has counted are left out, and phrases left in count as held.  That pass
    met only phrases of held parts, so that a phrase which its filter holds by
    mistake is not taken for one that it met.
    """
    tokens = chunk.replace(_CUT, b" " + _CUT + b" ").split()
    encoded = pa.array(tokens, pa.binary()).dictionary_encode()
    del tokens
    codes, words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    inside = codes != words.index(_CUT).as_py()
    if lengths[0] == 1:
        found = np.bincount(codes[inside], minlength=len(words))
        there = np.flatnonzero(found)
        yield 1, words.take(pa.array(there)), found[there]
    if known is None or lengths[-1] == 1:
        return
    own = _word_hashes(words.to_pylist(), lang)
    held = known(1, own)[codes] & inside
    done = before(1, own)[codes] & inside if before else None
    ids, hashes = codes, own
    for k in range(2, lengths[-1] + 1):
        at = np.flatnonzero(held[:-1] & held[1:])
        if not len(at):
            return
        _, first, number = np.unique(ids[at] * len(words) + codes[at + k - 1], return_index=True, return_inverse=True)
        first = at[first]
        hashes = _joined(hashes[ids[first]], own[codes[first + k - 1]])
        ids = np.zeros(len(codes), dtype=np.int64)
        ids[at] = number
        new = ~(done[first] & done[first + 1]) if before else np.ones(len(first), dtype=bool)
        if k >= lengths[0] and new.any():
            parts = [words.take(pa.array(codes[first[new] + i])) for i in range(k)]
            yield k, pc.binary_join_element_wise(*parts, b" "), np.bincount(number, minlength=len(first))[new]
        hold = known(k, hashes) | (new if before else False)
        held = np.zeros(len(codes), dtype=bool)
        held[at] = hold[number]
        if before:
            old = before(k, hashes)[number] & done[at] & done[at + 1]
            done = np.zeros(len(codes), dtype=bool)
            done[at] = old


def _pass(docs: DataFrame, lengths: range, known: Broadcast | None = None, before: Broadcast | None = None) -> DataFrame:
    """(lang, k, phrase, f): occurrences over ``docs`` (lang, text) of the phrases that ``_counts`` counts; all words of a language as k = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_, before_ = (pickle.loads(x.value) if x else None for x in (known, before))
        rows = (row for batch in small(batches) for row in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))))
        for lang, chunk in _chunks(rows):
            for k, phrases, f in _counts(chunk, lang, lengths, known_, before_):
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(f)), pa.array(np.full(len(f), k, dtype=np.int32)), phrases.cast(pa.string()), pa.array(f.astype(np.int64))]
                if k == 1 and len(f):
                    total = [pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int(f.sum())])]
                    columns = [pa.concat_arrays([a, b]) for a, b in zip(total, columns)]
                yield from small([pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "f"])], 10_000)

    return docs.select("lang", "text").mapInArrow(run, SCHEMA).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(lang, k, phrase, f): every phrase of up to ``LONGEST`` words with at least ``support`` occurrences in its language, exactly.

    ``docs`` has doc_id, text and lang.  Rows with k = 0 count all words of a language.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)
    enough = max(1, math.ceil(support / SAMPLE * LOWERED))
    proposed, held = spark.createDataFrame([], SCHEMA), None
    for k in range(1, LONGEST):
        level = staged(_pass(some, range(k, k + 1), held).where((F.col("f") >= enough) & (F.col("k") == k)), "proposed")
        proposed = proposed.unionByName(level)
        if held:
            held.destroy()
        held = shared_object(spark, filters := _filters(proposed))
    keep = (F.col("f") >= support) | (F.col("k") == 0)
    counted = staged(_pass(rows, range(1, LONGEST + 1), held).where(keep), "counted")
    if not _beyond(counted, filters).isEmpty():
        wider = shared_object(spark, _filters(counted.where("k > 0")))
        counted = counted.unionByName(staged(_pass(rows, range(2, LONGEST + 1), wider, held).where(keep), "counted"))
        wider.destroy()
    held.destroy()
    return counted


def _beyond(counted: DataFrame, filters: Filters) -> DataFrame:
    """Frequent phrases of the border, which ``filters`` does not hold."""
    held = shared_object(counted.sparkSession, filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(held.value)
        for batch in batches:
            hashes, lengths, new = _phrase_hashes(batch), batch.column(1).to_numpy(), np.zeros(batch.num_rows, dtype=bool)
            for k in range(1, LONGEST):
                new[lengths == k] = ~known(k, hashes[lengths == k])
            yield batch.filter(pa.array(new))

    return counted.where(f"k BETWEEN 1 AND {LONGEST - 1}").select("lang", "k", "phrase").mapInArrow(run, "lang string, k int, phrase string")


def _wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _cuts(candidates: DataFrame, counted: DataFrame) -> DataFrame:
    """``candidates`` (lang, k, phrase, a) with l, r and score of the lowest-scoring cut, the first of equal ones."""
    words = F.split("phrase", " ")
    text = lambda x: F.array_join(x, " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("cut"), text(F.slice(words, 1, c)).alias("head"), text(F.slice(words, c + 1, LONGEST)).alias("rest")))
    parts = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select(
        "lang", "phrase", "a", "c.cut", F.explode(F.array(F.struct(F.lit(True).alias("head"), F.col("c.head").alias("part")), F.struct(F.lit(False).alias("head"), F.col("c.rest").alias("part")))).alias("p"))
    parts = staged(parts.select("lang", "phrase", "a", "cut", "p.head", "p.part"), "parts")
    known = counted.where("k > 0").select("lang", F.col("phrase").alias("part"), "f")
    found = joined_by_key(parts, known, ["lang", "part"])
    sums = [F.max(F.when((F.col("cut") == c) & (F.col("head") == head), F.col("f"))).alias(f"{'l' if head else 'r'}{c}") for c in range(1, LONGEST) for head in (True, False)]
    wide = found.groupBy("lang", "phrase", "a").agg(*sums)
    options = []
    for c in range(1, LONGEST):
        low = F.expr(f"CAST({SCALE} * CAST(a AS decimal(20,0)) AS decimal(38,0)) div CAST(CAST(l{c} AS decimal(20,0)) + CAST(r{c} AS decimal(20,0)) AS decimal(38,0))")
        options.append(F.when(F.col(f"l{c}").isNotNull(), F.struct(low.alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))))
    best = F.least(*options)
    return wide.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of every language (None: all).

    ``docs`` has doc_id, text and lang; A-Z is lower-cased, NULL and empty texts
    have no words, a NULL lang is ``und``, repeated rows count again.  A phrase of
    2 to 4 words is a candidate if it occurs ``support`` times; one that lies in a
    longer candidate at least 80 % as frequent is dropped.  ``l`` and ``r`` are the
    frequencies of the two parts at the cut with the lowest score.  Ties are
    ordered by frequency, then phrase.
    """
    counted = frequent_phrases(docs, support)
    candidates = counted.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice(words, at, size), " "))))
    longer = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * CONTAINED)).select("lang", "k", "phrase", "a")
    scored = _cuts(kept, counted)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = scored.withColumn("rank", rank)
    listed = ranked.where(F.col("rank") <= top) if top else ranked
    return listed.join(counted.where("k = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), phrases AS (
    SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k)
), counted AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY lang, k, phrase
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2 AND f >= 30
), inner_phrases AS (
    SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, a
    FROM (SELECT lang, w, a, size, unnest(range(1, k - size + 2)) AS i FROM candidates, (VALUES (2), (3)) AS v(size) WHERE size < k)
), longer AS (
    SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY lang, phrase
), kept AS (
    SELECT c.* FROM candidates c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase
    WHERE o.longer IS NULL OR 100 * CAST(o.longer AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)
), cuts AS (
    SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS head, array_to_string(list_slice(w, cut + 1, k), ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)
), scored AS (
    SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (CAST(l.f AS HUGEINT) + r.f) AS score
    FROM cuts c JOIN counted l ON l.lang = c.lang AND l.phrase = c.head JOIN counted r ON r.lang = c.lang AND r.phrase = c.rest
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM lowest s JOIN totals t ON t.lang = s.lang QUALIFY rank <= 2000
"""
