"""Near-duplicates by the Jaccard similarity of word shingles, screened by bit-sliced fingerprints.

Two sets of hashed shingles that reach the similarity share one of their first
shingles in any common order (prefix filtering), so they meet in a bucket.
There the sets' fingerprints are stored as bit planes, and carry-save counters
leave only what is near; pairs left make up coarse groups.  Inside a group the
sets themselves are compared, so that every link is exact.  Shingles that a
sample of texts shows to be common come last in the order and tell which buckets
are large; whatever the sample says, the same links are found.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.bloom import mixed
from assay.llm.common import discard, lower_words, raw_texts, shared_object, small, staged, text_key
from assay.llm.components import components
from assay.llm.simhash import group_firsts, near, planes

SHINGLE = 5
#: Similarity of 4/5: sets of n and m shingles have it if they share at least 4/9 of n + m.
NEED, OF = 4, 5
#: Fingerprints of sets at the similarity differ in 9.7 of 64 bits on average with a deviation of 2.9, unrelated ones in 32.
RADIUS = 24
#: One text in so many is looked at for common shingles, which are those that so many of the texts looked at have.
SAMPLE, COMMON, MOST_COMMON = 16, 3, 1_000_000
#: Members of a bucket, and members and shingles of a coarse group, that one task compares; more are cut into parts.
BUCKET_ROWS, PART_ROWS, PART_SHINGLES = 4096, 4096, 1 << 22
#: Members of a coarse group with several parts that every part sees.
PIVOTS = 16
_COMMON_BIT = np.uint64(1 << 62)
_WINDOW = 1 << 13
_BASE = 0x9E3779B97F4A7C55
_LETTERS = mixed(np.arange(256, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Hashes of all runs of ``SHINGLE`` words as differences of a running sum over the bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        text = np.frombuffer(b" ".join(words), dtype=np.uint8)
        if len(text) >= len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(text)), _powers(pow(_BASE, -1, 1 << 64), 2 * len(text))
        spaces = np.flatnonzero(text == 32)
        starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(text)]))
        n = max(len(words) - SHINGLE + 1, 1)
        running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[text] * self.up[:len(text)], dtype=np.uint64)))
        starts, ends = starts[:n], ends[len(words) - n:]
        return mixed((running[ends] - running[starts]) * self.down[starts])


def shingles(text: bytes, hasher: _Hasher) -> np.ndarray:
    """The distinct shingles of a text, hashed to 62 bits and sorted."""
    words = lower_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    parts = [hasher(words[at:at + _WINDOW + SHINGLE - 1]) for at in range(0, max(len(words) - SHINGLE + 1, 1), _WINDOW)]
    return np.unique(np.concatenate(parts) >> np.uint64(2))


def _late(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Shingles as ordered positive numbers, those in ``common`` (sorted) behind the others."""
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        values = np.sort(np.where(common[at] == values, values | _COMMON_BIT, values))
    return values.view(np.int64)


def _fingerprint(values: np.ndarray) -> np.uint64:
    """Majority of each bit over the shingles of a set."""
    counts = np.zeros(64, dtype=np.int64)
    spread = values * np.uint64(_BASE)
    for at in range(0, len(values), 8192):
        counts += np.unpackbits(spread[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ((counts * 2 > len(values)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64)


def _prefix(n: int) -> int:
    """How many of the first shingles of a set of ``n`` meet those of every similar set."""
    return n - -(-NEED * n // OF) + 1 if n else 0


def _named(values: np.ndarray) -> int:
    """A signed number for a set; 0 for the empty one."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(values.tobytes())).view(np.int64))) if len(values) else 0


def _common(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common among one text in ``SAMPLE``, sorted, and how many of these have each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for part in small(parts, 64):
            found = [shingles(t, hasher) for t in raw_texts(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    some = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(text)
    counted = some.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON)
    found = counted.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    values, counts = (found.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(values)
    return values[order].astype(np.uint64), counts[order]


def _prefixes(docs: DataFrame, text: str, doc_id: str, common: np.ndarray) -> DataFrame:
    """(doc_id, key, print, n, sim, first) of every row: its set's name, size, fingerprint and first shingles."""
    held = shared_object(docs.sparkSession, common)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, hasher = pickle.loads(held.value), _Hasher()
        for part in small(parts):
            sets = [shingles(t, hasher) for t in raw_texts(part.column(2))]
            sims = np.array([_fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([_named(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sims),
                 pa.array([_late(s, late)[:_prefix(len(s))] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "key", "print", "n", "sim", "first"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, print long, n long, sim long, first array<long>")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of rows, sorted by their first column, for each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column(0)[0].as_py() != keys[a]:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _column(group: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in group])


def _by_task(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over the rows of each ``task``, which stand together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, schema)


def _entries(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, print, parts) of the first shingles; a task gives each set once, however many copies it sees.

    ``parts`` is into how many parts the bucket of a common shingle is cut, 0 for other shingles.
    """
    held, share = shared_object(rows.sparkSession, common), SAMPLE * 1.25 / BUCKET_ROWS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (values, sampled), seen = pickle.loads(held.value), set()
        for part in small(parts, 1024):
            prints = part.column(0).to_pylist()
            new = [i for i, p in enumerate(prints) if not (p in seen or seen.add(p))]
            mine = part.take(pa.array(new, pa.int64()))
            counts = mine.column(1).value_lengths().to_numpy(zero_copy_only=False)
            first = mine.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            parts_, late = np.zeros(len(first), dtype=np.int32), first >= _COMMON_BIT
            parts_[late] = np.ceil(sampled[np.searchsorted(values, first[late] ^ _COMMON_BIT)] * share)
            yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.repeat(mine.column(0).to_numpy(), counts)), pa.array(parts_)], names=["shingle", "print", "parts"])

    return rows.where("n > 0").select("print", "first").mapInArrow(run, "shingle long, print long, parts int")


def _met(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, print, parts): entries of buckets with several sets, and into how many parts each bucket is cut.

    Common shingles are taken as they are, so only rare ones, whose buckets are small, are shuffled to see whether sets meet.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), dtype=np.int64)

        def kept(pairs: np.ndarray) -> pa.RecordBatch:
            if pairs.shape[1]:
                new = np.ones(pairs.shape[1], dtype=bool)
                new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
                pairs = pairs[:, new]
                begins = np.flatnonzero(np.concatenate(([True], pairs[0, 1:] != pairs[0, :-1])))
                sizes = np.diff(np.append(begins, pairs.shape[1]))
                pairs = pairs[:, np.repeat(sizes > 1, sizes)]
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["shingle", "print"])

        for batch in batches:
            held = np.concatenate((held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])), axis=1)
            if held.shape[1]:
                last = int(np.searchsorted(held[0], held[0, -1]))
                yield kept(held[:, :last])
                held = held[:, last:]
        yield kept(held)

    entries = _entries(rows, common)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = entries.where("parts = 0").select("shingle", "print").repartition(n, "shingle").sortWithinPartitions("shingle", "print").mapInArrow(shared, "shingle long, print long")
    return rare.withColumn("parts", F.lit(1)).unionByName(entries.where("parts > 0"))


def _tasks(parts: Column, *key: Column) -> Column:
    """The tasks in which a row's part meets itself and every other part."""
    mine = F.pmod(F.xxhash64("print"), parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.xxhash64(*key, F.least(p, mine), F.greatest(p, mine)))


def _neighbours(sims: np.ndarray, sizes: np.ndarray) -> Callable[[int], np.ndarray]:
    """For a member: those whose fingerprints are near and whose sizes allow the similarity; and how many are near at all."""
    if len(sims) <= 32:
        close = np.bitwise_count(sims[:, None] ^ sims[None, :]) <= RADIUS
        lanes = lambda i: close[i]
        degrees = close.sum(axis=1)
    else:
        sliced = planes(sims)
        bits = np.concatenate([near(sims[at:at + 64], sliced, RADIUS) for at in range(0, len(sims), 64)])
        lanes = lambda i: np.unpackbits(bits[i].view(np.uint8), bitorder="little")[:len(sims)]
        degrees = np.bitwise_count(bits).sum(axis=1)

    def of(i: int) -> np.ndarray:
        js = np.flatnonzero(lanes(i))
        return js[(js != i) & (np.minimum(sizes[js], sizes[i]) * OF >= np.maximum(sizes[js], sizes[i]) * NEED)]

    of.degrees = degrees
    return of


def _link(labels: np.ndarray, of: Callable[[int], np.ndarray], similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links between members that connect all similar neighbours, and none that ``labels`` shows to be connected."""
    found, done = [], np.zeros(len(labels), dtype=bool)
    for i in np.argsort(-of.degrees, kind="stable").tolist():
        js = of(i)
        js = js[(labels[js] != labels[i]) & ~done[js]]
        done[i] = True
        for j in js[similar(i, js)].tolist() if len(js) else ():
            if labels[j] != labels[i]:
                found.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return found


def _screened(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect, in every bucket, the sets whose fingerprints are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            prints, at = np.unique(_column(group, 1), return_index=True)
            if len(prints) > 1:
                of = _neighbours(_column(group, 3)[at].view(np.uint64), _column(group, 2)[at])
                links = np.array(_link(np.arange(len(prints)), of, lambda i, js: np.ones(len(js), dtype=bool)), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(prints[links[:, 0]]), pa.array(prints[links[:, 1]])], names=["a", "b"])

    tasks = met.select("print", F.explode(_tasks(F.col("parts"), F.col("shingle"))).alias("task")).join(sets, "print")
    return _by_task(tasks.select("task", "print", "n", "sim"), run, "a long, b long")


def _similar(members: DataFrame) -> DataFrame:
    """(a, b): links that connect, in every task of ``members`` (task, print, label, text), all sets with the similarity.

    Sets with equal ``label`` are known to be connected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for group in _grouped(batches):
            prints, at = np.unique(_column(group, 1), return_index=True)
            if len(prints) < 2:
                continue
            found: dict[int, np.ndarray] = {}
            for batch in group:
                for p, text in zip(batch.column(1).to_pylist(), raw_texts(batch.column(3))):
                    if p not in found:
                        found[p] = shingles(text, hasher)
            sets = [found[p] for p in prints.tolist()]
            sizes = np.array([len(s) for s in sets])

            def similar(i: int, js: np.ndarray) -> np.ndarray:
                others = np.concatenate([sets[j] for j in js.tolist()])
                place = np.minimum(np.searchsorted(sets[i], others), sizes[i] - 1)
                begins = np.concatenate(([0], np.cumsum(sizes[js])[:-1]))
                return (NEED + OF) * np.add.reduceat((sets[i][place] == others).astype(np.int64), begins) >= NEED * (sizes[js] + sizes[i])

            of = _neighbours(np.array([_fingerprint(s) for s in sets], dtype=np.uint64), sizes)
            links = np.array(_link(_column(group, 2)[at].copy(), of, similar), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(prints[links[:, 0]]), pa.array(prints[links[:, 1]])], names=["a", "b"])

    return _by_task(members, run, "a long, b long")


def similar_links(docs: DataFrame, rows: DataFrame, common: tuple[np.ndarray, np.ndarray], text: str, doc_id: str) -> DataFrame:
    """(a, b): links between names of sets in ``rows`` (of ``_prefixes``) that connect all similar sets, and none but similar ones."""
    sets = staged(rows.where("n > 0").groupBy("print").agg(F.first("n").alias("n"), F.first("sim").alias("sim"), F.min(F.struct("doc_id", "key")).alias("at")), "sets")
    met = staged(_met(rows, common), "met")
    coarse = components(staged(_screened(met, sets.select("print", "n", "sim")), "near"), "a", "b")
    members = coarse.withColumnRenamed("node", "print").join(sets.select("print", "n", "at"), "print")
    sized = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    members = staged(members.join(sized, "root").select("root", "print", "parts", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int").alias("part"), "at.*"), "members")

    def with_texts(tasks: DataFrame) -> DataFrame:
        """``tasks`` (print, label, task) with a text of each set."""
        tasks = staged(tasks, "tasks")
        wanted = members.join(tasks.select("print").distinct(), "print", "left_semi").select("print", "doc_id", "key")
        texts = docs.select(F.col(doc_id).alias("__id"), text_key(F.col(text)).alias("__key"), F.col(text).alias("__text"))
        wanted = staged(wanted, "wanted")
        found = texts.join(wanted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("key"))).select("print", F.col("__text").alias("text"))
        return found.dropDuplicates(["print"]).join(tasks, "print").select("task", "print", "label", "text")

    order = F.row_number().over(W.partitionBy("root").orderBy(F.xxhash64("print"), "print"))
    pivots = members.where("parts > 1").withColumn("nth", order).where(F.col("nth") <= PIVOTS).select(
        "print", F.col("print").alias("label"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64("root", p))).alias("task"))
    own = members.select("print", F.col("print").alias("label"), F.xxhash64("root", "part").alias("task"))
    links = staged(_similar(with_texts(own.unionByName(pivots))), "links")
    large = members.where("parts > 1")
    if not large.isEmpty():
        links = links.unionByName(staged(_similar(with_texts(_left_over(large, links))), "links"))
    discard(met)
    return links


def _left_over(large: DataFrame, links: DataFrame) -> DataFrame:
    """(print, label, task) in which all sets of a coarse group that are not yet connected meet.

    Of each group the largest component stays in its parts; the other sets, in
    parts of their own, go to every part.
    """
    found = components(links, "a", "b").select(F.col("node").alias("print"), F.col("root").alias("label"))
    known = staged(large.join(found, "print", "left").select("root", "print", "parts", "part", F.coalesce("label", "print").alias("label")), "labelled")
    counts = known.groupBy("root", "label").count()
    most = counts.groupBy("root").agg(F.max(F.struct("count", "label")).alias("most"), F.sum("count").alias("all")).select(
        "root", F.col("most.label").alias("most"), F.ceil((F.col("all") - F.col("most.count")) / PART_ROWS).cast("int").alias("rests")).where("rests > 0")
    open_ = known.join(most, "root")
    rest = F.pmod(F.xxhash64("print", F.lit(1)), F.col("rests")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda q: F.xxhash64("root", "part", q))
    again = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64(F.col("root"), p, rest))
    return open_.select("print", "label", F.explode(every).alias("task")).unionByName(open_.where(F.col("label") != F.col("most")).select("print", "label", F.explode(again).alias("task")))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without near-duplicates: of each component one row with the smallest id stays, NULL ids last.

    Texts are linked if the sets of their five-word shingles have a Jaccard
    similarity of 0.8 or more; words are cut at white space, A-Z lower-cased, and
    a shorter text is one shingle.  Wordless and NULL texts are one group.  What
    decides among rows of an id is as in ``simhash.keep_first``.
    """
    common = _common(docs, text)
    rows = staged(_prefixes(docs, text, doc_id, common[0]), "prefixes")
    links = similar_links(docs, rows, common, text, doc_id)
    groups = group_firsts(rows.select("doc_id", "key", "print"), links)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("key").eqNullSafe(F.col("first.key"))
    decided = rows.select("doc_id", "key", "print").join(groups, F.col("print") == F.col("node")).groupBy("doc_id", "key").agg(F.max(same).alias("stays"), F.count("*").alias("copies"))
    decided = staged(decided.where("NOT stays OR copies > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "stays"), "decided")
    discard(rows)
    named = docs.withColumn("__text", text_key(F.col(text)))
    at = F.col(doc_id).eqNullSafe(F.col("__id")) & F.col("__text").eqNullSafe(F.col("__key"))
    ordered = [F.col(f.name) for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in (text, doc_id)]
    nth = F.row_number().over(W.partitionBy(doc_id, "__text").orderBy(*ordered, F.lit(0)))
    once = named.join(decided, at, "left_anti").select(*docs.columns)
    several = named.join(decided.where("stays"), at, "left_semi").withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
    return once.unionByName(several)
