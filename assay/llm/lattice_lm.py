"""Language-model scores from a lattice of subwords.

The pieces of an existing vocabulary are arcs over the characters of a word.
The probability of a word is the sum over all its segmentations, by a forward
recursion in log space; a text is its words and one end, so the sum over all
segmentations of a text is the product over its words.  The vocabulary's scores
start the pieces' probabilities; forward-backward counts over the training
words re-estimate them.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import lower_words, raw_texts, shared_object, staged, text_key

#: Vocabulary file of a public tokenizer, re-estimations, and added to every piece's count.
VOCABULARY, ROUNDS, SMOOTH = "/opt/tokenizers/piece_bpe_32k.model", 2, 0.1
#: Added to every count of the word model.
BASE_SMOOTH = 0.1
#: A token with one in so many of all occurrences is frequent, so at most so many are; longer ones than that are not broadcast.
FREQUENT, FREQUENT_BYTES = 1_000_000, 64
#: Distinct tokens that a task counts before it passes them on.
HELD_TOKENS = 400_000
_START, _END = "▁", b""
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are scored one by one, others in groups of one length out of so many words.
_LONG, _TOGETHER = 48, 60_000


def vocabulary(path: str) -> tuple[list[str], list[float]]:
    """Pieces and scores of a vocabulary file; bytes as ``<0xNN>``, control pieces left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids]


class Lattice:
    """Pieces with log probabilities, and the recursions over words."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        """``logs`` has one natural log for each piece, and a last one for the end of a text."""
        self.pieces, self.logs = pieces, np.asarray(logs, dtype=np.float64)
        bytes_of = {f"<0x{b:02X}>": b for b in range(256)}
        self.bytes = [0] * 256
        self.ids: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if p in bytes_of:
                self.bytes[bytes_of[p]] = i
            elif _START not in p[1:]:
                self.ids[p] = i
        self.longest = max(map(len, self.ids), default=1)
        self._slots = None

    def arcs(self, char: str) -> list[int]:
        """Pieces that stand for a character without a piece of its own: its bytes."""
        return [self.bytes[b] for b in char.encode("utf-8", "replace")]

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Open addressing from the hash of every beginning of a piece to the piece's id, or to -1 if it is only a beginning."""
        if self._slots is None:
            found: dict[int, int] = {}
            for piece, i in self.ids.items():
                h = 0
                for n, c in enumerate(piece, 1):
                    h = (h + ord(c) + 1) * int(_STEP) % 2**64
                    if n == len(piece) or h not in found:
                        found[h] = i if n == len(piece) else -1
            bits = max(10, (4 * len(found)).bit_length())
            keys, ids, used = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -2, dtype=np.int64), set()
            for h, i in found.items():
                slot = h >> (64 - bits)
                while slot in used:
                    slot = (slot + 1) % len(ids)
                used.add(slot)
                keys[slot], ids[slot] = h, i
            self._slots = keys, ids, np.uint64(64 - bits)
        return self._slots

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces, -1 for beginnings of pieces, -2 for anything else."""
        keys, ids, shift = self._table()
        slot = (hashes >> shift).astype(np.int64)
        out = ids[slot]
        retry = np.flatnonzero((out > -2) & (keys[slot] != hashes))
        while len(retry):
            slot[retry] = (slot[retry] + 1) % len(ids)
            out[retry] = ids[slot[retry]]
            retry = retry[(out[retry] > -2) & (keys[slot[retry]] != hashes[retry])]
        return out

    def log_sums(self, words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log of the sum over all segmentations of each word, and, with ``weights``, the expected counts of the pieces."""
        sums, counts = np.zeros(len(words)), np.zeros(len(self.logs)) if weights is not None else None
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, rows in by_length.items():
            if length > _LONG:
                for i in rows:
                    sums[i] = self._one(words[i], counts, None if weights is None else weights[i])
                continue
            codes = np.frombuffer("".join(_START + words[i] for i in rows).encode("utf-32-le"), dtype="<u4").reshape(len(rows), length + 1)
            sums[rows] = self._many(codes, counts, None if weights is None else weights[rows])
        return sums, counts

    def _many(self, codes: np.ndarray, counts: np.ndarray | None, weights: np.ndarray | None) -> np.ndarray:
        n, length = codes.shape
        steps = codes.astype(np.uint64) + np.uint64(1)
        arcs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []  # from, to, rows, ids (or -1), logs
        spelled: dict[int, list[int]] = {}
        for a in range(length):
            rows, hashes = np.arange(n), np.zeros(n, dtype=np.uint64)
            for b in range(a, min(length, a + self.longest)):
                hashes = (hashes + steps[rows, b]) * _STEP
                ids = self._find(hashes)
                pieces = ids >= 0
                if b == a and not pieces.all():  # characters without a piece
                    bare = np.flatnonzero(~pieces)
                    values, cost = codes[bare, a], np.zeros(len(bare))
                    for c in np.unique(values).tolist():
                        spelled.setdefault(c, self.arcs(chr(c)))
                        cost[values == c] = self.logs[spelled[c]].sum()
                    arcs.append((a, b + 1, bare, np.full(len(bare), -1), cost))
                if pieces.any():
                    arcs.append((a, b + 1, rows[pieces], ids[pieces], self.logs[ids[pieces]]))
                going = ids >= -1
                rows, hashes = rows[going], hashes[going]
                if not len(rows):
                    break
        forward = np.full((length + 1, n), -np.inf)
        forward[0] = 0.0
        for a, b, rows, _, logs in sorted(arcs, key=lambda x: x[1]):
            forward[b, rows] = np.logaddexp(forward[b, rows], forward[a, rows] + logs)
        if counts is None:
            return forward[length]
        backward = np.full((length + 1, n), -np.inf)
        backward[length] = 0.0
        for a, b, rows, _, logs in sorted(arcs, key=lambda x: -x[0]):
            backward[a, rows] = np.logaddexp(backward[a, rows], backward[b, rows] + logs)
        scaled = np.log(np.maximum(weights, 1e-300)) - forward[length]
        for a, b, rows, ids, logs in arcs:
            share = np.exp(forward[a, rows] + logs + backward[b, rows] + scaled[rows])
            if ids[0] >= 0:
                counts += np.bincount(ids, share, len(counts))
            else:
                for row, s in zip(rows.tolist(), share.tolist()):
                    for i in spelled[int(codes[row, a])]:
                        counts[i] += s
        return forward[length]

    def _edges(self, word: str) -> Iterator[tuple[int, int, list[int], float]]:
        text = _START + word
        for a in range(len(text)):
            for b in range(a + 1, min(len(text), a + self.longest) + 1):
                i = self.ids.get(text[a:b])
                if i is not None:
                    yield a, b, [i], float(self.logs[i])
                elif b == a + 1:
                    spelled = self.arcs(text[a])
                    yield a, b, spelled, float(self.logs[spelled].sum())

    def _one(self, word: str, counts: np.ndarray | None, weight: float | None) -> float:
        """The same for one long word, with scaled sums in place of matrices."""
        size = len(word) + 2
        forward = [-math.inf] * size
        forward[0] = 0.0
        for a, b, _, log in self._edges(word):
            x, y = forward[b], forward[a] + log
            forward[b] = y if x == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        total = forward[size - 1]
        if counts is not None:
            backward = [-math.inf] * size
            backward[size - 1] = 0.0
            for a, b, ids, log in reversed(list(self._edges(word))):
                x, y = backward[a], backward[b] + log
                backward[a] = y if x == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
                # All arcs into later places are done, so backward[b] is final.
                share = weight * math.exp(forward[a] + log + backward[b] - total)
                for i in ids:
                    counts[i] += share
        return total


def initial(pieces: list[str], scores: list[float]) -> np.ndarray:
    """Log probabilities from a vocabulary's scores, higher being better, as a Zipf law of their order; the end is like an average piece."""
    order = np.argsort(np.argsort(-np.asarray(scores, dtype=np.float64), kind="stable"), kind="stable")
    weight = np.append(1.0 / (order + 10.0), 0.0)
    weight[-1] = weight[:-1].mean() if len(pieces) else 1.0
    return np.log(weight / weight.sum())


def count_tokens(docs: DataFrame, text: str, train: str) -> DataFrame:
    """(token, c, n): occurrences of every token in training rows and in all rows; the end of a text is the empty token."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            for flag, counter in held.items():
                values = pa.array(counter.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.binary()), values if flag else pa.nulls(len(values), pa.int64()), values], names=["token", "c", "n"])
                counter.clear()

        for part in parts:
            for t, flag in zip(raw_texts(part.column(0)), part.column(1).to_pylist()):
                counter = held[flag]
                counter.update(lower_words(t))
                counter[_END] += 1
                if len(counter) > HELD_TOKENS:
                    yield from out()
        yield from out()

    rows = docs.select(F.col(text).alias("text"), F.col(train).alias("train")).mapInArrow(run, "token binary, c long, n long")
    return rows.groupBy("token").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.sum("n").alias("n"))


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``parts`` in batches of about ``_TOGETHER``."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        held.append(part)
        if sum(p.num_rows for p in held) >= _TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if any(p.num_rows for p in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _words(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in column.to_pylist()]


def estimate(tokens: DataFrame, pieces: list[str], scores: list[float], rounds: int = ROUNDS, smooth: float = SMOOTH) -> Lattice:
    """A lattice whose pieces were re-estimated ``rounds`` times from the training counts of all tokens.

    Each round every distinct training word is gone through once, wherever it
    lies; one total for each piece reaches the driver.
    """
    logs = initial(pieces, scores)
    words = tokens.where("c > 0 AND octet_length(token) > 0").select("token", "c")
    ends = tokens.where("octet_length(token) = 0").agg(F.sum("c")).first()[0] or 0
    for _ in range(rounds):
        shared = shared_object(tokens.sparkSession, Lattice(pieces, logs))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = pickle.loads(shared.value)
            total = np.zeros(len(lattice.logs))
            for part in _gathered(parts):
                total += lattice.log_sums(_words(part.column(0)), part.column(1).to_numpy().astype(np.float64))[1]
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

        counts = np.full(len(logs), smooth)
        for r in words.mapInArrow(run, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():
            counts[r["id"]] += r["n"]
        counts[-1] += ends
        logs = np.log(counts / counts.sum())
    return Lattice(pieces, logs)


def token_scores(tokens: DataFrame, lattice: Lattice, train_tokens: int, distinct: int) -> DataFrame:
    """(token, n, known, base, log10) of every token: its log probability by the word model and by the lattice."""
    shared = shared_object(tokens.sparkSession, lattice)
    floor = BASE_SMOOTH * (distinct + 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pickle.loads(shared.value)
        for part in _gathered(parts):
            words, c = part.column(0).to_pylist(), part.column(1).to_numpy()
            sums = lattice.log_sums([w.decode("utf-8", "replace") for w in words])[0]
            sums[[i for i, w in enumerate(words) if not w]] = lattice.logs[-1]
            base = np.log10((c + BASE_SMOOTH) / (train_tokens + floor))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(c > 0), pa.array(base), pa.array(sums / math.log(10))],
                                             names=["token", "n", "known", "base", "log10"])

    return tokens.select("token", "c", "n").mapInArrow(run, "token binary, n long, known boolean, base double, log10 double")


def score(docs: DataFrame, train: str, text: str = "text", doc_id: str = "doc_id", vocabulary_path: str = VOCABULARY, rounds: int = ROUNDS,
          frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    Learns from the rows where ``train`` holds.  Counts of all tokens stay
    distributed: only tokens with at least one in ``frequent`` of all occurrences,
    hence at most ``frequent`` of them, are broadcast; the others meet their
    documents in a join.  NULL and empty texts consist of an end.  Rows with equal
    id and text get equal scores, one row each.  Without training rows every
    token is unknown.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    tokens = staged(count_tokens(rows, "text", "train"), "tokens")
    train_tokens, distinct, occurrences = (x or 0 for x in tokens.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum("n")).first())
    lattice = estimate(tokens, *vocabulary(vocabulary_path), rounds)
    if not train_tokens:
        distinct = 0
    scored = staged(token_scores(tokens, lattice, max(train_tokens, 0), distinct), "scores")
    often = (F.col("n") * frequent >= occurrences) & (F.octet_length("token") <= FREQUENT_BYTES)
    known = {bytes(r["token"]): (r["base"], r["log10"], int(r["known"])) for r in scored.where(often).toLocalIterator()}
    shared = spark.sparkContext.broadcast(known)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        ends = get(_END)
        for part in parts:
            at, token, times, heads = [], [], [], []
            for i, t in enumerate(raw_texts(part.column(2))):
                base = log10 = 0.0
                n = hits = 0
                for w, k in Counter(lower_words(t)).items():
                    n += k
                    if (x := get(w)) is None:
                        at.append(i)
                        token.append(w)
                        times.append(k)
                        heads.append(None)
                    else:
                        base += k * x[0]
                        log10 += k * x[1]
                        hits += k * x[2]
                if ends is None:
                    at.append(i)
                    token.append(_END)
                    times.append(1)
                    heads.append(None)
                else:
                    base, log10, hits = base + ends[0], log10 + ends[1], hits + ends[2]
                at.append(i)
                token.append(b" %d" % (hash((i, n, base)) & 0xFFFF))  # no token holds a space, so this joins nothing and spreads
                times.append(0)
                heads.append({"n": n + 1, "known": hits, "base": base, "log10": log10})
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(token, pa.binary()), pa.array(times, pa.int64()),
                                              pa.array(heads, pa.struct([("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("log10", pa.float64())]))],
                                             names=["doc_id", "key", "token", "times", "head"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key long, token binary, times long, head struct<n: long, known: long, base: double, log10: double>")
    met = pieces.join(scored.select("token", "known", "base", "log10"), "token", "left")
    each = met.select("doc_id", "key", F.col("head.n").alias("n"), F.when(F.col("head").isNotNull(), 1).otherwise(0).alias("copies"),
                      F.coalesce("head.known", F.col("times") * F.col("known").cast("long")).alias("known"),
                      F.coalesce("head.base", F.col("times") * F.col("base")).alias("base"), F.coalesce("head.log10", F.col("times") * F.col("log10")).alias("log10"))
    summed = each.groupBy("doc_id", "key").agg(*[F.sum(c).alias(c) for c in ("n", "copies", "known", "base", "log10")])
    one = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one.select("doc_id", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
                      F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("log10") / F.col("copies")).alias("score"))
