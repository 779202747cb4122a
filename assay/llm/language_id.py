"""Language identification by cross-parsing: how few phrases of a labelled text cover a document.

For each language the suffix automaton of a bounded labelled sample is built on
the driver and turned into a transition table.  A document is parsed greedily:
each phrase is the longest match, from where the last one ended, that occurs in
the sample; a character that the sample lacks is a phrase of its own.  The
language with the fewest phrases per log of its sample's length wins.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import shared_object

#: Predicted for a text that is NULL or has no letter.
UNDETERMINED = "und"
#: The sample: about so many rows, and at most so many characters, of each language.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 24_000
#: Characters of all samples together; beyond 64 languages each sample is shorter, and from so few rows at least.
TABLE_CHARS, LEAST_ROWS = 64 * SAMPLE_CHARS, 32
#: Entries of the transition table, of four bytes each; larger alphabets shorten the samples as well.
TABLE_ENTRIES = 50_000_000
#: Below so many documents still running, the rest is parsed one by one.
_FEW = 24
_SPACE, _OTHER = 0, 1


class Automaton:
    """Suffix automaton of a sequence of symbols."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state


def _letters() -> np.ndarray:
    """For every code point: 0, or for a letter the code point of its lower case plus 1."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x30000):  # planes above hold no letters but unassigned ones and ideographs
        if chr(i).isalpha():
            low = chr(i).lower()
            table[i] = 1 + (ord(low) if len(low) == 1 else i)
    table[0x30000:0x32400] = np.arange(0x30000, 0x32400) + 1
    return table


def points(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-cased letters of a text as code points, other runs as single spaces, a space at either end."""
    codes = letters[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    codes = np.concatenate(([0], codes, [0]))
    return np.maximum(codes[(codes > 0) | np.concatenate(([True], codes[:-1] > 0))].astype(np.int64) - 1, 32)


class Parser:
    """The automata of all languages in one table: next state, and whether a phrase ended before it.

    ``table[state * width + symbol]`` is ``2 * next + ended``.  A symbol without
    a continuation ends the phrase and starts the next one at the language's
    root; one that the root lacks as well leads back to the root.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = _letters()
        parts = {k: points(samples[k], letters) for k in self.languages}
        alphabet = sorted(set(np.concatenate([*parts.values(), [32]]).tolist()) - {32})
        self.symbols = {32: _SPACE} | {c: i + 2 for i, c in enumerate(alphabet)}
        self.width = len(alphabet) + 2
        self.roots, tables, offset = [], [], 0
        self.norm = np.array([math.log2(len(parts[k]) + 1) for k in self.languages])
        for k in self.languages:
            states = Automaton([self.symbols[c] for c in parts[k].tolist()]).next
            start = np.full(self.width, 2 * offset + 1, dtype=np.int32)
            for c, s in states[0].items():
                start[c] = 2 * (offset + s) + 1
            rows = np.tile(start, (len(states), 1))
            for i, arcs in enumerate(states[1:], 1):
                for c, s in arcs.items():
                    rows[i, c] = 2 * (offset + s)
            self.roots.append(offset)
            tables.append(rows.reshape(-1))
            offset += len(states)
        self.table = np.concatenate(tables or [np.zeros(0, dtype=np.int32)])
        self._map = None

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        if self._map is None:
            table = np.full(0x110000, _OTHER, dtype=np.uint8 if self.width < 256 else np.uint32)
            for c, i in self.symbols.items():
                table[c] = i
            self._map = _letters(), table
        return self._map

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text under each language.  At the root no phrase is open, hence none is counted when one starts there."""
        letters, table = self.classes()
        coded = [table[points(t, letters)] for t in texts]
        order = sorted(range(len(coded)), key=lambda i: -len(coded[i]))
        lengths = np.array([len(coded[i]) for i in order])
        counts = np.zeros((len(order), len(self.languages)), dtype=np.int64)
        states = np.tile(np.array(self.roots, dtype=np.int64), (len(order), 1))
        step, width, chunk = 0, self.width, 512
        active = int(np.searchsorted(-lengths, 0, side="left"))
        while active >= _FEW:
            block = np.zeros((chunk, active), dtype=np.int64)
            for row, i in enumerate(order[:active]):
                part = coded[i][step:step + chunk]
                block[:len(part), row] = part
            running = np.searchsorted(-lengths, -np.arange(step, step + chunk + 1), side="left").tolist()  # texts longer than that
            for symbols, active in zip(block, running):
                if active < _FEW:
                    break
                now, ended = states[:active], counts[:active]
                now *= width
                now += symbols[:active, None]
                moved = self.table[now]
                ended += moved & 1
                np.right_shift(moved, 1, out=now, casting="unsafe")
                step += 1
            else:
                active = running[-1]
        # The rows still running and, if the loop never ran, all others stand at ``step``.
        for row in range(active):
            rest = coded[order[row]][step:].tolist()
            for k in range(len(self.languages)):
                counts[row, k] += self._one(rest, int(states[row, k]))
        out = np.empty_like(counts)
        out[order] = counts
        return out

    def _one(self, symbols: list[int], state: int) -> int:
        table, width, ended = self.table, self.width, 0
        for c in symbols:
            moved = int(table[state * width + c])
            ended += moved & 1
            state = moved >> 1
        return ended

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: 1 minus the best normalised number of phrases over the second best."""
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not known or not self.languages:
            return names, scores
        cost = self.phrases([texts[i] for i in known]) * self.norm
        best = np.argmin(cost, axis=1)
        least = cost[np.arange(len(known)), best]
        others = cost.copy()
        others[np.arange(len(known)), best] = np.inf
        second = others.min(axis=1)
        margin = np.where(np.isinf(second), 1.0, 1.0 - least / np.maximum(second, 1e-9))
        for i, b, m in zip(known, best.tolist(), margin.tolist()):
            names[i], scores[i] = self.languages[b], min(max(m, 0.0), 1.0)
        return names, scores


def shortened(samples: dict[str, str], entries: int = TABLE_ENTRIES) -> dict[str, str]:
    """The samples cut to one length for which the table surely has at most ``entries``: two states a character, one symbol a letter."""
    size = max(map(len, samples.values()), default=0)
    while size > 1:
        need = 2 * sum(map(len, samples.values())) * (len(set().union(*samples.values())) + 2)
        if need <= entries:
            break
        size = max(1, size * entries // need)
        samples = {k: v[:size] for k, v in samples.items()}
    return samples


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
        table_chars: int = TABLE_CHARS) -> Parser:
    """Automata of a bounded sample of labelled rows, one for every label.

    Distinct texts are drawn by their hash, about ``sample_rows`` of each
    language, and joined in that order up to ``sample_chars`` characters.  With
    so many labels that this exceeds ``table_chars`` in all, or letters that the
    table does, every label is learned from a shorter sample.  Rows without text or label are left out; an
    empty table gives a parser that answers ``und``.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    samples = dict.fromkeys(sorted(texts), "")
    if not samples:
        return Parser(samples)
    chars = max(1, min(sample_chars, table_chars // len(samples)))
    some = max(LEAST_ROWS, min(sample_rows, sample_rows * table_chars // (sample_chars * len(samples))))
    shares = spark.createDataFrame([(k, min(1.0, some / max(n, 1))) for k, n in texts.items()], "lang string, share double")
    place = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    drawn = rows.join(F.broadcast(shares), "lang").where((place < F.col("share")) | (F.col("share") == 1))
    sizes = sorted((r["lang"], r["h"], r["n"]) for r in drawn.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n")).collect())
    wanted, filled = [], dict.fromkeys(samples, 0)
    for k, h, n in sizes:
        if (room := chars - filled[k]) > 0:
            wanted.append((k, h, min(n, room)))
            filled[k] += n
    asked = F.broadcast(spark.createDataFrame(wanted, "lang string, h long, room int"))
    got = drawn.join(asked, ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.expr("substr(text, 1, room)")).alias("text"))
    for r in sorted(got.collect()):
        samples[r["lang"]] += r["text"] + "\n"
    return Parser(shortened({k: v for k, v in samples.items() if v}))


def identify(docs: DataFrame, parser: Parser, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score between 0 and 1.

    The whole text is parsed.  NULL, empty and letterless texts are ``und`` with
    score 0; equal costs go to the smaller label with score 0; with a single
    learned language every other text scores 1.  Repeated rows are judged alike.
    Input columns with the names of the new ones are replaced.
    """
    keep = [c for c in docs.columns if c not in names]
    shared = shared_object(docs.sparkSession, parser)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = pickle.loads(shared.value)
        for part in parts:
            for at in range(0, part.num_rows, 2_000):
                piece = part.slice(at, 2_000)
                lang, score = parser.decide(piece.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    return docs.select(*keep).mapInArrow(run, schema)


def has_language(lang_pred: Column) -> Column:
    return lang_pred != UNDETERMINED
