"""Cross-parsing against direct longest matches, and held-out accuracy."""

import random

import pytest

from assay.llm import language_id
from assay.llm.queries import QUERIES


def letters(text):
    out = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    return " " + "".join(w + " " for w in out.split()) if out.split() else " "


def slow_phrases(sample, text):
    """Phrases of ``text``, each the longest match that occurs in ``sample``, at least one character."""
    sample, text, n, at = letters(sample), letters(text), 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


SAMPLES = {"a": "the cat and the dog ran to the house, then they ate", "b": "der Hund und die Katze gehen zum Haus über die Straße", "c": "el perro y el gato corren a la casa"}


@pytest.mark.parametrize("n", [3, 40])
def test_phrases_equal_direct_search(n):
    rng = random.Random(n)
    pool = " ".join(SAMPLES.values()).split() + ["Ünï", "中文", "x1y", "!!", "ÄÖ", "İ"]
    texts = ["", "?!", "a", "The CAT and the dog"] + [" ".join(rng.choices(pool, k=rng.randrange(1, 60 if n > 10 else 900))) for _ in range(n)]
    parser = language_id.Parser(SAMPLES)
    found = parser.phrases(texts)
    for i, t in enumerate(texts):
        assert found[i].tolist() == [slow_phrases(SAMPLES[k], t) for k in parser.languages], t


def test_odd_rows(spark):
    parser = language_id.Parser(SAMPLES)
    rows = [(1, None), (2, ""), (3, "12 !! \n"), (4, "der Hund und die Katze"), (4, "der Hund und die Katze"), (None, "THE CAT AND THE DOG"), (5, "el perro y el gato " * 20_000)]
    df = spark.createDataFrame([(d, t, "x", 9.0, "en") for d, t in rows], "doc_id long, text string, lang_pred string, score double, lang string")
    found = {(r["doc_id"], (r["text"] or "")[:9]): (r["lang_pred"], r["score"]) for r in language_id.identify(df, parser).collect()}
    assert [found[k][0] for k in [(1, ""), (2, ""), (3, "12 !! \n"), (4, "der Hund "), (None, "THE CAT A"), (5, "el perro ")]] == ["und", "und", "und", "b", "a", "c"]
    assert all(0 <= s <= 1 for _, s in found.values()) and found[(1, "")][1] == 0
    assert language_id.identify(df.limit(0), parser).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    parser = language_id.fit(df)
    assert [r["lang_pred"] for r in language_id.identify(df, parser).collect()] == ["und", "und"]


def test_sample_is_bounded_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (language_id.fit(d, sample_chars=500) for d in (docs, docs.repartition(7)))
    assert (one.table == two.table).all()
    assert max(one.norm) <= 9.1


def test_every_label_is_learned(spark):
    def words(i, n):
        draw = random.Random(n)
        return " ".join("".join(draw.choices("bcdfg"[i % 5] + "hjklm"[i // 5 % 5] + "pqrst"[i // 25 % 5] + "aeiou"[i % 4], k=6)) for _ in range(n))

    labels = [f"l{i:02}" for i in range(70)]
    rows = [(i, words(i, 20 + n), label) for i, label in enumerate(labels) for n in range(4)]
    rows += [(99, "one and the same text", "hot")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = language_id.fit(df, table_chars=70 * 60)
    assert parser.languages == sorted([*labels, "hot"])
    assert max(parser.norm) <= 7  # at most 60 characters of a label and the spaces around them
    found = language_id.identify(df.where("lang <> 'hot'"), parser).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) > len(found) / 2


def test_table_is_bounded():
    samples = {f"l{i}": "".join(chr(0x4E00 + 97 * i + k % 90) for k in range(3000)) for i in range(20)}
    cut = language_id.shortened(samples, 400_000)
    assert cut.keys() == samples.keys() and all(cut.values())
    assert language_id.Parser(cut).table.size <= 400_000
    assert language_id.shortened(samples, 10**9) == samples and language_id.shortened({}) == {}


def test_held_out_accuracy(spark, sf):
    found = QUERIES["op4_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 40
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
