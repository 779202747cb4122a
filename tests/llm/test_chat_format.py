"""Chat formatting read back from its output."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assay.llm import chat_format as cf
from assay.llm.queries import ORACLES, QUERIES
from workbench.verify import compare

TEXTS = ["plain", "", cf.TRICKY, r"\b \l \\g <turn x>", "</turn>\n<turn assistant>", "\\", "<<>>", "é中𝄞\n\r\t", "a" * 60_000]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, mask int")


def test_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "<sys>\\")[t % 3], TEXTS[(c + t) % len(TEXTS)], "x", 1) for c in range(9) for t in range(7)]
    done = cf.format_conversations(rows_of(spark, rows).repartition(5).withColumn("parts", cf.text_part(F.col("text"))))
    found = done.select("conv_id", cf.read_turns(F.col("formatted")).alias("turns"), cf.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    assert len(found) == 9
    for r in found:
        mine = [x for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == [(x[2], x[3]) for x in mine]
        assert r["loss"] == "".join(x[3] for x in mine if x[2] == "assistant")


def test_typed_parts(spark):
    parts = [("text", "see <this>", None, None), ("image", None, "s3://a.png", 2.5), ("audio", None, "b.wav", None), (None, "and", None, None), ("document", None, "c.pdf", 3.0), ("video", None, "d", 7.0)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, None, [])], f"conv_id int, turn int, role string, parts {cf.PARTS}")
    r = cf.format_conversations(df).first()
    assert r["formatted"] == "<turn assistant>see \\lthis\\g<image 1.2/><audio 1.3/>and<document 1.5/><video 1.6/></turn>\n<turn user></turn>\n<turn ></turn>\n"
    assert [tuple(a) for a in r["attachments"]] == [("1.2", "image", "s3://a.png", 640), ("1.3", "audio", "b.wav", 25), ("1.5", "document", "c.pdf", 1536), ("1.6", "video", "d", 7)]
    assert r["tokens"] == 2 + 640 + 25 + 1 + 1536 + 7
    assert [r["formatted"][a:b] for a, b in map(tuple, r["mask"])] == ["see \\lthis\\g", "and"]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, "", 0), (None, 1, "assistant", "b", "", 0), (2, 1, "user", "b", "", 0), (2, 1, "user", "a", "", 0), (2, 1, "user", "a", "", 0)]
    done = cf.format_conversations(rows_of(spark, rows).withColumn("parts", cf.text_part(F.col("text")))).select("conv_id", cf.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["t"]] for r in done} == {None: [("", ""), ("assistant", "b")], 2: [("user", "a"), ("user", "a"), ("user", "b")]}
    assert cf.format_conversations(rows_of(spark, rows).limit(0).withColumn("parts", cf.text_part(F.col("text")))).count() == 0


def test_tricky_conversation(spark, sf):
    query = QUERIES["op6_chat_format"](spark, sf)
    assert "Python" not in query._jdf.queryExecution().toString()
    r = query.where("conv_id = -7").first()
    assert (r["n_turns"], r["loss_chars"]) == (2, len(cf.TRICKY))
    assert r["loss_sha256"] == hashlib.sha256(cf.TRICKY.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{cf.TRICKY}\nassistant\n{cf.TRICKY}\n".encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_duckdb(spark, duck, sf, name):
    ok, note = compare(spark, duck, sf, name, QUERIES[name], ORACLES[name])
    assert ok, note
