"""WARC archives: an exact round trip, hand-made archives and damaged ones."""

import gzip
import hashlib
import random

import pytest

from assay.llm import warc
from assay.llm.common import shared_object  # noqa: F401  (the subpackage travels by value)

SCHEMA = "page_id long, url string, payload binary"


def rows():
    rng = random.Random(3)
    long = bytes(rng.randrange(256) for _ in range(200_000))
    tricky = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.WARC/1." * 400
    same = b"<html>" + b"x" * 5000
    return [(1, "http://a/", b"<p>one</p>"), (2, "http://b/ c\r\nWARC/1.0 d", tricky), (3, None, long), (4, "http://a/", b""), (5, "e", None), (9, "f", same), (7, "g%20", same), (8, "h", same + b"y"),
            (10, "short", b"x" * 99), (11, "short", b"x" * 99), (12, "long enough", b"x" * 100), (13, "long enough", b"x" * 100), (7, "g%20", same), (9, "f", same), (3, None, long), (None, "n", same),
            (None, "m", b"\r\n\r\n" * 50), (14, "lines", b"\r\n\r\n" * 50 + b"\n")]


def expected(data):
    out, least = [], {}
    for page, _, payload in data:
        if page is not None:
            least[payload or b""] = min(page, least.get(payload or b"", page))
    for page, _, payload in data:
        payload = payload or b""
        first = least.get(payload) if len(payload) >= 100 else None
        later = first is not None and first != page
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if later else "response", first if later else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk", "segment"), [(4096, 16_384), (7, 100_000), (64, 1000)])
def test_round_trip(spark, monkeypatch, chunk, segment):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    monkeypatch.setattr(warc, "SEGMENT", segment)
    data = rows()
    pages = spark.createDataFrame([(*r, "extra") for r in data], SCHEMA + ", kind string").repartition(3)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == expected(data)


def test_contents_and_addresses(spark, tmp_path):
    data = rows()
    warc.write_archive(spark.createDataFrame(data, SCHEMA), f"{tmp_path}/w")
    read = warc.read_archive(spark, f"{tmp_path}/w").collect()
    assert len(read) == len(data) and all(r["whole"] for r in read)
    responses = [(r["page"], r["uri"], bytes(r["content"])) for r in read if r["kind"] == "response"]
    revisited = {page for page, _, _, kind, _ in expected(data) if kind == "revisit"}
    assert sorted(responses, key=repr) == sorted(((str(p) if p is not None else None, u, b or b"") for p, u, b in data if not (p in revisited and len(b or b"") >= 100 and (p, b) != (None, b"\r\n\r\n" * 50))), key=repr)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def record(kind, block, **fields):
    lines = [f"WARC-Type: {kind}", *(f"WARC-{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_and_damaged_records(spark, tmp_path):
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    good = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    digest = hashlib.sha256(b"abc").hexdigest()
    halves = good[:20], good[20:]
    archive = [
        record("warcinfo", b"software: any", Record_ID="<info>"),
        record("response", good, Record_ID="<plain>", Payload_Digest=f"sha256:{digest}", Target_URI="http://x/"),
        record("response", good, Record_ID="<wrong digest>", Payload_Digest="sha256:00"),
        record("response", chunked + b"3;x=y\r\nabc\r\n0\r\n\r\n", Record_ID="<chunked>"),
        record("response", chunked + b"3\r\nabcd\r\n0\r\n\r\n", Record_ID="<bad chunk>"),
        record("response", chunked + b"3\r\nabc\r\n", Record_ID="<no last chunk>"),
        record("continuation", halves[1], Record_ID="<s2>", Segment_Number=2, Segment_Origin_ID="<cut>", Segment_Total_Length=len(good)),
        record("response", halves[0], Record_ID="<cut>", Segment_Number=1),
        record("response", halves[0], Record_ID="<gap>", Segment_Number=1),
        record("continuation", halves[1], Record_ID="<g3>", Segment_Number=3, Segment_Origin_ID="<gap>", Segment_Total_Length=len(good)),
        record("response", halves[0], Record_ID="<short>", Segment_Number=1),
        record("continuation", halves[1], Record_ID="<h2>", Segment_Number=2, Segment_Origin_ID="<short>", Segment_Total_Length=len(good) + 1),
        record("revisit", b"", Record_ID="<again>", Refers_To="<plain>"),
        record("revisit", b"", Record_ID="<lost>", Refers_To="<nowhere>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in archive))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("response", good, Record_ID="<cut off>")[:-8]))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("response", good, Record_ID="<next>")))
    read = {r["record"]: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    whole = {"plain", "chunked", "cut", "again", "next"}
    assert set(read) == whole | {"wrong digest", "bad chunk", "no last chunk", "gap", "short", "lost", "cut off"}
    assert {k for k, r in read.items() if r["whole"]} == whole
    assert all(bytes(read[k]["content"]) == b"abc" for k in whole - {"again"})
    assert (read["again"]["payload_bytes"], read["again"]["payload_digest"]) == (3, digest)
    assert read["plain"]["uri"] == "http://x/"
