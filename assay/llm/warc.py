"""WARC archives: writing with segments and chunked transfer framing, and reading them back.

Large records are cut into segments, which are records of their own.  A reader
groups continuations by the identifier of their first segment, orders them by
number, verifies the total length and decodes the transfer framing.  Archives
are gzip text files whose records Spark reads one by one, so no file is ever
held as a whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import joined_by_key, staged
from assay.session import shared_folder

#: Payloads from this size on are written once; bytes of a transfer chunk and of a segment; pages in an archive.
LEAST_REVISIT, CHUNK, SEGMENT, FILE_ROWS = 100, 4096, 16_384, 100_000
DATE = "2024-01-31T00:00:00Z"
_END, _MARK = "\r\n", "WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PARSED = ("record string, kind string, origin string, number int, total long, page string, uri string, refers_to string, declared string, "
           "payload_bytes long, payload_digest string, whole boolean, segmented boolean, content binary")


def _bytes(text: Column) -> Column:
    return text.cast("binary")


def _pieces(value: Column, size: int) -> Column:
    """A binary in pieces of ``size`` bytes, at least one."""
    count = F.greatest(F.ceil(F.octet_length(value) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(value, i * size + 1, F.lit(size)))


def _chunked(payload: Column) -> Column:
    """Transfer framing: each chunk behind its length in hexadecimal, then an empty one."""
    framed = F.transform(_pieces(payload, CHUNK), lambda c: F.concat(F.hex(F.octet_length(c).cast("long")), F.lit(_END), c.cast("string"), F.lit(_END)))
    return F.when(F.octet_length(payload) > 0, F.array_join(framed, "")).otherwise("")


def _record_id(page: Column, digest: Column) -> Column:
    """An identifier that depends on the page's id and payload alone, so that reruns of a task agree."""
    h = F.md5(_bytes(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest)))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for NULL; control characters and spaces are escaped."""
    safe = value.cast("string")
    for char in ("%", "\r", "\n", " "):
        safe = F.replace(safe, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit(_END))).otherwise("")


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, bytes, digest, record) of every row of ``pages``; a NULL payload is empty."""
    payload = F.coalesce("payload", _bytes(F.lit("")))
    digest = F.sha2(payload, 256)
    return pages.select("page_id", F.octet_length(payload).cast("long").alias("bytes"), digest.alias("digest"), _record_id(F.col("page_id"), digest).alias("record"))


def revisits(pages: DataFrame) -> DataFrame:
    """(record, first): records whose payload, of ``LEAST_REVISIT`` bytes or more, a page with a smaller id has too, and that page's record."""
    large = staged(marked(pages).where(F.col("bytes") >= LEAST_REVISIT).select("page_id", "digest", "record"), "marks")
    first = large.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL")
    later = joined_by_key(large, first.select("digest", "least"), ["digest"]).where(~F.col("page_id").eqNullSafe(F.col("least")))
    return later.select("record", _record_id(F.col("least"), F.col("digest")).alias("first")).distinct()


def write_archive(pages: DataFrame, path: str) -> None:
    """Write a record for every row of ``pages`` (page_id, url, payload binary), larger ones in segments.

    Of equal payloads with at least ``LEAST_REVISIT`` bytes the page with the
    smallest id is a response and the others revisit it; NULL ids are never the
    smallest.  Rows with equal id and payload are responses, or revisits, alike.
    NULL payloads are empty.
    """
    again = staged(revisits(pages), "revisits").withColumnRenamed("record", "later")
    payload = F.coalesce("payload", _bytes(F.lit("")))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("record", _record_id(F.col("page_id"), F.col("digest"))).join(again, F.col("record") == F.col("later"), "left")
    body = F.when(F.col("first").isNull(), F.concat(F.lit(_HTTP), _chunked(F.col("payload")), F.lit("0\r\n\r\n"))).otherwise(_HTTP)
    segments = rows.withColumn("block", _bytes(body)).select(
        "page_id", "url", "digest", "record", "first", F.octet_length("block").alias("total"), F.posexplode(_pieces(F.col("block"), SEGMENT)).alias("at", "block"))
    count = F.ceil(F.col("total") / SEGMENT)
    cut, begins, ends = count > 1, F.col("at") == 0, F.col("at") == count - 1
    kind = F.when(~begins, "continuation").when(F.col("first").isNull(), "response").otherwise("revisit")
    own = F.when(begins, F.col("record")).otherwise(F.concat("record", F.lit("-"), F.col("at") + 1))
    angled = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    header = F.concat(
        F.lit(_MARK + "1" + _END), _field("WARC-Type", kind), _field("WARC-Record-ID", angled(own)), F.lit(f"WARC-Date: {DATE}{_END}"), _field("WARC-Target-URI", F.col("url")),
        _field("X-Page-ID", F.col("page_id")), _field("WARC-Payload-Digest", F.when(begins, F.concat(F.lit("sha256:"), "digest"))),
        _field("WARC-Refers-To", F.when(begins, angled(F.col("first")))), _field("WARC-Profile", F.when(begins & F.col("first").isNotNull(), F.lit(_PROFILE))),
        _field("WARC-Segment-Number", F.when(cut, F.col("at") + 1)), _field("WARC-Segment-Origin-ID", F.when(~begins, angled(F.col("record")))),
        _field("WARC-Segment-Total-Length", F.when(cut & ends, F.col("total"))), F.lit("Content-Type: application/http;msgtype=response" + _END),
        F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(_END * 2))
    lines = segments.select(F.concat(header, F.col("block").cast("string")).alias("value"))
    lines.write.option("lineSep", _END * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", FILE_ROWS).text(path)


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a header by lower-case name; the first line is skipped."""
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields


def records(pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(fields, block, whole) of the records in ``pieces`` (file, what stands between two marks).

    A mark inside a record ends a piece too early; the record's length tells, and
    the next pieces of the file are joined to it.
    """
    mark, held, file = _MARK.encode(), None, None

    def parsed(text: bytes) -> tuple[dict[str, str] | None, bytes, bool]:
        head, found, block = text.partition(b"\r\n\r\n")
        if not found:
            return None, b"", False
        fields = header_fields(head)
        size = fields.get("content-length", "")
        size = int(size) if size.isdigit() else 0
        return fields, block[:size], len(block) >= size

    for source, piece in pieces:
        if held is not None and source != file:
            if (fields := parsed(bytes(held))[0]) is not None:
                yield fields, parsed(bytes(held))[1], False
            held = None
        file = source
        if held is None and not piece:
            continue  # before the first mark of a file
        held = bytearray(piece) if held is None else held + mark + piece
        fields, block, whole = parsed(bytes(held))
        if whole:
            yield fields, block, True
            held = None
    if held is not None and (fields := parsed(bytes(held))[0]) is not None:
        yield fields, parsed(bytes(held))[1], False


def dechunked(body: bytes) -> tuple[bytes, bool]:
    """The data in transfer framing, and whether the framing is whole."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size == 0:
            return b"".join(out), True
        out.append(body[end + 2:end + 2 + size])
        at = end + 2 + size + 2
        if body[at - 2:at] != b"\r\n":
            break
    return b"".join(out), False


def http_payload(block: bytes) -> tuple[bytes, bool]:
    """What an HTTP response carries, without its transfer framing, and whether it is whole."""
    head, found, body = block.partition(b"\r\n\r\n")
    fields = header_fields(head)
    if fields.get("transfer-encoding", "").lower() == "chunked":
        return dechunked(body)
    size = fields.get("content-length", "")
    return body, bool(found) and (not size.isdigit() or len(body) == int(size))


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _unescaped(value: str | None) -> str | None:
    if value:
        for char in (" ", "\n", "\r", "%"):
            value = value.replace(f"%{ord(char):02X}", char)
    return value


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def parse(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in ``path``; payloads of responses that are not cut into segments are decoded."""
    schema = _schema(_PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        rows, size = [], 0
        for fields, block, whole in records(pieces()):
            number, total = (int(fields[x]) if fields.get(x, "").isdigit() else None for x in ("warc-segment-number", "warc-segment-total-length"))
            kind = fields.get("warc-type")
            record = _bare(fields.get("warc-record-id"))
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
            content, n, found = block, None, None
            if number is None and kind == "response":
                content, framed = http_payload(block)
                whole, n, found = whole and framed, len(content), hashlib.sha256(content).hexdigest()
            rows.append((record, kind, _bare(fields.get("warc-segment-origin-id")) or record, number, total, fields.get("x-page-id"), _unescaped(fields.get("warc-target-uri")),
                         _bare(fields.get("warc-refers-to")), digest, n, found, whole, number is not None, content))
            size += len(content)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    lines = spark.read.option("lineSep", _MARK).text(path).select(F.xxhash64("_metadata.file_path").alias("file"), _bytes(F.col("value")).alias("piece"))
    return lines.mapInArrow(run, _PARSED)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records from their segments, a row for each copy of the record.

    A record is whole if its numbers run from one without a gap and the lengths
    add up to the total that the last one states.  Segments under one origin and
    number are copies of each other.
    """
    one = segments.groupBy("origin", "number").agg(
        F.count("*").alias("copies"), F.max("total").alias("total"), F.min("whole").alias("whole"),
        *[F.max(c).alias(c) for c in ("page", "uri", "refers_to", "declared")], F.max(F.when(F.col("number") == 1, F.col("kind"))).alias("kind"), F.max("content").alias("content"))
    groups = one.groupBy("origin").agg(
        F.max(F.when(F.col("number") == 1, F.col("copies"))).alias("copies"), F.max("total").alias("total"), F.min("whole").alias("whole"), F.max("kind").alias("kind"),
        *[F.max(c).alias(c) for c in ("page", "uri", "refers_to", "declared")], F.collect_list(F.struct("number", "content")).alias("parts"))
    schema = _schema("record string, kind string, page string, uri string, refers_to string, declared string, payload_bytes long, payload_digest string, whole boolean, copies long, content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = sorted(row["parts"], key=lambda p: p["number"])
                block = b"".join(p["content"] for p in parts)
                payload, framed = http_payload(block)
                whole = bool(row["whole"]) and framed and [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and row["total"] == len(block)
                values = (row["origin"], row["kind"], row["page"], row["uri"], row["refers_to"], row["declared"], len(payload), hashlib.sha256(payload).hexdigest(), whole, row["copies"] or 1, payload)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    ddl = ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long', 'bool': 'boolean'}).get(str(f.type), str(f.type))}" for f in schema)
    return groups.select("origin", "copies", "total", "whole", "kind", "page", "uri", "refers_to", "declared", "parts").mapInArrow(run, ddl)


_OUT = ("record", "kind", "page", "uri", "refers_to", "payload_bytes", "payload_digest", "whole", "content")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of the archives in ``path``: record, kind, page, uri, refers_to (a record), payload_bytes, payload_digest, whole, content.

    ``content`` is the payload of a response, NULL for a revisit, whose size and
    digest are those of the response it refers to.  ``whole`` is false for a record
    that ends too early, lacks a segment, contradicts its total length, its framing
    or its declared digest, and for a revisit without a response.  Other kinds of
    records are skipped; an archive without records gives no rows.
    """
    folder = f"{shared_folder(spark)}/warc-records-{uuid.uuid4().hex}"
    parse(spark, path).write.partitionBy("segmented").option("compression", "zstd").parquet(folder)
    parsed = spark.read.schema(_PARSED).parquet(folder)
    joined = staged(reassemble(parsed.where("segmented")), "reassembled")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    checked = (F.col("whole") & F.coalesce(F.col("declared") == F.col("payload_digest"), F.lit(True))).alias("whole")
    columns = [checked if c == "whole" else F.col(c) for c in _OUT]
    single = parsed.where("NOT segmented")
    responses = single.where("kind = 'response'").select(*columns).unionByName(joined.where("kind = 'response'").select(*columns))
    known = responses.groupBy("record").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"), F.max("page").alias("first_page"),
                                            F.max("whole").alias("found"))
    later = single.where("kind = 'revisit'").select("record", "kind", "page", "uri", "refers_to", "declared", "whole")
    resolved = joined_by_key(later.withColumnRenamed("refers_to", "first"), known.withColumnRenamed("record", "first"), ["first"])
    orphans = later.join(known.select(F.col("record").alias("refers_to")), "refers_to", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    again = resolved.select("record", "kind", "page", "uri", F.col("first").alias("refers_to"), "payload_bytes", "payload_digest",
                            (F.col("whole") & F.col("found") & F.coalesce(F.col("declared") == F.col("payload_digest"), F.lit(True))).alias("whole"), none("binary").alias("content"), "first_page")
    lost = orphans.select("record", "kind", "page", "uri", "refers_to", none("long").alias("payload_bytes"), F.col("declared").alias("payload_digest"), F.lit(False).alias("whole"),
                          none("binary").alias("content"), none("string").alias("first_page"))
    return responses.withColumn("first_page", none("string")).unionByName(again).unionByName(lost)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``pages`` (page_id, url, payload), written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archive(spark, path).where("whole").select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("first_page").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN later THEN least END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM least AS later FROM f)
"""
