"""Line deduplication by overlapping windows of three lines.

Windows are hashed, counted over all documents, and every occurrence but the
first is removed; the lines of removed windows are merged into one set of
positions per document.  The content of each removed line stays at an earlier
place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import text_key

#: Stripped from both ends of a line before it is compared.
_BLANK = " \t\r\x0b\x0c"
WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(id, key, pos, digest) of every window of ``width`` consecutive lines with any content."""
    lines = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text")).where(
        F.col("text").contains("\n")).select("id", "key", F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(_BLANK))).alias("lines"))

    def digest(start: Column) -> Column:
        part = F.slice(F.col("lines"), start + 1, width)
        return F.when(F.exists(part, lambda x: x != ""), F.unhex(F.md5(F.array_join(part, "\n"))))

    starts = F.sequence(F.lit(0), F.size("lines") - width)
    return (lines.where(F.size("lines") >= width)
            .select("id", "key", F.posexplode(F.transform(starts, digest)).alias("pos", "digest")).where(F.col("digest").isNotNull()))


def covered_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(id, key, covered) of the documents with later occurrences: positions, from 0, of the lines to remove.

    Occurrences are ordered by id (NULL first), then by a hash of the text, then by position.
    """
    found = windows(docs, text, doc_id, width)
    place = F.struct("id", "key", "pos")
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = found.join(first, "digest").where(place != F.col("first"))
    starts = later.groupBy("id", "key").agg(F.collect_set("pos").alias("starts"))
    lines = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + width - 1)))
    return starts.select("id", "key", F.array_sort(F.array_distinct(lines)).alias("covered"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages cut from the text, plus ``n_lines`` and ``removed`` (line positions, from 0).

    Lines are compared without white space at their ends; windows of blank lines
    never count.  A text with fewer than ``width`` lines, an empty and a NULL
    text stay as they are (``n_lines`` 0 for NULL).  Rows with equal id and text
    are one document and get the same result.  Input columns named ``n_lines``
    or ``removed`` are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "removed")]
    cover = covered_lines(docs, text, doc_id, width).withColumnRenamed("id", "__id").withColumnRenamed("key", "__key")
    joined = docs.select(*keep, text_key(F.col(text)).alias("__text")).join(
        cover, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left")
    lines = _lines(F.col(text))
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    clean = F.when(F.col("covered").isNull(), F.col(text)).otherwise(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.coalesce("covered", F.array().cast("array<int>"))
    return joined.select(*[clean.alias(c) if c == text else F.col(c) for c in keep], n_lines.alias("n_lines"), removed.alias("removed"))


def emptied(text: str = "text") -> Column:
    """Whether a result of ``dedup_lines`` lost lines and has no content left."""
    return (F.size("removed") > 0) & (F.btrim(F.col(text), F.lit(_BLANK + "\n")) == "")


ORACLE = """
WITH lines AS (
    SELECT doc_id, i - 1 AS pos, trim(l[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS t(i)
), win AS (
    SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS content
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS nth
        FROM win WHERE content IS NOT NULL AND content <> chr(10) || chr(10)) WHERE nth > 1
), covered AS (
    SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS v(k)
), kept AS (
    SELECT d.doc_id, string_agg(o.raw, chr(10) ORDER BY o.pos) FILTER (WHERE c.doc_id IS NULL) AS text,
           count(*) AS n_lines, coalesce(string_agg(CAST(c.pos AS VARCHAR), ',' ORDER BY c.pos), '') AS removed_lines
    FROM documents d
    JOIN (SELECT doc_id, i - 1 AS pos, l[i] AS raw
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS t(i)) o
      ON o.doc_id = d.doc_id
    LEFT JOIN covered c ON c.doc_id = o.doc_id AND c.pos = o.pos GROUP BY d.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.removed_lines, '') AS removed_lines,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
