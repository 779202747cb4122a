"""Mixing sources to target weights, in words.

Every document gets a hash-random key; within its source documents are taken in
the order of keys until the source's budget is used up, and again from the
start where the budget exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.llm.common import WORD, staged, text_key

WEIGHTS, EPOCHS, SHARE = (5, 2, 1), 2, (3, 2)
#: Hex digits of the key that name its range: 4096 equal ranges of a uniform key in every source.
_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """Hash-random by id: 32 hex digits; rows of one id follow each other by a hash of the text."""
    return F.concat(F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"))), F.lit("|"), F.coalesce(F.hex(text_key(text)), F.lit("")))


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` plus ``nth``, the place from 0 of each source: range-sorted, then counted on from the ranges before."""
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.repartitionByRange(n, F.asc_nulls_last("source"))
    dealt = staged(dealt.select("source", "source_size", F.spark_partition_id().alias("part")), "sources")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    offset = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return dealt.withColumn("inside", inside).join(offset, "part").select("source", "source_size", (F.col("offset") + F.col("inside") - 1).alias("nth"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, NULL last.

    ``share`` of all words, a fraction, is divided by weight; what exceeds
    ``epochs`` times a source's size is divided among the rest until no source
    exceeds its bound.  One row of totals reaches the driver in each round, and
    at least one more source is at its bound after each but the last.
    """
    turn = F.array(*[F.lit(w) for w in weights])
    rows = staged(_ranked(sizes).select("source", "source_size", F.get(turn, (F.col("nth") % len(weights)).cast("int")).cast("long").alias("weight")), "weights")
    num, den = share
    cap = epochs * F.col("source_size")
    every = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = every[0] or 0, every[1] or 1
    left = num * total  # in units of 1 / den
    while True:
        full = F.lit(left).cast("decimal(38,0)") * F.col("weight") >= cap * F.lit(den * weight).cast("decimal(20,0)")
        bound, rest = rows.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (num * total - den * (bound or 0), rest or weight)
        if now == (left, weight) or not rest:
            break
        left, weight = now
    target = F.least(F.lit(left).cast("double") * F.col("weight") / F.lit(den * weight).cast("double"), cap.cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        epochs: int = EPOCHS, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target`` and ``taken``: the words that the mix takes of each row.

    The words taken of a source add up to its target rounded down: whole epochs,
    and then documents in the order of keys, the last one in part.  Keys are cut
    into ranges; totals of ranges give each range its offset, so no source is
    sorted in one task.  NULL and empty texts have size 0 and nothing is taken of
    them; a NULL source is a source.  Rows with equal id and text share a key and
    count one by one.  Input columns with the names of the new ones are replaced.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    of, slot = ["__without", "__source"], ["__without", "__source", "__range"]
    key = random_key(F.col(doc_id), F.col(text))
    name = F.col(source).cast("string")
    sized = docs.select(*keep, n_words(F.col(text)).alias("size"), name.isNull().alias("__without"), F.coalesce(name, F.lit("")).alias("__source"),
                        key.alias("__key"), F.substring(key, 1, _DIGITS).alias("__range"))
    ranges = staged(sized.groupBy(*slot).agg(F.sum("size").alias("n")), "ranges")
    sizes = ranges.groupBy(*of).agg(F.sum("n").alias("source_size"))
    budget = targets(sizes.select(F.when(~F.col("__without"), F.col("__source")).alias("source"), "source_size"), weights, epochs, share)
    budget = budget.select(F.col("source").isNull().alias("__without"), F.coalesce("source", F.lit("")).alias("__source"), "source_size", "target")
    earlier = F.sum("n").over(W.partitionBy(*of).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    offsets = ranges.select(*slot, F.coalesce(earlier, F.lit(0)).alias("__before")).join(budget, of)
    inside = F.sum("size").over(W.partitionBy(*slot).orderBy("__key").rowsBetween(W.unboundedPreceding, -1))
    placed = sized.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(offsets, slot)
    whole = F.floor("target").cast("long")
    rounds = sum(((F.col("source_size") > 0) & (whole >= k * F.col("source_size"))).cast("long") for k in range(1, epochs + 1))
    rest = whole - rounds * F.col("source_size") - F.col("__before") - F.col("__inside")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select(*keep, "size", "source_size", "target", taken.cast("long").alias("taken"))


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row for each time that a document of ``mix`` is taken: ``epoch`` from 0 and ``words`` of this copy, the text cut to them.

    Rows of which nothing is taken go.
    """
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    words = F.least("size", F.col("taken") - F.col("epoch") * F.col("size"))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), F.col("words").cast("int")), " "))
    return rows.withColumn("words", words).withColumn(text, F.coalesce(cut, F.col(text)))


ORACLE = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS size,
           md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))) AS key FROM documents
), sizes AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (
    SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM sizes
), rounds AS (
    SELECT 0 AS n, 3 * CAST(sum(source_size) AS BIGINT) AS lft, CAST(sum(weight) AS BIGINT) AS w FROM weighed
    UNION ALL
    SELECT n + 1, (SELECT CAST(3 * sum(source_size) - 2 * coalesce(sum(2 * source_size) FILTER (WHERE lft * weight >= 4 * source_size * r.w), 0) AS BIGINT) FROM weighed),
           (SELECT CAST(sum(weight) FILTER (WHERE lft * weight < 4 * source_size * r.w) AS BIGINT) FROM weighed)
    FROM rounds r WHERE n < 64
), last AS (SELECT lft, w FROM rounds WHERE n = 64), budget AS (
    SELECT source, source_size, least(CAST(lft AS DOUBLE) * weight / CAST(2 * w AS DOUBLE), CAST(2 * source_size AS DOUBLE)) AS target FROM weighed, last
), placed AS (
    SELECT d.doc_id, d.size, b.source_size, b.target, CAST(floor(b.target) AS BIGINT) AS whole,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM docs d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole // greatest(source_size, 1) * size + greatest(0, least(whole - whole // greatest(source_size, 1) * source_size - before, size)) AS BIGINT) AS taken
FROM placed
"""
