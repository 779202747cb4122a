"""Classifying incident reports by keyword."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.exact import percent, ratio, scaled

PASS_RATE = 0.85
LOW_CONFIDENCE = 0.8

# Keywords, as substrings of the lower-cased text.
ABSENCE = ("stop", "stopped", "offline", "zero", "down", "no data", "empty", "absence", "missing", "not sending",
           "not arriving", "dropped", "gap", "nothing")
PLACES = ("northeast", "southeast", "northwest", "southwest", "apac", "emea", "west coast", "east coast", "chicago")
SLICES = ("region", "channel", "segment", "partition")
NULL_WORDS = ("null", "blank", "empty", "missing", "not loaded", "not populated")
COLUMN_WORDS = ("column", "field", "revenue", "amount", "value", "col", "data")
LOSS_WORDS = ("%", "row", "record", "order", "batch", "drop", "fell", "decline", "decrease", "below", "missing", "lost",
              "reduction", "collapsed", "lower")
COUNTED = ("%", "row", "record", "order", "batch")
LATE_PHRASES = ("crm feed", "source file", "didn't arrive", "did not arrive", "not landed", "not arrived", "hasn't arrived",
                "sla breach", "overdue")

# Patterns on the lower-cased text.
NOT_IN_ENUM = r"not in.{0,10}enum"
ODD_VALUE = r"(new|unknown|unexpected|unapproved).{0,20}(status|code|value)"
CODE_APPEARS = r"(status|error|category) code.{0,40}appear"
ONLY_PERCENT = r"\bonly\s+\d+\s*%"
ONLY_COUNT = r"\bonly\s+\d+\s+(record|row|order)"


def _any(t: Column, words: Sequence[str]) -> Column:
    """Any of the words; one that contains another of them adds nothing."""
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    out = F.contains(t, F.lit(needed[0]))
    for w in needed[1:]:
        out = out | F.contains(t, F.lit(w))
    return out


def _has(t: Column, word: str) -> Column:
    return F.contains(t, F.lit(word))


# Confidence of each decision.
CONFIDENCE = {"segment by place": 0.45, "segment by slice": 0.40, "nullcol": 0.45, "whitelist": 0.43, "volume": 0.42, "volume by row count": 0.40,
              "source": 0.43, "unknown": 0.20}


def _verdict(decision: str) -> Column:
    return F.struct(F.lit(decision.split()[0]).alias("key"), F.lit(CONFIDENCE[decision]).alias("confidence"))


def classification(t: Column) -> Column:
    """Struct (key, confidence) of a lower-cased text; the first rule that matches decides."""
    absent = _any(t, ABSENCE)
    whitelist = (_has(t, "whitelist") | (_has(t, "invalid") & _has(t, "value")) | _has(t, "unapproved")
                 | t.rlike(NOT_IN_ENUM) | t.rlike(ODD_VALUE) | t.rlike(CODE_APPEARS))
    loss = (_has(t, "volume") & _any(t, LOSS_WORDS)) | (_has(t, "drop") & _any(t, COUNTED))
    return (F.when(_any(t, PLACES) & absent, _verdict("segment by place"))
            .when(_any(t, SLICES) & absent, _verdict("segment by slice"))
            .when(_any(t, NULL_WORDS) & _any(t, COLUMN_WORDS), _verdict("nullcol"))
            .when(whitelist, _verdict("whitelist"))
            .when(loss, _verdict("volume"))
            .when(t.rlike(ONLY_PERCENT) | t.rlike(ONLY_COUNT), _verdict("volume"))
            .when(_has(t, "row count"), _verdict("volume by row count"))
            .when(_any(t, LATE_PHRASES), _verdict("source"))
            .otherwise(_verdict("unknown")))


def classify(reports: DataFrame, text: str = "text") -> DataFrame:
    """Reports with ``key`` and ``confidence``; each text is lower-cased once."""
    lowered = reports.withColumn("_t", F.lower(text))
    return lowered.withColumn("_v", classification(F.col("_t"))).select("*", "_v.key", "_v.confidence").drop("_v", "_t")


def confusion(labelled: DataFrame, expected: str = "expected_key") -> DataFrame:
    """Counts per expected and given key."""
    return classify(labelled).groupBy(F.col(expected).alias("expected_key"), F.col("key").alias("got_key")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(confused: DataFrame) -> DataFrame:
    """Accuracy per expected key and overall (``ALL``), against the gate."""
    hit = F.sum(F.when(F.col("expected_key") == F.col("got_key"), F.col("n")).otherwise(0))
    total = F.sum("n")
    rate = ratio(hit, total, 4)
    named = lambda df: df.withColumn("passes", F.col("accuracy") >= PASS_RATE)
    per = confused.groupBy("expected_key").agg(total.alias("total"), hit.alias("correct"), rate.alias("accuracy"))
    overall = confused.agg(F.lit("ALL").alias("expected_key"), total.alias("total"), hit.alias("correct"), rate.alias("accuracy"))
    return named(per.unionByName(overall))


def run_statistics(runs: DataFrame, since: Column | None = None) -> DataFrame:
    """Confidence and rates over the runs of a period."""
    r = runs if since is None else runs.filter(F.col("started_at") >= since)
    r = r.filter(F.col("confidence").isNotNull())
    n = F.count(F.lit(1))
    share = lambda cond: ratio(F.count_if(cond), n, 3)
    return r.agg(n.alias("total_runs"), ratio(F.sum(scaled(F.col("confidence"), 2)), n * 100, 3).alias("mean_confidence"),
                 share(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence_rate"), share(F.col("key") == "unknown").alias("unknown_rate"),
                 share(F.coalesce("grounded", F.lit(False))).alias("real_metrics_rate"))


def run_types(runs: DataFrame) -> DataFrame:
    """Runs by type."""
    return runs.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def recent_runs(runs: DataFrame, n: int = 8) -> DataFrame:
    """The newest runs; the report's list shows 80 characters of their text."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n).withColumn("shown_text", F.substring("text", 1, 80))
