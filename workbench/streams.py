"""Streaming queries (X), run over the events table until it is used up."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from assay.session import shared_folder
from assay.streaming import events as ev
from workbench.registry import query, table


def _stream(spark, sf):
    """The events table as a stream, whether it is one file or a folder of files."""
    schema = table(spark, sf, "events").schema
    path = f"{sf}/events.parquet"
    return ev.file_stream(spark, sf, schema, "events.parquet") if os.path.isfile(path) else ev.file_stream(spark, path, schema)


def _folders(spark):
    base = f"{shared_folder(spark)}/assay-stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


@query("x1_windowed_profile", """
SELECT strftime(w, '%Y-%m-%d') AS window_day, c AS column_name, n AS row_count, CASE c WHEN 'event_type' THEN nt ELSE nv END AS null_count FROM (
  SELECT date_trunc('day', ts) AS w, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS nt, count(*) FILTER (WHERE value > 400) AS nv, unnest(['event_type', 'value']) AS c FROM events GROUP BY 1)""")
def x1(spark, sf):
    """Daily windows, the open one included."""
    s = _stream(spark, sf).withColumn("event_type", F.nullif("event_type", F.lit("error"))).withColumn("value", F.when(F.col("value") <= 400, F.col("value")))
    out, state = _folders(spark)
    ev.keep_updates(ev.windowed_profile(s, "ts", "1 day", "1 hour", ["event_type", "value"]), out, state).awaitTermination()
    return ev.current_rows(spark, out, ["window_start", "column_name"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("window_day"), "column_name", "row_count", "null_count")


_RULES = {"positive": "value > 0", "small": "value <= 400", "known_user": "nullif(user_id, 7) IS NOT NULL"}


@query("x2_rule_check", " UNION ALL ".join(
    f"SELECT '{k}' AS rule_id, count(*) AS total_records, count(*) FILTER (WHERE NOT coalesce({e}, FALSE)) AS failed_records FROM events" for k, e in _RULES.items()))
def x2(spark, sf):
    """Rule counts per micro-batch, added up."""
    out, state = _folders(spark)
    ev.check_stream(_stream(spark, sf), _RULES, out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("rule_id").agg(F.sum("total_records").alias("total_records"), F.sum("failed_records").alias("failed_records"))


@query("x3_last_seen", """
SELECT strftime(w, '%Y-%m-%d') AS window_day, user_id, strftime(m, '%Y-%m-%d %H:%M:%S') AS last_seen, n AS events FROM (SELECT date_trunc('day', ts) AS w, user_id, max(ts) AS m, count(*) AS n FROM events GROUP BY 1, 2)""")
def x3(spark, sf):
    out, state = _folders(spark)
    ev.keep_updates(ev.last_seen(_stream(spark, sf), "ts", "user_id", "1 day", "1 hour"), out, state).awaitTermination()
    return ev.current_rows(spark, out, ["window_start", "user_id"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("window_day"), "user_id",
                                          F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "events")


@query("x3_entity_freshness", """
SELECT user_id, strftime(m, '%Y-%m-%d %H:%M:%S') AS last_seen, date_trunc('millisecond', m) + INTERVAL 12 HOUR < date_trunc('millisecond', max(m) OVER ()) - INTERVAL 1 HOUR AS overdue
FROM (SELECT user_id, max(ts) AS m FROM events WHERE user_id IS NOT NULL GROUP BY 1) WHERE m IS NOT NULL""")
def x3_entities(spark, sf):
    """One row for each user: when it was last seen, and whether its timer of twelve hours has fired."""
    out, state = _folders(spark)
    seen = ev.entity_freshness(_stream(spark, sf), "ts", "user_id", dt.timedelta(hours=12), "1 hour")
    ev.keep_updates(seen, out, state, keys=["user_id"], compact_every=2).awaitTermination()
    return ev.current_rows(spark, out, ["user_id"]).select("user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "overdue")
