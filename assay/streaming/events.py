"""Windowed profiles, rule checks per micro-batch, last-seen times.

State is bounded by windows times keys within the watermark, and for
:func:`entity_freshness` by the entities.  Sinks and checkpoints belong in a
folder that all executors share.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assay.functions.exact import percent
from assay.operators.relational import latest_per_key
from assay.operators.rules import check_rules


def file_stream(spark: SparkSession, path: str, schema, name_filter: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """Stream of the parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def windowed_profile(events: DataFrame, ts: str, window: str, watermark: str, columns: Sequence[str]) -> DataFrame:
    """Rows, NULLs and approximate distinct values per tumbling window and column.

    All columns are counted in one stateful aggregate and unpivoted after it.
    """
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"), F.approx_count_distinct(c).alias(f"ndv_{i}")]
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    one = timed.withWatermark(ts, watermark).groupBy(F.window(ts, window)).agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"nulls_{i}").alias("null_count"), F.col(f"ndv_{i}").alias("approx_distinct"))
             for i, c in enumerate(columns)]
    long = one.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "row_count", F.inline(F.array(*cells)))
    return long.withColumn("null_pct", percent(F.col("null_count"), F.col("row_count")))


def last_seen(events: DataFrame, ts: str, key: str, window: str, watermark: str) -> DataFrame:
    """Newest event per key and window; rows later than the watermark are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    out = timed.withWatermark(ts, watermark).groupBy(F.window(ts, window), F.col(key)).agg(
        F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("events"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "last_seen", "events")


def entity_freshness(events: DataFrame, ts: str, key: str, silence: dt.timedelta, watermark: str, forget: dt.timedelta | None = None) -> DataFrame:
    """(key, last_seen, overdue) whenever an entity is seen again or has been silent for longer than ``silence``.

    Each entity has one state with an event-time timer.  The timer fires once the
    watermark has passed its last event by more than ``silence``, and the row it
    emits is overdue; the next event clears that.  A row later than the watermark
    never moves ``last_seen`` back.  Rows with a NULL key or time are left out.
    ``forget`` drops the state of an entity that stays silent for so much longer;
    without it the state grows with the entities.  Each task sends the newest
    time per entity and Arrow batch, so a busy entity costs few rows.
    """
    rows = events.select(F.col(key), F.col(ts).cast("timestamp").alias("last_seen")).where(F.col(key).isNotNull() & F.col("last_seen").isNotNull())
    rows = rows.withColumn("micros", F.unix_micros("last_seen"))  # the same in every session time zone
    wait, longer = _millis(silence), None if forget is None else _millis(forget)

    def newest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            best = pa.Table.from_batches([part]).group_by(key).aggregate([("last_seen", "max"), ("micros", "max")]).select([key, "last_seen_max", "micros_max"])
            yield from best.rename_columns([key, "last_seen", "micros"]).cast(part.schema).to_batches()

    def follow(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, overdue = state.get if state.exists else (None, False)
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            if overdue:  # silent for the second time: nothing new to tell
                state.remove()
                return
            overdue = True
        else:
            seen = max(int(part["micros"].max()) for part in parts)
            last = seen if last is None else max(last, seen)
            overdue = last // 1000 + wait < now
        due = last // 1000 + wait
        state.update((last, overdue))
        if not overdue:
            state.setTimeoutTimestamp(due)
        elif longer is not None:
            state.setTimeoutTimestamp(max(due + longer, now))
        yield pd.DataFrame({key: [name[0]], "micros": [last], "overdue": [overdue]})

    partial = rows.mapInArrow(newest, rows.schema)
    out = T.StructType([rows.schema[key], T.StructField("micros", T.LongType()), T.StructField("overdue", T.BooleanType())])
    found = partial.withWatermark("last_seen", watermark).groupBy(key).applyInPandasWithState(
        follow, out, "last bigint, overdue boolean", "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(key, F.timestamp_micros("micros").alias("last_seen"), "overdue")


def _millis(time: dt.timedelta) -> int:
    return time // dt.timedelta(milliseconds=1)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append finished windows as parquet."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def check_stream(stream: DataFrame, rules: dict[str, str], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Row rules over each micro-batch in one scan.

    A batch overwrites its own folder, so a replayed batch is not counted twice.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        check_rules(batch, rules).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def keep_updates(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), compact_every: int = 0, **trigger) -> StreamingQuery:
    """Write every change of an aggregate's groups, those of open windows included, one folder per micro-batch.

    A replayed batch overwrites its own folder.  :func:`current_rows` reads the
    state that the batches add up to.  With ``keys``, every ``compact_every``
    batches become one table of the newest row of each group.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if keys and compact_every and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, path, keys)

    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each group that :func:`keep_updates` wrote and :func:`compact` kept."""
    return _newest_rows(spark, path, keys, *_written(spark, path)).drop("batch_id")


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Merge the batches under ``path`` into one table with the newest row of each group.

    The merged table appears whole or not at all: it is written beside the
    batches and counts once its success mark is there.  Only then do the batches
    and the older tables go; a reader that began before has to begin again.  A
    batch that is replayed afterwards is not newer than the table, hence not read
    again.
    """
    bases, batches = _written(spark, path)
    new = [n for n in batches if not bases or n > bases[-1]]
    if not new:
        return
    merged = _newest_rows(spark, path, keys, bases, batches)
    merged.write.mode("overwrite").parquet(f"{path}/_merged-{new[-1]}")
    system, folder = _file_system(spark, path)
    for n in bases:
        system.delete(folder(f"{path}/_merged-{n}"), True)
    for n in batches:
        system.delete(folder(f"{path}/batch_id={n}"), True)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path
    return folder(path).getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _written(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the merged tables and of the batches that are complete, in order."""
    system, folder = _file_system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(folder(path)) if s.isDirectory()]
    whole = [n for n in names if system.exists(folder(f"{path}/{n}/_SUCCESS"))]
    return tuple(sorted(int(n.removeprefix(prefix)) for n in whole if n.startswith(prefix)) for prefix in ("_merged-", "batch_id="))


def _newest_rows(spark: SparkSession, path: str, keys: Sequence[str], bases: list[int], batches: list[int]) -> DataFrame:
    """The newest row of each group, with its ``batch_id``, from the last merged table and what came after it."""
    parts = [spark.read.parquet(f"{path}/_merged-{bases[-1]}")] if bases else []
    new = [f"{path}/batch_id={n}" for n in batches if not bases or n > bases[-1]]
    if new:
        parts.append(spark.read.option("basePath", path).parquet(*new).withColumn("batch_id", F.col("batch_id").cast("bigint")))
    if not parts:
        raise ValueError(f"no batch was written to {path}")
    return latest_per_key(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), keys, [F.desc("batch_id")])


class LateRows(StreamingQueryListener):
    """Counts the rows that queries dropped because they were behind the watermark.

    Add it with ``spark.streams.addListener`` before a query starts; every
    micro-batch is counted, however long the query runs.
    """

    def __init__(self):
        self.totals: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.totals.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.totals[str(event.progress.id)] = self.totals.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))
