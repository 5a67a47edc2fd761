"""Event logs and tables as streams."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from evalspark.operators.keyed_log import KeyedLog
from evalspark.scratch import scratch_dir

#: State that grows with the keys in a watermark's span lies on disk, not on the executors' heaps.
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table as a stream of its files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def requeues(events: DataFrame) -> DataFrame:
    return events.filter("event = 'task_rate_limit_requeue'").groupBy("model").agg(F.count(F.lit(1)).alias("requeues"), F.max("cooldown").alias("max_cooldown"))


def _drain(df: DataFrame, mode: str, folder: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run the stream over what is there, batch by batch; what it has read is kept under ``folder``. State goes to
    RocksDB unless the session names a provider itself."""
    spark = df.sparkSession
    if spark.conf.get(PROVIDER, None) is None:
        spark.conf.set(PROVIDER, ROCKSDB)
    q = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(each).start()
    q.awaitTermination()
    return q


def latest(df: DataFrame, keys: Sequence[str], folder: str | None = None) -> DataFrame:
    """Run an aggregating stream over what is there; the last update of every key.

    Updates are written batch by batch (a batch that is run again writes its folder again), then the newest is taken.
    With a ``folder`` of an earlier run the stream goes on where that run ended.
    """
    folder = folder or scratch_dir(df.sparkSession)
    path, schema = f"{folder}/rows", df.schema
    _drain(df, "update", folder, lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/b={i}"))
    spark = df.sparkSession
    rest = [f.name for f in schema if f.name not in keys]
    rows = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


class Drained(NamedTuple):
    """What a stream with a watermark has given, over all runs with its folder."""

    #: What it emitted: every row once and for good.
    rows: DataFrame
    #: The input rows that it left out because the watermark had passed them.
    late: DataFrame
    #: ``batch``, ``watermark``, ``dropped`` and ``state_rows`` of the batches (of each run the last 100, as Spark keeps).
    progress: DataFrame


def _millis(c: Column) -> Column:
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1000).cast("long")


def _settled(out: DataFrame, taken: DataFrame, passed: Column, late: int, folder: str | None) -> Drained:
    """Run ``out``, a stream in append mode over the stream ``taken`` (with ``ts``, watermark ``late`` seconds), over
    what is there.

    ``passed``: the time of a row of ``taken`` that makes it late once the watermark has reached it. Spark drops such
    rows; they are kept apart here, by the rule that drops them: a batch is held against the watermark of the batch
    before it, which follows from the newest times of the batches before that. Both streams are one query, so they have
    the same batches. Every batch is one write of its own folder; one that is run again writes it again.
    """
    spark, folder = out.sparkSession, folder or scratch_dir(out.sparkSession)
    null = lambda df: F.lit(None).cast(df.schema)
    made = out.select(F.struct(*out.columns).alias("out"), null(taken).alias("row"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("passed"))
    seen = taken.select(null(out).alias("out"), F.struct(*taken.columns).alias("row"), _millis(F.col("ts")).alias("at"), _millis(passed).alias("passed"))
    marks = f"{folder}/marks"

    def each(batch: DataFrame, i: int) -> None:
        before = batch.sparkSession.read.schema("batch long, at long").json(f"{marks}/*").filter(F.col("batch") <= i - 2).agg(F.max("at")).first()[0] if i >= 2 else None
        reached = max(0, (before or 0) - 1000 * late)
        newest = Observation()
        both = batch.observe(newest, F.max("at").alias("at"))
        both.filter(F.col("out").isNotNull() | (F.col("passed") <= reached)).select("out", "row").write.mode("overwrite").parquet(f"{folder}/rows/b={i}")
        batch.sparkSession.createDataFrame([(i, newest.get["at"])], "batch long, at long").coalesce(1).write.mode("overwrite").json(f"{marks}/b={i}")

    q = _drain(made.unionByName(seen), "append", folder, each)
    facts = []
    for p in (json.loads(x.json) for x in q.recentProgress):
        ops = p.get("stateOperators") or [{}]
        facts.append((p["batchId"], (p.get("eventTime") or {}).get("watermark"), sum(o.get("numRowsDroppedByWatermark", 0) for o in ops), sum(o.get("numRowsTotal", 0) for o in ops)))
    kind = "batch long, watermark string, dropped long, state_rows long"
    if facts:
        spark.createDataFrame(facts, kind).coalesce(1).write.mode("overwrite").json(f"{folder}/progress/from={facts[0][0]}")
    both = spark.read.schema(T.StructType([T.StructField("out", out.schema), T.StructField("row", taken.schema)])).parquet(f"{folder}/rows/*")
    return Drained(both.filter("out is not null").select("out.*"), both.filter("row is not null").select("row.*"), spark.read.schema(kind).json(f"{folder}/progress/*"))


def _completed(events: DataFrame, late: int) -> DataFrame:
    return events.filter("event = 'task_complete'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late} seconds")


def progress(events: DataFrame, late: int, folder: str, window: str = "1 minute") -> Drained:
    """Completed tasks per window (``start``), model and status. A window is given once, when the watermark has passed
    its end; completions of a window that is closed are late. What is open yet is in open_windows."""
    done = _completed(events, late)
    g = done.groupBy(F.window("ts", window).alias("w"), "model", "status").agg(F.count(F.lit(1)).alias("n"))
    return _settled(g.select(F.col("w.start").alias("start"), "model", "status", "n"), done, F.window("ts", window)["end"], late, folder)


def open_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows that a run of progress has begun and not closed, from its state: ``start``, model, status, ``n``."""
    s = spark.read.format("statestore").load(f"{folder}/checkpoint")
    return s.select(F.col("key.window.start").alias("start"), "key.model", "key.status", F.col("value.count").alias("n"))


def first_completions(events: DataFrame, late: int, folder: str | None = None) -> Drained:
    """Each sample's completion once, however often it completes within ``late`` seconds of the newest event; only the
    samples of that span are kept in mind. Completions that come later than that are late."""
    done = _completed(events, late)
    return _settled(done.dropDuplicatesWithinWatermark(["sample_id"]), done, F.col("ts"), late, folder)


class _FirstSeen(StatefulProcessor):
    """Per name the earliest time (microseconds), and a timer for when it stops being recent."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "first long")

    def _take(self, time: int) -> bool:
        """Whether ``time`` is earlier than what is known; the timer follows it."""
        known = self.first.get()[0] if self.first.exists() else None
        if known is not None and known <= time:
            return False
        if known is not None:
            self.handle.deleteTimer(self._ends(known))
        self.first.update((time,))
        self.handle.registerTimer(self._ends(time))
        return True

    def _ends(self, time: int) -> int:
        return -(-(time + self.span) // 1000)

    def _row(self, key, time: int, recent: bool, step: int) -> pd.DataFrame:
        return pd.DataFrame({"name": [key[0]], "first": [time], "recent": [recent], "step": [step]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._take(int(initialState["first"].min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._take(min(int(x["first"].min()) for x in rows))
        time = self.first.get()[0]
        yield self._row(key, time, self._ends(time) > timerValues.getCurrentWatermarkInMs(), 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._row(key, self.first.get()[0], False, 1)

    def close(self) -> None:
        pass


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest time per name of each batch, so that a frequent name sends a row per batch to its task."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("name").aggregate([("first", "min")]).rename_columns(["name", "first"])
        yield from t.cast(b.schema).to_batches()


def first_seen(events: DataFrame, folder: str, saved: DataFrame | None = None, days: int = 7, late: int = 0) -> DataFrame:
    """``name``, ``first_seen`` and ``recent`` of every name of the stream's ``name`` and ``ts``: its earliest time over
    all runs with ``folder`` and over ``saved`` (the same columns, used by the first run only), however late it comes;
    recent until the watermark (``late`` seconds behind the newest event) is ``days`` past it. A saved name appears once
    the stream has seen it or its time is up. Rows without name or time are left out.

    Names are the state: one row and one timer each, on disk.
    """
    spark = events.sparkSession
    shaped = lambda df: df.filter("name is not null and ts is not null").select("name", F.unix_micros(F.col("ts").cast("timestamp")).alias("first"))
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late} seconds")
    before = shaped(saved) if saved is not None else spark.createDataFrame([], "name string, first long")
    kind = "name string, first long, recent boolean, step int"
    states = shaped(marked).mapInArrow(_earliest, "name string, first long").groupBy("name").transformWithStateInPandas(
        statefulProcessor=_FirstSeen(int(dt.timedelta(days=days) / dt.timedelta(microseconds=1))), outputStructType=kind, outputMode="Update", timeMode="EventTime", initialState=before.groupBy("name"),
    )
    _drain(states, "update", folder, lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/rows/b={i}"))
    rows = spark.read.schema(f"{kind}, batch int").parquet(f"{folder}/rows/*")
    last = rows.groupBy("name").agg(F.max_by(F.struct("first", "recent"), F.struct("batch", "step")).alias("r"))
    return last.select("name", F.timestamp_micros("r.first").alias("first_seen"), "r.recent")


def retry_at(ts: Column, cooldown: Column) -> Column:
    """When a requeued sample may be asked again, in microseconds: ``cooldown`` seconds after its requeue."""
    return F.unix_micros(ts.cast("timestamp")) + (F.coalesce(cooldown, F.lit(0)).cast("decimal(18,6)") * 1000000).cast("long")


class _DueAgain(StatefulProcessor):
    """Per sample its newest requeue (microseconds), the time at which that lets it go on, its newest completion, and the
    timer that is set."""

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "queued long, retry long, done long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reached = timerValues.getCurrentWatermarkInMs()
        queued, retry, done, timer = self.known.get() if self.known.exists() else (-1, -1, -1, -1)
        fresh = queued < 0 and done < 0
        for x in rows:
            for kind, ts, again in zip(x["kind"].tolist(), x["ts"].tolist(), x["retry"].tolist(), strict=True):
                if fresh and 0 < reached and ts // 1000 <= reached:
                    continue  # what a forgotten sample did before the watermark
                if kind:
                    done = max(done, ts)
                else:
                    queued, retry = max((queued, retry), (ts, again))
        if queued < 0 and done < 0:
            return
        if timer >= 0:
            self.handle.deleteTimer(timer)
        finished = done >= queued
        timer = -(-(done if finished else retry) // 1000)
        passed = timer <= reached
        if finished and passed:
            self.known.clear()
        else:
            if not passed:
                self.handle.registerTimer(timer)
            self.known.update((queued, retry, done, -1 if passed else timer))
        if queued >= 0:
            yield self._row(key, retry, "done" if finished else "due" if passed else "waiting", 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        queued, retry, done, _ = self.known.get()
        if done >= queued:
            self.known.clear()
        else:
            self.known.update((queued, retry, done, -1))
            yield self._row(key, retry, "due", 1)

    def _row(self, key, retry: int, state: str, step: int) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": [key[0]], "model": [key[1]], "retry": [retry], "state": [state], "step": [step]})

    def close(self) -> None:
        pass


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest requeue and completion per sample of each batch."""
    by = ["sample_id", "model", "kind"]
    for b in batches:
        t = pa.Table.from_batches([b]).sort_by([("ts", "ascending"), ("retry", "ascending")])
        last = t.group_by(by, use_threads=False).aggregate([("ts", "last"), ("retry", "last")]).rename_columns([*by, "ts", "retry"])
        yield from last.cast(b.schema).to_batches()


def due_again(events: DataFrame, folder: str, late: int = 0) -> DataFrame:
    """Samples that a rate limit sent back (``sample_id``, ``model``, ``retry_at``, ``state``), over all runs with
    ``folder``: ``waiting`` until the watermark (``late`` seconds behind the newest requeue or completion) reaches the time of
    their newest requeue's retry, ``due`` from then on, ``done`` once they complete at or after that requeue.

    Of a sample's events the newest requeue (of equal ones that with the longest cooldown) and the newest completion
    count, in whatever order they come. A sample that is done is forgotten when the watermark has passed its completion;
    events from before the watermark do not bring it back. So the state is the samples that are still owed, and those
    that moved within ``late``. Rows without sample or time are left out, a missing cooldown is none.
    """
    kind = F.when(F.col("event") == "task_rate_limit_requeue", 0).when(F.col("event") == "task_complete", 1)
    moves = events.withColumn("kind", kind).filter("sample_id is not null and ts is not null and kind is not null")
    moves = moves.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late} seconds")
    moves = moves.select("sample_id", "model", "kind", F.unix_micros("ts").alias("ts"), retry_at(F.col("ts"), F.col("cooldown")).alias("retry"))
    ids = f"sample_id {events.schema['sample_id'].dataType.simpleString()}, model string"
    made = f"{ids}, retry long, state string, step int"
    states = moves.mapInArrow(_newest, f"{ids}, kind int, ts long, retry long").groupBy("sample_id", "model").transformWithStateInPandas(
        statefulProcessor=_DueAgain(), outputStructType=made, outputMode="Update", timeMode="EventTime",
    )
    _drain(states, "update", folder, lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/rows/b={i}"))
    rows = events.sparkSession.read.schema(f"{made}, batch int").parquet(f"{folder}/rows/*")
    last = rows.groupBy("sample_id", "model").agg(F.max_by(F.struct("retry", "state"), F.struct("batch", "step")).alias("r"))
    return last.select("sample_id", "model", F.timestamp_micros("r.retry").alias("retry_at"), "r.state")


def published(stream: DataFrame, key: str, order: Sequence[str], existing: DataFrame, folder: str | None = None, buckets: int = 16, compact_every: int = 16) -> DataFrame:
    """The dataset ``existing`` with all batches of ``stream`` merged in by key (see KeyedLog); a batch writes its own
    rows, however large the dataset is. With the folder of an earlier run the stream goes on where that one ended, and
    ``existing`` only lends its columns."""
    log = KeyedLog(stream.sparkSession, folder or scratch_dir(stream.sparkSession), existing.schema, key, order, buckets)
    log.begin(existing)

    def each(batch: DataFrame, i: int) -> None:
        log.append(batch, i)
        if (i + 1) % compact_every == 0:
            log.compact(i)

    _drain(stream, "append", log.folder, each)
    return log.read()
