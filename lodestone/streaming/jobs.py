"""Event streams: windowed counts with a watermark, latest state by upsert, de-duplication, timed state.

The table folder is read as a file stream with ``availableNow``, so that a run ends when all
files are read. A job keeps its checkpoint, and its results, in the folder ``out``: started again
with the same folder it reads new files only and goes on from its last state. Without one it
takes a new folder in the shared one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import durable, shared_folder


def _folder(spark: SparkSession, out: str | None = None) -> str:
    return out.rstrip("/") if out else f"{shared_folder(spark)}/lodestone/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, folder: str, copy: str | None = None) -> DataFrame:
    """The events table as a stream (its own schema, event time as a timestamp)."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a table may be one file or a folder of files
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return source.parquet(_parent(spark, path, copy)).withColumn("ts", F.col("ts").cast("timestamp"))


def _parent(spark: SparkSession, path: str, copy: str | None) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        return path
    # a stream reads folders: a single file is copied as a table first, once for each job folder
    out = (copy or _folder(spark)) + "/input"
    target = jvm.org.apache.hadoop.fs.Path(out + "/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        spark.read.parquet(path).write.mode("overwrite").parquet(out)
    return out


def _run(stream: DataFrame, mode: str, spark: SparkSession, out: str) -> DataFrame:
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def windowed_counts(spark: SparkSession, folder: str, width: str = "1 hour", late: str = "1 hour", out: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; the batches upsert the latest value of each window."""
    out = _folder(spark, out)
    agg = events(spark, folder, out).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    q = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/data/*")
    last = rows.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", F.col("v.n").alias("n"), F.round("v.total", 4).alias("total"))


def _states(spark: SparkSession, out: str) -> dict[int, str]:
    """The finished state tables of a job folder by batch."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{out}/state-*/_SUCCESS")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    return {int(p.getName().split("-")[1]): p.toString() for p in (s.getPath().getParent() for s in found or [])}


def latest_state(spark: SparkSession, folder: str, out: str | None = None) -> DataFrame:
    """(user_id, n, last_event): each batch is folded into a state table by key; replayed batches change nothing.

    A batch writes one new state beside the last, and the one before that goes."""
    out = _folder(spark, out)

    def fold(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
        state = _states(spark, out)
        before = sorted(k for k in state if k < number)
        if before:
            old = batch.sparkSession.read.parquet(state[before[-1]])
            new = old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))
        new.write.mode("overwrite").parquet(f"{out}/state-{number}")
        for k in before[:-1]:  # the last one stays: a batch that fails after this is folded again from it
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state[k])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    q = events(spark, folder, out).writeStream.foreachBatch(fold).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    state = _states(spark, out)
    if not state:  # no file has come yet
        return spark.createDataFrame([], "user_id long, n long, last_event long")
    return spark.read.parquet(state[max(state)])


def deduplicated(spark: SparkSession, folder: str, late: str = "1 hour", out: str | None = None) -> DataFrame:
    """Counts of event types over a stream without repeated ids (at-least-once sources deliver some twice)."""
    out = _folder(spark, out)
    once = events(spark, folder, out).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    return _run(once, "append", spark, out).groupBy("event_type").agg(F.count("*").alias("n"))


def expiring_cache(stream: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """(key, value, hit): first values by key are kept for a time to live after their event; later ones are hits.

    stream: key, value, ts with a watermark. State is dropped by event time once it has expired."""
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, until = state.get if state.exists else (None, 0)
        for pdf in batches:
            rows = []
            for v, ts in sorted(zip(pdf["value"], pdf["ts"], strict=True), key=lambda x: x[1]):
                at = int(ts.timestamp() * 1000)
                hit = value is not None and at < until
                if not hit:
                    value, until = v, at + millis
                rows.append((key[0], value, hit))
            yield pd.DataFrame(rows, columns=["key", "value", "hit"])
        state.update((value, until))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    return stream.groupBy("key").applyInPandasWithState(step, "key string, value string, hit boolean", "value string, until long", "append", "EventTimeTimeout")


def acknowledged(spark: SparkSession, folder: str, handle: Callable[[DataFrame], DataFrame], most: int = 5, out: str | None = None) -> DataFrame:
    """(event_id, event_type, deliveries): events that a consumer has acknowledged, with the number of deliveries that took.

    ``handle(messages)`` works on a delivery (event_id, event_type, deliveries) and returns the event_ids that it acknowledges. The rest
    stays pending, in a state table beside the checkpoint, and is delivered again with the next batch, and when the stream has
    ended until nothing is pending; after ``most`` deliveries a message goes to the table of dead ones instead. If ``handle`` fails,
    the batch is not committed: started again, the same batch is delivered once more together with what was pending before it, so
    every message comes once at least. Each batch writes its own folders anew, so a replay replaces what it left."""
    out = _folder(spark, out)

    def deliver(messages: DataFrame, number: int, turn: int = 0) -> None:
        """Delivery ``turn`` of batch ``number`` (later turns come after the stream has ended)."""
        messages = messages.withColumn("deliveries", F.col("deliveries") + 1)
        acks = durable(handle(messages).select("event_id").distinct(), "acks")
        rest = messages.join(acks, "event_id", "left_anti")
        messages.join(acks, "event_id", "left_semi").write.mode("overwrite").parquet(f"{out}/done/{number}-{turn}")
        rest.filter(F.col("deliveries") >= most).write.mode("overwrite").parquet(f"{out}/dead/{number}-{turn}")
        # numbers of states: batches leave room for turns
        rest.filter(F.col("deliveries") < most).write.mode("overwrite").parquet(f"{out}/state-{number * _TURNS + turn}")

    def pending(below: int) -> tuple[int, DataFrame] | None:
        found = _states(spark, out)
        last = max((k for k in found if k < below), default=None)
        return None if last is None else (last, spark.read.parquet(found[last]))

    def batch(rows: DataFrame, number: int) -> None:
        new = rows.select("event_id", "event_type", F.lit(0).alias("deliveries"))
        before = pending(number * _TURNS)
        deliver(new if before is None else new.unionByName(before[1]), number)

    q = events(spark, folder, out).writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    while (left := pending(1 << 62)) is not None and not left[1].isEmpty():
        deliver(left[1], left[0] // _TURNS, left[0] % _TURNS + 1)
    if left is None:  # no file has come yet
        return spark.createDataFrame([], "event_id long, event_type string, deliveries int")
    return spark.read.parquet(f"{out}/done/*")


#: Deliveries of a batch at most.
_TURNS = 1000
