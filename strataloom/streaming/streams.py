"""Structured Streaming forms of the rolling, deduplicating and index-updating operators.

Each takes a streaming DataFrame and gives one; `drain` runs it over what is there and returns the sink's table. Checkpoints and sinks lie in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def read_table(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The Parquet table at `path`, a directory or one file, as a stream in the files' own schema; times without zone become timestamps, as watermarks need them."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()).option("recursiveFileLookup", "true"), at.getParent().toString()
    raw = reader.parquet(path)
    return raw.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run the stream over all that is there now and return what it wrote. With a checkpoint kept by the caller, the next call goes on where this one ended."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed(events: DataFrame, ts: str, by: list[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum by event-time window. A window comes out once the watermark, `late` behind the newest event, has passed its end; what comes later still is dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events no further apart than `gap`."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def first_deliveries(messages: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each message once, the first to arrive; copies up to `late` apart are dropped, with state no longer than that."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def admitted(requests: DataFrame, by: str, ts: str, cost: str, seconds: int, most_requests: int, most_cost: float, late: str = "1 hour") -> DataFrame:
    """(by, ts, cost, admitted): a request is admitted if, with it, its key has no more than most_requests and most_cost among those admitted in the last `seconds`.

    The requests of a key in a micro-batch are taken in order of time. Its state is the admitted requests of its last `seconds`: at most most_requests of them; it goes once the watermark, `late` behind
    the newest request, has passed the last of them by `seconds`, so that keys that don't come again leave nothing behind.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(zip(*state.get)) if state.exists else []
        rows = sorted((t, c) for pdf in batches for t, c in zip(pdf["t"], pdf["c"]))
        out = []
        for t, c in rows:
            recent = [(a, b) for a, b in recent if a > t - seconds * 1_000_000]
            ok = len(recent) < most_requests and sum(b for _, b in recent) + c <= most_cost
            if ok:
                recent.append((t, c))
            out.append((key[0], t, c, ok))
        state.update(([a for a, _ in recent], [b for _, b in recent]))
        newest = max((t for t, _ in rows), default=0) // 1000
        state.setTimeoutTimestamp(max(newest + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["k", "t", "c", "admitted"])

    at = F.col(ts).cast("timestamp")
    keyed = requests.select(F.col(by).cast("string").alias("k"), at.alias("at"), F.col(cost).cast("double").alias("c")).where("at is not null").withWatermark("at", late)
    timed = keyed.select("k", "at", F.unix_micros("at").alias("t"), "c")
    out = timed.groupBy("k").applyInPandasWithState(step, "k string, t bigint, c double, admitted boolean", "times array<bigint>, costs array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("k").alias(by), F.timestamp_micros("t").alias(ts), F.col("c").alias(cost), "admitted")


def apply_batches(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Run `update` on each micro-batch, as for keeping an index: the checkpoint makes a batch that was cut off come again, so `update` must bear a repeat."""
    spark = stream.sparkSession
    where = checkpoint or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    stream.writeStream.foreachBatch(update).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
