"""File events as streams: debouncing, folding and throttling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.session import shared_dir

IGNORED = ["node_modules", ".git", "__pycache__", "dist", "build"]


def watched(events: DataFrame, extensions: list[str]) -> DataFrame:
    """Events (path, ...) of files with these extensions outside ignored folders."""
    return events.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(extensions) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))


def moves_apart(events: DataFrame) -> DataFrame:
    """(workspace, ts, path, kind): a move is a deletion at its source and a creation at its destination."""
    one = lambda p, k: F.struct(p.alias("path"), k.alias("kind"))
    parts = F.when(F.col("kind") == "moved", F.array(one(F.col("path"), F.lit("deleted")), one(F.col("dest"), F.lit("created")))).otherwise(F.array(one(F.col("path"), F.col("kind"))))
    return events.select("workspace", "ts", F.inline(parts))


def folded(events: DataFrame, quiet: str = "800 milliseconds") -> DataFrame:
    """(workspace, start, end, path, change_type): per quiet period the outcome for each path: the last creation or deletion, else a
    modification. Works on a stream (with a watermark) as on a table; aggregation is one state row per path and session."""
    w = F.session_window("ts", quiet)
    g = events.groupBy(w.alias("w"), "workspace", "path").agg(F.max(F.when(F.col("kind") != "modified", F.struct("ts", "kind"))).alias("l"))
    kind = F.when(F.col("l.kind") == "created", "added").when(F.col("l.kind") == "deleted", "deleted").otherwise("modified")
    return g.select("workspace", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "path", kind.alias("change_type"))


def sessions(events: DataFrame, key: str, quiet: str) -> DataFrame:
    """(key, start, end, n): runs of events of a key with no pause of `quiet` or more (trailing-edge debounce)."""
    w = F.session_window("ts", quiet)
    g = events.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def throttle_stream(events: DataFrame, key: str, seconds: int = 5, late: str = "5 seconds") -> DataFrame:
    """(key, ts): the events accepted by a leading-edge throttle: one passes if the last accepted one of its key is at least `seconds` back.
    A state of one timestamp per key, dropped when the watermark (`late` behind the newest event) has passed the time it refuses, as any
    later event is accepted anyway. Within a micro-batch events go in order of time; events that come late to their key are refused."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        us = np.sort(np.concatenate([b["ts"].to_numpy("datetime64[us]").view("int64") for b in batches]))
        out = []
        at = 0 if last is None else int(np.searchsorted(us, last + seconds * 1_000_000))
        while at < len(us):  # from one accepted event straight to the next that may pass
            last = int(us[at])
            out.append(last)
            at = int(np.searchsorted(us, last + seconds * 1_000_000))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "ts": np.array(out).view("datetime64[us]")})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "ts").withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, written to Parquet in the shared folder and read back: exactly once, with nothing kept on the driver."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/graphloom-stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def upsert_each(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Every micro-batch handed to one writer in turn, which updates a stored graph."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
