"""Sessions, throttles and stored-row dedup: batch forms, and the same rules over streams.

Batch forms of rules that depend on the last *stored* row read each key's rows in time order as a
stream through one pass (``repartition`` by key, sort, carry): nothing of a key is held but its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(key, started, last_event, events) of runs of events with no idle gap; works on streams with a watermark."""
    return (
        events.groupBy(key, F.session_window(time, gap).alias("w"))
        .agg(F.min(time).alias("started"), F.max(time).alias("last_event"), F.count("*").alias("events"))
        .drop("w")
    )


def _carry(keys: list[str], order: list[str], time: str, gap_s: float, most: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last, used = None, 0.0, 0
        for pdf in frames:
            seconds = pdf[time].astype("int64") / (10**9 if str(pdf[time].dtype).startswith("datetime64[ns") else 10**6)
            keep = []
            for key, t in zip(pdf[keys].itertuples(index=False, name=None), seconds, strict=True):
                if key != last_key:
                    last_key, last, used = key, -float("inf"), 0
                ok = t - last >= gap_s and (most is None or used < most)
                if ok:
                    last, used = t, used + 1
                keep.append(ok)
            yield pdf[keep]

    return run


def throttled(events: DataFrame, keys: list[str], time: str = "ts", tie: str = "event_id", gap_seconds: float = 30, most: int | None = None) -> DataFrame:
    """Rows that are stored if each must come ``gap_seconds`` after the last stored row of its key, ``most`` of a key."""
    dealt = events.repartition(*keys).sortWithinPartitions(*keys, time, tie)
    return dealt.mapInPandas(_carry(keys, [time, tie], time, gap_seconds, most), events.schema)


def throttled_stream(events: DataFrame, key: str, time: str = "ts", gap_seconds: float = 30, lateness: str = "1 minute") -> DataFrame:
    """The stream form: state holds the last stored time of each key; idle keys time out by the watermark."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(time)
        last = state.get[0] if state.exists else -(1 << 62)
        keep = []
        for t in pdf[time]:
            micros = int(pd.Timestamp(t).value // 1000)
            ok = micros - last >= gap_seconds * 1_000_000
            last = micros if ok else last
            keep.append(ok)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last / 1000 + gap_seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pdf[keep]

    return events.withWatermark(time, lateness).groupBy(key).applyInPandasWithState(step, events.schema, "last long", "append", "EventTimeTimeout")


def nudges(events: DataFrame, key: str = "user_id", time: str = "ts", idle: timedelta = timedelta(minutes=15)) -> DataFrame:
    """Rows after an idle time, with the seconds since the row before."""
    from pyspark.sql import Window

    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    since = seconds(F.col(time)) - seconds(F.lag(time).over(Window.partitionBy(key).orderBy(time, "event_id")))
    return events.withColumn("idle", since).where(F.col("idle") >= idle.total_seconds())


def apply_changes(stream: DataFrame, path: str, key: str = "entry_id", checkpoint: str | None = None):
    """Write coalesced micro-batches of a change stream below ``path``, one folder a batch.

    A batch that runs again after a failure overwrites its own folder, so each change is applied once.
    """
    from tessera.operators.replication import coalesced

    def write(batch: DataFrame, number: int) -> None:
        coalesced(batch, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).start()
