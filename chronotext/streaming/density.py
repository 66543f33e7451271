"""Streaming forms of log operators (an extension of ours): tumbling density and stateful thinning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of event rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def density(events: DataFrame, time_col: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events per tumbling window and key; state older than the watermark is dropped, later rows with it."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def thin(events: DataFrame, key: str, time_col: str, gap_ms: int, ts_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Per key, keeps an event when it comes over ``gap_ms`` after the last kept one; rows ``key`` and ``t_ms`` (``ts_col`` is the same time as a timestamp).

    Within a batch rows are sorted; across batches a row up to ``late`` behind may come after later ones, and is kept or not by what was kept so far; rows
    behind the watermark are dropped. State: the last kept time, which expires once the watermark is ``gap_ms`` beyond it.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for pdf in batches for t in pdf[time_col]):
            if last is None or t - last > gap_ms:
                kept.append(t)
                last = t
        if last is not None:
            state.update((int(last),))
            state.setTimeoutTimestamp(max(int(last) + gap_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [k[0]] * len(kept), "t_ms": kept})

    timed = events.withWatermark(ts_col, late).groupBy(key)
    return timed.applyInPandasWithState(step, f"{key} long, t_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
