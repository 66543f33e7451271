"""Chunk ownership as a rule for late data: a line counts in the chunk that owns its middle, and is given out once that chunk closes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LINE = "line_idx long, start_ms long, end_ms long, text string"
OUT = "rec_id long, chunk long, line_idx long, start_ms long, end_ms long, text string"
#: The state of timers and lists needs this store: ``spark.sql.streaming.stateStore.providerClass``.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OwnedLines(StatefulProcessor):
    """Lines of a chunk until it closes: a value for each distinct line, and a timer for the chunk's end."""

    def __init__(self, chunk_ms: int):
        self.chunk_ms = chunk_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", LINE, "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        close = (int(key[1]) + 1) * self.chunk_ms
        if timerValues.getCurrentWatermarkInMs() < close:  # else the chunk has been given out
            for pdf in rows:
                for line in pdf[["line_idx", "start_ms", "end_ms", "text"]].itertuples(index=False, name=None):
                    self.lines.updateValue(line, (1,))
            self.handle.registerTimer(close)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = sorted(tuple(k) for k in self.lines.keys())
        self.lines.clear()
        if found:
            out = pd.DataFrame(found, columns=["line_idx", "start_ms", "end_ms", "text"])
            out.insert(0, "chunk", int(key[1]))
            out.insert(0, "rec_id", int(key[0]))
            yield out

    def close(self) -> None:
        pass


def owned_lines(decoded: DataFrame, chunk_ms: int, late: str = "0 seconds") -> DataFrame:
    """``rec_id, chunk, line_idx, start_ms, end_ms, text``: of lines (``rec_id, chunk`` that decoded them, and the line) those whose middle their chunk owns.

    Event time is the line's end: a chunk closes once the watermark, ``late`` behind the latest line, has passed its end; then its lines go out and its state
    goes away. Repeated rows count once; a line behind the watermark whose chunk has closed is dropped. Equal to the batch rule where nothing comes that late.
    """
    middle = F.expr(f"(start_ms + end_ms) div 2 div {int(chunk_ms)}")
    mine = decoded.where(F.col("chunk") == middle).withColumn("ts", F.timestamp_millis("end_ms")).withWatermark("ts", late)
    rows = mine.select("rec_id", "chunk", "line_idx", "start_ms", "end_ms", "text", "ts")
    return rows.groupBy("rec_id", "chunk").transformWithStateInPandas(OwnedLines(chunk_ms), OUT, outputMode="Append", timeMode="EventTime")
