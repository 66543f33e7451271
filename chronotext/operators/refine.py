"""Lines moved to where the sound begins and ends: onsets and offsets over levels in frames, words in proportion, neighbours apart.

Lines meet the frames in blocks: a block of ``width`` frames with the context that the widest search needs is one task's dense array,
so a recording spreads over tasks, a line is one row for each of its edges, and no frame is copied for a line. Times are integer milliseconds, ``hop_ms`` a frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written
from .blocks import group_by_group, with_context
from .signals import refined_edges
from .sweeps import split_at_middles

#: Frames on either side of a search whose low percentile is the floor.
AROUND, SHARE = 20, 10
ROWS = 4096  # edges that are looked at together


def found_edges(level: np.ndarray, there: np.ndarray, at: np.ndarray, before: int, after: int, up: float, first: bool) -> np.ndarray:
    """For each frame of ``at`` the first frame of [at - before, at + after) that rises over the floor by more than ``up``, or the one after the last; -1: none.

    ``level`` and ``there`` (which frames exist) reach ``before + AROUND`` and ``after + AROUND`` frames beyond all of ``at``.
    """
    out = np.full(len(at), -1, np.int64)
    for low in range(0, len(at), ROWS):
        own = at[low : low + ROWS, None]
        wide = own + np.arange(-before - AROUND, after + AROUND)
        x = np.where(there[wide], level[wide], np.inf)
        n = np.isfinite(x).sum(1)
        x.sort(1)
        place = SHARE / 100 * np.maximum(0, n - 1)
        a = place.astype(np.int64)
        rows = np.arange(len(x))
        lower, upper = x[rows, a], x[rows, np.minimum(a + 1, np.maximum(0, n - 1))]
        with np.errstate(invalid="ignore"):
            floor = lower + (upper - lower) * (place - a)
        search = own + np.arange(-before, after)
        loud = there[search] & (level[search] > floor[:, None] + up)
        hit = loud.argmax(1) if first else loud.shape[1] - loud[:, ::-1].argmax(1)
        out[low : low + ROWS] = np.where(loud.any(1), search[:, 0] + hit, -1)
    return out


def edges(lines: DataFrame, frames: DataFrame, hop_ms: int, onset: tuple[int, int, float, int], offset: tuple[int, int, float, int] | None, width: int = 100_000) -> DataFrame:
    """``rec_id, line_idx, onset_ms, offset_ms``: found edges of the lines; null where nothing rises, or too far away.

    ``onset`` and ``offset`` are (frames before, frames after, rise, most milliseconds away); frames are ``rec_id, frame_idx, level``.
    The nearest frame of a time is its quotient, halves to even.
    """
    kinds = [("onset", "start_ms", onset), *([("offset", "end_ms", offset)] if offset else [])]
    halo = max(x for _, _, (a, b, _, _) in kinds for x in (a, b)) + AROUND + 1
    wanted = [F.struct(F.lit(k).alias("kind"), F.rint(F.col(c) / hop_ms).cast("long").alias("at")) for k, c, _ in kinds]
    asked = lines.select("rec_id", "line_idx", F.explode(F.array(*wanted)).alias("w")).select("rec_id", "line_idx", "w.kind", "w.at").withColumn("block", F.floor(F.col("at") / width).cast("long"))
    sound = frames.where("level is not null and frame_idx >= 0").groupBy("rec_id", F.col("frame_idx").cast("long").alias("frame_idx")).agg(F.max(F.col("level").cast("double")).alias("level"))
    sound = with_context(sound, "frame_idx", width, halo)
    none = lambda kind: F.lit(None).cast(kind)
    both = asked.select("rec_id", "block", "line_idx", "kind", "at", none("double").alias("level")).unionByName(
        sound.select("rec_id", "block", none("long").alias("line_idx"), none("string").alias("kind"), F.col("frame_idx").alias("at"), "level")
    )
    plain = pa.schema([("rec_id", pa.int64()), ("line_idx", pa.int64()), ("kind", pa.string()), ("frame", pa.int64())])
    none_found = plain.empty_table()

    def run(table: pa.Table) -> pa.Table:
        if table["kind"].null_count == table.num_rows:
            return none_found
        low = table["block"][0].as_py() * width - halo
        line = table["kind"].is_valid()
        left, right = table.filter(line), table.filter(pc.invert(line))
        level, there = np.zeros(width + 2 * halo), np.zeros(width + 2 * halo, bool)
        at = right["at"].to_numpy() - low
        level[at], there[at] = right["level"].to_numpy(), True
        parts = []
        for kind, _, (before, after, up, _) in kinds:
            own = left.filter(pc.equal(left["kind"], kind))
            found = found_edges(level, there, own["at"].to_numpy() - low, before, after, up, kind == "onset")
            frame = pa.array(found + low, pa.int64(), mask=found < 0)
            parts.append(pa.Table.from_arrays([own["rec_id"], own["line_idx"], own["kind"], pa.chunked_array([frame])], schema=plain))
        return pa.concat_tables(parts)

    dealt = both.repartition("rec_id", "block").sortWithinPartitions("rec_id", "block")
    got = dealt.mapInArrow(group_by_group(run, ["rec_id", "block"], plain), "rec_id long, line_idx long, kind string, frame long")
    timed = {k: F.max(F.when(F.col("kind") == k, F.col("frame") * hop_ms)).alias(f"{k}_ms") for k, _, _ in kinds}
    found = written(got.groupBy("rec_id", "line_idx").agg(*timed.values()), "edges")  # read twice, as lines are parted after they are moved
    held = lambda k, c, most: F.when(F.abs(F.col(f"{k}_ms") - F.col(c)) <= most, F.col(f"{k}_ms")).alias(f"{k}_ms")
    near = lines.select("rec_id", "line_idx", "start_ms", "end_ms").join(found, ["rec_id", "line_idx"])
    out = near.select("rec_id", "line_idx", *[held(k, c, x[3]) for k, c, x in kinds])
    return out if offset else out.withColumn("offset_ms", F.lit(None).cast("long"))


def _scaled(words: Column, old: Column, new: Column, old_span: Column, new_span: Column) -> Column:
    at = lambda x: F.floor(new + (x - old) * new_span / F.greatest(F.lit(1), old_span) + 0.5).cast("long")
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), at(w["start_ms"]).alias("start_ms"), at(w["end_ms"]).alias("end_ms")))


def _apart(lines: DataFrame, gap_ms: int) -> DataFrame:
    """Overlapping neighbours parted at the middle; the first and last word follow."""
    edges_ = split_at_middles(lines, gap_ms).select("rec_id", "line_idx", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    t = lines.join(edges_, ["rec_id", "line_idx"])
    if "words" in lines.columns:
        n = F.size("words")
        moved = F.transform("words", lambda w, i: F.struct(w["text"].alias("text"), F.when(i == 0, F.col("__s")).otherwise(w["start_ms"]).alias("start_ms"), F.when(i == n - 1, F.col("__e")).otherwise(w["end_ms"]).alias("end_ms")))
        t = t.withColumn("words", moved)
    return t.withColumn("start_ms", F.col("__s")).withColumn("end_ms", F.col("__e")).select(*lines.columns)


def refine_lines(
    lines: DataFrame, frames: DataFrame, hop_ms: int = 10, before_ms: int = 250, after_ms: int = 150, onset_db: float = 6.0, offset_db: float = 3.0, most_start_ms: int = 600, most_end_ms: int = 800,
    hold_ms: int = 180, gap_ms: int = 30, width: int = 100_000,
) -> DataFrame:
    """Lines with both edges at the sound: the start at the first rise around it, the end ``hold_ms`` before its own or at the last sound around it.

    Words (``words array<struct<text, start_ms, end_ms>>``, where there are any) keep their share of the line; lines that come within ``gap_ms`` then part at the middle.
    """
    on = (before_ms // hop_ms, after_ms // hop_ms, onset_db, most_start_ms)
    off = (200 // hop_ms, 250 // hop_ms, offset_db, most_end_ms)
    found = edges(lines, frames, hop_ms, on, off, width)
    moved = refined_edges(lines, found, hold_ms).select("rec_id", "line_idx", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    t = lines.join(moved, ["rec_id", "line_idx"])
    if "words" in lines.columns:
        t = t.withColumn("words", _scaled(F.col("words"), F.col("start_ms"), F.col("__s"), F.col("end_ms") - F.col("start_ms"), F.col("__e") - F.col("__s")))
    return _apart(t.withColumn("start_ms", F.col("__s")).withColumn("end_ms", F.col("__e")).select(*lines.columns), gap_ms)


def snap_to_speech(lines: DataFrame, frames: DataFrame, hop_ms: int = 10, before_ms: int = 250, after_ms: int = 150, onset_db: float = 6.0, most_ms: int = 800, gap_ms: int = 30, width: int = 100_000) -> DataFrame:
    """Whole lines moved so that they begin at the first rise around their start; lengths and words stay, lines that come within ``gap_ms`` then part at the middle."""
    found = edges(lines, frames, hop_ms, (before_ms // hop_ms, after_ms // hop_ms, onset_db, most_ms), None, width)
    t = lines.join(found.select("rec_id", "line_idx", "onset_ms"), ["rec_id", "line_idx"])
    by = F.coalesce(F.col("onset_ms") - F.col("start_ms"), F.lit(0).cast("long"))
    if "words" in lines.columns:
        t = t.withColumn("words", F.transform("words", lambda w: F.struct(w["text"].alias("text"), (w["start_ms"] + by).alias("start_ms"), (w["end_ms"] + by).alias("end_ms"))))
    t = t.withColumn("__by", by).withColumn("start_ms", F.col("start_ms") + F.col("__by")).withColumn("end_ms", F.col("end_ms") + F.col("__by"))
    return _apart(t.select(*lines.columns), gap_ms)
