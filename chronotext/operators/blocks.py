"""One long recording over many tasks: blocks with context, speech found by block and merged at seams, runs in two levels.

A key may hold a third of all rows, so nothing here gathers a key's rows in one task: rows are dealt by (key, block of time), and
what neighbouring blocks must know of each other is one small row for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.folders import written


def with_context(rows: DataFrame, at: str, width: int, halo: int) -> DataFrame:
    """Each row in the block of ``width`` that owns it (``block, owned``), and a copy in each block that it is within ``halo`` of."""
    own = lambda c: F.floor(c / width).cast("long")
    t = F.col(at)
    spread = rows.withColumn("block", F.explode(F.sequence(own(t - halo), own(t + halo))))
    return spread.withColumn("owned", F.col("block") == own(t))


def group_by_group(run: Callable[[pa.Table], pa.Table], keys: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows sorted by ``keys``: ``run`` gets each group's rows. Many small groups share a message; of a batch's last group the rows are held until it ends."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of the group that is open
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            new = np.zeros(t.num_rows, bool)
            for k in keys:
                codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = bool(held) and any(held[0][k][0].as_py() != t[k][0].as_py() for k in keys)
            out, low = [], 0
            for cut in np.flatnonzero(new).tolist():
                whole = pa.concat_tables([*held, t.slice(low, cut - low)]) if held else t.slice(low, cut - low)
                if (got := run(whole)).num_rows:
                    out.append(got)
                held, low = [], cut
            held.append(t.slice(low))
            if out:
                yield from pa.concat_tables(out).cast(schema).combine_chunks().to_batches()
        if held:
            yield from run(pa.concat_tables(held)).cast(schema).combine_chunks().to_batches()

    return apply


def _runs(index: np.ndarray, bridge: int) -> list[tuple[int, int]]:
    """(first, last) of sorted indexes, gaps of up to ``bridge`` missing ones bridged."""
    if not len(index):
        return []
    cut = np.flatnonzero(np.diff(index) > bridge + 1)
    return list(zip(index[np.append(0, cut + 1)].tolist(), index[np.append(cut, len(index) - 1)].tolist(), strict=True))


def speech_spans(frames: DataFrame, keys: list[str], on: float, off: float, smooth: int = 0, hang: int = 10, least: int = 5, pad: int = 0, width: int = 100_000) -> DataFrame:
    """``keys, first_frame, last_frame``: speech by level with hysteresis, of frames ``keys, frame_idx, level``.

    A frame's level is the mean of the frames within ``smooth`` of it. Speech begins where it reaches ``on`` and lasts until more than ``hang``
    frames in a row are below ``off``; spans under ``least`` frames go, the others get ``pad`` frames on either side (not below 0), and
    spans that then touch are one. Blocks of ``width`` frames see ``smooth`` frames of their neighbours, so that each
    frame's level is that of the whole recording, and give the runs that they own; only runs near a border can go on in the next block,
    and these alone are merged across. Missing frames and null levels count neither as sound nor in means; of repeated frames the loudest counts.
    """
    if off > on:
        raise ValueError("off must not be above on")
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    rows = frames.where("frame_idx is not null and level is not null").groupBy(*keys, F.col("frame_idx").cast("long").alias("frame_idx")).agg(F.max(F.col("level").cast("double")).alias("level"))
    dealt = with_context(rows, "frame_idx", width, smooth).select(*keys, "block", "frame_idx", "level")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "first long, last long, begin long, edge boolean"])
    plain = pa.schema([*to_arrow_schema(dealt.select(*keys).schema), ("first", pa.int64()), ("last", pa.int64()), ("begin", pa.int64()), ("edge", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        low = block * width
        at = table["frame_idx"].to_numpy() - low + smooth
        level, there = np.zeros(width + 2 * smooth), np.zeros(width + 2 * smooth, bool)
        level[at], there[at] = table["level"].to_numpy(), True
        if smooth:
            span = 2 * smooth + 1
            total = lambda x: np.convolve(x, np.ones(span), "valid")
            mean = total(level) / np.maximum(1, np.rint(total(there.astype(float))))
            there = there[smooth : smooth + width]
        else:
            mean = level
        loud, weak = there & (mean >= on), np.flatnonzero(there & (mean >= off))
        first_loud = np.append(np.flatnonzero(loud), np.iinfo(np.int64).max)
        found = []
        for a, b in _runs(weak, hang):
            begin = int(first_loud[np.searchsorted(first_loud, a)])
            found.append((low + a, low + b, low + begin if begin <= b else None, a <= hang or b >= width - 1 - hang))
        first, last, begin, edge = zip(*found, strict=True) if found else ((), (), (), ())
        same = [pa.array([table[k][0].as_py()] * len(found), table.schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*same, pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(begin, pa.int64()), pa.array(edge, pa.bool_())], names=[*keys, "first", "last", "begin", "edge"])

    dealt = dealt.repartition(*keys, "block").sortWithinPartitions(*keys, "block")
    runs = written(dealt.mapInArrow(group_by_group(run, [*keys, "block"], plain), schema), "runs")  # read several times below
    # at the seams: runs of both sides of a border, with the place where the first of them is loud
    w = Window.partitionBy(*keys).orderBy("first", "last")
    seams = runs.where("edge").withColumn("new", F.when(F.col("first") - F.lag("last").over(w) <= hang + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    joined = seams.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("begin").alias("begin"))
    whole = joined.select(*keys, "begin", "last").unionByName(runs.where("not edge").select(*keys, "begin", "last"))
    kept = whole.where(F.col("begin").isNotNull() & (F.col("last") - F.col("begin") + 1 >= least))
    padded = kept.select(*keys, F.greatest(F.lit(0).cast("long"), F.col("begin") - pad).alias("start_ms"), (F.col("last") + pad + 1).alias("end_ms"))
    if pad:
        padded = merged_in_blocks(padded, keys, 0, width)
    return padded.select(*keys, F.col("start_ms").alias("first_frame"), (F.col("end_ms") - 1).alias("last_frame"))


def islands_in_blocks(rows: DataFrame, keys: list[str], gap: int, width: int, start: str = "start_ms", end: str = "end_ms", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``island``: rows of a key that start at most ``gap`` after the furthest end of those before share its value (the place of its first row).

    Blocks of ``width`` are sorted by themselves. How far the rows before a block reach, and which run is open there, are taken from
    a row for each block.
    """
    by = [start, end, *order]
    t = rows.withColumn("__b", F.floor(F.col(start) / width).cast("long"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*by)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    reach = t.groupBy(*keys, "__b").agg(F.max(end).alias("__e")).withColumn("__r", F.max("__e").over(before)).drop("__e")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__b"]]
    both = lambda a, b: a.alias("l").join(b.alias("r"), same[0] if len(same) == 1 else _all(same))
    t = both(t, reach).select("l.*", "r.__r")
    so_far = F.greatest(F.col("__r"), F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("__so", so_far)
    # a run is known by where it starts: all rows that start a run of a key start at different places, as the next is beyond the reach of the last
    t = t.withColumn("__f", F.when(F.col("__so").isNull() | (F.col(start) - F.col("__so") > gap), F.col(start)))
    opened = t.groupBy(*keys, "__b").agg(F.max("__f").alias("__m")).withColumn("__o", F.max("__m").over(before)).drop("__m")
    t = both(t, opened).select("l.*", "r.__o")
    own = F.max("__f").over(inside)  # with its equals, whichever of them comes first
    return t.withColumn("island", F.coalesce(own, "__o")).drop("__b", "__r", "__so", "__f", "__o")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def merged_in_blocks(rows: DataFrame, keys: list[str], gap: int, width: int) -> DataFrame:
    """``keys, start_ms, end_ms``: runs of intervals, a long key spread over blocks; equal to those of ``intervals.gap_merge``."""
    runs = islands_in_blocks(rows, keys, gap, width)
    return runs.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def thinned(rows: DataFrame, keys: list[str], time_col: str, gap: int, width: int | None = None) -> DataFrame:
    """Keeps a time when it is more than ``gap`` after the last *kept* one of its key, starting anew after each pause.

    After a pause of more than ``gap`` the next time is kept whatever came before, so the runs between pauses are passes of their own: a
    key's rows spread over tasks by blocks of ``width`` (``None``: they are short enough for one). A pass finds each time's successor by a
    sorted search and jumps from kept time to kept time. Null times go.
    """
    rows = rows.select(*keys, time_col).where(F.col(time_col).isNotNull())
    by = list(keys)
    if width is not None:
        rows = islands_in_blocks(rows, keys, gap, width, time_col, time_col)
        by.append("island")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, limit = None, None  # of the run that the last batch ended in: no time up to the limit is kept
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(i) for i in range(len(by))]
            new = np.zeros(n, bool)
            for c in columns:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            key = tuple(c[0].as_py() for c in columns)
            first = np.concatenate([[0], np.flatnonzero(new)])
            times = batch.column(batch.schema.get_field_index(time_col)).to_numpy(zero_copy_only=False)
            keep = np.zeros(n, bool)
            for a, b in zip(first.tolist(), np.append(first[1:], n).tolist(), strict=True):
                own = times[a:b]
                i = 0
                if a == 0 and key == last_key:
                    i = int(np.searchsorted(own, limit, "right"))
                if own[-1] - own[0] <= gap:
                    hops = [i] if i < len(own) else []
                else:
                    after, hops = np.searchsorted(own, own + gap, "right").tolist(), []
                    while i < len(own):
                        hops.append(i)
                        i = after[i]
                keep[np.array(hops, np.int64) + a] = True
                if hops:
                    limit = own[hops[-1]] + gap
            last_key = tuple(c[n - 1].as_py() for c in columns)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in out], names=names).filter(pa.array(keep))

    names = [*keys, time_col]
    rows = rows.select(*by, time_col)
    out = [rows.columns.index(c) for c in names]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.repartition(*by).sortWithinPartitions(*by, time_col).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))
