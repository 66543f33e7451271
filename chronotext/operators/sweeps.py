"""Ordered passes over rows that are sorted within partitions: each key's rows pass once, with a state that is bounded by time.

A pass whose state is empty after a pause takes the length of that pause: with ``width`` set, the runs between pauses are passes of their
own, found by blocks of ``width`` milliseconds, so that one long recording spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_key
from .blocks import islands_in_blocks, thinned


def sweep(rows: DataFrame, keys: list[str], order: list, start: Callable[[], Callable[[tuple], Iterator[tuple]]], schema: str, pause: int | None = None, width: int | None = None) -> DataFrame:
    """Passes each key's rows in order to a function that ``start`` makes for the key; it yields rows for each one, and for None at the end.

    ``pause`` and ``width``: a run that starts over ``pause`` after everything before has ended gets a function of its own, and may go to another task.
    """
    names, out = rows.columns, [c.split(" ")[0] for c in schema.split(", ")]
    if width is not None:
        rows = islands_in_blocks(rows, keys, pause, width).select(*names, "island")
        keys = [*keys, "island"]
    at, n = [rows.columns.index(k) for k in keys], len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for pdf in batches:
            got = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                k = tuple(row[i] for i in at)
                if k != key:
                    if step:
                        got += step(None)
                    key, step = k, start()
                got += step(row[:n])
            yield pd.DataFrame(got, columns=out)
        if step:
            yield pd.DataFrame(list(step(None)), columns=out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def thin(rows: DataFrame, keys: list[str], time_col: str, gap: int) -> DataFrame:
    """Keeps a time when it is more than ``gap`` after the last *kept* one of its key; see ``blocks.thinned``, which also spreads a long key."""
    return thinned(rows, keys, time_col, gap)


def suppress_repeats(rows: DataFrame, keys: list[str], text_key: str, within_ms: int) -> DataFrame:
    """Drops a row whose text was kept before, ending at most ``within_ms`` before it and not overlapping it."""
    rows = rows.select(*keys, text_key, "ord", "start_ms", "end_ms")

    def start():
        ends: list[int] = []

        def step(row):
            if row is None:
                return
            begin = row[-2]
            ends[:] = [e for e in ends if begin - e <= within_ms]
            if not any(e <= begin for e in ends):
                ends.append(row[-1])
                yield row

        return step

    return sweep(rows, [*keys, text_key], ["start_ms", "ord", "end_ms"], start, _schema(rows))


LINE = "rec_id long, line_idx long, start_ms long, end_ms long, text string"


def seam_dedupe(rows: DataFrame, share: float = 0.6, width: int | None = None) -> DataFrame:
    """Lines that overlap a kept one by ``share`` of the shorter and whose text (without spaces) equals, contains or lies in it are its copies; the longer text stays."""
    rows = rows.select("rec_id", "line_idx", "start_ms", "end_ms", "text")

    def start():
        kept: list[list] = []  # lines that may still overlap what follows

        def step(row):
            if row is None:
                yield from map(tuple, kept)
                return
            gone = [k for k in kept if k[3] <= row[2]]
            kept[:] = [k for k in kept if k[3] > row[2]]
            yield from map(tuple, gone)
            text = row[4].replace(" ", "")
            for k in kept:
                common, other = min(row[3], k[3]) - max(row[2], k[2]), k[4].replace(" ", "")
                if common > 0 and common >= share * (min(row[3] - row[2], k[3] - k[2]) or 1e-3) and (text in other or other in text):
                    if len(text) > len(other):
                        k[:] = row
                    return
            kept.append(list(row))

        return step

    return sweep(rows, ["rec_id"], ["start_ms", "end_ms", "line_idx"], start, LINE, -1, width)


def finalize_lines(rows: DataFrame, within_ms: int = 25_000, near_ms: int = 1_000, least_ms: int = 50, width: int | None = None) -> DataFrame:
    """``rec_id, line_idx, start_ms, end_ms, text``: without empty lines, repeats and contained neighbours, and without overlaps.

    A text (letters and digits, four or more) that ended up to ``within_ms`` before is a repeat; of a line and the one kept before it, within ``near_ms`` of
    its end, one of which contains the other, the longer text stays; a line that runs into the next ends there, lasting ``least_ms`` at least.
    """
    rows = rows.where("text <> ''").select("rec_id", "line_idx", "start_ms", F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 10).otherwise(F.col("end_ms")).alias("end_ms"), "text", normal_key(F.col("text")).alias("k"))

    def start():
        seen: dict[str, list[list]] = {}
        ends: list[tuple[int, str]] = []  # a heap: texts leave ``seen`` once they are out of reach
        last: list | None = None  # the line kept last, not yet given out
        floor = None  # where it may begin

        def give(nxt):
            """The last line, cut by the next one, which may move in turn."""
            nonlocal floor
            line = last[:5]
            if floor is not None and line[2] < floor:
                line[2] = floor
            if line[3] <= line[2]:
                line[3] = line[2] + least_ms if floor is not None else line[3]
            if nxt is not None and line[3] > nxt[2]:
                line[3] = max(line[2] + least_ms, nxt[2])
            floor = line[3]
            return tuple(line)

        def step(row):
            nonlocal last
            if row is None:
                if last:
                    yield give(None)
                return
            row, key = list(row), row[5]
            while ends and row[2] - ends[0][0] > within_ms:
                _, old = heappop(ends)
                reach = max((x[3] for x in seen.get(old, ())), default=None)
                if reach is not None and row[2] - reach <= within_ms:
                    heappush(ends, (reach, old))  # a longer text took its place since
                else:
                    seen.pop(old, None)
            if len(key) >= 4:
                before = seen.setdefault(key, [])
                before[:] = [x for x in before if row[2] - x[3] <= within_ms]
                if any(x[3] <= row[2] + 50 for x in before):
                    return
                before.append(row)
                heappush(ends, (row[3], key))
            if key and last and row[2] - last[3] < near_ms and len(key) >= 3 and last[5] and (key in last[5] or last[5] in key):
                if len(key) > len(last[5]):
                    last[2:6] = row[2:6]
                return
            if last:
                yield give(row)
            last = row

        return step

    return sweep(rows, ["rec_id"], ["start_ms", "line_idx"], start, LINE, max(within_ms, near_ms, least_ms), width)


def split_at_middles(rows: DataFrame, gap_ms: int = 30, least_ms: int = 120) -> DataFrame:
    """Neighbours that come within ``gap_ms`` part around the middle of their common edge; each step may move the next line's start."""
    rows = rows.select("rec_id", "line_idx", "start_ms", "end_ms", "text")
    half = gap_ms // 2

    def start():
        last: list | None = None

        def step(row):
            nonlocal last
            if row is None:
                if last:
                    yield tuple(last)
                return
            row = list(row)
            if last and last[3] > row[2] - gap_ms:
                middle = (row[2] + last[3]) // 2
                last[3] = max(last[2] + least_ms, middle - half)
                row[2] = max(last[3] + half, middle + half)
                if row[3] <= row[2]:
                    row[3] = row[2] + least_ms
            if last:
                yield tuple(last)
            last = row

        return step

    return sweep(rows, ["rec_id"], ["line_idx"], start, LINE)


def aggregate_words(atoms: DataFrame, most_ms: int = 5000, most_chars: int = 25, sentence_end: str = ".!?") -> DataFrame:
    """``rec_id, block, pos, line``: a word starts a new line when the last ended a sentence, or the line would grow too long in time or characters."""
    rows = atoms.select("rec_id", "block", "pos", "start_ms", "end_ms", "text")

    def start():
        line, begin, chars, stop = -1, 0, 0, True

        def step(row):
            nonlocal line, begin, chars, stop
            if row is None:
                return
            _, _, _, s, e, t = row
            if stop or e - begin > most_ms or chars + len(t) > most_chars:
                line, begin, chars = line + 1, s, 0
            chars, stop = chars + len(t), t.endswith(tuple(sentence_end))
            yield (*row[:3], line)

        return step

    return sweep(rows, ["rec_id", "block"], ["pos"], start, "rec_id long, block long, pos long, line long")
