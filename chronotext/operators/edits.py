"""Row edits on an ordered line table, and its versioned store; every operator returns a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sweeps import sweep

LINE = ["rec_id", "line_idx", "start_ms", "end_ms", "text"]


def reindex(rows: DataFrame, *order: str) -> DataFrame:
    """Dense line numbers from 0 in the given order, per recording."""
    return rows.withColumn("line_idx", (F.row_number().over(Window.partitionBy("rec_id").orderBy(*order)) - 1).cast("long"))


def split_line(rows: DataFrame, which: Column, at: Column) -> DataFrame:
    """Cuts the chosen lines before character ``at`` (1..length-1), time in proportion."""
    ok = which & (at >= 1) & (at < F.length("text"))
    cut = (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * at / F.length("text"))).cast("long")
    part = lambda i, s, e, t: F.struct(F.lit(i).alias("p"), s.alias("start_ms"), e.alias("end_ms"), t.alias("text"))
    left, right = part(0, F.col("start_ms"), cut, F.expr("left(text, __at)")), part(1, cut, F.col("end_ms"), F.expr("substr(text, __at + 1)"))
    whole = part(0, F.col("start_ms"), F.col("end_ms"), F.col("text"))
    cutting = rows.withColumn("__at", at.cast("int")).withColumn("__x", F.explode(F.when(ok, F.array(left, right)).otherwise(F.array(whole))))
    return reindex(cutting.select("rec_id", F.col("line_idx").alias("line_idx"), "__x.*"), "line_idx", "p").select(*LINE)


def merge_lines(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Joins the contiguous lines first..last (two or more) into one."""
    inside = (F.col("line_idx") >= first) & (F.col("line_idx") <= last) & (last > first)
    run = F.when(inside, first).otherwise(F.col("line_idx"))
    g = rows.groupBy("rec_id", run.cast("long").alias("line_idx")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("line_idx").alias("i"), "text"))), lambda x: x["text"]), "").alias("text"))
    return reindex(g, "line_idx").select(*LINE)


def shift_lines(rows: DataFrame, which: Column, delta_ms: int) -> DataFrame:
    """Moves the chosen lines, never below 0; each lasts 10 ms at least."""
    start = F.when(which, F.greatest(F.lit(0), F.col("start_ms") + delta_ms)).otherwise(F.col("start_ms")).cast("long")
    moved = rows.withColumn("__s", start).withColumn("end_ms", F.when(which, F.greatest(F.col("__s") + 10, F.col("end_ms") + delta_ms)).otherwise(F.col("end_ms")).cast("long"))
    return moved.withColumn("start_ms", F.col("__s")).select(*LINE)


def retime(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Scales all times by num/den, which must be positive."""
    if num <= 0 or den <= 0:
        raise ValueError("the factor must be positive")
    return rows.withColumn("start_ms", F.floor(F.col("start_ms") * num / den).cast("long")).withColumn("end_ms", F.floor(F.col("end_ms") * num / den).cast("long")).select(*LINE)


def update_line(rows: DataFrame, which: Column, start: Column, end: Column) -> DataFrame:
    """New times for the chosen lines, kept 10 ms clear of the neighbours and 100 ms long at least."""
    w = Window.partitionBy("rec_id").orderBy("line_idx")
    low, high = F.coalesce(F.lag("end_ms").over(w) + 10, F.lit(0)), F.lead("start_ms").over(w) - 10
    t = rows.withColumn("__l", low).withColumn("__h", high)
    s = F.greatest(F.col("__l"), start)
    e = F.greatest(s + 100, F.least(end, F.coalesce("__h", end)))
    out = t.withColumn("__s", F.when(which, s).otherwise(F.col("start_ms")).cast("long")).withColumn("end_ms", F.when(which, e).otherwise(F.col("end_ms")).cast("long"))
    return out.withColumn("start_ms", F.col("__s")).select(*LINE)


def duplicate_lines(rows: DataFrame, which: Column) -> DataFrame:
    """A copy after each chosen line, right behind it in time and of the same length."""
    span = F.col("end_ms") - F.col("start_ms")
    copy = rows.where(which).select("rec_id", "line_idx", F.lit(1).alias("p"), F.col("end_ms").alias("start_ms"), (F.col("end_ms") + span).cast("long").alias("end_ms"), "text")
    return reindex(rows.withColumn("p", F.lit(0)).select("rec_id", "line_idx", "p", "start_ms", "end_ms", "text").unionByName(copy), "line_idx", "p").select(*LINE)


def paste_lines(rows: DataFrame, clip: DataFrame, at_ms: int) -> DataFrame:
    """Inserts clipboard lines so that the first starts at ``at_ms``; gaps stay, the table is sorted by start."""
    first = clip.groupBy("rec_id").agg(F.min("start_ms").alias("__m"))
    moved = clip.join(first, "rec_id").select("rec_id", "line_idx", (F.col("start_ms") - F.col("__m") + at_ms).alias("start_ms"), (F.col("end_ms") - F.col("__m") + at_ms).alias("end_ms"), "text", F.lit(1).alias("p"))
    return reindex(rows.select(*LINE, F.lit(0).alias("p")).unionByName(moved), "start_ms", "p", "line_idx").select(*LINE)


def delete_lines(rows: DataFrame, which: Column) -> DataFrame:
    return reindex(rows.where(~which), "line_idx").select(*LINE)


def fix_overlaps(rows: DataFrame, gap_ms: int = 20, least_ms: int = 100) -> DataFrame:
    """An end that passes the next start moves to ``gap_ms`` before it, leaving ``least_ms`` at least."""
    nxt = F.lead("start_ms").over(Window.partitionBy("rec_id").orderBy("line_idx"))
    end = F.when(F.col("end_ms") > F.col("__n"), F.greatest(F.col("start_ms") + least_ms, F.col("__n") - gap_ms)).otherwise(F.col("end_ms"))
    return rows.withColumn("__n", nxt).withColumn("end_ms", end.cast("long")).select(*LINE)


def split_long(rows: DataFrame, most: int) -> DataFrame:
    """Lines over ``most`` characters in equal parts by characters, time in proportion."""
    n = F.ceil(F.length("text") / most)
    k = F.greatest(F.lit(1), n).cast("int")
    parts = rows.withColumn("__k", k).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    at = lambda i: F.floor(F.length("text") * i / F.col("__k")).cast("int")
    time = lambda i: (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * at(i) / F.greatest(F.lit(1), F.length("text")))).cast("long")
    cut = parts.select("rec_id", "line_idx", "__i", time(F.col("__i")).alias("start_ms"), F.when(F.col("__i") + 1 == F.col("__k"), F.col("end_ms")).otherwise(time(F.col("__i") + 1)).alias("end_ms"), F.substring("text", at(F.col("__i")) + 1, at(F.col("__i") + 1) - at(F.col("__i"))).alias("text"))
    return reindex(cut, "line_idx", "__i").select(*LINE)


def line_stats(rows: DataFrame) -> DataFrame:
    """Counts per recording: lines, short (<0.4 s), long (>20 characters), overlapping the next; mean duration and length."""
    nxt = F.lead("start_ms").over(Window.partitionBy("rec_id").orderBy("line_idx"))
    t = rows.withColumn("__n", nxt)
    flag = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    span = F.col("end_ms") - F.col("start_ms")
    return t.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(span) / F.count(F.lit(1)), 6).alias("mean_ms"), F.round(F.sum(F.length("text")) / F.count(F.lit(1)), 6).alias("mean_chars"),
        flag(span < 400, "n_short"), flag(F.length("text") > 20, "n_long"), flag(F.col("end_ms") > F.col("__n"), "n_overlap"),
    )


def readable_spans(rows: DataFrame, width_px: int = 800, line_px: int = 36, least_ms: int = 5_000, most_ms: int = 600_000) -> DataFrame:
    """``rec_id, start_ms, span_ms``: where a view of a recording begins, and how long it is for its median line to be ``line_px`` wide.

    The median is the upper of two; lines of no length count as two seconds. The span lies within the bounds, and is no longer than the recording.
    """
    place = Window.partitionBy("rec_id")
    t = rows.withColumn("__d", F.col("end_ms") - F.col("start_ms"))
    t = t.withColumn("__r", F.row_number().over(place.orderBy("__d")) - 1).withColumn("__n", F.count(F.lit(1)).over(place))
    mid = F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2), F.col("__d")))
    g = t.groupBy("rec_id").agg(F.min_by("start_ms", "line_idx").alias("start_ms"), F.coalesce(F.nullif(mid, F.lit(0)), F.lit(2000)).alias("d"), F.max("end_ms").alias("all"))
    high = F.least(F.lit(most_ms), F.greatest(F.lit(least_ms), F.col("all")))
    return g.select("rec_id", "start_ms", F.greatest(F.lit(least_ms), F.least(high, F.floor(width_px * F.col("d") / line_px))).cast("long").alias("span_ms"))


def insert_line(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Adds ``rec_id, start_ms, end_ms, text`` lines that end after they start; the table is sorted by start."""
    fresh = new.where("end_ms > start_ms").select("rec_id", F.lit(-1).cast("long").alias("line_idx"), "start_ms", "end_ms", "text", F.lit(1).alias("p"))
    return reindex(rows.select(*LINE, F.lit(0).alias("p")).unionByName(fresh), "start_ms", "p", "line_idx").select(*LINE)


def retime_edge(rows: DataFrame, which: Column, start: Column | None = None, end: Column | None = None, least_ms: int = 200) -> DataFrame:
    """Moves one edge of the chosen lines, whatever the neighbours, leaving ``least_ms``; ``words`` keep their share of the line's time."""
    s0 = F.greatest(F.lit(0), F.col("start_ms") if start is None else start)
    e0 = F.col("end_ms") if end is None else end
    short = e0 - s0 < least_ms
    s = F.when(short, F.greatest(F.lit(0), e0 - least_ms)).otherwise(s0) if start is not None else s0
    e = F.when(short, s0 + least_ms).otherwise(e0) if start is None else e0
    t = rows.withColumn("__s", F.when(which, s).otherwise(F.col("start_ms")).cast("long")).withColumn("__e", F.when(which, e).otherwise(F.col("end_ms")).cast("long"))
    at = lambda x: (F.col("__s") + F.floor((x - F.col("start_ms")) * (F.col("__e") - F.col("__s")) / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")) + 0.5)).cast("long")
    if "words" in rows.columns:
        t = t.withColumn("words", F.transform("words", lambda w: F.struct(w["text"].alias("text"), at(w["start_ms"]).alias("start_ms"), at(w["end_ms"]).alias("end_ms"))))
    return t.withColumn("start_ms", F.col("__s")).withColumn("end_ms", F.col("__e")).drop("__s", "__e")


def shift_words(words: Column, delta_ms: int) -> Column:
    """Words moved, never below 0; each lasts 10 ms at least. A shift under 20 ms is none."""
    if abs(delta_ms) < 20:
        return words
    s = lambda w: F.greatest(F.lit(0).cast("long"), w["start_ms"] + delta_ms)
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), s(w).alias("start_ms"), F.greatest(s(w) + 10, w["end_ms"] + delta_ms).alias("end_ms")))


def retime_words(words: Column, num: int, den: int) -> Column:
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), F.floor(w["start_ms"] * num / den).cast("long").alias("start_ms"), F.floor(w["end_ms"] * num / den).cast("long").alias("end_ms")))


def set_style(rows: DataFrame, which: Column, style: dict[str, str]) -> DataFrame:
    """A style of its own for the chosen lines, in place of what they had; an empty one takes it away."""
    new = F.create_map(*[F.lit(x) for kv in style.items() for x in kv]) if style else F.lit(None).cast("map<string,string>")
    return rows.withColumn("style", F.when(which, new).otherwise(F.col("style")))


def replace_text(rows: DataFrame, text: Column, end: Column) -> DataFrame:
    """A new text, with one word for the line's whole time, as the old words' times say nothing of it."""
    return rows.withColumn("text", text).withColumn("end_ms", end).withColumn("words", F.array(F.struct("text", "start_ms", "end_ms")))


STATE = "project long, seq long, versions array<long>, version long"


def _replay(versions: list[int], version: int, op: str, seq: int, most: int) -> tuple[list[int], int]:
    """The saves that are held (by ``seq``) and how many of them are in force, after one more operation."""
    if op == "save":
        versions = [*versions[:version], seq][-most:]
        return versions, min(most, version + 1)
    return versions, max(0, version - 1) if op == "undo" else min(len(versions), version + 1)


def _states(log: DataFrame, most: int, every: int | None) -> DataFrame:
    """States of each project as ``STATE``: after every ``every``-th operation (from the first on), or after the last alone.

    One sorted pass; what it holds is ``most`` numbers, however long a project's log is.
    """

    def start():
        versions, version, n, last = [], 0, 0, None

        def step(row):
            nonlocal versions, version, n, last
            if row is None:
                if every is None:
                    yield (*last, versions, version)
                return
            versions, version = _replay(versions, version, row[2], row[1], most)
            last, n = row[:2], n + 1
            if every is not None and n % every == 0:
                yield (*last, versions, version)

        return step

    return sweep(log.select(F.col("project").cast("long").alias("project"), F.col("seq").cast("long").alias("seq"), "op"), ["project"], ["seq"], start, STATE)


def _with_payload(states: DataFrame, log: DataFrame) -> DataFrame:
    """``project, seq, version, n_versions, payload``: the payload of the save in force."""
    force = F.when(F.col("version") > 0, F.element_at("versions", F.greatest(F.lit(1), F.col("version")).cast("int")))
    saves = log.where("op = 'save'").select(F.col("project").alias("__p"), F.col("seq").alias("__q"), "payload")
    t = states.select("project", "seq", "version", F.size("versions").cast("long").alias("n_versions"), force.alias("__f"))
    return t.join(saves, (F.col("project") == F.col("__p")) & (F.col("__f") == F.col("__q")), "left").select("project", "seq", "version", "n_versions", "payload")


def current_version(log: DataFrame, most: int = 60) -> DataFrame:
    """State after a log of save, undo and redo (``project, seq, op, payload``): a pointer into the saved versions, per project; the last ``most`` are held.

    A save drops the versions beyond the pointer and appends; undo and redo move the pointer within bounds. ``seq`` is unique within a project.
    """
    return _with_payload(_states(log, most, None), log).select("project", "version", "n_versions", "payload")


def snapshots(log: DataFrame, every: int = 1000, most: int = 60) -> DataFrame:
    """``project, n, seq, versions, version``: the state after every ``every``-th operation; ``n`` counts these from 1."""
    n = F.row_number().over(Window.partitionBy("project").orderBy("seq"))
    return _states(log, most, every).withColumn("n", n.cast("long"))


def state_as_of(log: DataFrame, asked: DataFrame, snaps: DataFrame, every: int = 1000, most: int = 60) -> DataFrame:
    """``project, seq, version, n_versions, payload`` of each asked ``project, seq``: the state after that operation (or the last one before it).

    The nearest snapshot before it, and at most ``every`` operations replayed from there: however long the log, an answer reads no more. Projects without
    an operation up to the asked one give version 0.
    """
    ends = Window.partitionBy("project").orderBy("seq")
    spans = snaps.select("project", F.col("seq").alias("low"), F.lead("seq").over(ends).alias("high"), "versions", "version")
    none = F.expr("cast(array() as array<bigint>)")
    firsts = asked.select("project").distinct().join(snaps.groupBy("project").agg(F.min("seq").alias("high")), "project", "left").select("project", F.lit(None).cast("long").alias("low"), "high", none.alias("versions"), F.lit(0).cast("long").alias("version"))
    q = asked.select(F.col("project").alias("__p"), F.col("seq").alias("asked"))
    found = q.join(firsts.unionByName(spans), (F.col("__p") == F.col("project")) & (F.col("low").isNull() | (F.col("low") <= F.col("asked"))) & (F.col("high").isNull() | (F.col("asked") < F.col("high"))))
    ops = log.select(F.col("project").alias("__o"), "seq", "op")
    replayed = found.join(ops, (F.col("__o") == F.col("project")) & (F.col("low").isNull() | (F.col("seq") > F.col("low"))) & (F.col("seq") <= F.col("asked")) & (F.col("high").isNull() | (F.col("seq") < F.col("high"))), "left")
    held = replayed.groupBy("project", "asked").agg(F.first("versions").alias("v"), F.first("version").alias("p"), F.array_sort(F.collect_list(F.when(F.col("op").isNotNull(), F.struct("seq", "op")))).alias("ops"))

    def step(acc, x):
        v = F.concat(F.slice(acc["v"], F.lit(1), acc["p"].cast("int")), F.array(x["seq"]))
        v = F.when(F.size(v) > most, F.slice(v, F.lit(2), F.lit(most))).otherwise(v)
        return (
            F.when(x["op"] == "save", F.struct(v.alias("v"), F.least(F.lit(most).cast("long"), acc["p"] + 1).alias("p")))
            .when(x["op"] == "undo", F.struct(acc["v"].alias("v"), F.greatest(F.lit(0).cast("long"), acc["p"] - 1).alias("p")))
            .otherwise(F.struct(acc["v"].alias("v"), F.least(F.size(acc["v"]).cast("long"), acc["p"] + 1).alias("p")))
        )

    state = held.withColumn("s", F.aggregate("ops", F.struct(F.col("v").alias("v"), F.col("p").alias("p")), step))
    return _with_payload(state.select("project", F.col("asked").alias("seq"), F.col("s.v").alias("versions"), F.col("s.p").alias("version")), log)


def recovered(saves: DataFrame, autosaved: DataFrame) -> DataFrame:
    """``project, at, payload, recovered`` of ``project, at, payload``: the last save, or an autosave that is newer; a tie is the save's."""
    rows = saves.select("project", "at", "payload", F.lit(False).alias("recovered")).unionByName(autosaved.select("project", "at", "payload", F.lit(True).alias("recovered")))
    return rows.groupBy("project").agg(F.max_by(F.struct("at", "payload", "recovered"), F.struct("at", (~F.col("recovered")).alias("s"))).alias("b")).select("project", "b.*")


def autosaves(log: DataFrame, quiet_ms: int = 1500) -> DataFrame:
    """``project, seq`` of the changes (``project, seq, t_ms, forced``) that are saved: forced ones, and those that no other follows within ``quiet_ms``."""
    nxt = F.lead("t_ms").over(Window.partitionBy("project").orderBy("t_ms", "seq"))
    return log.withColumn("__n", nxt).where(F.col("forced") | F.col("__n").isNull() | (F.col("__n") - F.col("t_ms") >= quiet_ms)).select("project", "seq")


def old_drafts(projects: DataFrame, now: int, ttl: int) -> DataFrame:
    """Drafts that were last changed over ``ttl`` ago."""
    return projects.where(F.col("draft") & (F.lit(now) - F.col("updated") > ttl)).select("project")


def evict(files: DataFrame, older_than: int, capacity: int, by: str) -> DataFrame:
    """Files to remove: those last used before ``older_than``; of the others the oldest, until the rest fits the capacity.

    The running total is taken in two levels, over ``by`` groups of modification time first, so no one task sorts all files.
    """
    young = files.where(F.col("mtime") >= older_than)
    totals = young.groupBy(by).agg(F.sum("size").alias("s"))
    later = totals.withColumn("after", F.sum("s").over(Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1))).select(by, F.coalesce("after", F.lit(0)).alias("after"))
    inside = F.sum("size").over(Window.partitionBy(by).orderBy(F.desc("mtime"), F.desc("path_id")))
    kept = young.join(later, by).withColumn("total", F.col("after") + inside)
    return files.where(F.col("mtime") < older_than).select("path_id", F.lit("ttl").alias("why")).unionByName(kept.where(F.col("total") > capacity).select("path_id", F.lit("capacity").alias("why")))
