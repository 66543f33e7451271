"""Interval algebra over rows with a key and ``start_ms``/``end_ms`` (integer milliseconds, half-open use noted per function)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    floor = lambda c: F.floor(c / width).cast("long")
    return F.sequence(floor(start), F.greatest(floor(start), floor(end)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_ms: int, how: str = "inner") -> DataFrame:
    """Pairs of rows of equal ``key`` that overlap by more than 0 ms, with ``overlap_ms``.

    Both sides are expanded to the bins that they touch and joined on (key, bin), so no nested loop is planned and a
    long recording spreads over tasks; a pair is emitted in the later of the two first bins alone. Columns of the right
    side get the suffix ``_r``. ``how``: inner, or left_semi / left_anti over the left side.
    """
    r = right.select(F.col(key), *[F.col(c).alias(f"{c}_r") for c in right.columns if c != key])
    lb = left.withColumn("__b", F.explode(_bins(F.col("start_ms"), F.col("end_ms"), bin_ms))).withColumn("__fl", F.floor(F.col("start_ms") / bin_ms))
    rb = r.withColumn("__b", F.explode(_bins(F.col("start_ms_r"), F.col("end_ms_r"), bin_ms))).withColumn("__fr", F.floor(F.col("start_ms_r") / bin_ms))
    common = F.least("end_ms", "end_ms_r") - F.greatest("start_ms", "start_ms_r")
    both = lb.join(rb, [key, "__b"]).where((common > 0) & (F.col("__b") == F.greatest("__fl", "__fr")))
    if how == "inner":
        return both.withColumn("overlap_ms", common.cast("long")).drop("__b", "__fl", "__fr")
    ids = both.select(key, "start_ms", "end_ms").distinct()
    return left.join(ids, [key, "start_ms", "end_ms"], how)


def nearest_join(left: DataFrame, right: DataFrame, key: str, before_ms: int, after_ms: int, bin_ms: int, keep: list[str], order: str) -> DataFrame:
    """Each left row with the right row whose ``t_ms`` in [start - before, end + after] is nearest to its start; ties: smaller ``order``."""
    r = right.select(F.col(key), F.col("t_ms"), F.col(order).alias("__o"), *[F.col(c).alias(f"{c}_r") for c in keep]).withColumn("__b", F.floor(F.col("t_ms") / bin_ms))
    lb = left.withColumn("__b", F.explode(_bins(F.col("start_ms") - before_ms, F.col("end_ms") + after_ms, bin_ms)))
    near = lb.join(r, [key, "__b"]).where((F.col("t_ms") >= F.col("start_ms") - before_ms) & (F.col("t_ms") <= F.col("end_ms") + after_ms))
    best = near.groupBy(*left.columns).agg(F.min_by(F.struct("t_ms", *[f"{c}_r" for c in keep]), F.struct(F.abs(F.col("t_ms") - F.col("start_ms")), "__o")).alias("__n"))
    return best.select(*left.columns, F.col("__n.t_ms").alias("near_ms"), *[F.col(f"__n.{c}_r").alias(f"near_{c}") for c in keep])


def islands(rows: DataFrame, keys: list[str], gap_ms: int, order: Iterable[str] = ("start_ms", "end_ms")) -> DataFrame:
    """Adds ``island``: the running number of the run that a row joins when it starts at most ``gap_ms`` after the furthest end so far."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_ms") - reach > gap_ms), 1).otherwise(0)
    return rows.withColumn("__n", fresh).withColumn("island", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")


def gap_merge(rows: DataFrame, keys: list[str], gap_ms: int, min_ms: int = 0, pad_ms: int = 0, limit: Column | None = None) -> DataFrame:
    """Merged runs ``keys, start_ms, end_ms, n``; runs shorter than ``min_ms`` go, before padding by ``pad_ms`` (never below 0, nor beyond ``limit``)."""
    runs = islands(rows, keys, gap_ms).groupBy(*keys, "island").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.count(F.lit(1)).alias("n"))
    kept = runs.where(F.col("e") - F.col("s") >= min_ms)
    return kept.select(*keys, F.greatest(F.lit(0), F.col("s") - pad_ms).cast("long").alias("start_ms"), (F.col("e") + pad_ms if limit is None else F.least(limit, F.col("e") + pad_ms)).cast("long").alias("end_ms"), "n")


def split_windows(rows: DataFrame, width_ms: int, min_ms: int) -> DataFrame:
    """Each interval in max(1, round half-even(span / width)) equal parts; parts shorter than ``min_ms`` go."""
    span = F.col("end_ms") - F.col("start_ms")
    n = F.greatest(F.lit(1), F.rint(span / width_ms)).cast("long")
    parts = rows.withColumn("__n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = lambda i: (F.col("start_ms") + F.floor(span * i / F.col("__n"))).cast("long")
    cut = parts.select("*", at(F.col("part")).alias("part_start"), at(F.col("part") + 1).alias("part_end")).drop("__n")
    return cut.where(F.col("part_end") - F.col("part_start") >= min_ms)


def plan_chunks(durations: DataFrame, chunk_ms: int, overlap_ms: int) -> DataFrame:
    """Decode windows [chunk_start, chunk_end) with overlap, and the exclusive range [keep_start, keep_end) that each owns."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / chunk_ms)).cast("long")
    c = durations.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    keep_start, keep_end = F.col("chunk") * chunk_ms, F.least((F.col("chunk") + 1) * chunk_ms, F.col("duration_ms"))
    return c.select(
        "*", F.greatest(F.lit(0), keep_start - overlap_ms).cast("long").alias("chunk_start"), F.least(keep_end + overlap_ms, F.col("duration_ms")).cast("long").alias("chunk_end"),
        keep_start.cast("long").alias("keep_start"), keep_end.cast("long").alias("keep_end"),
    )


def runs_of_lines(rows: DataFrame, keys: list[str], order: str, most: int = 3) -> DataFrame:
    """Every run of 1..``most`` consecutive rows with its joined text and time range."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = [F.lead(F.struct("text", "end_ms"), i).over(w) if i else F.struct("text", "end_ms") for i in range(most)]
    held = rows.select(*keys, order, "start_ms", F.array(*ahead).alias("__a"))
    runs = held.select("*", F.explode(F.sequence(F.lit(1), F.size(F.filter("__a", lambda x: x.isNotNull())))).alias("n_lines"))
    part = F.slice("__a", F.lit(1), F.col("n_lines"))
    return runs.select(*keys, order, "n_lines", "start_ms", F.element_at(part, -1)["end_ms"].alias("end_ms"), F.array_join(F.transform(part, lambda x: x["text"]), "").alias("text"))


def keep_inside(rows: DataFrame, kept: DataFrame, key: str, bin_ms: int) -> DataFrame:
    """Rows that overlap a kept interval; a key without kept intervals keeps all its rows."""
    some = kept.select(key).distinct()
    return overlap_join(rows, kept, key, bin_ms, "left_semi").unionByName(rows.join(some, key, "left_anti"))


def kept_seconds(rows: DataFrame, kept: Column) -> DataFrame:
    """``rec_id, kept_s, total_s``: lengths of the kept intervals and of all."""
    span = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")) / 1000
    return rows.groupBy("rec_id").agg(F.round(F.sum(F.when(kept, span).otherwise(0.0)), 3).alias("kept_s"), F.round(F.sum(span), 3).alias("total_s"))


def best_span(rows: DataFrame, spans: DataFrame, key: str, row_id: str, bin_ms: int = 60_000) -> DataFrame:
    """``key, row_id, span_start, span_end``: the span with the largest overlap, else the one whose middle is nearest; of equals the earliest.

    Overlaps are found by time bins. What overlaps nothing looks at the nearest span on either side alone, in two sorted passes over middles.
    """
    s = spans.select(key, "start_ms", "end_ms").distinct()
    plain = rows.select(key, row_id, "start_ms", "end_ms")
    over = overlap_join(plain, s, key, bin_ms).groupBy(key, row_id).agg(F.min(F.struct((-F.col("overlap_ms")).alias("o"), F.col("start_ms_r").alias("span_start"), F.col("end_ms_r").alias("span_end"))).alias("r"))
    over = over.select(key, row_id, "r.span_start", "r.span_end")
    rest = plain.join(over.select(key, row_id), [key, row_id], "left_anti")
    middle = (F.col("start_ms") + F.col("end_ms")).alias("m")
    nothing = F.lit(None).cast(dict(plain.dtypes)[row_id]).alias(row_id)
    both = rest.select(key, row_id, middle, F.lit(None).cast("struct<a: bigint, z: bigint>").alias("s")).unionByName(s.select(key, nothing, middle, F.struct(F.col("start_ms").alias("a"), F.col("end_ms").alias("z")).alias("s")))
    # of spans with one middle the last that a pass comes by is the earliest
    side = lambda *by: F.last("s", ignorenulls=True).over(Window.partitionBy(key).orderBy(*by, F.col("s").isNull(), F.desc("s.a"), F.desc("s.z")).rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("p", side("m")).withColumn("n", side(F.desc("m"))).where(F.col("s").isNull())
    apart = lambda c: F.struct(F.abs(F.col(f"{c}.a") + F.col(f"{c}.z") - F.col("m")).alias("d"), F.col(f"{c}.a").alias("span_start"), F.col(f"{c}.z").alias("span_end"))
    best = F.least(*[F.when(F.col(c).isNotNull(), apart(c)) for c in ("p", "n")])
    found = near.withColumn("r", best).where("r is not null").select(key, row_id, "r.span_start", "r.span_end")
    return over.unionByName(found)
