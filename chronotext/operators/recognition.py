"""What follows speech and song recognition: filters of segments and windows, search results, and times of lyric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_segment(compression_ratio: Column, no_speech_prob: Column, avg_logprob: Column, n_words: Column, most_ratio: float = 2.4, most_silent: float = 0.90, least_logprob: float = -1.2) -> Column:
    """Not too repetitive, not silent, not unlikely (0 stands for unknown), and with words."""
    return (compression_ratio <= most_ratio) & (no_speech_prob <= most_silent) & ((avg_logprob == 0) | (avg_logprob >= least_logprob)) & (n_words > 0)


def voice_filter(windows: DataFrame, policy: str, threshold: float) -> DataFrame:
    """``windows`` (with ``speak, sing, keep``) by policy: ``mark`` and ``off`` keep all, ``filter`` drops what was decided against or has a weak voice; ``flagged`` is what goes for review."""
    weak = F.greatest("speak", F.coalesce("sing", F.lit(0.0))) < 0.72 * threshold
    kept = F.col("keep") & ~weak if policy == "filter" else F.lit(True)
    return windows.withColumn("flagged", ~F.col("keep") & F.lit(policy != "off")).withColumn("keep", kept)


def search_order(results: DataFrame, by: str, tie: str, least: float) -> DataFrame:
    """Results of ``score`` of at least ``least`` with their ``rank``: by score, synced first, then by source."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("synced"), "source", tie)
    return results.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w).cast("long"))


def longest_hit_run(rows: DataFrame, keys: list[str], order: str, hit: str, least: float = 0.6) -> DataFrame:
    """``keys, first_row, last_row, n_rows``: the longest run of rows with a ratio of ``least``, one miss between two allowed; the first of equals."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = rows.where(F.col(hit) >= least).withColumn("__gap", F.col(order) - F.lag(order).over(w))
    runs = on.withColumn("__g", F.sum(F.when(F.col("__gap") <= 2, 0).otherwise(1)).over(w)).groupBy(*keys, "__g").agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count(F.lit(1)).alias("n"))
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("a", "z", "n"), F.struct("n", -F.col("a"))).alias("b"))
    return best.select(*keys, F.col("b.a").alias("first_row"), F.col("b.z").alias("last_row"), F.col("b.n").alias("n_rows"))


def budget_window(rows: DataFrame, keys: list[str], order: str, size: Column, budget: Column, share: float = 1.15) -> DataFrame:
    """The first rows until their sizes add up to ``share`` of the budget; the row that gets there is the last."""
    t = rows.withColumn("__n", size)
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(order)) - F.col("__n")
    return t.withColumn("__b", before).where(F.col("__b") < budget * share).drop("__n", "__b")


def align_rows(rows: DataFrame, keys: list[str], block_start: Column, block_end: Column, tail_ms: int = 4000, over_ms: int = 1000, least_ms: int = 400) -> DataFrame:
    """``keys, line_idx, start_ms, end_ms, text``: stamped rows (``t_ms``) moved so that the first one starts the block.

    A row lasts to the next one (the last ``tail_ms``), ``least_ms`` at least, and ends ``over_ms`` after the block at most; rows that would start later go.
    """
    w = Window.partitionBy(*keys).orderBy("t_ms", "line_idx")
    base = F.first("t_ms").over(w)
    s = block_start + F.col("t_ms") - base
    nxt = block_start + F.lead("t_ms").over(w) - base
    t = rows.withColumn("__s", s).withColumn("__e", F.coalesce(nxt, s + tail_ms)).where(F.col("__s") <= block_end + over_ms)
    end = F.least(F.greatest("__e", F.col("__s") + least_ms), block_end + over_ms)
    return t.select(*keys, "line_idx", F.col("__s").cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), "text")


def lines_from_characters(chars: DataFrame, lines: DataFrame) -> DataFrame:
    """``rec_id, line_idx, start_ms, end_ms, n_words``: characters with times (``rec_id, pos``) dealt to lines (``rec_id, line_idx, n``) in order; lines that get none go."""
    w = Window.partitionBy("rec_id").orderBy("line_idx")
    t = lines.where("n > 0").withColumn("z", F.sum("n").over(w)).withColumn("a", F.col("z") - F.col("n"))
    each = t.select("rec_id", "line_idx", F.explode(F.sequence("a", F.col("z") - 1)).alias("pos")).join(chars, ["rec_id", "pos"])
    return each.groupBy("rec_id", "line_idx").agg(F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.count(F.lit(1)).alias("n_words"))


def probes(blocks: DataFrame, every_ms: int) -> DataFrame:
    """``blocks`` with ``probe, probe_ms``: the middles of equal parts, one for each ``every_ms`` of the block and one at least."""
    span = F.col("end_ms") - F.col("start_ms")
    k = F.greatest(F.lit(1), F.floor(span / every_ms))
    t = blocks.withColumn("__k", k).withColumn("probe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    return t.withColumn("probe_ms", (F.col("start_ms") + F.floor(span * (2 * F.col("probe") + 1) / (2 * F.col("__k")))).cast("long")).drop("__k")


def resolve_songs(blocks: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """``blocks`` (``rec_id, block``) with ``doc, tier``: the first of the tiers (``rec_id, block, doc, score`` each, the cheapest first) that has a candidate; of its candidates the best score, then the smallest doc."""
    rows = None
    for i, t in enumerate(tiers):
        one = t.select("rec_id", "block", F.lit(i).alias("tier"), "doc", "score")
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("rec_id", "block").agg(F.min_by(F.struct("doc", "tier"), F.struct("tier", -F.col("score"), "doc")).alias("b"))
    return blocks.join(best, ["rec_id", "block"], "left").select(*blocks.columns, "b.doc", "b.tier")
