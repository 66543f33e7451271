"""Pairing of reference and candidate lines, and the accuracy report of recordings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lcs_udf, whole_cer
from .intervals import islands, overlap_join
from .matching import ratio_udf

PAIRS = "rec_id long, i long, j long, overlap_ms long"


def _first_free(by: list[str]):
    """Sweep over rows sorted by ``by`` and rank: within each ``by``, a row is a pair when both its lines are still free."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken = None, set()
        for pdf in batches:
            keep = []
            for key, i, j in zip(pdf[by].itertuples(index=False, name=None), pdf["i"].tolist(), pdf["j"].tolist(), strict=True):
                if key != at:
                    at, taken = key, set()
                free = ("i", i) not in taken and ("j", j) not in taken
                keep.append(free)
                if free:
                    taken |= {("i", i), ("j", j)}
            yield pdf.loc[np.array(keep, bool), ["rec_id", "i", "j", "overlap_ms"]]

    return run


def greedy_pairs(ref: DataFrame, hyp: DataFrame, bin_ms: int = 10_000) -> DataFrame:
    """``rec_id, i, j, overlap_ms``: one-to-one pairs, the largest overlap first (ties by i, j).

    Pairs that are the best of both their lines are taken by rank alone; what is contested lies in islands (runs of lines of either
    side without a gap), which are swept in one sorted pass, many islands to a task.
    """
    lines = ref.select("rec_id", "start_ms", "end_ms", F.lit(0).alias("side"), F.col("line_idx").alias("n")).unionByName(hyp.select("rec_id", "start_ms", "end_ms", F.lit(1).alias("side"), F.col("line_idx").alias("n")))
    where = islands(lines, ["rec_id"], 0).where("side = 0").select("rec_id", F.col("n").alias("i"), "island")
    cand = overlap_join(ref.select("rec_id", "line_idx", "start_ms", "end_ms"), hyp.select("rec_id", "line_idx", "start_ms", "end_ms"), "rec_id", bin_ms)
    cand = cand.select("rec_id", F.col("line_idx").alias("i"), F.col("line_idx_r").alias("j"), "overlap_ms")
    rank = [F.desc("overlap_ms"), "i", "j"]
    top = lambda side: F.row_number().over(Window.partitionBy("rec_id", side).orderBy(*rank)) == 1
    marked = cand.withColumn("sure", top("i") & top("j"))
    taken = lambda side: F.max("sure").over(Window.partitionBy("rec_id", side))
    left = marked.withColumn("ti", taken("i")).withColumn("tj", taken("j")).where("sure or not (ti or tj)")
    contested = left.where("not sure").join(where, ["rec_id", "i"]).repartition("rec_id", "island").sortWithinPartitions("rec_id", "island", *rank)
    return left.where("sure").select("rec_id", "i", "j", "overlap_ms").unionByName(contested.mapInPandas(_first_free(["rec_id", "island"]), PAIRS))


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def similarity_fallback(ref: DataFrame, hyp: DataFrame, pairs: DataFrame, norm, least: float = 0.6) -> DataFrame:
    """Pairs for lines that overlap left over: each left reference line in order takes the unused candidate most alike (ratio of at least ``least``; ties: the first).

    Candidates have lengths that allow the ratio; the ratios of all are taken side by side, then one sorted pass deals them out.
    """
    rest = lambda lines, used, n, t: lines.join(pairs.select("rec_id", F.col(used).alias("line_idx")), ["rec_id", "line_idx"], "left_anti").select("rec_id", F.col("line_idx").alias(n), norm(F.col("text")).alias(t))
    both = rest(ref, "i", "i", "a").join(rest(hyp, "j", "j", "b"), "rec_id").where(2 * F.least(F.length("a"), F.length("b")) >= least * (F.length("a") + F.length("b")))
    # Dealt out to all tasks, and not deterministic, so that the filter on the ratio stays where it is: else ratios are taken twice, in few tasks.
    both = both.repartition(_tasks(ref), "rec_id", "i", "j")
    scored = both.withColumn("ratio", F.pandas_udf(ratio_udf.func, "double").asNondeterministic()("a", "b")).where(F.col("ratio") >= least).withColumn("overlap_ms", F.lit(0).cast("long"))
    ranked = scored.repartition("rec_id").sortWithinPartitions("rec_id", "i", F.desc("ratio"), "j")
    return ranked.select("rec_id", "i", "j", "overlap_ms").mapInPandas(_first_free(["rec_id"]), PAIRS)


def accuracy(ref: DataFrame, hyp: DataFrame, norm, tol_ms: int = 300) -> DataFrame:
    """The whole report per recording: pairs with the fallback, rates, errors, error rate and recall of the joined texts."""
    by_time = greedy_pairs(ref, hyp)
    pairs = by_time.unionByName(similarity_fallback(ref, hyp, by_time, norm))
    out = report(paired_lines(ref, hyp, pairs, norm, tol_ms), hyp)
    joined = lambda t, name: t.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", norm(F.col("text")).alias("t")))), lambda x: x["t"]), "").alias(name))
    texts = joined(ref, "rt").join(joined(hyp, "ht"), "rec_id", "left").withColumn("ht", F.coalesce("ht", F.lit("")))
    texts = texts.repartition(_tasks(ref), "rec_id")  # whole texts are not put together in few tasks, and not in batches of thousands
    recall = F.when(F.length("rt") > 0, lcs_udf("rt", "ht") / F.length("rt")).otherwise(F.lit(0.0))
    return out.join(texts.select("rec_id", F.round(whole_cer(F.col("ht"), F.col("rt")), 6).alias("cer"), F.round(recall, 6).alias("char_recall")), "rec_id")


def paired_lines(ref: DataFrame, hyp: DataFrame, pairs: DataFrame, norm, tol_ms: int = 300) -> DataFrame:
    """One row per reference line with its candidate, or nulls."""
    r = ref.select("rec_id", F.col("line_idx").alias("i"), F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"), norm(F.col("text")).alias("rt"))
    h = hyp.select("rec_id", F.col("line_idx").alias("j"), F.col("start_ms").alias("hs"), F.col("end_ms").alias("he"), norm(F.col("text")).alias("ht"))
    p = r.join(pairs.select("rec_id", "i", "j"), ["rec_id", "i"], "left").join(h, ["rec_id", "j"], "left")
    start, end = F.abs(F.col("rs") - F.col("hs")), F.abs(F.col("re") - F.col("he"))
    return p.select(
        "rec_id", "i", "j", start.alias("start_err_ms"), end.alias("end_err_ms"), F.levenshtein("rt", "ht").cast("long").alias("edits"), F.length("rt").cast("long").alias("ref_len"),
        F.coalesce(F.col("rt") == F.col("ht"), F.lit(False)).alias("exact_text"), F.coalesce((start <= tol_ms) & (end <= tol_ms), F.lit(False)).alias("exact_time"),
    )


def rank_floor(values: Column, share: float) -> Column:
    """The sorted list's element at int(share * (n - 1))."""
    s = F.sort_array(values)
    return F.when(F.size(s) > 0, F.element_at(s, F.floor(share * (F.size(s) - 1)).cast("int") + 1))


def report(lines: DataFrame, hyp: DataFrame) -> DataFrame:
    """Per recording: counts, rates over max(1, lines), mean and P90 (by rank) start error."""
    n_hyp = hyp.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_hyp"))
    hit = F.col("j").isNotNull()
    a = lines.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("n_ref"), F.sum(hit.cast("long")).alias("n_pairs"), F.sum(F.col("exact_text").cast("long")).alias("n_exact_text"), F.sum(F.col("exact_time").cast("long")).alias("n_exact_time"),
        F.sum("start_err_ms").alias("start_err_sum"), F.sum("end_err_ms").alias("end_err_sum"), rank_floor(F.collect_list("start_err_ms"), 0.9).alias("start_p90_ms"),
    )
    rate = lambda c: F.round(F.col(c) / F.greatest(F.lit(1), F.col("n_ref")), 6)
    mean = lambda c: F.round(F.col(c) / F.greatest(F.lit(1), F.col("n_pairs")), 6)
    return a.join(n_hyp, "rec_id", "left").select(
        "rec_id", "n_ref", F.coalesce("n_hyp", F.lit(0)).alias("n_hyp"), "n_pairs", (F.col("n_ref") - F.col("n_pairs")).alias("n_missing"), (F.coalesce("n_hyp", F.lit(0)) - F.col("n_pairs")).alias("n_extra"),
        rate("n_exact_text").alias("exact_text_rate"), rate("n_exact_time").alias("exact_time_rate"), mean("start_err_sum").alias("start_err_mean"), mean("end_err_sum").alias("end_err_mean"), "start_p90_ms",
    )
