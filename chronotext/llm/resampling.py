"""Quality classifier by importance resampling (Xie et al., 2023): hashed n-gram models of target and raw text.

Words and word pairs hash into ``BUCKETS``; two smoothed bag-of-n-grams models are estimated, of the target text (documents
labelled good, at most ``max_labelled`` of them by hash of the id, so that their ids can be broadcast) and of all raw text, by
counting every document whole, both in one reading (bounded arrays of partial counts are what is shuffled). A
document's log importance weight is the log ratio of its likelihoods under the two models: the sum over its n-grams. Gumbel
noise, keyed by seed, document and text, is added, and the documents with the largest sums are the sample: Gumbel top-k
draws k without replacement in proportion to the weights. The k-th largest sum comes from a distributed search by
histograms, not from a sort; no text is shuffled.

Defined results: null or empty text has no n-grams, weight 0, and is sampled only after all texts; repeated rows draw the same
noise, and of rows that tie at the threshold so many are kept that k are, whichever; null labels and labels without
a document are ignored, a document with any good label is good; without any target text all weights are 0. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, mix64, word_bytes

BUCKETS = 1 << 15
_LAST = -1e300  # the key that stands for a row without text


def buckets(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Bucket of each word and each pair of neighbouring words."""
    h = hashes(word_bytes(text, lower=True))
    if not len(h):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        pairs = mix64(h[:-1] * np.uint64(0x100000001B3) ^ h[1:], 41)
    return (np.concatenate([mix64(h, 37), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def ngram_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the buckets over the rows of ``text, good`` that are good, and over all; each task sends at most BUCKETS rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total = WordHashes(), np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            for t, good in zip(pdf["text"], pdf["good"], strict=True):
                n = np.bincount(buckets(t, hashes), minlength=BUCKETS)
                total[1] += n
                if good:
                    total[0] += n
        at = np.flatnonzero(total[1])
        yield pd.DataFrame({"bucket": at, "good": total[0][at], "n": total[1][at]})

    rows = texts.select("text", "good").mapInPandas(count, "bucket int, good long, n long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()
    out = np.zeros((2, BUCKETS), np.int64)
    for r in rows:
        out[:, r["bucket"]] = r["good"], r["n"]
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """``row_no, doc_id, n_grams, log_weight, key`` for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            n, w = [], []
            for t in pdf["text"]:
                b = buckets(t, hashes)
                n.append(len(b))
                w.append(float(ratio[b].sum()))
            h = mix64(pdf["doc_id"].fillna(0).astype("int64").to_numpy().view(np.uint64), seed) ^ pdf["text_hash"].to_numpy(np.int64).view(np.uint64)
            u = ((mix64(h, 53) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
            key = np.where(np.array(n) > 0, np.array(w) - np.log(-np.log(u)), -np.inf)
            yield pd.DataFrame({"row_no": pdf["row_no"], "doc_id": pdf["doc_id"], "n_grams": n, "log_weight": w, "key": key}).astype({"doc_id": "Int64"})

    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInPandas(run, "row_no long, doc_id long, n_grams long, log_weight double, key double")


def kth_largest(frame: DataFrame, k: int) -> float:
    """The k-th largest of the doubles in ``x``, 1 <= k <= rows: each step counts 256 bins of what is left of the range."""
    low, high = frame.agg(F.min("x"), F.max("x")).first()
    while low < high:
        width = (high / 256 - low / 256) or (high - low)
        bin_of = F.least(F.floor((F.col("x") - low) / width), F.lit(255))
        bins = frame.where(F.col("x").between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):
            low, high = r["low"], r["high"]
            if r["n"] >= k:
                break
            k -= r["n"]
        else:
            raise ValueError("k exceeds the number of rows")
    return low


def top_k(weighed: DataFrame, k: int) -> DataFrame:
    """Adds ``kept``: whether a row is among the k with the largest keys; exactly k are (or all, if there are fewer)."""
    if k <= 0:
        return weighed.withColumn("kept", F.lit(False))
    if k >= weighed.count():
        return weighed.withColumn("kept", F.lit(True))
    # Row numbers are 31 bits of partition over 33 bits of place, and a double holds either whole.
    kept = F.lit(False)
    rest = F.lit(True)
    for x in (F.greatest("key", F.lit(_LAST)), -F.shiftright("row_no", 33).cast("double"), -F.col("row_no").bitwiseAND((1 << 33) - 1).cast("double")):
        among = weighed.where(rest).select(x.alias("x"))
        at = kth_largest(among, k)
        kept = kept | (rest & (x > at))
        more, ties = among.agg(F.count(F.when(F.col("x") > at, 1)), F.count(F.when(F.col("x") == at, 1))).first()
        rest, k = rest & (x == at), k - more
        if ties == k:
            break
    return weighed.withColumn("kept", kept | rest)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1, max_labelled: int = 20_000) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, kept`` for every row; ``share`` of the rows (by default the labels' share of good ones) are kept."""
    if share is None:
        share = labels.agg(F.avg("quality")).first()[0] or 0.0
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = texts.join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("good"))
    target, raw = ngram_counts(told)
    weighed = cut(weigh(texts, log_ratio(target, raw), seed))
    return top_k(weighed, math.floor(share * weighed.count())).drop("row_no")
