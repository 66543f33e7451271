"""Correction by a dictionary of any size: a table of words with their wrong forms, as a keyword store holds it.

Forms run as automata over the lines, so that a line meets only the forms that occur in it; whole words run in blocks against the
lines of like length whose characters allow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_alnum
from .matching import CharRows, _histograms, similarity
from .patterns import occurring

BLOCK_WORDS = 20_000


def forms(words: DataFrame) -> DataFrame:
    """``ord, form, word`` of ``place, word, alias``: written forms in N2 in the order of places, a word before its aliases; of equal forms the last word counts, in the first one's place."""
    each = words.select("place", F.trim("word").alias("word"), F.posexplode(F.concat(F.array("word"), F.coalesce("alias", F.array().cast("array<string>")))).alias("i", "t"))
    f = each.select(F.struct("place", "i").alias("at"), "word", normal_alnum(F.col("t")).alias("form")).where("form <> ''")
    one = f.groupBy("form").agg(F.min("at").alias("at"), F.max_by("word", "at").alias("word"))
    return one.select((F.col("at.place").cast("long") * 1_000_000 + F.col("at.i")).alias("ord"), "form", "word")


def closest_words(lines: DataFrame, keys: list[str], words: DataFrame, least: float, band: int = 4) -> DataFrame:
    """``keys, word``: for each line (``keys, n2``) the word (``word, n2``) most like it, of ``least`` or more and a length within ``band``; ties go to the first word."""
    spark = lines.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "word string, score double"])
    blocks = max(1, -(-words.count() // BLOCK_WORDS))
    found = None
    for b in range(blocks):
        mine = sorted({(r.n2, r.word) for r in words.where(F.pmod(F.xxhash64("n2", "word"), F.lit(blocks)) == b).toLocalIterator()}, key=lambda x: x[1].encode("utf-8", "surrogatepass"))
        shared = spark.sparkContext.broadcast(mine)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            rows, ready = shared.value, {}
            held, size = _histograms([r[0] for r in rows]), np.array([len(r[0]) for r in rows], np.int64)
            for pdf in batches:
                at, out = [], []
                for i, (t, h) in enumerate(zip(pdf["n2"].tolist(), _histograms(pdf["n2"].tolist()), strict=True)):
                    near = np.flatnonzero(np.abs(size - len(t)) <= band)
                    common = np.minimum(held[near], h).sum(1)
                    may = (common >= (least - 1e-4) * np.minimum(len(t), (size[near] + len(t)) / 2)) | (common == np.minimum(size[near], len(t)))
                    best = (0.0, 0)
                    for k in near[may].tolist():
                        if k not in ready:
                            ready[k] = CharRows(rows[k][0])
                        best = max(best, (similarity(t, rows[k][0], max(least, best[0]), ready[k]), -k))
                    if best[0] >= least:
                        at.append(i)
                        out.append((rows[-best[1]][1], best[0]))
                got = pdf[keys].iloc[at].reset_index(drop=True)
                got["word"] = pd.Series([x[0] for x in out], dtype=object)
                got["score"] = pd.Series([x[1] for x in out], dtype="float64")
                yield got

        part = lines.select(*keys, "n2").where("n2 <> ''").mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "word")
        found = found.withColumn("r", F.row_number().over(w)).where("r = 1")
    return found.select(*keys, "word")


def correct_by_dictionary(lines: DataFrame, words: DataFrame, keys: tuple[str, ...] = ("rec_id", "line_idx"), least: float = 0.72) -> DataFrame:
    """``lines`` with ``fixed`` and ``changed``, from ``place, word, alias``; the rules are those of ``matching.correct_by_keywords``.

    A known wrong form in a line becomes its word (the last that applies counts); else a line that is like a whole word becomes it. Null texts stay.
    """
    keys = list(keys)
    known = forms(words)
    wrong = known.where(F.col("form") != normal_alnum(F.col("word")))
    hits = occurring(lines, keys, "text", wrong, "ord", "form").distinct()
    mine = hits.join(wrong, "ord").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "form", "word"))).alias("__f"))
    text, n2 = F.col("text"), normal_alnum(F.coalesce("text", F.lit("")))

    def step(acc: Column, k: Column) -> Column:
        hit = acc["n2"].contains(k["form"]) & ~text.contains(k["word"])
        new = F.replace(text, k["form"], k["word"])
        return F.struct(F.when(hit, new).otherwise(acc["fixed"]).alias("fixed"), F.when(hit, normal_alnum(new)).otherwise(acc["n2"]).alias("n2"))

    long = F.length(n2) >= 2
    t = lines.join(mine, keys, "left")
    formed = F.aggregate("__f", F.struct(text.alias("fixed"), n2.alias("n2")), step, lambda acc: acc["fixed"])
    t = t.withColumn("__one", F.when(long, F.coalesce(formed, text)).otherwise(text)).drop("__f")
    rest = t.where(long & (F.col("__one") == text)).select(*keys, n2.alias("n2"))
    whole = closest_words(rest, keys, words.select(F.trim("word").alias("word")).distinct().select("word", normal_alnum(F.col("word")).alias("n2")).where("n2 <> ''"), least)
    t = t.join(whole.withColumnRenamed("word", "__w"), keys, "left")
    return t.withColumn("fixed", F.coalesce("__w", "__one")).drop("__one", "__w").withColumn("changed", F.col("fixed") != text).select(*lines.columns, "fixed", "changed")
