"""Many patterns in many texts: an automaton for a block of patterns, built once in each worker, through which every text passes once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns and characters of one automaton at most: so much is broadcast. Beyond it the texts pass once for each block of patterns.
BLOCK_PATTERNS, BLOCK_CHARS = 200_000, 4_000_000
_built: dict[str, object] = {}


def _automaton(name: str, patterns: list[tuple[str, list[int]]]):
    """The last one stays for the worker's next tasks."""
    if name not in _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for text, ids in patterns:
            a.add_word(text, ids)
        a.make_automaton()
        _built.clear()
        _built[name] = a
    return _built[name]


def occurring(texts: DataFrame, keys: list[str], text: str, patterns: DataFrame, pattern_id: str, pattern: str) -> DataFrame:
    """``keys, pattern_id``: for each text the patterns that occur in it, once each. Null and empty patterns occur nowhere; null texts hold none.

    Equal patterns are one word of the automaton with several ids. A pattern id is a whole number.
    """
    spark = texts.sparkSession
    known = patterns.select(F.col(pattern_id).cast("long").alias("id"), F.col(pattern).alias("t")).where("t <> ''")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // BLOCK_PATTERNS), -(-size.chars // BLOCK_CHARS))
    rows = texts.select(*keys, F.col(text).alias("__text")).where("__text <> ''")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{pattern_id} long"])
    found = None
    for b in range(blocks):
        held: dict[str, list[int]] = {}
        for r in known.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).toLocalIterator():
            held.setdefault(r.t, []).append(r.id)
        shared = spark.sparkContext.broadcast(list(held.items()))
        name = f"{spark.sparkContext.applicationId}/{shared._jbroadcast.id()}" if hasattr(shared, "_jbroadcast") else str(id(shared))

        def run(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            if not shared.value:
                return
            hits = _automaton(name, shared.value).iter
            for pdf in batches:
                at, ids = [], []
                for i, t in enumerate(pdf["__text"].tolist()):
                    mine = {p for _, own in hits(t) for p in own}
                    at += [i] * len(mine)
                    ids += mine
                out = pdf[keys].iloc[at].reset_index(drop=True)
                out[pattern_id] = pd.array(ids, "int64")
                yield out

        part = rows.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    return found
