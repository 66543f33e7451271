"""Which song a sung stretch is: by request, by transcript, and of several versions by what is sung in one piece; and where in it the stretch begins.

The library is a stated set of documents: blocks of it (``BLOCK_DOCS`` texts, ``BLOCK_CHARS`` characters) are broadcast, every transcript runs against
each, and keeps its best few of each block. Bounds from character counts and from common runs of four come first, so that only pairs that can win are compared letter by letter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import coverage
from ..functions.text import normal_alnum
from ..sources.folders import written
from .matched import Parts
from .matching import CharRows, _histograms, common_lengths, matched_chars, matched_table, similarities
from .patterns import occurring

BLOCK_DOCS, BLOCK_CHARS = 5_000, 8_000_000
CHUNK_CHARS, TEXT_CHARS = 1 << 16, 1 << 12  # documents and transcripts of so many characters are matched at a time


def coverage_bound(body: str, grams: set[str]) -> float:
    """At least the coverage of ``body`` by a text with these runs of four: what they cover in all, and in the longest piece."""
    covered = longest = run = 0
    last = -1  # the last covered place
    for i in range(len(body) - 3):
        if body[i : i + 4] in grams:
            run = run + 1 if run else 4
            covered += i + 3 - max(last, i - 1)
            last = i + 3
            longest = max(longest, run)
        else:
            run = 0
    return (longest + covered) / (2 * len(body)) if body else 0.0


def best_version(body: str, versions: list[str], grams: list[set[str]] | None = None) -> int | None:
    """The first of the versions with the largest contiguous coverage; versions that cannot beat the best so far are not compared."""
    best, at = -1.0, None
    for i, text in enumerate(versions):
        if at is not None:
            own = grams[i] if grams else {text[k : k + 4] for k in range(len(text) - 3)}
            if coverage_bound(body, own) + 1e-4 < best:
                continue
        if (score := coverage(body, text)) > best:
            best, at = score, i
    return at


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _library(docs: DataFrame) -> tuple[DataFrame, int]:
    b = docs.select(F.col("doc").cast("long").alias("doc"), "title", normal_alnum(F.col("text")).alias("body")).where("body <> ''")
    size = b.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars")).first()
    return b, max(1, -(-size.n // BLOCK_DOCS), -(-size.chars // BLOCK_CHARS))


def _runs_of(size: np.ndarray, most: int) -> list[np.ndarray]:
    """Neighbouring places whose sizes add up to about ``most`` or less; a larger one by itself."""
    return np.split(np.arange(len(size)), np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1) if len(size) else []


def ranked(transcripts: DataFrame, keys: list[str], docs: DataFrame, top: int, least: float = 0.0) -> DataFrame:
    """``keys, rank, doc, score``: the ``top`` documents (``doc, title, text``) of each transcript (``keys, text``) by score, title and doc, of ``least`` or more.

    Some transcripts at a time are matched with some documents; those whose characters, or whose runs found so far, cannot reach the last of the best few are left.
    """
    spark = transcripts.sparkSession
    q = transcripts.select(*keys, normal_alnum(F.col("text")).alias("q")).where("q <> ''").repartition(_tasks(docs), *keys)
    library, blocks = _library(docs)
    kinds = {f.name: f.dataType.simpleString() for f in q.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "doc long, title string, score double"])
    found = None
    for b in range(blocks):
        mine = [(r.doc, r.title or "", r.body) for r in library.where(F.pmod(F.xxhash64("doc"), F.lit(blocks)) == b).toLocalIterator()]
        shared = spark.sparkContext.broadcast(sorted(mine, key=lambda x: (x[1].encode("utf-8", "surrogatepass"), x[0])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            rows = shared.value
            bodies = [r[2] for r in rows]
            held, size = _histograms(bodies), np.array([len(x) for x in bodies], np.int64)
            chunks = [(at, [bodies[k] for k in at]) for at in _runs_of(size, CHUNK_CHARS)]
            parts = [Parts.of(texts) for _, texts in chunks]
            ready = [CharRows(x) for x in bodies] if least else []
            for pdf in batches:
                queries, at, out = pdf["q"].tolist(), [], []
                for some in _runs_of(np.array([len(x) for x in queries], np.int64), TEXT_CHARS):
                    texts = [queries[i] for i in some]
                    best: list[list[tuple[float, int]]] = [[] for _ in texts]
                    n, have = np.array([len(x) for x in texts])[:, None], _histograms(texts)
                    for (docs, own), p in zip(chunks, parts, strict=True):
                        floor = np.array([max(x[-1][0] if len(x) == top else least, least) for x in best])
                        base = np.minimum(n, (size[docs] + n) / 2)
                        common = np.stack([np.minimum(held[docs], h).sum(1) for h in have])
                        inside = common == np.minimum(size[docs], n)
                        for i, k in zip(*np.nonzero(inside), strict=True):
                            inside[i, k] = own[k] in texts[i] or texts[i] in own[k]
                        live = inside | (common / base + 1e-4 >= floor[:, None])
                        for i, x in enumerate(live & ~inside if least else ()):  # common subsequences leave few that reach a stated score
                            k = np.flatnonzero(x)
                            live[i, k] = common_lengths(texts[i], [ready[d] for d in docs[k].tolist()]) / base[i, k] + 1e-4 >= floor[i]
                        if not live.any():
                            continue
                        share = matched_table(texts, own, p, live & ~inside, top, base, floor) / base
                        share = np.where(inside, 1.0, np.where(live, share, -1.0))
                        last = np.partition(share, -top, axis=1)[:, -top] if len(own) > top else np.zeros(len(texts))
                        for i, low in enumerate(np.maximum(last, floor) - 2e-4):
                            new = [(round(share[i, k].item(), 4), int(docs[k])) for k in np.flatnonzero(live[i] & (share[i] >= low))]
                            best[i] = sorted([*best[i], *[x for x in new if x[0] >= least]], key=lambda x: (-x[0], x[1]))[:top]
                    for i, x in zip(some, best, strict=True):
                        at += [i] * len(x)
                        out += [(rows[k][0], rows[k][1], s) for s, k in x]
                got = pdf[keys].iloc[at].reset_index(drop=True)
                for j, (c, kind) in enumerate((("doc", "int64"), ("title", object), ("score", "float64"))):
                    got[c] = pd.Series([x[j] for x in out], dtype=kind)
                yield got

        part = q.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "title", "doc")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select(*keys, "rank", "doc", "score")


def titled_by(requests: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, doc``: the documents whose title contains a block's requested ``name``, or lies in it, in N2 form."""
    named = requests.select(*keys, normal_alnum(F.col("name")).alias("n")).where("n <> ''")
    names = named.select("n").distinct().select("n", F.xxhash64("n").alias("nid"))
    titles = docs.select(F.col("doc").cast("long").alias("doc"), normal_alnum(F.col("title")).alias("t")).where("t <> ''")
    inside = occurring(names, ["nid"], "n", titles, "doc", "t")
    around = occurring(titles, ["doc"], "t", names, "nid", "n").select("nid", "doc")
    pairs = inside.unionByName(around).distinct()
    return named.withColumn("nid", F.xxhash64("n")).join(pairs, "nid").select(*keys, "doc").distinct()


def _reranked(candidates: DataFrame, blocks: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, doc, score``: of each block's candidates (``keys, rank, doc, score``) the one that its transcript covers in the largest pieces."""
    bodies = docs.select(F.col("doc").cast("long").alias("doc"), normal_alnum(F.col("text")).alias("body"))
    few = candidates.join(bodies, "doc").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "score", "body"))).alias("c"))

    @F.pandas_udf("int")
    def choose(body: pd.Series, versions: pd.Series) -> pd.Series:
        return pd.Series([best_version(b, list(v)) for b, v in zip(body, versions, strict=True)], dtype="Int32")

    # Dealt out to all tasks: small joined rows would be put together in few of them.
    t = few.join(blocks.select(*keys, normal_alnum(F.col("text")).alias("q")), keys).repartition(_tasks(docs), *keys)
    t = t.withColumn("i", choose("q", F.transform("c", lambda x: x["body"])))
    return t.select(*keys, F.get("c", F.col("i"))["doc"].alias("doc"), F.get("c", F.col("i"))["score"].alias("score"))


def retrieve(blocks: DataFrame, requests: DataFrame, docs: DataFrame, accept: float = 0.55, least: float = 0.35, versions: tuple[int, int] = (6, 8)) -> DataFrame:
    """``rec_id, block, doc, tier, score`` for each sung block (``rec_id, block, text``); nulls where nothing is found.

    Tier 0: a document titled as requested (``rec_id, block, name``) with a score of ``accept``. Tier 1: of the first few titled so with ``least``, the
    version that the transcript covers best. Tier 2: the same of the whole library's with ``accept``. The first tier with an answer counts.
    """
    keys = ["rec_id", "block"]
    named = titled_by(requests, docs, keys)
    bodies = docs.select(F.col("doc").cast("long").alias("doc"), "title", normal_alnum(F.col("text")).alias("body")).where("body <> ''")
    pairs = named.join(bodies, "doc").join(blocks.select(*keys, normal_alnum(F.col("text")).alias("q")), keys).where("q <> ''").repartition(_tasks(docs), *keys)

    @F.pandas_udf("double")
    def alike(q: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series(similarities(q.tolist(), body.tolist(), least))

    # Not deterministic, so that the filter on the score stays where it is: else pairs are compared twice, and before they are dealt out.
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "title", "doc")
    asked = pairs.withColumn("score", alike.asNondeterministic()("q", "body")).where(F.col("score") >= least).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= versions[0]).select(*keys, "rank", "doc", "score")
    asked = written(asked, "asked")  # what is compared once is read by two tiers, and their answer by what follows
    one = asked.where((F.col("rank") == 1) & (F.col("score") >= accept)).select(*keys, "doc", "score", F.lit(0).alias("tier"))
    two = _reranked(asked.join(one.select(*keys), keys, "left_anti"), blocks, docs, keys).withColumn("tier", F.lit(1))
    settled = written(one.unionByName(two), "settled")
    rest = blocks.join(settled.select(*keys), keys, "left_anti")
    three = _reranked(ranked(rest, keys, docs, versions[1], accept), rest, docs, keys).withColumn("tier", F.lit(2))
    found = settled.unionByName(three)
    return blocks.select(*keys).join(found, keys, "left").select(*keys, "doc", "tier", "score")


# ---- where a stretch begins ----


def sung_offset(rows: list[str], body: str) -> int:
    """The lyric row from which ``body`` is best covered; all in N2 form.

    From each row on, rows are joined until they are 1.15 times as long as the body, or 20 longer; the share of the body that matches decides, within 1e-4 the
    shorter stretch. Two pointers move the stretch and its character counts along, and stretches whose counts fall short of the best so far are not compared.
    """
    n = len(body)
    if not n or not rows:
        return 0
    best, best_i, best_len = -1.0, 0, 10**9
    want, have, common, end, size = Counter(body), Counter(), 0, 0, 0
    for i, first in enumerate(rows):
        end = max(end, i)
        while end < len(rows) and (end == i or not (size >= n * 1.15 or size >= n + 20)):
            for c in rows[end]:
                have[c] += 1
                common += have[c] <= want[c]
            size += len(rows[end])
            end += 1
        if size and common / n >= best - 1e-4:
            text = "".join(rows[i:end])
            score = matched_chars(body, text) / n
            if score > best + 1e-4 or (abs(score - best) <= 1e-4 and size < best_len):
                best, best_i, best_len = score, i, size
        for c in first:
            common -= have[c] <= want[c]
            have[c] -= 1
        size -= len(first)
    return best_i


def rows_by_budget(rows: list[str], start: int, n: int) -> tuple[int, int]:
    """(first, one after the last) row from ``start`` on until they are 1.15 times ``n`` characters; eight rows where there is no budget."""
    if n <= 0:
        return start, min(len(rows), start + 8)
    start = max(0, min(start, len(rows) - 1))
    end, total = start, 0
    while end < len(rows):
        total += len(rows[end])
        end += 1
        if total >= n * 1.15:
            break
    return start, end


def sung_windows(blocks: DataFrame, lyrics: DataFrame) -> DataFrame:
    """``rec_id, block, doc, first_row, last_row``: where each block (``rec_id, block, doc, text``) begins in its document's rows (``doc, lyric_idx, text``), and how far its characters reach.

    A document's rows travel once for each block of it; blocks of documents without rows give nothing.
    """
    rows = lyrics.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("lyric_idx", normal_alnum(F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]).alias("rows"))

    @F.pandas_udf("first_row long, last_row long")
    def place(body: pd.Series, own: pd.Series) -> pd.DataFrame:
        out = []
        for b, r in zip(body, own, strict=True):
            r = list(r)
            first, end = rows_by_budget(r, sung_offset(r, b), len(b))
            out.append((first, end - 1))
        return pd.DataFrame(out, columns=["first_row", "last_row"])

    t = blocks.join(rows, "doc").withColumn("p", place(normal_alnum(F.coalesce("text", F.lit(""))), "rows"))
    return t.select("rec_id", "block", "doc", "p.first_row", "p.last_row")
