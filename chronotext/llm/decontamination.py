"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage by block-max WAND.

Items are cut into pieces of at most ``PIECE`` words and indexed in blocks of ``INDEX_BLOCK`` pieces; statistics (piece
frequency of terms, average length) always cover all of them. Each document is read whole as overlapping passages, each at
least twice as long as a piece, and each passage is a query: a disjunction of its distinct terms, each scored for the piece by
BM25. A piece is retrieved when it reaches ``min_score`` of the score that it would give its own text. The
blocks' maxima, added up for all passages of a document at once, tell which blocks can reach the threshold; only those are
opened, and within one the terms' bounds, from the largest down, decide which pieces are still worth scoring. So pieces
that cannot reach the threshold are skipped, as in block-max WAND, and none that can is lost. Retrieved pieces are
verified: shared word shingles must cover the piece's question (its first three quarters) and its answer (the rest), or
most of it.

The documents are never shuffled. An index block is broadcast (its size is bounded by ``INDEX_BLOCK``); more items are
indexed in more blocks, and all documents run against each.

Defined results: null or empty text leaks nothing; null or empty items are not indexed; repeated rows are judged one by
one; of a document's passages that leak one item, the best score is returned. Ties change nothing, as every piece above
the threshold is returned. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, frugal

PIECE, PASSAGE, STRIDE = 64, 128, 64
INDEX_BLOCK, POSTING_BLOCK, STEP = 5_000, 4, 2_000
K1, B_LEN, SHINGLE = 1.2, 0.75, 3
OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, start int"


@dataclass
class Index:
    """Postings in blocks of POSTING_BLOCK pieces; impacts are already divided by the piece's threshold.

    ``first[t] : first[t + 1]`` are a term's entries in ``block`` (ascending) and ``most`` (the block's largest impact);
    ``postings[b][t]`` lists the (piece, impact) pairs of a term within a block.
    """

    terms: dict[str, int]
    top: np.ndarray
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray
    postings: list[dict[int, list[tuple[int, float]]]]
    item: list[int]
    question: list[frozenset]
    answer: list[frozenset]

    def open_blocks(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs where the block's maxima over the passage's distinct terms add up to 1 or more."""
        blocks = len(self.postings)
        found = []
        for low in range(0, n, STEP):  # so that the sums of a very long text stay bounded
            i, j = passage.searchsorted([low, low + STEP])
            t = term[i:j]
            counts = self.first[t + 1] - self.first[t]
            at = np.repeat(self.first[t] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            bound = np.bincount(np.repeat(passage[i:j] - low, counts) * blocks + self.block[at], weights=self.most[at], minlength=blocks)
            hit = np.flatnonzero(bound >= 1)
            found.append((hit // blocks + low, hit % blocks))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def scores(self, block: int, terms: list[int]) -> dict[int, float]:
        """Pieces of an open block with a score of 1 or more.

        The terms' lists are walked from the largest bound down; a piece is skipped for good once its score and the bounds
        still to come stay below 1.
        """
        held = self.postings[block]
        lists = sorted(((max(s for _, s in held[t]), held[t]) for t in terms if t in held), key=lambda x: -x[0])
        rest = sum(m for m, _ in lists)
        score: dict[int, float] = {}
        for most, pairs in lists:
            for piece, s in pairs:
                if (old := score.get(piece, 0.0)) + rest >= 1:
                    score[piece] = old + s
            rest -= most
        return {p: s for p, s in score.items() if s >= 1}


def _shingles(words: list[str]) -> frozenset:
    return frozenset(tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))) if words else frozenset()


_TERM = re.compile(r"[^\W_]+")


def _term_words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _TERM.findall(text.lower()) if text else []


def _pieces(items: DataFrame) -> DataFrame:
    """``item_id, words`` for each piece."""

    def into_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                words = _term_words(text)
                n = -(-len(words) // PIECE)
                rows += [(item, words[i * len(words) // n : (i + 1) * len(words) // n]) for i in range(n)]
            yield pd.DataFrame(rows, columns=["item_id", "words"])

    return items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").mapInPandas(frugal(into_pieces), "item_id long, words array<string>")


def build_index(rows: list[tuple[int, list[str]]], df: dict[str, int], n_pieces: int, mean_len: float, min_score: float) -> Index:
    terms: dict[str, int] = {}
    postings: list[list[tuple[int, float]]] = []
    item, question, answer = [], [], []
    for at, (item_id, words) in enumerate(rows):
        scores = {}
        for w, tf in Counter(words).items():
            idf = np.log(1 + (n_pieces - df[w] + 0.5) / (df[w] + 0.5))
            scores[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B_LEN + B_LEN * len(words) / mean_len))
        need = min_score * sum(scores.values())
        for w, s in scores.items():
            t = terms.setdefault(w, len(terms))
            if t == len(postings):
                postings.append([])
            postings[t].append((at, s / need))
        split = max(1, len(words) * 3 // 4)
        item.append(int(item_id))
        question.append(_shingles(words[:split]))
        answer.append(_shingles(words[split:] if len(words) - split >= SHINGLE else words[-SHINGLE:]))
    blocks: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(-(-len(rows) // POSTING_BLOCK))]
    for t, x in enumerate(postings):
        for at, s in x:
            blocks[at // POSTING_BLOCK].setdefault(t, []).append((at, s))
    entries = [[(b, max(s for at, s in x if at // POSTING_BLOCK == b)) for b in dict.fromkeys(at // POSTING_BLOCK for at, _ in x)] for x in postings]
    first = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)
    flat = [e for x in entries for e in x]
    top = np.array([max(s for _, s in x) for x in postings])
    return Index(terms, top, first, np.array([b for b, _ in flat], np.int64), np.array([m for _, m in flat]), blocks, item, question, answer)


def leaks_of(text: str | None, index: Index, min_question: float, min_answer: float, min_whole: float) -> list[tuple]:
    """(item_id, score, question overlap, answer overlap, first word of the passage) of each item that leaks into the text."""
    words = _term_words(text)
    if not words:
        return []
    get = index.terms.get
    ids = np.array([get(w, -1) for w in words], np.int64)
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return []
    n, t = max(1, -(-(len(words) - STRIDE) // STRIDE)), len(index.terms)
    place = at // STRIDE  # a word lies in the passage that starts at its stride and in the one before
    pairs = np.concatenate([place * t + ids[at], (place - 1) * t + ids[at]])
    pairs = np.unique(pairs[(pairs >= 0) & (pairs < n * t)])
    passage, term = pairs // t, pairs % t
    near = np.bincount(passage, weights=index.top[term], minlength=n) >= 1
    keep = near[passage]
    passage, term = passage[keep], term[keep]
    best: dict[int, tuple] = {}
    for k, block in zip(*index.open_blocks(passage, term, n), strict=True):
        lo, hi = passage.searchsorted([k, k + 1])
        hits = index.scores(int(block), term[lo:hi].tolist())
        if not hits:
            continue
        start = int(k) * STRIDE
        here = _shingles(words[start : start + PASSAGE])
        for piece, score in hits.items():
            q, a = index.question[piece], index.answer[piece]
            nq, na = len(q & here), len(a & here)
            oq, oa = nq / len(q), na / len(a)
            if (oq >= min_question and oa >= min_answer) or (nq + na) / (len(q) + len(a)) >= min_whole:
                # the best passage of an item, whatever the order that its pieces come in and the index that they lie in
                item, rank = index.item[piece], (round(score, 9), -start, oq, oa)
                if item not in best or rank > best[item][0]:
                    best[item] = (rank, (item, rank[0], oq, oa, start))
    return [x for _, x in best.values()]


def index_blocks(items: DataFrame, min_score: float) -> tuple[int, Iterator]:
    """How many indexes there are, and one after the other as a broadcast, of at most about INDEX_BLOCK pieces each; statistics are those of all items."""
    spark = items.sparkSession
    pieces = cut(_pieces(items))
    n, mean_len = pieces.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    blocks = -(-n // INDEX_BLOCK)
    number = F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, blocks)))
    freq = pieces.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count()

    def built() -> Iterator:
        for block in range(blocks):
            mine = pieces.where(number == block)
            rows = sorted((r["item_id"], r["words"]) for r in mine.collect())
            here = mine.select(F.explode("words").alias("w")).distinct()
            yield spark.sparkContext.broadcast(build_index(rows, {r["w"]: r["count"] for r in freq.join(here, "w").collect()}, n, mean_len, min_score))

    return blocks, built()


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.4, min_question: float = 0.5, min_answer: float = 0.3, min_whole: float = 0.6) -> DataFrame:
    """One row per document and leaked item; ``score`` is the share of the threshold, 1 or more."""
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    blocks, indexes = index_blocks(items, min_score)
    # Pieces of one item may lie in different indexes: a row is then known by a number, as rows may be equal or share an id.
    asked = cut(asked.withColumn("row", F.monotonically_increasing_id())) if blocks > 1 else asked.withColumn("row", F.lit(0).cast("long"))
    for index in indexes:

        def query(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(r, d, *x) for r, d, t in zip(pdf["row"], pdf["doc_id"], pdf["text"], strict=True) for x in leaks_of(t, index.value, min_question, min_answer, min_whole)]
                yield pd.DataFrame(rows, columns=["row", "doc_id", "item_id", "score", "question_overlap", "answer_overlap", "start"]).astype({"doc_id": "Int64"})

        found.append(asked.mapInPandas(frugal(query), f"row long, {OUT}"))
    if len(found) < 2:
        return found[0].drop("row") if found else docs.sparkSession.createDataFrame([], OUT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.struct("score", -F.col("start"), "question_overlap", "answer_overlap")
    best = out.groupBy("row", "doc_id", "item_id").agg(F.max_by(F.struct("score", "question_overlap", "answer_overlap", "start"), rank).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def drop_leaking(docs: DataFrame, items: DataFrame, text_col: str = "text", min_score: float = 0.4, min_question: float = 0.5, min_answer: float = 0.3, min_whole: float = 0.6) -> DataFrame:
    """The rows whose text leaks no item, with all their columns."""

    def clean(index) -> Column:
        @F.pandas_udf("boolean")
        def no_leak(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            clear = lambda t: not leaks_of(t, index.value, min_question, min_answer, min_whole)
            yield from frugal(lambda own: (texts.map(clear).astype(bool) for texts in own))(batches)

        return no_leak(F.col(text_col))

    for index in index_blocks(items, min_score)[1]:
        docs = docs.where(clean(index))
    return docs
