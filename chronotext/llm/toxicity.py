"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Lexicons are mined from a bounded sample of labelled rows: words far commoner in toxic texts, dealt over
   ``LEXICONS`` voters. Pattern voters (shouting, exclamation runs, symbol noise, repeated words) join them.
2. The label model sees every text, without labels: the voters' first and second moments over the whole corpus, summed
   by partition. Given the class, uncorrelated voters have covariances of rank one, v_i v_j, so each v_i follows from
   triplets (the median of C_ij C_ik / C_jk); pairs whose covariance leaves a large residue are correlated, left
   out of a second round, and share their weight in the posterior. The class share comes from the labelled sample.
3. The posterior of each sampled text trains a logistic classifier on the words that tell the posterior's sides apart
   and on the pattern votes. It scores every text, whole.

Bounded on purpose, by parameters: about ``max_labelled`` sampled rows, by hash of their id (and, where ids repeat, of the row),
the ``lexicon_words`` and ``features`` that tell most. The driver holds only that sample's sparse
features, the moments (voters squared) and the model.

Defined results: null or empty text scores as one without words; repeated labels of an id count as toxic if any is; null
labels are not used; with no usable toxic or clean label, every score is the share of toxic labels, or 0. Other
columns are never inputs. Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, frugal

TOKEN = re.compile(r"\w+")
LEXICONS, CORRELATED = 24, 0.3
LEAST_GAIN, LEAST_BELIEF = 11.0, 9.0  # log-likelihood gains that are beyond chance for a word of a lexicon, and of the classifier
PATTERNS: list[Callable[[str], bool]] = [
    str.isupper,
    lambda t: t.count("!!") >= 3,
    lambda t: t.count("***") + t.count("%%%") + t.count("&&&") + t.count("$$$") >= 3,
    lambda t: " | " in t,
]


@dataclass
class ToxicityModel:
    lexicon: dict[str, int] = field(default_factory=dict)  # word -> voter
    alpha: np.ndarray | None = None  # P(votes | toxic)
    beta: np.ndarray | None = None  # P(votes | clean)
    share: np.ndarray | None = None  # weight of each voter, less than 1 where voters are correlated
    correlated: list[tuple[int, int]] = field(default_factory=list)
    prior: float = 0.0
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: float = 0.0

    def words_in(self, text: str | None) -> set[str]:
        return set(TOKEN.findall((text or "").lower()))

    def votes(self, text: str | None, words: set[str]) -> np.ndarray:
        v = np.zeros(LEXICONS + len(PATTERNS))
        for w in words & self.lexicon.keys():
            v[self.lexicon[w]] = 1
        v[LEXICONS:] = [p(text or "") for p in PATTERNS]
        return v

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.log(self.prior / (1 - self.prior)) + votes @ (self.share * np.log(self.alpha / self.beta)) + (1 - votes) @ (self.share * np.log((1 - self.alpha) / (1 - self.beta)))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def features(self, text: str | None, words: set[str]) -> list[int]:
        return sorted(self.words[w] for w in words & self.words.keys()) + [len(self.words) + i for i, p in enumerate(PATTERNS) if p(text or "")]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.prior
        z = self.bias + self.weights[self.features(text, self.words_in(text))].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _word_counts(sample: DataFrame, weight: Callable[[str | None, int, set[str]], float]) -> DataFrame:
    """``word, pos, n``: texts that hold a word, and the same weighted by how toxic each is; summed by task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, pos = Counter(), Counter()
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                words = TOKEN.findall((text or "").lower())
                words = set(words)
                n.update(words)
                if (w := weight(text, toxic, words)) > 0.01:
                    for x in words:
                        pos[x] += w
            if len(n) > 300_000:
                yield pd.DataFrame({"word": list(n), "pos": [float(pos[w]) for w in n], "n": list(n.values())})
                n, pos = Counter(), Counter()
        if n:
            yield pd.DataFrame({"word": list(n), "pos": [float(pos[w]) for w in n], "n": list(n.values())})

    return sample.mapInPandas(frugal(count), "word string, pos double, n long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def _telling(counts: DataFrame, share: float, most: int, least: float) -> list:
    """The words that tell toxic texts: commoner there, with a log-likelihood gain over the plain share of at least ``least``."""
    rate = F.col("pos") / F.col("n")
    part = lambda k, r, p: F.when(k > 1e-9, k * F.log(r / p)).otherwise(0.0)
    gain = part(F.col("pos"), rate, share) + part(F.col("n") - F.col("pos"), 1 - rate, 1 - share)
    return counts.where((rate > 2 * share) & (F.col("pos") > 0)).select("word", gain.alias("gain")).where(F.col("gain") >= least).orderBy(F.desc("gain"), "word").limit(most).collect()


def _label_model(model: ToxicityModel, moments: np.ndarray, n: float) -> None:
    """Accuracies and correlations from the voters' moments; moments[i, j] counts texts where both vote."""
    m = len(moments)
    mean = np.diag(moments) / n
    cov = moments / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    skip = np.eye(m, dtype=bool)
    tied = cov / np.outer(sd, sd) > 0.05  # a triplet of voters that hardly move together tells nothing
    for _ in range(2):
        v = np.zeros(m)
        for i in range(m):
            j, k = np.nonzero(~skip & ~skip[i][:, None] & ~skip[i][None, :] & tied & tied[i][:, None] & tied[i][None, :])
            if len(j):
                v[i] = np.sqrt(max(0.0, float(np.median(cov[i, j] * cov[i, k] / cov[j, k]))))
        residue = np.abs(cov - np.outer(v, v)) / np.outer(sd, sd)
        skip = np.eye(m, dtype=bool) | (residue > CORRELATED)
    model.correlated = [(i, j) for i in range(m) for j in range(i) if skip[i, j]]
    model.share = 1 / (1 + np.where(skip & ~np.eye(m, dtype=bool), residue, 0).sum(1))  # the effective number of voters among its like
    p = model.prior
    delta = v / np.sqrt(p * (1 - p))
    model.alpha, model.beta = np.clip(mean + (1 - p) * delta, 1e-3, 0.99), np.clip(mean - p * delta, 1e-3, 0.99)


def _logistic(rows: list[list[int]], y: np.ndarray, width: int, l2: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum on sparse binary rows and soft labels."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64)
    w, b, mw, mb = np.zeros(width), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(width), 0.0
    seen = np.bincount(col, minlength=width) + 4.0 * l2
    for _ in range(rounds):
        z = b + np.bincount(at, weights=w[col], minlength=len(rows))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        mw = 0.9 * mw + (np.bincount(col, weights=g[at], minlength=width) + l2 * w * 0.1) / seen
        mb = 0.9 * mb + g.mean()
        w, b = w - 0.5 * mw, b - 0.5 * mb
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 480, features: int = 4000) -> ToxicityModel:
    """Learn from labels whose fold is not 0, at most ``max_labelled`` of them; the label model's moments cover all texts."""
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # so many ids at most are broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = cut(texts.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), F.monotonically_increasing_id().alias("row_no")))
    if (rows_found := sample.count()) > max_labelled:  # ids repeat
        sample = sample.where(F.pmod(F.xxhash64("row_no"), F.lit(rows_found)) < max_labelled)
    model = ToxicityModel()
    n, n_pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model.prior = n_pos / n if n else 0.0
    if not 0 < n_pos < n:
        return model

    mined = _telling(_word_counts(sample, lambda text, toxic, words: float(toxic)), model.prior, lexicon_words, LEAST_GAIN)
    model.lexicon = {r["word"]: i % LEXICONS for i, r in enumerate(mined)}
    m = LEXICONS + len(PATTERNS)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((m, m)), 0
        for pdf in batches:
            for text in pdf["text"]:
                v = np.flatnonzero(model.votes(text, model.words_in(text)))
                total[np.ix_(v, v)] += 1
                count += 1
        yield pd.DataFrame({"at": np.arange(m * m + 1), "n": [*total.ravel(), float(count)]})

    summed = {r["at"]: r["n"] for r in texts.select("text").mapInPandas(frugal(moments), "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    _label_model(model, np.array([summed[i] for i in range(m * m)]).reshape(m, m), summed[m * m])

    def belief(text: str | None, toxic: int, words: set[str]) -> float:
        return float(model.posterior(model.votes(text, words)))

    told = _telling(_word_counts(sample, belief), model.prior, features, LEAST_BELIEF)
    model.words = {r["word"]: i for i, r in enumerate(told)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(f := model.words_in(t), model.features(t, f), belief(t, 0, f))[1:] for t in pdf["text"]]
            yield pd.DataFrame(out, columns=["at", "y"])

    got = sample.mapInPandas(frugal(rows), "at array<int>, y double").toPandas()
    model.weights, model.bias = _logistic([list(r) for r in got["at"]], got["y"].to_numpy(), len(model.words) + len(PATTERNS))
    return model


def score_column(model: ToxicityModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from frugal(lambda own: (texts.map(model.score).astype("float64") for texts in own))(batches)

    return score(text)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
