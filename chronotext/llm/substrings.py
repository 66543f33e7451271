"""Substring dedup: a compressed FM-index per shard, searched backwards for matching statistics.

A window is ``WINDOW`` consecutive words; each word covered by a window that also starts in a document with a smaller id
is removed.

1. Each document's words hash to 64 bits. Anchors are the word ``K``-grams with the least hash in any stretch of a
   window's K-grams, so every window holds an anchor, and equal windows hold the same one.
2. Anchors of two or more documents are kept (counted by partial sums). Around each of their occurrences the words of
   all windows that it governs form a segment; equal windows govern alike, so they meet in their anchor's shard. Equal segments of a
   document are one, with all their places.
3. A shard indexes its segments: suffixes sorted by at most WINDOW words, the Burrows-Wheeler transform in a wavelet
   matrix with packed bits and counted blocks. Each segment is streamed backwards through it; each step of backward search
   takes the interval of the matched words, cut to the window's length, and wherever the match is as long as the window the
   least document id of the interval decides. Segments are searched side by side.
4. An anchor with more than ``HOT`` occurrences would make a shard that one task cannot hold. Its windows do not enter a shard: they are
   known by their 64-bit hash, the least document of each hash is a plain aggregate, and the occurrences are joined with it. This is
   exact but for collisions of hashes, and it is not the FM-index; the README says so.

Defined results: null or blank text has no words; rows that share an id are one document, windows of which do not remove
each other's words; a null id sorts first. Repeated rows each get a result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, mix64, partitions, shingle_hashes, word_bytes, words_of

WINDOW, K, HOT, SHARD_WORDS = 50, 8, 5000, 300_000
_NULL_ID = -(1 << 63)


class WaveletMatrix:
    """Rank of any symbol in a sequence, from one packed bit row for each bit of the alphabet."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.rows, self.counts, self.zeros = [], [], []
        seq = seq.astype(np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.rows.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

        # Where each symbol's occurrences begin on the last level: the path of position 0.
        self.base = self._path(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._path(symbol, at.astype(np.int64)) - self.base[symbol]

    def _path(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1
            ones = self._ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.counts[k][word] + np.bitwise_count(self.rows[k][word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    """Index of segments of words; suffixes are sorted by their first ``depth`` words."""

    def __init__(self, segments: list[np.ndarray], docs: np.ndarray, depth: int):
        self.depth = depth
        sizes = np.array([len(s) for s in segments])
        self.alphabet, codes = np.unique(np.concatenate(segments), return_inverse=True)
        # Code 0 ends each segment, so no match runs into the next.
        n = int(sizes.sum()) + len(sizes)
        text, doc = np.zeros(n, np.int64), np.repeat(docs, sizes + 1)
        at = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
        text[at] = codes + 1
        rank, step = text.copy(), 1

        def joined(rank: np.ndarray, ahead: int) -> np.ndarray:
            nxt = np.zeros(n, np.int64)
            nxt[: n - ahead] = rank[ahead:] + 1
            return np.unique(rank * (n + 2) + nxt, return_inverse=True)[1]

        while 2 * step <= depth:  # doubles the sorted depth
            rank, step = joined(rank, step), 2 * step
        if step < depth:
            rank = joined(rank, depth - step)  # two overlapping halves
        order = np.argsort(rank, kind="stable")
        self.doc = doc[order]
        sigma = len(self.alphabet) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        self.n = n
        # For each suffix in order, the interval of those that share its first ``depth`` words.
        starts = np.flatnonzero(np.diff(rank[order], prepend=-1))
        number = rank[order]
        self.group_start, self.group_end = starts[number], np.append(starts[1:], n)[number]
        self.least = self._least_table()

    def _least_table(self) -> list[np.ndarray]:
        table, width = [self.doc], 1
        while 2 * width <= self.n:
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def least_doc(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least document of each interval [low, high), not empty."""
        level = np.floor(np.log2(high - low)).astype(np.int64)
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.table_at(k, low[m]), self.table_at(k, high[m] - (1 << int(k))))
        return out

    def table_at(self, k: int, at: np.ndarray) -> np.ndarray:
        return self.least[int(k)][at]

    def search(self, queries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Matching statistics of each query against the index: for each start of a full window, its interval [low, high).

        Every word of a query is in the alphabet. Words are consumed from the right; a match that has reached
        ``depth`` words is cut back to ``depth`` by widening its interval to the class of its first suffix.
        """
        m = len(queries)
        sizes = np.array([len(q) for q in queries])
        coded = [np.searchsorted(self.alphabet, q) + 1 for q in queries]
        lanes = np.full((m, int(sizes.max())), -1, np.int64)
        for i, c in enumerate(coded):
            lanes[i, : len(c)] = c[::-1]  # column 0 is the last word
        low, high, length = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.zeros(m, np.int64)
        lows = np.full(lanes.shape, -1, np.int64)
        highs = np.full(lanes.shape, -1, np.int64)
        for step in range(lanes.shape[1]):
            on = np.flatnonzero(lanes[:, step] >= 0)
            s = lanes[on, step]
            both = self.wavelet.rank(np.concatenate([s, s]), np.concatenate([low[on], high[on]])) + np.tile(self.before[s], 2)
            a, b = both[: len(on)], both[len(on) :]
            size = length[on] + 1
            full = size >= self.depth
            a, b = np.where(full, self.group_start[a], a), np.where(full, self.group_end[a], b)
            low[on], high[on], length[on] = a, b, np.minimum(size, self.depth)
            lows[on[full], step], highs[on[full], step] = a[full], b[full]
        out = []
        for i, n in enumerate(sizes):
            starts = np.arange(n - self.depth, -1, -1) if n >= self.depth else np.empty(0, np.int64)
            steps = n - 1 - starts
            out.append((lows[i, steps], highs[i, steps]))
        return out


def anchors(word_hashes: np.ndarray) -> np.ndarray:
    """Positions of the K-grams that are least within some window (leftmost on ties), ascending."""
    span = WINDOW - K + 1
    h = mix64(shingle_hashes(word_hashes, K), 31)
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return np.unique(governors(h, n, span))


def governors(h: np.ndarray, n: int, span: int) -> np.ndarray:
    """For each of n windows, the position of its least K-gram."""
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    out = np.empty(n, np.int64)
    for i in range(0, n, 65536):
        out[i : i + 65536] = view[i : i + 65536].argmin(1)
    return out + np.arange(n)


def _governed(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash, anchor position) of each window of a text's word hashes."""
    span = WINDOW - K + 1
    h = mix64(shingle_hashes(w, K), 31)
    g = governors(h, len(w) - WINDOW + 1, span)
    return h[g], g


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for pdf in batches:
        sizes, found = [], []
        for t in pdf["text"]:
            w = hashes(word_bytes(t))
            a = np.unique(_governed(w)[0]) if len(w) >= WINDOW else np.empty(0, np.uint64)
            found.append(a.view(np.int64))
            sizes.append(len(a))
        if sizes:
            yield pd.DataFrame({"anchor": np.concatenate(found), "id": np.repeat(pdf["id"].to_numpy(), sizes), "row": np.repeat(pdf["row"].to_numpy(), sizes)})


def _segment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments (runs of windows under one kept anchor) of each document; windows of hot anchors one by one, as hashes."""
    hashes = WordHashes()
    for pdf in batches:
        out = []
        for r, d, t, kept, hot in zip(pdf["row"], pdf["id"], pdf["text"], pdf["kept"], pdf["hot"], strict=True):
            w = hashes(word_bytes(t))
            if len(w) < WINDOW:
                continue
            a, at = _governed(w)
            kept, hot = np.asarray(kept, np.int64).view(np.uint64), np.asarray(hot, np.int64).view(np.uint64)
            run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ends = np.concatenate([run[1:], [len(at)]])
            mine = np.isin(a[run], kept)
            equal: dict[tuple[int, bytes], list[int]] = {}  # a text that repeats itself has equal segments in many places
            for k, i, j in zip(a[run[mine]].view(np.int64).tolist(), run[mine].tolist(), ends[mine].tolist(), strict=True):
                equal.setdefault((k, w[i : j + WINDOW - 1].tobytes()), []).append(i)
            out += [(k, r, d, starts, words, 0) for (k, words), starts in equal.items()]
            if len(hot):
                windows = np.flatnonzero(np.isin(a, hot))
                if len(windows):
                    whole = shingle_hashes(w, WINDOW)[windows].view(np.int64)
                    out += [(int(h), r, d, [int(i)], None, 1) for h, i in zip(whole, windows, strict=True)]
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["key", "row", "id", "starts", "words", "hot"])
                out = []
        yield pd.DataFrame(out, columns=["key", "row", "id", "starts", "words", "hot"])


def _search_shard(rows: list[int], ids: list[int], starts: list[np.ndarray], segments: list[np.ndarray]) -> pd.DataFrame:
    """Windows of the shard's segments that also start in a smaller document, as runs (row, start, end) of words.

    Equal segments are indexed and searched once, with their least document.
    """
    copies: dict[bytes, list[int]] = {}
    for i, seg in enumerate(segments):
        copies.setdefault(seg.tobytes(), []).append(i)
    groups, out = list(copies.values()), []
    if len(segments) > 1:
        own = [segments[g[0]] for g in groups]
        index = FMIndex(own, np.array([min(ids[i] for i in g) for g in groups], np.int64), WINDOW)
        for b in range(0, len(own), 4096):
            for g, (low, high) in zip(groups[b : b + 4096], index.search(own[b : b + 4096]), strict=True):
                least = index.least_doc(low, high)
                at = len(segments[g[0]]) - WINDOW - np.arange(len(low))
                for i in g:
                    if (bad := least < ids[i]).any():
                        out += _runs(rows[i], np.unique(np.add.outer(starts[i], at[bad])))
    return pd.DataFrame(out, columns=["row", "start", "end"], dtype="int64")


def _runs(row: int, at: np.ndarray) -> list[tuple[int, int, int]]:
    """Unions of the windows that begin at the ascending positions."""
    gap = np.flatnonzero(np.diff(at) > WINDOW)
    first, last = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(at) - 1]])
    return [(row, int(at[i]), int(at[j]) + WINDOW) for i, j in zip(first, last, strict=True)]


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key; whole keys gather to shards of about ``SHARD_WORDS`` words."""
    key, rows, ids, starts, segments, size = None, [], [], [], [], 0
    for pdf in batches:
        for k, r, d, s, w in zip(*(pdf[c].tolist() for c in ("key", "row", "id", "starts", "words")), strict=True):
            if size >= SHARD_WORDS and k != key:
                yield _search_shard(rows, ids, starts, segments)
                rows, ids, starts, segments, size = [], [], [], [], 0
            seg = np.frombuffer(w, np.uint64)
            key = k
            rows.append(r)
            ids.append(d)
            starts.append(np.asarray(s, np.int64))
            segments.append(seg)
            size += len(seg)
    if segments:
        yield _search_shard(rows, ids, starts, segments)


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for d, t, spans in zip(pdf["id"], pdf["text"], pdf["spans"], strict=True):
            words = word_bytes(t)
            gone = np.zeros(len(words), bool)
            for s in spans if spans is not None else ():
                gone[s["start"] : s["end"]] = True
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
            out.append((d, len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the kept words, joined by one space) for every row."""
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    # A row's own number: rows that share an id and a text get equal results, so (id, hash of text) will do.
    rows = rows.withColumn("row", F.xxhash64("id", "text"))
    found = cut(rows.mapInPandas(_anchor_rows, "anchor long, id long, row long"))
    held = found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    held = cut(held.select("anchor", (F.col("n") > HOT).alias("hot")))
    by_row = found.select("anchor", "row").join(held, "anchor").groupBy("row").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("kept"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot")
    )
    by_row = cut(by_row)
    segments = rows.join(by_row, "row").mapInPandas(_segment_rows, "key long, row long, id long, starts array<int>, words binary, hot int")
    segments = cut(segments)

    plain = segments.where("hot = 0").select("key", "row", "id", "starts", "words")
    removed = plain.repartition(parts, "key").sortWithinPartitions("key", "id").mapInPandas(_shards, "row long, start long, end long")
    single = segments.where("hot = 1").select("key", "row", "id", F.col("starts")[0].alias("start"))
    shared = single.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    again = single.join(cut(shared.select("key", "lo")), "key").where("id > lo").select("row", F.col("start").cast("long").alias("start"), (F.col("start") + WINDOW).cast("long").alias("end"))
    spans = removed.unionByName(again).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    out = rows.join(spans, "row", "left").select("id", "text", "spans").mapInPandas(_kept, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))


def digest_columns(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def removed_words(texts: list[tuple[int, str | None]]) -> dict[int, str]:
    """Plain form for tests: id -> sha256 of the kept words."""
    least: dict[tuple, int] = {}
    for d, t in texts:
        w = words_of(t)
        for i in range(len(w) - WINDOW + 1):
            key = tuple(w[i : i + WINDOW])
            least[key] = min(d, least.get(key, d))
    out = {}
    for d, t in texts:
        w, gone = words_of(t), set()
        for i in range(len(w) - WINDOW + 1):
            if least[tuple(w[i : i + WINDOW])] < d:
                gone.update(range(i, i + WINDOW))
        out[d] = hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    return out
