"""N-gram Jaccard join: blocked products of the document by n-gram incidence matrix.

1. Each document becomes the set of its distinct word shingles (64-bit hashes); equal sets are one class, known by 128
   bits of set hash.
2. Size-derived bounds: linked sets of sizes a <= b have b <= a / t and differ in at most D = (a + b)(1 - t)/(1 + t)
   shingles. Sizes fall in bands of ratio 1/t; for each pair of neighbouring bands the hash space is cut into more
   parts than D, so linked sets agree on a part. A set emits one signature for each part that is not empty.
   Shingles that many documents share (boilerplate; a bounded list) are left out of the parts, which adds no difference;
   a set of which too little is left emits the signatures of all its shingles too, and if even these are too few for an
   agreement on one that is not empty, a common one. This loses no link, whatever is on the list.
3. Sets that share a signature are a group; groups of equal members are one. A group's head is its member that shares
   signatures with the most others in all groups: of near copies the one nearest to what they were copied from. Each set
   first meets a single partner: of its groups' heads the one that it shares the most signatures with. What links so, a
   large group of near copies above all, is one component already, and costs a comparison for each set.
4. Groups that still hold several components are compared by histograms of the shingles, a 32nd of their bytes: two sets
   differ in at least the L1 distance of theirs, so nearly all pairs of different texts are beyond the bound. The
   components of the pairs that are not are the diagonal blocks of the matrix. A group or block of more than ``BLOCK`` sets
   (or of more than ``BLOCK_GRAMS`` shingles) is cut, and each pair of cuts is a task of bounded size; cuts of its largest
   component do not meet each other, so such a group costs in proportion to it. A task tells a pair only where the pairs
   that it told before do not connect it.
5. A block's task multiplies its rows with each other: columns that many rows share by a dense product, the others by
   counting pairs. Overlaps below the bound are dropped; the rest are links, and a spanning forest of them leaves the task.
6. Components of all links; each document gets the smallest doc_id that it reaches.

A large group of which most sets are not linked with first partners costs a product for each pair of its cuts.

Defined results: null, empty or blank text has an empty set (0 shingles) and links with nothing; a text with fewer words
than a shingle is one shingle; repeated rows are equal sets, and travel as one; a null doc_id sorts first, so what links
with it has a null component. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import cut, frugal, mix64, partitions, shingle_hashes, spent, word_hashes
from .components import components

BLOCK, BLOCK_GRAMS = 256, 1_000_000
FREQUENT, LIST = 200_000, 50_000  # shingles on the list, nodes of a list at most
BITMAP = 1 << 26  # bits of a filter of ids at most: 8 MB
CHUNK = 1 << 20  # characters of texts that are cut into shingles at once, a whole text at least
SEEN = 200_000  # nodes that a task remembers at most
_NULL_ID = -(1 << 63)


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and how many each has."""
    h, words = word_hashes([t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts])
    end = np.cumsum(words)
    start = end - words
    size = np.where(words >= n, words - n + 1, words > 0)
    low = np.cumsum(size) - size
    total = int(size.sum())
    windows = shingle_hashes(h, n)
    grams = np.zeros(total, np.uint64)
    if len(windows):
        grams = windows[np.minimum(np.repeat(start - low, size) + np.arange(total), len(windows) - 1)]
    for i in np.flatnonzero((words > 0) & (words < n)).tolist():
        grams[low[i]] = shingle_hashes(h[start[i] : end[i]], int(words[i]))[0]
    for a, z in zip(low.tolist(), (low + size).tolist(), strict=True):
        grams[a:z].sort()
    keep = np.ones(total, bool)
    keep[1:] = grams[1:] != grams[:-1]
    keep[low[size > 0]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return grams[keep], before[low + size] - before[low]


def chunks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in runs of some ``CHUNK`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def set_hashes(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set, as two rows."""
    out, some = np.zeros((2, len(sizes)), np.uint64), sizes > 0
    first = (np.cumsum(sizes) - sizes)[some]
    if len(first):
        for row, seed in zip(out, (11, 13), strict=True):
            row[some] = np.add.reduceat(mix64(grams, seed), first)
    return out.view(np.int64)


def sets_of(texts: Iterable[str | None], n: int) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
    """Each text's set and its hashes."""
    for some in chunks(texts):
        grams, sizes = shingle_sets(some, n)
        yield from zip(np.split(grams, np.cumsum(sizes)[:-1]), zip(*set_hashes(grams, sizes).tolist(), strict=True), strict=True)


class Bands:
    """Size bands for the threshold p/q (linked: q * intersection >= p * union)."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.low = p, q, [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.q // self.p + 1)
        return bisect_right(self.low, n) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """(most differing shingles, number of parts) for pairs whose smaller set lies in the band."""
        self.of(self.low[-1])
        while len(self.low) <= band + 1:
            self.of(self.low[-1])
        a = self.low[band + 1] - 1
        most = (a + a * self.q // self.p) * (self.q - self.p) // (self.q + self.p)
        return most, most + most // 8 + 4


def signatures_of(grams: np.ndarray, sizes: np.ndarray, bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets that are not empty, for their own bands and for those below, and the number of each one's set; ``frequent`` is sorted."""
    m = len(sizes)
    of = np.repeat(np.arange(m), sizes)
    rare = np.ones(len(grams), bool)
    if len(frequent):
        rare = frequent[np.minimum(frequent.searchsorted(grams), len(frequent) - 1)] != grams
    common = np.bincount(of[~rare], minlength=m) > 0
    mixed = mix64(grams, 17)
    own = np.array([bands.of(n) for n in sizes.tolist()], np.int64)
    sigs, sets = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for band in (own, own - 1):
        kinds, kind = np.unique(band, return_inverse=True)
        most, parts = (x[kind] for x in np.array([bands.parts(b) if b >= 0 else (0, 0) for b in kinds.tolist()], np.int64).reshape(-1, 2).T)
        left = most > 0  # else only equal sets can link
        for some, whose in ((rare, left), (None, common)):
            todo = left & whose
            pick = todo[of] if some is None else todo[of] & some
            which = of[pick]
            if not len(which):
                continue
            part = ((grams[pick] >> np.uint64(32)) * parts.astype(np.uint64)[which]) >> np.uint64(32)  # ascending in a set, as its grams are sorted
            new = np.ones(len(which), bool)
            new[1:] = (part[1:] != part[:-1]) | (which[1:] != which[:-1])
            first = np.flatnonzero(new)
            sets.append(which[first])
            place = part[first] + (band[sets[-1]].astype(np.uint64) << np.uint64(40))
            sigs.append(mix64(np.add.reduceat(mixed[pick], first) ^ mix64(place, 19), 23))
            left &= np.bincount(sets[-1], minlength=m) <= most  # an agreement cannot be on empty parts alone
        sets.append(np.flatnonzero(left))
        sigs.append(mix64(band[left].astype(np.uint64), 29))
    return np.concatenate(sigs), np.concatenate(sets)


def signatures(grams: np.ndarray, bands: Bands, frequent: np.ndarray) -> np.ndarray:
    """A single set's signatures."""
    return signatures_of(grams, np.array([len(grams)]), bands, frequent)[0]


def histogram(grams: np.ndarray) -> bytes:
    """How many shingles fall in each of some n / 4 buckets; empty, and so without a bound, if a count leaves a byte."""
    size = 16
    while size * 4 < len(grams):
        size *= 2
    h = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return h.astype(np.uint8).tobytes() if h.max(initial=0) < 256 else b""


def near(hists: list[np.ndarray], sizes: np.ndarray, label: np.ndarray, p: int, q: int, tree: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with different labels that may link: their histograms are no farther apart than linked sets' can be. Sets of one number in ``tree`` are connected already."""
    out, m = [], len(sizes)
    if q * int(sizes.min()) < p * int(sizes.max()) and m == 2:
        return out
    bounded = np.array([len(h) > 0 for h in hists])
    width = min((len(h) for h in hists if len(h)), default=0)
    table = np.zeros((m, width), np.int16)
    for i, h in enumerate(hists):
        if len(h):
            table[i] = h if len(h) == width else h.reshape(-1, width).sum(0, dtype=np.int16)
    tree = np.arange(m) if tree is None else tree.copy()
    rows = max(1, (1 << 20) // max(1, m * width))  # rows that are compared with all others at once
    for low in range(0, m - 1, rows):
        i = np.arange(low, min(low + rows, m))[:, None]
        may = (np.arange(m) > i) & (label != label[i]) & (tree != tree[i]) & (q * np.minimum(sizes, sizes[i]) >= p * np.maximum(sizes, sizes[i]))
        if not may.any():
            continue
        apart = np.abs(table[i] - table).sum(2, dtype=np.int64) * (bounded & bounded[i])
        x, y = np.nonzero(may & (apart * (q + p) <= (sizes + sizes[i]) * (q - p)))
        for a, b in zip((x + low).tolist(), y.tolist(), strict=True):
            if tree[a] != tree[b]:
                tree[tree == tree[b]] = tree[a]
                out.append((a, b))
    return out


def _sets(n_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each text; and for each shingle that at least 10 of some 2,000 sets hold, with how many as -n."""
        names = ["id", "n", "h1", "h2", "hist"]
        for pdf in batches:
            for low in range(0, len(pdf), 2000):
                rows, seen, grams = [], set(), []
                ids, texts = pdf["id"][low : low + 2000], pdf["text"][low : low + 2000]
                for d, (g, h) in zip(ids, sets_of(texts, n_words), strict=True):
                    rows.append((d, len(g), *h, histogram(g)))
                    if h not in seen:
                        seen.add(h)
                        grams.append(g)
                yield pd.DataFrame(rows, columns=names)
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                many = n >= 10
                yield pd.DataFrame({"id": 0, "n": -n[many], "h1": g[many].view(np.int64), "h2": 0, "hist": None}, columns=names)

    return run


def _signature_rows(n_words: int, p: int, q: int, frequent: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, seen = Bands(p, q), set()
        for pdf in batches:
            for texts in chunks(pdf["text"]):
                grams, sizes = shingle_sets(texts, n_words)
                node = set_hashes(grams, sizes)[0]
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.zeros(len(sizes), bool)
                for i in np.flatnonzero(sizes).tolist():
                    if (h := int(node[i])) not in seen:  # else an equal set of this task has emitted the same rows
                        seen.add(h)
                        fresh[i] = True
                sigs, sets = signatures_of(grams[np.repeat(fresh, sizes)], sizes[fresh], bands, frequent.value)
                yield pd.DataFrame({"sig": sigs.view(np.int64), "node": node[fresh][sets]})

    return run


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by signature and node -> ``gid, node`` of signatures with two nodes or more; equal lists of nodes have one gid.

    The last list of a batch is carried over to the next; one of over ``LIST`` nodes goes out as it comes, its signature as gid.
    """
    s = v = np.empty(0, np.int64)
    long = None
    for pdf in chain(batches, [None]):
        if pdf is not None:
            s, v = np.concatenate([s, pdf["sig"].to_numpy(np.int64)]), np.concatenate([v, pdf["node"].to_numpy(np.int64)])
        if not len(s):
            continue
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (v[1:] != v[:-1])])
        s, v = s[fresh], v[fresh]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(first, len(s)))
        as_long = np.full(len(first), False) if long is None else s[first] == long
        if pdf is not None and size[-1] > LIST:
            long, as_long[-1] = s[-1], True
        carried = pdf is not None and not as_long[-1]
        with np.errstate(over="ignore"):
            gid = mix64(np.add.reduceat(mix64(v.view(np.uint64), 43), first), 47).view(np.int64)
        gid = np.where(as_long, s[first], gid)
        keep = (size > 1) | as_long
        keep[-1] &= not carried
        rows = np.repeat(keep, size)
        if rows.any():
            yield pd.DataFrame({"gid": np.repeat(gid, size)[rows], "node": v[rows]})
        start = first[-1] if carried else len(s)
        s, v = s[start:], v[start:]


def linked(rows: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """Boolean matrix of linked pairs, by a product of the rows' incidence matrix with its transpose."""
    m, sizes = len(rows), np.array([len(r) for r in rows], np.int64)
    cols, inverse, freq = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    at = np.repeat(np.arange(m), sizes)
    many = freq >= (2 if m <= 24 else 16)
    number = np.cumsum(many) - 1
    heavy = many[inverse]
    overlap = np.zeros((m, m), np.int64)
    r, c = at[heavy], number[inverse[heavy]]
    width = max(1, (1 << 24) // m)  # columns of one product, so that its matrix stays bounded
    for low in range(0, int(many.sum()), width):
        here = (c >= low) & (c < low + width)
        dense = np.zeros((m, width), np.float32)
        dense[r[here], c[here] - low] = 1
        overlap += np.rint(dense @ dense.T).astype(np.int64)
    light = ~heavy & (freq[inverse] >= 2)
    if light.any():
        order = np.argsort(inverse[light], kind="stable")
        c, r = inverse[light][order], at[light][order]
        pairs = np.zeros(m * m, np.int64)
        for step in range(1, 16):  # partners ``step`` places on in the column's run
            same = c[step:] == c[:-step]
            if not same.any():
                break
            i, j = r[:-step][same], r[step:][same]
            pairs += np.bincount(i * m + j, minlength=m * m)
        square = pairs.reshape(m, m)
        overlap += square + square.T
    union = sizes[:, None] + sizes[None, :] - overlap
    out = q * overlap >= p * union
    np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    out, left = [], np.ones(len(links), bool)
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            fresh = np.flatnonzero(links[i] & left)
            left[fresh] = False
            out += [(i, int(j)) for j in fresh]
            queue += fresh.tolist()
    return out


def _stars(p: int, q: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by task key, the head first: links of the others with it."""
        key, head, grams, before = None, 0, None, None
        for pdf in batches:
            out = []
            for k, member, node, g in zip(pdf["key"], pdf["member"], pdf["node"], pdf["grams"], strict=True):
                g = np.frombuffer(g, np.uint64)
                if not member:
                    key, head, grams, before = k, node, g, None
                elif k == key and node != before:
                    before = node
                    o = int((grams[np.minimum(grams.searchsorted(g), len(grams) - 1)] == g).sum())
                    if q * o >= p * (len(g) + len(grams) - o):
                        out.append((node, head))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _tasks(columns: list[str], names: list[str], of_task):
    """Rows sorted by key and node; ``of_task`` gets each key's rows, a repeated node once. Tasks are bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for pdf in batches:
            for k, *row in zip(*(pdf[c] for c in ("key", *columns)), strict=True):
                if k != key and rows:
                    if len(rows) > 1:
                        yield pd.DataFrame(of_task(key, rows), columns=names, dtype="int64")
                    rows = []
                key = k
                if not rows or rows[-1][0] != row[0]:
                    rows.append(row)
        if len(rows) > 1:
            yield pd.DataFrame(of_task(key, rows), columns=names, dtype="int64")

    return run


def _root(tree: dict[int, int], x: int) -> int:
    while (y := tree.get(x, x)) != x:
        tree[x] = tree.get(y, y)
        x = y
    return x


def _bounded(p: int, q: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree: dict[int, int] = {}  # what the pairs told so far connect

        def of_task(key: int, rows: list) -> list[tuple]:
            if len(tree) > SEEN:
                tree.clear()
            roots = [_root(tree, r[0]) for r in rows]
            if roots.count(roots[0]) == len(roots):
                return []
            joined = np.unique(np.array(roots, np.int64), return_inverse=True)[1]
            pairs = near([np.frombuffer(r[2], np.uint8) for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), p, q, joined)
            out = [(rows[i][0], rows[j][0]) for i, j in pairs]
            for a, b in out:
                tree[_root(tree, a)] = _root(tree, b)
            return out

        yield from _tasks(["node", "n", "hist", "label"], ["a", "b"], of_task)(batches)

    return run


def _products(p: int, q: int):
    def of_task(key: int, rows: list) -> list[tuple]:
        return [(rows[i][0], rows[j][0]) for i, j in forest(linked([np.frombuffer(r[1], np.uint64) for r in rows], p, q))]

    return _tasks(["node", "grams"], ["a", "b"], of_task)


def _perhaps(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """The rows whose id may be one of the tasks', so that few other texts are shuffled: a hashed bitmap of at most ``BITMAP`` bits, with which all rows pass once it is full."""
    spark = rows.sparkSession
    bits = min(BITMAP, max(64, 1 << (16 * tasks.count()).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = tasks.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf(BooleanType())
    def held(place: pd.Series) -> pd.Series:
        x = place.to_numpy(np.int64)
        return pd.Series((shared.value[x >> 6] >> (x & 63)) & 1 == 1)

    return rows.where(held(at))


def _with_grams(rows: DataFrame, tasks: DataFrame, n_words: int, order: list[str]) -> DataFrame:
    """``key, member, node, grams`` for each of ``tasks(id, h1, h2, key, member)``, sorted within partitions."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sent = ["key", "member", "node", "grams"], set()
        for pdf in batches:
            texts, out = pdf["text"], []
            fresh = (texts != texts.shift()).to_numpy()
            fresh[:1] = True
            sets = sets_of(texts[fresh], n_words)
            for new, h1, h2, k, member in zip(fresh.tolist(), *(pdf[c] for c in ("h1", "h2", "key", "member")), strict=True):
                if new:
                    g, h = next(sets)
                if h != (h1, h2) or (k, h1) in sent:
                    continue  # another row shares the id
                if len(sent) > SEEN:
                    sent.clear()
                sent.add((k, h1))
                out.append((k, member, h1, g.tobytes()))
                if len(out) > 200:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    loaded = _perhaps(rows, tasks).join(tasks, "id").mapInPandas(frugal(grams), "key long, member boolean, node long, grams binary")
    return loaded.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions(*order)


def _star_links(rows: DataFrame, groups: DataFrame, classes: DataFrame, n_words: int, p: int, q: int) -> DataFrame:
    """``a, b``: each node's link with its first partner, if there is one."""
    held = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
    others = groups.join(held, "gid").groupBy("node").agg(F.sum(F.col("m") * F.col("n_sigs")).alias("others"))
    central = groups.join(others, "node").groupBy("gid").agg(F.max_by("node", F.struct("others", "node")).alias("head"))
    shared = groups.join(central, "gid").where("node <> head").groupBy("node", "head").agg(F.sum("n_sigs").alias("n"))
    best = shared.groupBy("node").agg(F.max_by("head", F.struct("n", "head")).alias("head"))
    mine, its = (classes.select(F.col("h1").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("h2", "id", "n", "hist")]) for k in ("node", "head"))

    def may_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pair = zip(*(pdf[f"{k}_{c}"] for c in ("hist", "n") for k in ("node", "head")), strict=True)
            ok = [near([np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)], np.array([m, n], np.int64), np.arange(2), p, q) for x, y, m, n in pair]
            yield pdf.loc[np.array([len(x) > 0 for x in ok], bool), ["node", "head", "node_h2", "node_id", "head_h2", "head_id"]]

    edges = best.join(mine, "node").join(its, "head").mapInPandas(frugal(may_link), "node long, head long, node_h2 long, node_id long, head_h2 long, head_id long")
    edges = cut(edges)
    many = edges.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    dealt = edges.join(many, "head").withColumn("key", F.xxhash64("head", F.pmod(F.xxhash64("node"), "cuts")))
    nodes = dealt.select(F.col("node_id").alias("id"), F.col("node").alias("h1"), F.col("node_h2").alias("h2"), "key", F.lit(True).alias("member"))
    heads = dealt.select(F.col("head_id").alias("id"), F.col("head").alias("h1"), F.col("head_h2").alias("h2"), "key", F.lit(False).alias("member")).distinct()
    tasks = cut(nodes.unionByName(heads))
    links = cut(_with_grams(rows, tasks, n_words, ["key", "member", "node"]).mapInPandas(frugal(_stars(p, q)), "a long, b long"))
    spent(edges, tasks)
    return links


def _blocks(members: DataFrame, by: str) -> DataFrame:
    """``node, label, key`` from ``by, node, n, label``: each group is a task, or is cut by hash of the node, with a task for each pair of cuts that may hold different labels."""
    cuts = lambda m, grams: F.greatest(F.ceil(m / BLOCK), F.ceil(grams / BLOCK_GRAMS), F.lit(1)).cast("int")
    sizes = members.groupBy(by).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"))
    sizes = cut(sizes.where("m > 1"))
    large = sizes.where(cuts(F.col("m"), F.col("grams")) > 1)
    shares = members.join(large.select(by), by).groupBy(by, "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"))
    most = shares.groupBy(by).agg(F.max(F.struct("m", "label", "grams")).alias("top"))  # its sets are not compared with each other
    dealt = sizes.join(most, by, "left").select(by, F.col("top.label").alias("top"), *[F.when(F.col("top").isNull(), alone).otherwise(cuts(*x)).alias(c) for c, alone, x in (("rest", 1, (F.col("m") - F.col("top.m"), F.col("grams") - F.col("top.grams"))), ("tops", 0, (F.col("top.m"), F.col("top.grams"))))])
    dealt = cut(dealt)
    at_top, hashed = F.coalesce(F.col("label") == F.col("top"), F.lit(False)), F.xxhash64("node")
    placed = members.join(dealt, by).withColumn("i", F.when(at_top, F.col("rest") + F.pmod(hashed, F.greatest("tops", F.lit(1)))).otherwise(F.pmod(hashed, "rest")).cast("int"))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(at_top, F.col("rest")).otherwise(F.col("rest") + F.col("tops")) - 1)))
    return placed.select("node", "label", F.xxhash64(by, F.least("i", "j"), F.greatest("i", "j")).alias("key"))


def _block_links(rows: DataFrame, groups: DataFrame, classes: DataFrame, known: DataFrame, n_words: int, p: int, q: int) -> DataFrame:
    """``a, b``: the links between components ``known(node, component)`` within the groups."""
    parts = partitions(rows.sparkSession)
    sets = classes.select(F.col("h1").alias("node"), "n", "h2", "id", "hist")
    named = cut(groups.join(known, "node", "left").join(sets.select("node", "n"), "node").select("gid", "node", "n", F.coalesce("component", "node").alias("label")))
    mixed = named.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("gid")
    keyed = _blocks(named.join(cut(mixed), "gid"), "gid").join(sets.select("node", "n", "hist"), "node")
    may = cut(keyed.repartition(parts, "key").sortWithinPartitions("key", "node").mapInPandas(frugal(_bounded(p, q)), "a long, b long").distinct())
    # What may link is near copies, so its components are small blocks; each set travels to one, however many signatures it shares.
    clusters = components(may)
    labelled = clusters.join(known.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    tasks = _blocks(labelled.join(sets.select("node", "n"), "node"), "component").select("key", "node").join(sets.select("node", "h2", "id"), "node")
    tasks = cut(tasks.select("id", F.col("node").alias("h1"), "h2", "key", F.lit(True).alias("member")))
    links = cut(_with_grams(rows, tasks, n_words, ["key", "node"]).mapInPandas(frugal(_products(p, q)), "a long, b long"))
    spent(named, may, clusters, tasks)
    return links


def jaccard_components(docs: DataFrame, n_words: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; sets link when q * intersection >= p * union."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    found = cut(rows.mapInPandas(frugal(_sets(n_words)), "id long, n long, h1 long, h2 long, hist binary"))
    sets = found.where("n >= 0")
    often = found.where("n < 0").groupBy("h1").agg(F.sum("n").alias("n")).orderBy("n", "h1").limit(FREQUENT).select("h1").toPandas()
    frequent = spark.sparkContext.broadcast(np.sort(often["h1"].to_numpy(np.int64).view(np.uint64)))
    classes = cut(sets.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("hist").alias("hist")))

    sigs = rows.select("text").mapInPandas(frugal(_signature_rows(n_words, p, q, frequent)), "sig long, node long")
    together = sigs.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "node").mapInPandas(frugal(_groups), "gid long, node long")
    groups = cut(together.groupBy("gid", "node").agg(F.count(F.lit(1)).alias("n_sigs")))
    frequent.unpersist()

    stars = _star_links(rows, groups, classes, n_words, p, q)
    known = components(stars)
    blocks = _block_links(rows, groups, classes, known, n_words, p, q)
    joined = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(blocks))
    spent(stars, blocks, known, groups)

    named = classes.join(joined.withColumnRenamed("node", "h1"), "h1", "left").select("h1", "h2", "n", "id", F.coalesce("component", "h1").alias("component"))
    named = cut(named)
    least = cut(named.groupBy("component").agg(F.min("id").alias("least")))
    out = sets.select("id", "n", "h1", "h2").join(cut(named.join(least, "component").select("h1", "h2", "n", "least")), ["h1", "h2", "n"], "left")
    spent(classes, joined, named, least)
    shown = lambda c: F.when(c != _NULL_ID, c)
    return out.select(shown(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(F.coalesce("least", "id")).alias("component_id"))
