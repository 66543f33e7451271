"""Matched characters of texts with many parts at once.

Every part is split as :func:`matching.matched_chars` splits it: the longest common run first, then what lies on either side of it. All regions of all pairs take
their steps together: first runs of ``LONG`` characters and more are settled, then in what is left those of a character less, down to single ones.
"""

from __future__ import annotations

import numpy as np

LONG = 4  # common runs are looked up by so many characters first
MOST_PAIRS = 1 << 20  # so many common runs are looked at together
PLACE = 21  # bits of a place in a key
TABLE = 1 << 21  # up to this size the counts of runs before each place are a table


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + np.repeat((first - ends + size).astype(np.int32), size)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Parts:
    """Parts of a text (``first`` place and ``size`` of each) laid end to end, and for each place the numbers of the runs of 1 to ``LONG`` characters that begin there."""

    def __init__(self, text: str, first: np.ndarray, size: np.ndarray):
        self.size, self.end = np.asarray(size, np.int64), np.cumsum(size, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(size), dtype=np.int32), self.size)
        at, codes, self.kinds, self.runs = _spans(np.asarray(first, np.int64), self.size), _codes(text), [], []
        for g in range(1, LONG + 1):
            kinds, ids = np.unique(codes, return_inverse=True)
            single = ids if g == 1 else single
            self.kinds.append(kinds.astype(np.int64))
            self.runs.append(np.concatenate([ids, np.zeros(g, np.int64)]).astype(np.int32)[at])  # what runs over a part's end is not asked for
            codes = ids[:-1] * len(self.kinds[0]) + single[g:]  # numbered after the run without its last character, and this one
        whole = np.flatnonzero(np.arange(len(at)) + LONG <= self.end[self.owner])
        held = self.runs[-1][whole]
        self.places = whole[np.argsort(held, kind="stable")].astype(np.int32)
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=len(self.kinds[-1])))])

    @classmethod
    def of(cls, texts: list[str]) -> Parts:
        size = np.array([len(t) for t in texts], np.int64)
        return cls("".join(texts), np.cumsum(size) - size, size)

    def numbers(self, text: str) -> list[np.ndarray]:
        """The numbers of a text's runs of 1 to ``LONG`` characters; -1 for those that the parts don't have."""
        out, codes = [], _codes(text).astype(np.int64)
        for g, kinds in enumerate(self.kinds, 1):
            k = np.searchsorted(kinds, codes)
            k[k == len(kinds)] = 0
            out.append(np.where(kinds[k] == codes, k, -1) if len(kinds) else np.full(len(codes), -1))
            ahead, last = out[-1][:-1], out[0][g:]
            codes = np.where((ahead >= 0) & (last >= 0), ahead * len(self.kinds[0]) + last, -1)
        return out


def _settle(regions: np.ndarray, runs: np.ndarray, least: int, text_first: bool, out: np.ndarray) -> np.ndarray:
    """Takes each region's longest run (of equals the first in the one text, then in the other) and splits the region there, until no run of ``least`` is left; those left that are not empty.

    Rows of ``regions``: pair, first place and the one after the last in the texts, then in the parts; of ``runs``: place in the texts, in the parts, length, region.
    """
    top = (1 << PLACE) - 1
    while runs.shape[1]:
        s, m, size, region = runs
        a, b = (s, m) if text_first else (m, s)
        best = np.zeros(regions.shape[1], np.int64)
        np.maximum.at(best, region, (size.astype(np.int64) << 2 * PLACE) + ((top - a).astype(np.int64) << PLACE) + (top - b))
        hit = np.flatnonzero(best)
        key = best[hit]
        n, x, y = (key >> 2 * PLACE).astype(np.int32), (top - (key >> PLACE & top)).astype(np.int32), (top - (key & top)).astype(np.int32)
        if not text_first:
            x, y = y, x
        np.add.at(out, regions[0, hit], n)
        to = np.zeros(regions.shape[1], np.int32)
        to[hit] = np.arange(len(hit), dtype=np.int32)
        own = to[region]
        ds, dm, n_own = x[own] - s, y[own] - m, n[own]
        # No run reaches to both sides: it would be longer than the longest.
        before = np.minimum(np.minimum(ds, dm), size)
        skip = np.maximum(np.maximum(ds, dm) + n_own, 0)
        left, right = np.flatnonzero(before >= least), np.flatnonzero(size - skip >= least)
        over = skip[right]
        runs = np.concatenate([
            np.stack([s[left], m[left], before[left], own[left] + np.int32(regions.shape[1])]),
            np.stack([s[right] + over, m[right] + over, size[right] - over, region[right]]),
        ], axis=1)
        # What lies before a run is a new region, what lies after it takes the old one's place.
        ahead = regions[:, hit]
        ahead[2], ahead[4] = x, y
        regions[1, hit], regions[3, hit] = x + n, y + n
        regions = np.concatenate([regions, ahead], axis=1)
    return regions[:, np.minimum(regions[2] - regions[1], regions[4] - regions[3]) > 0]


def _reaching(regions: np.ndarray, out: np.ndarray, need: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Which regions belong to pairs that can still reach what they need."""
    room = np.minimum(regions[2] - regions[1], regions[4] - regions[3])
    may = out + np.bincount(regions[0], room if most is None else np.minimum(room, most), minlength=len(out)) >= need
    return may[regions[0]]


class _Texts:
    """Texts laid end to end, with what is needed to look their runs up."""

    def __init__(self, texts: list[str], parts: Parts):
        self.parts, self.size = parts, np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.size)
        self.start, self.n = self.end - self.size, int(self.end[-1])
        self.owner = np.repeat(np.arange(len(texts)), self.size)
        self.numbers = parts.numbers("".join(texts))
        for g, held in enumerate(self.numbers, 1):
            held[np.arange(len(held)) + g > self.end[self.owner[: len(held)]]] = -1

    def finish(self, regions: np.ndarray, text_first: bool, out: np.ndarray, need: np.ndarray | None = None) -> bool:
        """Settles all runs shorter than ``LONG``, but for pairs that cannot reach ``need``; false where there are too many."""
        parts = self.parts
        for g in range(LONG - 1, 0, -1):
            if need is not None:
                regions = regions[:, _reaching(regions, out, need)]
            if not regions.shape[1]:
                break
            many, held = len(parts.kinds[g - 1]), self.numbers[g - 1]
            mine = np.flatnonzero(held >= 0)
            own = self.owner[mine] * many + held[mine]
            order = np.argsort(own, kind="stable")
            mine, own = mine[order].astype(np.int32), own[order]
            new = np.diff(own, prepend=-1) != 0
            kinds, row = own[new], np.cumsum(new) - 1  # the runs of each text by themselves
            local = np.full(len(self.size) * many, -1, np.int32)
            local[kinds] = np.arange(len(kinds), dtype=np.int32)
            pair, s0, s1, m0, m1 = regions
            text = pair // len(parts.size)
            wide = np.where(s1 - s0 >= g, np.maximum(m1 - m0 - g + 1, 0), 0)
            m, region = _spans(m0, wide), np.repeat(np.arange(len(wide), dtype=np.int32), wide)
            k = local[parts.runs[g - 1][m] + (text * many)[region]]
            some = np.flatnonzero(k >= 0)
            m, region, k = m[some], region[some], k[some]
            width = self.size[kinds // many] + 1
            table = int(width.sum()) <= TABLE
            base = np.cumsum(width) - width - self.start[kinds // many] if table else np.arange(len(kinds)) * (self.n + 1)
            low = base[k] + s0[region]
            high = low + (s1 - s0 - g + 1)[region]
            if table:
                count = np.zeros(int(width.sum()), np.int32)
                count[base[row] + mine + 1] = 1  # of a row's first place nothing comes before
                count = np.cumsum(count, dtype=np.int32)
                first, last = count[low], count[high]
            else:
                keys = base[row] + mine
                first, last = np.searchsorted(keys, low), np.searchsorted(keys, high)
            counts = last - first
            if need is not None and g == 1:
                may = _reaching(regions, out, need, np.bincount(region, counts > 0, minlength=regions.shape[1]))
                counts = np.where(may[region], counts, 0)
            if counts.sum() > MOST_PAIRS:
                return False
            s = mine[_spans(first, counts)]
            runs = np.stack([s, np.repeat(m, counts), np.full(len(s), g, np.int32), np.repeat(region, counts)])
            regions = _settle(regions, runs, g, text_first, out)
        return True


def matched_with(texts: list[str], parts: Parts, live: np.ndarray | None = None, text_first: bool = True, top: int = 0, base: np.ndarray | None = None, floor: np.ndarray | None = None) -> np.ndarray | None:
    """Characters in matching blocks of each text and each part, a row for a text (0 for pairs not in ``live``): ``matched_chars(text, part)``, or with ``text_first`` false ``matched_chars(part, text)``.

    With ``top``: exact for all parts that may be among a text's so many largest shares of ``base`` (to four places) of ``floor`` or more, less for the others.
    None where the texts or the parts are too long, or too many runs are common.
    """
    shape = (len(texts), len(parts.size))
    out = np.zeros(shape[0] * shape[1], np.int64)
    wanted = np.ones(shape, bool) if live is None else live
    use = np.flatnonzero(wanted & (parts.size > 0) & (np.array([len(t) for t in texts]) > 0)[:, None])
    if not len(use):
        return out.reshape(shape)
    if max(sum(map(len, texts)), len(parts.owner), len(out)) >= 1 << PLACE:
        return None
    t = _Texts(texts, parts)
    held = t.numbers[-1]
    i = np.flatnonzero(held >= 0)
    counts = parts.bounds[held[i] + 1] - parts.bounds[held[i]]
    if counts.sum() > MOST_PAIRS:
        return None
    s, m = np.repeat(i, counts), parts.places[_spans(parts.bounds[held[i]], counts)]
    key = np.sort((m - s + t.n) * (t.n + 1) + s)  # along the diagonals
    first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    size = np.diff(first, append=len(key)) + LONG - 1
    s = key[first] % (t.n + 1)
    m = key[first] // (t.n + 1) - t.n + s
    index = np.full(len(out), -1, np.int32)
    index[use] = np.arange(len(use), dtype=np.int32)
    own, part = np.divmod(use, shape[1])
    regions = np.stack([use, t.start[own], t.end[own], parts.end[part] - parts.size[part], parts.end[part]]).astype(np.int32)
    runs = np.stack([s, m, size, index[t.owner[s] * shape[1] + parts.owner[m]]]).astype(np.int32)
    regions = _settle(regions, runs[:, runs[3] >= 0], LONG, text_first, out)
    if not top:
        return out.reshape(shape) if t.finish(regions, text_first, out) else None
    # The parts ahead by their long runs are finished first; then it is known what the others need.
    base = np.ones(shape) if base is None else base
    floor = np.zeros(shape[0]) if floor is None else floor
    share = np.where(wanted, out.reshape(shape) / base, -1.0)
    ahead = np.zeros(shape, bool)
    np.put_along_axis(ahead, np.argpartition(-share, min(top + 2, shape[1] - 1), axis=1)[:, : top + 3], True, axis=1)
    mine = ahead.ravel()[regions[0]]
    if not t.finish(regions[:, mine], text_first, out, ((floor - 1e-4)[:, None] * base).ravel()):
        return None
    if shape[1] >= top:
        share = np.where(ahead & wanted, out.reshape(shape) / base, 0.0)
        floor = np.maximum(floor, np.partition(share, shape[1] - top, axis=1)[:, shape[1] - top])
    return out.reshape(shape) if t.finish(regions[:, ~mine], text_first, out, ((floor - 1e-4)[:, None] * base).ravel()) else None
