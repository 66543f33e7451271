"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary file gives pieces and scores; the encoder is a byte-pair merge agenda of its own: adjacent symbols whose
union is a piece are candidates, the best score first (ties: leftmost). With dropout, each candidate that the agenda
offers is skipped when a keyed hash of (seed, doc_id, chunk's place in the document, position, piece) falls below the
rate, so each occurrence of a word is drawn anew, and the same key always gives the same segmentation. Characters without
a piece fall back to byte pieces, and so does a literal U+2581, which otherwise stands for the space: every text decodes
to itself.

No piece holds a space after its start or a newline, so a text is cut there and each chunk is encoded alone. The agendas
of many chunks take their steps together, in arrays; nothing is remembered from one chunk for another.

Defined results: null text gives null ids (and decodes to null), empty text no ids; a null doc_id keys as 0; repeated rows
get equal ids. Very long texts are lists of chunks like any other. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix64

SPACE = "▁"
CHUNK = re.compile(rf"[\n{SPACE}]| *[^ \n{SPACE}]+| +")
SLICE = 1_000_000  # characters that are encoded at once
ROWS = 16_384  # chunks whose agendas take their steps together
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 40, 64)  # longer chunks are rare and go one by one
_M, _M32 = (1 << 64) - 1, (1 << 32) - 1
_NEVER = 1 << 30  # the rank of what is no candidate
_PLAIN = 1 << 17  # symbol of a character without a piece: this and its code point


class PieceCodec:
    """Encoder and decoder over one vocabulary file; ids are unsigned 16-bit."""

    def __init__(self, model_path: str, dropout: float = 0.0, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = {i: sp.id_to_piece(i).replace(SPACE, " ").encode() for i in plain} | {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.limit, self.seed = int(dropout * (1 << 32)), seed
        self._tables()

    def _tables(self) -> None:
        """Symbols are pieces' ids, or characters alone; tables from code point to symbol, from piece to rank, and from pairs of symbols to their union."""
        scores = sorted({r[0] for r in self.rank.values()})
        order = {x: i for i, x in enumerate(scores)}
        self.order = np.full(max(i for _, i in self.rank.values()) + 1, _NEVER, np.int32)
        self.symbol = np.arange(0x110000, dtype=np.int32) + _PLAIN
        for t, (x, i) in self.rank.items():
            self.order[i] = order[x]
            if len(t) == 1:
                self.symbol[ord(t)] = i
        self.symbol[ord(" ")], self.symbol[ord(SPACE)] = self.symbol[ord(SPACE)], _PLAIN + ord(SPACE)
        of = lambda t: r[1] if (r := self.rank.get(t)) else int(self.symbol[ord(t)]) if len(t) == 1 else None
        pairs = {}
        for t, (_, i) in self.rank.items():
            for k in range(1, len(t)):
                if (a := of(t[:k])) is not None and (b := of(t[k:])) is not None:
                    pairs[a << 21 | b] = i
        keys, values = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        self.pairs = []  # hash tables: what finds its slot taken goes to the next
        while len(keys):
            bits = max(4, int(4 * len(keys)).bit_length())
            slot = self._slot(keys, bits, len(self.pairs))
            table, value = np.full(1 << bits, _M, np.uint64), np.full(1 << bits, -1, np.int32)
            table[slot], value[slot] = keys, values
            lost = table[slot] != keys
            self.pairs.append((bits, table, value))
            keys, values = keys[lost], values[lost]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, table: int) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15 + 0x6A09E667F3BCC908 * table & _M | 1)) >> np.uint64(64 - bits)

    def _union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = (a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)
        out = np.full(len(keys), -1, np.int32)
        rest = np.arange(len(keys))
        for k, (bits, table, value) in enumerate(self.pairs):
            slot = self._slot(keys[rest] if k else keys, bits, k)
            there, found = table[slot], value[slot]
            hit = there == (keys[rest] if k else keys)
            if not k:
                out = np.where(hit, found, -1)
            else:
                out[rest[hit]] = found[hit]
            rest = rest[~hit & (found >= 0)]
            if not len(rest):
                break
        return out

    def _ranks(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.order[piece], _NEVER)

    def _skipped(self, key: int, at: int, piece: int) -> bool:
        h = (key + at * 0xC2B2AE3D + piece * 0x27D4EB2F) & _M32
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & _M32
        h = ((h ^ (h >> 12)) * 0x297A2D39) & _M32
        return (h ^ (h >> 15)) < self.limit

    def segment(self, chunk: str, key: int) -> list[int]:
        """Ids of one chunk, in plain form. The agenda: for each left symbol, its candidate with the next one; the best is merged or skipped."""
        get, none = self.rank.get, (float("inf"), 0)
        if chunk == SPACE:
            return [self.byte[b] for b in chunk.encode()]
        symbols = list(chunk.replace(" ", SPACE))
        offers = [get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]  # offers[i]: merging symbols i and i + 1
        scores = [o[0] for o in offers]
        at = list(range(len(symbols)))  # each symbol's first character
        while scores and (best := min(scores)) != none[0]:
            i = scores.index(best)
            if self.limit and self._skipped(key, at[i], offers[i][1]):
                scores[i] = none[0]  # until a neighbour's merge makes it anew
                continue
            s = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del at[i + 1], offers[i], scores[i]
            if i:
                offers[i - 1] = o = get(symbols[i - 1] + s, none)
                scores[i - 1] = o[0]
            if i < len(scores):
                offers[i] = o = get(s + symbols[i + 1], none)
                scores[i] = o[0]
        out = []
        for s in symbols:
            if (r := get(s)) is not None:
                out.append(r[1])
            else:
                out += [self.byte[b] for b in s.encode("utf-8", "surrogatepass")]
        return out

    def _steps(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The agendas of many chunks, a row of characters' symbols each, step by step; what was merged into its left neighbour is -1 in the end.

        A symbol stays in the column of its first character; the last column is where rows end on both sides.
        """
        rows, width = symbols.shape[0], symbols.shape[1] - 1
        piece = np.full((rows, width + 1), -1, np.int32)
        inside = np.arange(1, width) < sizes[:, None]
        piece[:, : width - 1][inside] = self._union(symbols[:, : width - 1][inside], symbols[:, 1:width][inside])
        rank = self._ranks(piece)
        columns = np.arange(width + 1)
        after = np.where(columns + 1 < sizes[:, None], columns + 1, width).astype(np.int32)
        before = np.broadcast_to(np.where(columns > 0, columns - 1, width), (rows, width + 1)).astype(np.int32)
        s, p, r, nxt, prv = symbols.ravel(), piece.ravel(), rank.ravel(), after.ravel(), before.ravel()
        limit, active = np.uint32(min(self.limit, _M32)), np.arange(rows)
        while len(active):
            i = rank[active].argmin(1)
            base = active * (width + 1)
            x = base + i
            more = r[x] < _NEVER
            active, base, i, x = active[more], base[more], i[more], x[more]
            if self.limit:
                h = keys[active] + i.astype(np.uint32) * np.uint32(0xC2B2AE3D) + p[x].astype(np.uint32) * np.uint32(0x27D4EB2F)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
                skip = (h ^ (h >> np.uint32(15))) < limit
                r[x[skip]] = _NEVER  # until a neighbour's merge makes it anew
                keep = ~skip
                base, i, x = base[keep], i[keep], x[keep]
            s[x] = p[x]
            y = base + nxt[x]
            last = nxt[y]
            s[y], r[y] = -1, _NEVER
            nxt[x] = last
            z, w = base + last, base + prv[x]
            prv[z] = i
            for left, right in ((w, x), (x, z)):
                a, b = s[left], s[right]
                real = (a >= 0) & (b >= 0)
                new = np.full(len(a), -1, np.int32)
                new[real] = self._union(a[real], b[real])
                p[left], r[left] = new, self._ranks(new)
        return symbols

    def _slice(self, texts: list[str], of_doc: np.ndarray) -> list[bytes]:
        """Ids of texts that are not empty."""
        points = [np.frombuffer((" " + t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        ends = np.cumsum([len(x) for x in points])
        c = np.concatenate(points)
        apart, space = (c == ord("\n")) | (c == ord(SPACE)), c == ord(" ")
        starts = apart.copy()  # as CHUNK cuts
        starts[1:] |= apart[:-1] | (space[1:] & ~space[:-1])
        starts[0] = True
        starts[ends[:-1]] = True
        first = np.flatnonzero(starts)
        size = np.diff(np.append(first, len(c)))
        doc = np.searchsorted(ends, first, side="right")
        place = np.arange(len(first)) - np.searchsorted(first, ends - [len(x) for x in points])[doc]
        with np.errstate(over="ignore"):
            keys = (mix64(of_doc[doc] + place.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        symbols = self.symbol[c]
        out, low = symbols.copy(), 1
        longer = {}
        for width in WIDTHS:
            chosen = np.flatnonzero((size > low) & (size <= width))
            low = width
            columns = np.arange(width)
            for k in range(0, len(chosen), ROWS):
                own = chosen[k : k + ROWS]
                inside = columns < size[own, None]
                where = (first[own, None] + columns)[inside]
                m = np.full((len(own), width + 1), -1, np.int32)
                m[:, :width][inside] = symbols[where]
                out[where] = self._steps(m, size[own], keys[own])[:, :width][inside]
        for k in np.flatnonzero(size > low).tolist():
            span = slice(int(first[k]), int(first[k] + size[k]))
            out[span] = -1
            longer[span.start] = self._long(c[span].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), int(keys[k]))
        # Most symbols are one id; those that are more are put in between.
        special = np.flatnonzero(out >= _PLAIN)
        more = longer | {int(k): [self.byte[b] for b in chr(int(out[k]) - _PLAIN).encode("utf-8", "surrogatepass")] for k in special}
        count = (out >= 0).astype(np.int64)
        for k, ids in more.items():
            count[k] = len(ids)
        total = np.cumsum(count)
        ids = np.repeat(out, count)
        for k, many in more.items():
            ids[total[k] - count[k] : total[k]] = many
        ids, cuts = ids.astype("<u2"), [0, *total[ends - 1].tolist()]
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _long(self, chunk: str, key: int) -> list[int]:
        """The same agenda as :meth:`segment` on a heap, for chunks of any length."""
        import heapq

        rank, symbols = self.rank, list(chunk.replace(" ", SPACE))
        n = len(symbols)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        version = [0] * n  # an offer is dead once either of its symbols has changed
        heap = [(r[0], i, r[1], 0, i + 1, 0) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, piece, vi, j, vj = heapq.heappop(heap)
            if version[i] != vi or version[j] != vj or (self.limit and self._skipped(key, i, piece)):
                continue
            symbols[i] += symbols[j]
            version[i] += 1
            version[j] = -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (r := rank.get(symbols[a] + symbols[b])):
                    heapq.heappush(heap, (r[0], a, r[1], version[a], b, version[b]))
        out, i = [], 0
        while i < n:
            r = rank.get(symbols[i])
            out += [r[1]] if r else [self.byte[b] for b in symbols[i].encode("utf-8", "surrogatepass")]
            i = nxt[i]
        return out

    def encode_all(self, texts: list[str | None], doc_ids: list[int]) -> list[bytes | None]:
        """Little-endian 16-bit ids of each text; a leading space is added, as the vocabulary's words begin with one."""
        out: list[bytes | None] = [None if t is None else b"" for t in texts]
        rows, chars = [], 0
        last = max((i for i, t in enumerate(texts) if t), default=-1)
        for i in range(last + 1):
            if not texts[i]:
                continue
            rows.append(i)
            chars += len(texts[i])
            if chars >= SLICE or i == last:
                of_doc = mix64(np.array([doc_ids[k] & _M for k in rows], np.uint64), self.seed)
                for k, ids in zip(rows, self._slice([texts[k] for k in rows], of_doc), strict=True):
                    out[k] = ids
                rows, chars = [], 0
        return out

    def encode(self, text: str | None, doc_id: int = 0) -> bytes | None:
        return self.encode_all([text], [doc_id])[0]

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, np.uint16).tolist()))
        return text[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def codec(model_path: str, dropout: float, seed: int) -> PieceCodec:
    """One codec for each worker process."""
    return PieceCodec(model_path, dropout, seed)


def encode_documents(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, ids`` (little-endian uint16)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = codec(model_path, dropout, seed)
        for pdf in batches:
            keys = pdf["doc_id"].fillna(0).astype("int64")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": [None if t is None else len(t) for t in pdf["text"]], "ids": of.encode_all(pdf["text"].tolist(), keys.tolist())}).astype({"doc_id": "Int64", "n_chars": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(frugal(run), "doc_id long, n_chars long, ids binary")


def decode_column(ids: Column, model_path: str) -> Column:
    """Texts of a column of ids; any variant's or seed's ids decode alike."""

    @F.pandas_udf("string")
    def text_of(values: pd.Series) -> pd.Series:
        of = codec(model_path, 0.0, 0)
        return pd.Series([of.decode(v) for v in values], dtype=object)

    return text_of(ids)


def digest_columns(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_chars, n_pieces, ids_sha256, decoded_sha256``."""
    text = encoded.withColumn("text", decode_column(F.col("ids"), model_path))
    return text.select("doc_id", "n_chars", (F.octet_length("ids") / 2).cast("long").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
