"""Cost-balanced packing: sequences of a fixed length whose attention costs are alike, without padding.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``: projections and feed-forward layers grow with the tokens,
attention with their square, within the piece alone. Each task packs the rows that it reads in blocks of about ``BLOCK_TOKENS``
tokens; nothing is shuffled, a block is all that is held, and a lost task repeats to the same sequences.

A block of ``t`` tokens gets ``t // length`` sequences of ``length`` tokens, and for the remainder one sequence for each power
of two in it, as a sequence of such a length needs no padding. Longest documents first, each goes to the sequence of the
lowest cost that has room for it (ties: the first); where none has, the sequence of the lowest cost with any room takes as
much as fits, and the rest goes on as a document of its own. Documents longer than a sequence fill whole sequences first.
As rooms and tokens are equal in number, every sequence ends full.

Ids are those of a byte-level BPE with its special token, whose string in a text is that token; ``end_id`` follows each document.

Defined results: null or empty text is ``end_id`` alone; repeated rows and ids are packed each; a null id stays null; an
empty table gives no sequences. A very long text is tokenized whole and its tokens are one block. Other columns are ignored.
``sequence_id`` names the partition and the sequence in it, so it follows the layout of the input.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TOKENS = 1 << 20
#: A model of width d spends about 24 d^2 operations on a token and 4 d on a pair of tokens; here d is 1,024.
LINEAR, QUADRATIC = 6 * 1024, 1
PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
OUT = "sequence_id long, n_tokens int, cost double, ids binary, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"


@lru_cache(maxsize=2)
def encoding(ranks_path: str, special: tuple[tuple[str, int], ...]):
    """Byte-level BPE from a ranks file, once for each worker process."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("balanced", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def capacities(tokens: int, length: int) -> list[int]:
    """Rooms for exactly so many tokens: whole sequences, then the powers of two of the remainder."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def balance(lengths: list[int], length: int, linear: int = LINEAR, quadratic: int = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """For each sequence its pieces (document, start, length)."""
    room = np.array(capacities(sum(lengths), length), np.int64)
    cost, out = np.zeros(len(room)), [[] for _ in room]
    whole = 0
    heap = []
    for doc, n in enumerate(lengths):
        full = n // length
        for i in range(full):
            out[whole + i].append((doc, i * length, length))
        whole += full
        if n % length:
            heap.append((-(n % length), doc, full * length))
    room[:whole] = 0
    heapq.heapify(heap)
    while heap:
        n, doc, start = heapq.heappop(heap)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
        at = int(np.where(fits, cost, np.inf).argmin())
        take = min(n, int(room[at]))
        out[at].append((doc, start, take))
        room[at] -= take
        cost[at] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(heap, (take - n, doc, start + take))
    return out


def _sequences(first: int, ids: list, tokens: list[np.ndarray], length: int, linear: int, quadratic: int) -> Iterator[pa.RecordBatch]:
    packed = balance([len(t) for t in tokens], length, linear, quadratic)
    for low in range(0, len(packed), 512):
        some, rows = packed[low : low + 512], []
        for n, pieces in enumerate(some, first + low):
            flat = np.concatenate([tokens[d][s : s + m] for d, s, m in pieces]).astype("<u4")
            offsets = np.cumsum([0] + [m for _, _, m in pieces]).tolist()
            cost = float(sum(linear * m + quadratic * m * m for _, _, m in pieces))
            rows.append((n, len(flat), cost, flat.tobytes(), [(ids[d], s, m, len(tokens[d]), o) for (d, s, m), o in zip(pieces, offsets, strict=False)]))
        seq, sizes, costs, flat, pieces = zip(*rows, strict=True)
        named = [[dict(zip(("doc_id", "start", "length", "doc_tokens", "offset"), p, strict=True)) for p in row] for row in pieces]
        columns = [pa.array(seq, pa.int64()), pa.array(sizes, pa.int32()), pa.array(costs, pa.float64()), pa.array(flat, pa.binary()), pa.array(named, pa.list_(PIECE))]
        yield pa.RecordBatch.from_arrays(columns, names=["sequence_id", "n_tokens", "cost", "ids", "pieces"])


def pack_balanced(
    docs: DataFrame, ranks_path: str, length: int = 2048, end_id: int = 1, special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),),
    linear: int = LINEAR, quadratic: int = QUADRATIC, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Packed sequences; see ``OUT``. ``ids`` are little-endian, four bytes each; ``length`` is a power of two."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks_path, special).encode_to_numpy
        end = np.array([end_id], np.uint32)
        n, ids, tokens, held = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                tokens.append(np.concatenate([encode(text.as_py(), allowed_special="all"), end]))
                held += len(tokens[-1])
                if held >= BLOCK_TOKENS:
                    for packed in _sequences(n, ids, tokens, length, linear, quadratic):
                        n += packed.num_rows
                        yield packed
                    ids, tokens, held = [], [], 0
        if ids:
            yield from _sequences(n, ids, tokens, length, linear, quadratic)

    return rows.mapInArrow(run, OUT)


def pieces_of(packed: DataFrame) -> DataFrame:
    """A row for each piece, with the checksum of its ids."""
    rows = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.expr("substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))")
    return rows.select("p.doc_id", "p.start", "p.length", F.crc32(own).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
