"""Token-ID output: best-fit-decreasing packing of documents into rows of fixed length.

Documents are dealt by hash of their id and text to shards of about ``SHARD_DOCS`` documents (their number follows from the
row count, not from the layout of the files), tokenized with byte-level BPE and packed shard by shard, so the rows do not
depend on partitions and a lost task repeats to the same rows. A document longer than a row is split without loss: full
rows of its own, and a rest that is packed like a short document. Pieces are placed longest first, each into the open row
with the least room that fits; a segment tree over the remaining capacities finds that row in O(log length).

A packed row holds its ids (little-endian, two bytes each, or four where the vocabulary and ``pad_id`` need them), padded with
``pad_id`` to the full length, the cumulative segment lengths from 0, and ``position_ids`` (of the same width), which count
from 0 within each segment and in the padding, so that pieces of one document restart too.

Defined results: null or empty text has no tokens and is in no row; repeated rows are packed
each; ties go to the smaller (doc_id, hash of text, part), and equal capacities to the row opened first. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

SHARD_DOCS = 2000
OUT = "shard long, row int, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, parts array<int>"


class CapacityTree:
    """Segment tree over capacities 0..n: which rows have exactly so much room; finds the least capacity that fits."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        import heapq

        heapq.heappush(self.rows.setdefault(capacity, []), row)
        i = capacity + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) with the least capacity of at least ``least``; taken out of the tree."""
        import heapq

        i = least + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # up until a right sibling has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.size
        rows = self.rows[capacity]
        row = heapq.heappop(rows)
        if not rows:
            while i and not (i < self.size and (self.any[2 * i] or self.any[2 * i + 1])):
                self.any[i] = 0
                i >>= 1
        return capacity, row


def pack(lengths: list[int], length: int) -> list[list[int]]:
    """Best-fit decreasing: for each row the pieces in it, by number."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (hit := tree.take(lengths[i])) is None:
            rows.append([])
            hit = (length, len(rows) - 1)
        capacity, row = hit
        rows[row].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], row)
    return rows


@lru_cache(maxsize=2)
def encoding(ranks_path: str):
    """Byte-level BPE from a ranks file, once for each worker process."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_width(n_vocab: int, pad_id: int, length: int) -> type:
    """The unsigned type that holds all ids, the padding and all positions."""
    return np.uint16 if max(n_vocab - 1, pad_id, length) < 1 << 16 else np.uint32


def _pack_shard(shard: int, ids: list, tokens: list[np.ndarray], length: int, pad_id: int, width: type) -> Iterator[tuple]:
    pieces = [(d, part, t[i : i + length]) for d, t in zip(ids, tokens, strict=True) for part, i in enumerate(range(0, len(t), length))]
    for n, row in enumerate(pack([len(p[2]) for p in pieces], length)):
        used = [pieces[i] for i in row]
        flat = np.concatenate([p[2] for p in used])
        full = np.full(length, pad_id, width)
        full[: len(flat)] = flat
        cu = [0, *np.cumsum([len(p[2]) for p in used]).tolist()]
        yield shard, n, len(flat), full.tobytes(), position_ids(cu, length).astype(width).tobytes(), cu, [p[0] for p in used], [p[1] for p in used]


def pack_documents(docs: DataFrame, ranks_path: str, length: int = 2048, pad_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows; see ``OUT``."""
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text <> ''")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))).withColumn("h", F.xxhash64("text"))
    ordered = dealt.repartition(max(partitions(docs.sparkSession), 1), "shard").sortWithinPartitions("shard", "doc_id", "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in OUT.split(", ")]
        codec = encoding(ranks_path)
        encode, width = codec.encode_to_numpy, id_width(codec.n_vocab, pad_id, length)
        shard, ids, tokens = None, [], []
        for pdf in batches:
            for s, d, t in zip(pdf["shard"].tolist(), pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                if s != shard and ids:
                    yield pd.DataFrame(_pack_shard(shard, ids, tokens, length, pad_id, width), columns=names)
                    ids, tokens = [], []
                shard = s
                ids.append(None if d is None or d != d else int(d))
                tokens.append(encode(t, disallowed_special=()).astype(width))
        if ids:
            yield pd.DataFrame(_pack_shard(shard, ids, tokens, length, pad_id, width), columns=names)

    return ordered.mapInPandas(run, OUT)


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Positions that restart at each segment, and in the padding."""
    cu = np.unique(np.append(cu_seqlens, length))
    return np.arange(length) - np.repeat(cu[:-1], np.diff(cu))


def unpack(rows: list[tuple[list[int], list[int], list[int], bytes]], width: type = np.uint16) -> dict[int, np.ndarray]:
    """Each document's tokens back from rows of (doc_ids, parts, cu_seqlens, ids)."""
    found: dict[int, dict[int, np.ndarray]] = {}
    for doc_ids, parts, cu, ids in rows:
        flat = np.frombuffer(ids, width)
        for d, part, a, b in zip(doc_ids, parts, cu, cu[1:], strict=False):
            found.setdefault(d, {})[part] = flat[a:b]
    return {d: np.concatenate([x[i] for i in sorted(x)]) for d, x in found.items()}


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the id matrices with their segment lengths and positions."""
    packed.write.mode("overwrite").parquet(path)


def digest_columns(packed: DataFrame) -> DataFrame:
    """A row for each packed row, with digests for its ids and position resets."""
    cu = packed["cu_seqlens"]
    joined = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")
    return packed.select(
        "shard", "row", "n_tokens", F.size("doc_ids").alias("n_segments"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"),
        joined(cu).alias("cu_seqlens"), joined(F.slice(cu, F.lit(1), F.size(cu) - 1)).alias("resets"), "doc_ids",
    )
