"""Vector codes: product quantisation whose codebooks follow delta-maintained Lloyd rounds.

Components become integers (``floor(scale * x)``), vectors are cut into equal consecutive parts, and each part position has a
codebook of ``entries`` entries that starts as that part of the smallest ids' vectors. Everything is integer, so neither the
order of rows nor that of tasks changes a result.

What a round keeps is a table: each vector with its codes, and the running sums and counts of every entry. The next round
assigns the parts anew beside the codes that the table holds, and a task adds up only the parts whose code changed: minus for
the entry that they left, plus for the one that they join. These contributions, one number for each component of an entry
that changed at most, are all that is shuffled; added to the running sums they give the next codebooks. The vectors are read
and written once a round and never shuffled. The driver sees the sums alone (``entries * (width + parts)`` numbers).

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped, and so are vectors that have
another length than most (ties: the longer); that length must be a multiple of ``parts``. With fewer rows than ``entries`` codebooks are
shorter; ties of ids at the start go by vector, null ids last; repeated rows are coded each. Components saturate at 2**24
either way, after scaling. An empty table gives no rows. Other columns stay out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spent

MOST = 1 << 24
STATE = "vec_id {id}, label {label}, v binary, codes binary, error long, slots array<int>, amounts array<long>"


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * scale), -MOST, MOST).astype(np.int32)


def distances(v: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances (part, row, entry) of parts (row, part, place) to the entries (part, entry, place), exact."""
    reach = int(np.abs(v).max(initial=0)) + int(np.abs(books).max(initial=0))
    if reach * reach * v.shape[2] < 1 << 52:  # every sum below is an integer that float64 holds
        a, b = v.transpose(1, 0, 2).astype(np.float64), books.astype(np.float64)
        return ((a * a).sum(2)[:, :, None] - 2 * (a @ b.transpose(0, 2, 1)) + (b * b).sum(2)[:, None, :]).astype(np.int64)
    a, b = v.transpose(1, 0, 2).astype(np.int64), books.astype(np.int64)
    return np.stack([((a - b[:, e, None, :]) ** 2).sum(2) for e in range(b.shape[1])], 2)


def contributions(v: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """What changed parts take from and give to sums and counts: (part, entry, place and count)."""
    out = np.zeros((v.shape[1], entries, v.shape[2] + 1), np.int64)
    for p in range(v.shape[1]):
        moved = np.arange(len(v)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        side = np.zeros((entries, len(moved)))
        side[new[moved, p], np.arange(len(moved))] += 1
        if old is not None:
            side[old[moved, p], np.arange(len(moved))] -= 1
        own = v[moved, p].astype(np.float64)  # below 2**24, so that sums of a batch are exact
        out[p] = np.rint(side @ np.concatenate([own, np.ones((len(moved), 1))], 1)).astype(np.int64)
    return out


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary values of equal length as a matrix."""
    first, size = column.offset, width * np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[first : first + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, int(offsets[0])).reshape(len(column), width) if size and len(column) else np.zeros((len(column), width), kind)


class VectorCodes:
    """Codebooks in training and the table of vectors with their codes."""

    def __init__(self, vectors: DataFrame, parts: int = 8, entries: int = 16, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"):
        if not 1 <= entries <= 256:
            raise ValueError("entries must be 1 to 256, as a code is a byte")
        self.parts, self.entries, self.scale = parts, entries, scale
        x = F.col("x")
        rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
        finite = rows.where(x.isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
        most = finite.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        self.width = most.width if most else 0
        if self.width % parts:
            raise ValueError(f"vectors of {self.width} components cannot be cut into {parts} equal parts")
        kept = finite.where(F.size("x") == self.width)
        seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
        self.place = self.width // parts
        first = quantise(np.array([r.x for r in seeds], np.float64).reshape(len(seeds), self.width), scale)
        self.books = first.reshape(len(seeds), parts, self.place).transpose(1, 0, 2).astype(np.int64)
        self.entries = len(seeds)
        kinds = dict(rows.dtypes)
        self.schema = STATE.format(id=kinds["vec_id"], label=kinds["label"])
        self.state, self.sums = self._start(kept), None

    def _start(self, kept: DataFrame) -> DataFrame:
        scale, width = self.scale, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                v = quantise(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, width), scale)
                rest = [pa.array([r.tobytes() for r in v], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rest], names=["vec_id", "label", "v", "codes", "error", "slots", "amounts"])

        return kept.mapInArrow(run, self.schema)

    def assign(self, keep_vectors: bool = True) -> None:
        """Code every vector by the present codebooks; the table also gets a row of each task's contributions."""
        books, parts, place, width, entries = self.books, self.parts, self.place, self.width, self.entries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, names, kinds = np.zeros((parts, entries, place + 1), np.int64), None, None
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                names, kinds = batch.schema.names, batch.schema.types
                v = _rows(batch.column(2), np.int32, width).reshape(n, parts, place)
                old = None if batch.column(3).null_count else _rows(batch.column(3), np.uint8, parts)
                far = distances(v, books)
                new = far.argmin(2).T.astype(np.uint8)
                error = pa.array(far.min(2).sum(0), pa.int64())
                if keep_vectors:
                    total += contributions(v, old, new, entries)
                codes = pa.array([r.tobytes() for r in new], pa.binary())
                kept = batch.column(2) if keep_vectors else pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept, codes, error, batch.column(5), batch.column(6)], names=names)
            flat = total.reshape(-1)
            slots = np.flatnonzero(flat)
            if len(slots):
                row = [pa.nulls(1, k) for k in kinds[:5]] + [pa.array([slots], pa.list_(pa.int32())), pa.array([flat[slots]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, names=names)

        before, rows = self.state, self.state.where(F.col("slots").isNull())
        self.state = cut(rows.mapInArrow(run, self.schema))
        if hasattr(before, "cut_path"):
            spent(before)

    def update(self) -> None:
        """Add the contributions of the last assignment to the running sums, and take the codebooks from them."""
        pairs = self.state.where(F.col("slots").isNotNull()).select(F.explode(F.arrays_zip("slots", "amounts")).alias("p")).select(F.col("p.slots").alias("slot"), F.col("p.amounts").alias("amount"))
        before = self.sums
        self.sums = cut((pairs if before is None else before.union(pairs)).groupBy("slot").agg(F.sum("amount").alias("amount")))
        if before is not None:
            spent(before)
        flat = np.zeros(self.parts * self.entries * (self.place + 1), np.int64)
        for r in self.sums.collect():
            flat[r.slot] = r.amount
        table = flat.reshape(self.parts, self.entries, self.place + 1)
        used = table[:, :, -1] > 0
        self.books = np.where(used[:, :, None], table[:, :, :-1] // np.maximum(table[:, :, -1:], 1), self.books)

    def train(self, rounds: int) -> None:
        for _ in range(rounds):
            self.assign()
            self.update()
        self.assign(keep_vectors=False)
        if self.sums is not None:
            spent(self.sums)

    def codes(self) -> DataFrame:
        """vec_id, label, codes (a byte for each part), error."""
        return self.state.where(F.col("slots").isNull()).select("vec_id", "label", "codes", "error")

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = 6, **options) -> VectorCodes:
    codes = VectorCodes(vectors, **options)
    codes.train(rounds)
    return codes


def digest_columns(model: VectorCodes) -> DataFrame:
    """A row for each vector, with its label's error; labels are added up before they are joined."""
    rows = model.codes()
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
