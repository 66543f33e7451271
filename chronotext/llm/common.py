"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_ROWS = 2_000
_own_dir: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most ``BATCH_ROWS`` rows at a time from here on in the session: whole texts may be long, and a worker keeps the memory that it once took."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def word_bytes(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text in UTF-8 (which bytes.split and bytes.lower treat by exactly the ASCII rules wanted here); null or empty text has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def words_of(text: str | None, lower: bool = False) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in word_bytes(text, lower)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one on a single machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return f"file://{_own_dir[0]}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def spent(*frames: DataFrame) -> None:
    """Delete the folders of frames from :func:`cut` that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _give_back() -> None:
    """What a task has freed goes back to the system, as the worker waits for others beside those that run."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """A function over batches whose worker gives memory back once its task ends."""

    def outer(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return outer


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, remembered for the words seen most recently (a bounded memory, not a bounded vocabulary)."""

    def __init__(self, keep: int = 400_000):
        self.keep, self.known = keep, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.keep:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            of = xxhash.xxh3_64_intdigest
            for i, h in enumerate(found):
                if h is None:
                    known[words[i]] = found[i] = of(words[i])
        return np.fromiter(found, np.uint64, len(found))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 256


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (of the same rule as :func:`word_bytes`) and how many words each text has.

    All words take in their next eight bytes at once; words of at most eight bytes and of one length never collide.
    """
    raw = b" " + b" ".join(texts) + b" " * 9
    gap = _SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    at, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    words = np.diff(at.searchsorted(ends + 1), prepend=0)
    h = mix64(size, 31)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        import xxhash

        h[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i] + size[i]])
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    rows = np.flatnonzero(size <= LONG_WORD)
    at, left = at[rows], size[rows]
    while len(rows):
        h[rows] = mix64(h[rows] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)]), 37)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return h, words


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words: their hashes times odd numbers, one for each place, added and mixed."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h += word_hashes[j : j + m] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    return mix64(h)
