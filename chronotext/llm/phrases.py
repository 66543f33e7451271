"""Collocations: frequent phrases, scored by their weakest cut.

1. Blocks: tasks number the words of about ``BLOCK_WORDS`` consecutive words of text (numbers of the block's own; 0 stands
   between pieces) and count them. The rows of a block's vocabulary, not words, are shuffled to count words per language.
2. Words with at least ``least`` occurrences get dense 32-bit ids, each language its own. Every block gets the ids of its own
   words by a join, so no dictionary is broadcast or held whole anywhere; other words become breaks.
3. For k = 2 to ``longest``: k consecutive ids are a binary key of 4k bytes. A block sorts its keys by radix and counts runs.
   Mixed keys are spread evenly, so equal slices of their range are even ranges without a sample; a block sends each range its
   keys and counts as one row. Numbers are written and travel as compressed byte planes, ascending ones as differences; which
   key stands where is not written but sorted out again at the next length. A task sorts a range by radix again and adds up its runs. Frequent keys return to the blocks that
   hold them, and a longer key is made only where both its ends are frequent, which every frequent phrase fulfils. Stretches
   without one leave the blocks.
4. All parts of a frequent phrase are frequent, so the counts of both sides of each cut are found by joins on keys.

A word or language that holds most rows is at most one row for each block before it is counted, and a key one entry.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each; an empty table
gives no phrases; very long texts are cut into slices at white space, and a block goes on beyond its bound only until a piece
ends. Other columns are ignored. Up to 2**32 - 2 frequent words can be numbered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from operator import index

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import LOWER, UPPER, cut, mix64, partitions, spent

BLOCK_WORDS, BLOCK_VOCABULARY, SLICE = 1_500_000, 500_000, 1 << 20
RANGE_WORDS = 2_000_000  # a range for each so many words: more than it gets keys
#: A-Z lower-cased, a tab as a space, piece ends as a byte that UTF-8 never holds.
BREAK = b"\xff"
TABLE = bytes.maketrans(UPPER.encode() + b"\t" + b".,;:!?\n\x0b\x0c\r", LOWER.encode() + b" " + BREAK * 10)
BLOCK = "block long, words binary, marks binary, lang string, word binary, local int, n long, range int, keys binary"


def tokens(raw: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text, in slices."""
    raw, low = raw.translate(TABLE), 0
    while low < len(raw):
        high = len(raw)
        if high - low > SLICE and (space := raw.find(b" ", low + SLICE)) >= 0:
            high = space
        yield [w for w in raw[low:high].replace(BREAK, b" \xff ").split(b" ") if w]
        low = high


def last_break(words: list[bytes]) -> int:
    """The place of the last break; -1 where there is none."""
    for i in range(len(words) - 1, -1, -1):
        if words[i] == BREAK:
            return i
    return -1


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of the rows of a uint32 matrix: a stable counting pass over each 16-bit digit that differs, last one first."""
    order = np.arange(len(keys), dtype=np.int32 if len(keys) < 1 << 31 else np.int64)
    for column in reversed(range(keys.shape[1])):
        for shift in (0, 16):
            digit = ((keys[:, column] >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, the first place of each run of equal keys in it)."""
    order = radix_order(keys)
    new = np.zeros(len(keys), bool)
    new[:1] = True
    for column in keys.T:
        ordered = column[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def packed(keys: np.ndarray) -> pa.Array:
    """Rows of ids as binary keys of equal width."""
    width = 4 * keys.shape[1]
    flat = np.ascontiguousarray(keys.astype(">u4")).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((np.arange(len(keys) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(flat)])


def squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed planes of their first, second, third and fourth bytes, after how many they are."""
    planes = np.ascontiguousarray(numbers.astype("<u4", copy=False).reshape(-1).view(np.uint8).reshape(-1, 4).T)
    return numbers.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, size).T).view("<u4").reshape(size)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The slice of the mixed keys' range that each key lies in."""
    mixed = np.zeros(len(keys), np.uint64)
    for column in keys.T:
        mixed = mix64(mixed ^ column.astype(np.uint64))
    return ((mixed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _batch(size: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "words": pa.binary(), "marks": pa.binary(), "lang": pa.string(), "word": pa.binary(), "local": pa.int32(), "n": pa.int64(), "range": pa.int32(), "keys": pa.binary()}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, kind)) for c, kind in kinds.items()], names=list(kinds))


class _Block:
    """Words of a stretch of texts, numbered from 1 as they come."""

    def __init__(self):
        self.numbers = count(1)
        self.known: dict[str, dict[bytes, int]] = {}
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        if lang not in self.known:
            self.known[lang] = defaultdict(self.numbers.__next__, {BREAK: 0})
        self.codes.append(np.fromiter(map(self.known[lang].__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def full(self, more: int) -> bool:
        return self.size + more >= BLOCK_WORDS or sum(map(len, self.known.values())) >= BLOCK_VOCABULARY

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.codes)
        n = np.bincount(codes, minlength=1)
        yield _batch(1, block=pa.array([block]), words=pa.array([squeezed(codes)], pa.binary()))
        for lang, known in self.known.items():
            del known[BREAK]
            if not (m := len(known)):
                continue
            local = np.fromiter(known.values(), np.int32, m)
            words = pa.array(list(known), pa.binary())
            yield _batch(m, block=pa.array(np.full(m, block)), lang=pa.array([lang] * m), word=words, local=pa.array(local), n=pa.array(n[local], pa.int64()))


def blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """A row with the numbered words of each block, and one for each word in it."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 33, _Block()
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for words in tokens(b"\n".join(own)):
                    end = last_break(words) if block.full(len(words)) else -1
                    block.add(lang, words[: end + 1] if end >= 0 else words)
                    if end >= 0:  # blocks end where pieces do, so that no phrase is cut
                        yield from block.rows(number)
                        number, block = number + 1, _Block()
                        block.add(lang, words[end + 1 :])
                block.add(lang, [BREAK])
        if block.size:
            yield from block.rows(number)

    return rows.mapInArrow(run, BLOCK)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with dense ids from 1, in ``order``; what the driver sees is the size of each partition."""
    sortable = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(sortable.withColumn("at", F.monotonically_increasing_id()))
    part, low = F.shiftright("at", 33), 1
    starts = []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r.part, low))
        low += r["count"]
    if low > 0xFFFFFFFF:
        raise ValueError("more frequent words than 32-bit ids")
    start = rows.sparkSession.createDataFrame(starts, "part long, low long")
    out = cut(placed.join(F.broadcast(start), part == start.part).withColumn("id", F.col("low") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "low"))
    spent(placed)
    return out


def keys_at(ends: np.ndarray) -> np.ndarray:
    """Places of the phrases both of whose ends, shorter by a word, are frequent; ``ends`` says so of each place."""
    return np.flatnonzero(ends[:-1] & ends[1:]).astype(np.int32)


def dealt(words: np.ndarray, at: np.ndarray, k: int, ranges: int) -> tuple[np.ndarray, ...]:
    """(order of the k-word keys at the places, how often each distinct one occurs, the distinct ones, their ranges, the order in which they are sent)."""
    keys = np.stack([words[at + j] for j in range(k)], 1)
    order, first = runs_of(keys)
    own = keys[order[first]]
    to = range_of(own, ranges)
    return order, np.diff(np.append(first, len(order))), own, to, np.argsort(to, kind="stable").astype(np.int32)


def shorter(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the stretches that hold a key, with a break between them, and whether a key starts there."""
    inside, marks = np.zeros(len(words), bool), np.zeros(len(words), bool)
    marks[at] = True
    for j in range(k):
        inside[at + j] = True
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the break
    return np.where(inside, words, 0)[keep].astype(np.uint32), marks[keep]


def counted_block(block: int, words: np.ndarray, ends: np.ndarray, k: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """What remains of a block at length k, and a row for each range that it has keys in: keys and counts, and the block's number of the first of them."""
    at = keys_at(ends)
    if not len(at):
        return
    _, n, own, to, by = dealt(words, at, k, ranges)
    words, marks = shorter(words, at, k)
    yield _batch(1, block=pa.array([block]), words=pa.array([squeezed(words)], pa.binary()), marks=pa.array([np.packbits(marks).tobytes()], pa.binary()))
    cut_at = np.flatnonzero(np.diff(to[by], prepend=-1))
    parts = list(zip(cut_at.tolist(), np.append(cut_at[1:], len(by)).tolist(), strict=True))
    sent = np.concatenate([own.T, n[None].astype(np.uint32)])[:, by]
    sent[0] = np.diff(sent[0], prepend=np.uint32(0))  # keys ascend in a range
    sent[0, cut_at] = own[by[cut_at], 0]
    for low in range(0, len(parts), 1000):
        some = parts[low : low + 1000]
        keys = pa.array([squeezed(sent[:, a:z]) for a, z in some], pa.binary())
        first = pa.array([a for a, _ in some], pa.int32())
        yield _batch(len(some), block=pa.array(np.full(len(some), block)), range=pa.array(to[by[[a for a, _ in some]]]), keys=keys, local=first)


def by_block(hits: DataFrame) -> DataFrame:
    """``of, pairs``: of a block's numbers (block, local, id; a null id is none) those with an id, two halves of a long each."""
    return hits.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.shiftleft(F.col("local").cast("long"), 32).bitwiseOR(F.col("id"))).alias("pairs"))


def next_blocks(held: DataFrame, hits: DataFrame, k: int, ranges: int) -> DataFrame:
    """Blocks at length k, from those before and the frequent words (k = 2) or keys in them, as :func:`by_block` gives them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        pairs = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in right["pairs"].chunks)])
        local, ids = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint32)
        for row in left.to_pylist():
            if k == 2:
                codes = unsqueezed(row["words"])
                table = np.zeros(int(max(codes.max(initial=0), local.max(initial=0))) + 1, np.uint32)
                table[local] = ids
                words = table[codes]
                ends = words > 0
            else:
                words = unsqueezed(row["words"])
                at = np.flatnonzero(np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=len(words))).astype(np.int32)
                order, n, _, _, by = dealt(words, at, k - 1, ranges)
                often, ends = np.zeros(len(n), bool), np.zeros(len(words), bool)
                often[by[local]] = True
                ends[at[order]] = np.repeat(often, n)
            out += counted_block(row["block"], words, ends, k, ranges)
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_batch(0)])

    return held.groupBy("block").cogroup(hits.groupBy("of")).applyInArrow(run, BLOCK)


def run_length_counts(rows: DataFrame, k: int, least: int, ranges: int) -> DataFrame:
    """Keys with ``least`` occurrences: ``key, n`` for each, and ``of, pairs`` (see :func:`by_block`) for each block of a range that holds some."""

    def one(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sent = [unsqueezed(r[2]).reshape(k + 1, -1) for r in held]
        sizes = [x.shape[1] for x in sent]
        local = np.concatenate([np.arange(r[3], r[3] + size, dtype=np.int64) for r, size in zip(held, sizes, strict=True)])
        for x in sent:
            x[0] = np.cumsum(x[0], dtype=np.uint32)
        sent = np.concatenate(sent, axis=1)
        keys, n = sent[:k].T, sent[k].astype(np.int64)
        order, first = runs_of(keys)
        total = np.add.reduceat(n[order], first)
        often = total >= least
        hot = np.zeros(len(keys), bool)
        hot[order] = np.repeat(often, np.diff(np.append(first, len(order))))
        found = packed(keys[order[first[often]]])
        m = len(found)
        names = ["key", "n", "of", "pairs"]
        yield pa.RecordBatch.from_arrays([found, pa.array(total[often]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))], names=names)
        blocks_, pairs, low = [], [], 0
        for r, size in zip(held, sizes, strict=True):
            mine = local[low : low + size][hot[low : low + size]]
            low += size
            if len(mine):
                blocks_.append(r[1])
                pairs.append(mine << 32)
        m = len(blocks_)
        if m:
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(blocks_, pa.int64()), pa.array(pairs, pa.list_(pa.int64()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield from one(held)
                    held = []
                held.append(row)
        if held:
            yield from one(held)

    dealt = rows.select("range", "block", "keys", "local").repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    return dealt.mapInArrow(run, "key binary, n long, of long, pairs array<long>")


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language the first ``top`` (None: all) by score, frequency and phrase."""
    if index(longest) < 2 or index(least) < 1:
        raise ValueError("longest must be 2 or more, least 1 or more")
    held = cut(blocks(docs, text_col, lang_col))
    vocabulary = held.where("word is not null")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = numbered(frequent, ["lang", "word"])
    totals = cut(totals)
    ids = words.withColumnRenamed("lang", "of").withColumnRenamed("word", "it")
    # every word of a block gets its id or none: as many rows as words of blocks, however many of them are frequent
    hits = vocabulary.join(ids, (F.col("lang") == F.col("of")) & (F.col("word") == F.col("it")), "left").select("block", "local", "id")
    hits = by_block(hits)
    # a word's key is its id, as four bytes
    levels, spare = [words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), F.col("f").alias("a"))], []
    ranges = max(partitions(docs.sparkSession), -(-(totals.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS))
    for k in range(2, longest + 1):
        after = cut(next_blocks(held.where("words is not null").select("block", "words", "marks"), hits, k, ranges))
        spent(held)
        held = after
        found = cut(run_length_counts(held.where("keys is not null"), k, least, ranges))
        hits = found.where("of is not null").groupBy("of").agg(F.flatten(F.collect_list("pairs")).alias("pairs"))
        levels.append(found.where("key is not null").select("key", F.col("n").alias("a")))
        spare.append(found)
    spent(held)
    out = cut(ranked(levels, words, totals, top))
    spent(words, totals, *spare)
    return out


def ranked(levels: list[DataFrame], words: DataFrame, totals: DataFrame, top: int | None) -> DataFrame:
    """Scores of the phrases that no longer one of the same frequency holds."""
    phrases, known = levels[1], levels[0]
    for level in levels[2:]:
        phrases = phrases.union(level)
    for level in levels[1:]:
        known = known.union(level)
    size = F.octet_length("key")
    # frequencies never grow with length, so a longer phrase of equal frequency implies one that is longer by a single word
    inner = phrases.where(size > 8).select(F.explode(F.array(F.expr("substring(key, 1, octet_length(key) - 4)"), F.expr("substring(key, 5, octet_length(key) - 4)"))).alias("key"), "a").distinct()
    kept = phrases.join(inner, ["key", "a"], "left_anti")
    cuts = kept.select("key", "a", F.explode(F.sequence(F.lit(1), (size / 4 - 1).cast("int"))).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring(key, 1, 4 * k)")).withColumn("tail", F.expr("substring(key, 4 * k + 1, octet_length(key) - 4 * k)"))
    heads = known.select(F.col("key").alias("head"), F.col("a").alias("l"))
    tails = known.select(F.col("key").alias("tail"), F.col("a").alias("r"))
    spelled = kept.select("key", F.posexplode(F.expr("transform(sequence(1, cast(octet_length(key) / 4 as int)), i -> cast(conv(hex(substring(key, 4 * i - 3, 4)), 16, 10) as long))")).alias("at", "id"))
    spelled = spelled.join(words.select("id", "word", "lang"), "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"), F.first("lang").alias("lang"))
    spelled = spelled.select("key", "lang", F.array_join("w.word", " ").alias("phrase")).join(F.broadcast(totals) if totals.count() <= 1000 else totals, "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = F.expr("cast(top div under as bigint)")
    parts = cuts.join(heads, "head").join(tails, "tail").join(spelled.select("key", "n"), "key")
    parts = parts.withColumn("top", (F.col("a").cast("decimal(18,0)") * 1000).cast("decimal(19,0)") * wide("n", 18)).withColumn("under", wide("l", 18) * wide("r", 18)).withColumn("score", score)
    best = parts.groupBy("key").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("key", "b.*")
    rows = best.drop("n").join(spelled, "key")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
