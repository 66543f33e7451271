"""Matching of lines with lyrics and passages, and correction of lines by evidence."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.scalars import longest_common, matching_blocks
from ..functions.text import normal_alnum
from ..sources.folders import written
from .matched import Parts, matched_with

LEAST_CHARS, LYRIC_BLOCK, BUCKETS = 3, 5_000, 64


MATRIX_BITS = 1 << 22  # beyond it a pair's matrix of equal characters is not laid out
PART_CHARS = 1 << 16  # parts of a text are compared so many characters at a time
LOOKED_UP = 24  # up to this length the shorter part's runs are looked up in the longer one


class CharRows:
    """A text prepared for :func:`matched_chars`: for each of its characters, where it stands, as a row of bits.

    ``rare``: as ``difflib`` does by default, in a text of 200 characters or more those that make up over a hundredth of it begin no match, but extend one.
    """

    def __init__(self, text: str, rare: bool = False):
        self.extends = rare and len(text) >= 200
        self.text, self.width = text, len(text) // 8 + 1  # a bit is left free, so that no diagonal runs on in the next row
        at: dict[str, int] = {}
        for j, c in enumerate(text):
            at[c] = at.get(c, 0) | 1 << j
        if self.extends:
            at = {c: x for c, x in at.items() if x.bit_count() <= len(text) // 100 + 1}
        self.rows = {c: x.to_bytes(self.width, "little") for c, x in at.items()}
        self.none, self.ones = bytes(self.width), ((1 << len(text)) - 1).to_bytes(self.width, "little")


def _unmatched(text: str, masks: dict[str, int], full: int, width: np.ndarray) -> np.ndarray:
    """Of rows of bits that lie side by side, how many characters a longest common subsequence with the text leaves out; ``masks``: where a character stands, ``width``: bytes of each row."""
    v = full
    for c in text:
        if hit := v & masks[c]:
            v = (v + hit | v ^ hit) & full
    ends = np.cumsum(width)
    left = np.bitwise_count(np.frombuffer(v.to_bytes(int(ends[-1]), "little"), np.uint8)).astype(np.int64)
    return np.add.reduceat(left, np.concatenate([[0], ends[:-1]]))


def common_lengths(text: str, rows: list[CharRows]) -> np.ndarray:
    """The longest common subsequence of a text with each of the rows; matching blocks never hold more.

    The rows lie side by side in one whole number, a bit for each character (see ``scalars.lcs_length``); what a row carries over ends in its free bit.
    """
    if not rows:
        return np.zeros(0, np.int64)
    masks = {c: int.from_bytes(b"".join([r.rows.get(c, r.none) for r in rows]), "little") for c in set(text)}
    full = int.from_bytes(b"".join([r.ones for r in rows]), "little")
    return np.array([len(r.text) for r in rows]) - _unmatched(text, masks, full, np.array([r.width for r in rows]))


def matched_chars(a: str, b: str, need: float = 0.0, prepared: CharRows | None = None) -> int:
    """Characters in matching blocks (the longest first, then what lies on either side of it); -1 as soon as ``need`` is out of reach.

    The matrix of equal characters is one whole number. And-ing it with itself, shifted by a diagonal step each time, leaves after k steps
    the starts of common runs of k + 1; the lowest bit left is the first longest run. In short parts runs are looked up instead.
    """
    n, m = len(a), len(b)
    left = min(n, m)
    if left < need:
        return -1
    r = prepared or CharRows(b)
    if n * m > MATRIX_BITS:
        return _matched_long(a, b, need) if not r.extends else sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
    get, none, stride = r.rows.get, r.none, 8 * r.width
    matrix, ones, total, regions = None, None, 0, [(0, n, 0, m)]
    while regions:
        a0, a1, b0, b1 = regions.pop()
        short = min(a1 - a0, b1 - b0)
        left -= short
        if short <= LOOKED_UP and not r.extends:
            i, j, size = longest_common(a[a0:a1], b[b0:b1])
            if not size:
                if total + left < need:
                    return -1
                continue
            total, i, j = total + size, i + a0, j + b0
            if (x := min(i - a0, j - b0)) > 0:
                regions.append((a0, i, b0, j))
                left += x
            if (x := min(a1 - i, b1 - j) - size) > 0:
                regions.append((i + size, a1, j + size, b1))
                left += x
            if total + left < need:
                return -1
            continue
        if a1 - a0 == n and b1 - b0 == m:
            if matrix is None:
                matrix = int.from_bytes(b"".join([get(c, none) for c in a]), "little")
            runs = matrix
        else:
            if ones is None:
                ones = int.from_bytes((b"\x01" + none[1:]) * n, "little")
            runs = (matrix >> a0 * stride) & (((1 << b1) - (1 << b0)) * (ones & (1 << (a1 - a0) * stride) - 1))
        i, j, size = a0, b0, 0
        if runs:
            size, moved = 1, runs >> stride + 1
            while longer := runs & moved:
                runs, size, moved = longer, size + 1, moved >> stride + 1
            i, j = divmod((runs & -runs).bit_length() - 1, stride)
            i += a0
        if r.extends:
            while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
                size += 1
        if not size:
            if total + left < need:
                return -1
            continue
        total += size
        for part in ((a0, i, b0, j), (i + size, a1, j + size, b1)):
            if (x := min(part[1] - part[0], part[3] - part[2])) > 0:
                regions.append(part)
                left += x
        if total + left < need:
            return -1
    return total


def _matched_long(a: str, b: str, need: float) -> int:
    """The same for long texts."""
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    regions, total, left = [(0, len(a), 0, len(b))], 0, min(len(a), len(b))
    while regions:
        a0, a1, b0, b1 = regions.pop()
        left -= min(a1 - a0, b1 - b0)
        i, j, n = m.find_longest_match(a0, a1, b0, b1)
        if not n:
            if total + left < need:
                return -1
            continue
        total += n
        for part in ((a0, i, b0, j), (i + n, a1, j + n, b1)):
            if (size := min(part[1] - part[0], part[3] - part[2])) > 0:
                regions.append(part)
                left += size
        if total + left < need:
            return -1
    return total


def similarity(a: str, b: str, least: float = 0.0, prepared: CharRows | None = None) -> float:
    """Of N2 forms: 0 for an empty one, 1 for containment, else the matched characters over the shorter of ``a`` and the mean length; 4 places. May be 0 where it is below ``least``."""
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return 1.0
    base = min(len(a), (len(a) + len(b)) / 2)
    need = (least - 1e-4) * base
    return round(max(0, matched_chars(a, b, need, prepared)) / base, 4)


def similarities(texts: list[str], others: list[str], least: float) -> np.ndarray:
    """:func:`similarity` of pairs, with ``least``: each of the others is prepared once, and a text meets the common subsequences of all its others at once."""
    ready = {b: CharRows(b) for b in set(others)}
    out, pairs = np.zeros(len(texts)), {}
    for i, t in enumerate(texts):
        pairs.setdefault(t, []).append(i)
    for t, mine in pairs.items():
        mine = [i for i in mine if t and others[i]]
        size, held = np.array([len(others[i]) for i in mine]), common_lengths(t, [ready[others[i]] for i in mine])
        may = (held >= (least - 1e-4) * np.minimum(len(t), (size + len(t)) / 2)) | (held == np.minimum(size, len(t)))  # alike, or one holds the other
        for i in np.array(mine, np.int64)[may].tolist():
            out[i] = similarity(t, others[i], least, ready[others[i]])
    return out


def matched_table(texts: list[str], others: list[str], parts: Parts, live: np.ndarray, top: int, base: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """:func:`matched.matched_with` of any texts: what is too much at once is halved, and a pair alone matched by itself. ``parts``: of the others."""
    if not live.any():
        return np.zeros(live.shape, np.int64)
    got = matched_with(texts, parts, live, True, top, base, floor)
    if got is not None:
        return got
    if len(texts) > 1:
        h = len(texts) // 2
        return np.concatenate([matched_table(texts[x], others, parts, live[x], top, base[x], floor[x]) for x in (slice(0, h), slice(h, None))])
    if len(others) > 1:
        h = len(others) // 2
        return np.concatenate([matched_table(texts, others[x], Parts.of(others[x]), live[:, x], top, base[:, x], floor) for x in (slice(0, h), slice(h, None))], axis=1)
    need = (floor[0] - 1e-4) * base[0, 0]
    return np.array([[max(0, matched_chars(texts[0], others[0], need))]])


@F.pandas_udf(DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])


def ratio(a: str, b: str) -> float:
    """Twice the matched characters over both lengths, as ``difflib`` has it (see ``CharRows``)."""
    return 2.0 * matched_chars(a, b, prepared=CharRows(b, rare=True)) / (len(a) + len(b)) if a or b else 1.0


def closest_part(long_text: str, target: str) -> str:
    """The part of a text that is as long as the target and most like it (the first of equals); parts that cannot beat the best so far are left early.

    Many parts are matched together, unless ``difflib`` would have characters that begin no match.
    """
    n = len(target)
    if len(long_text) <= n:
        return long_text
    ready, best, at, many = CharRows(target, rare=True), -1, 0, max(1, PART_CHARS // max(1, n))
    for i in range(0, len(long_text) - n + 1, many):
        first = np.arange(i, min(i + many, len(long_text) - n + 1))
        got = matched_with([target], Parts(long_text[i : int(first[-1]) + n], first - i, np.full(len(first), n)), None, False, 1, None, np.array([max(best, 0)])) if n and not ready.extends else None
        if got is not None:
            k = int(got[0].argmax())
            if got[0, k] > best:
                best, at = int(got[0, k]), int(first[k])
            continue
        for k in first.tolist():
            if (x := matched_chars(long_text[k : k + n], target, best + 1, ready)) > best:
                best, at = x, k
                if best == n:
                    return long_text[at : at + n]
    return long_text[at : at + n]


def closest_parts(long_texts: list[str], targets: list[str]) -> list[str]:
    """:func:`closest_part` of pairs, some at a time."""
    out, some, chars = [""] * len(targets), [], 0

    def compare() -> None:
        size = np.array([len(targets[i]) for i in some], np.int64)
        many = np.array([len(long_texts[i]) for i in some], np.int64) - size + 1
        ends, at = np.cumsum(many), np.cumsum(many + size - 1) - many - size + 1
        first = np.arange(int(ends[-1])) + np.repeat(at - ends + many, many)
        own = np.repeat(np.arange(len(some)), many)
        got = matched_with([targets[i] for i in some], Parts("".join(long_texts[i] for i in some), first, size[own]), own == np.arange(len(some))[:, None], False)
        for k, i in enumerate(some):
            if got is None:
                out[i] = closest_part(long_texts[i], targets[i])
            else:
                x = int(got[k, ends[k] - many[k] : ends[k]].argmax())
                out[i] = long_texts[i][x : x + int(size[k])]

    for i, (long_text, target) in enumerate(zip(long_texts, targets, strict=True)):
        n = len(target)
        parts = n * (len(long_text) - n + 1)
        if n >= len(long_text) or not 0 < n < 200 or parts > PART_CHARS:
            out[i] = closest_part(long_text, target)
            continue
        if some and chars + parts > PART_CHARS:
            compare()
            some, chars = [], 0
        some.append(i)
        chars += parts
    if some:
        compare()
    return out


@F.pandas_udf(StringType())
def closest_udf(long_text: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series(closest_parts(long_text.fillna("").tolist(), target.fillna("").tolist()), dtype=object)


def _common_with_parts(text: str, codes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The longest common subsequence of a text with each of some parts of one width of another text, given by its codes; a part may run over the end."""
    stride = width // 8 + 1
    parts = np.concatenate([codes, np.full(width, 2**32 - 1, np.uint32)])[first[:, None] + np.arange(width)]

    def laid(bits: np.ndarray) -> int:
        rows = np.zeros((len(first), stride), np.uint8)
        packed = np.packbits(bits, axis=1, bitorder="little")
        rows[:, : packed.shape[1]] = packed
        return int.from_bytes(rows.tobytes(), "little")

    return width - _unmatched(text, {c: laid(parts == ord(c)) for c in set(text)}, laid(np.ones(parts.shape, bool)), np.full(len(first), stride))


def may_be_like_part(text: str, long_text: str, least: float) -> bool:
    """Whether any part of ``long_text`` that is as long as ``text`` has a ratio of ``least`` with it.

    Wider and wider parts hold several of them: what has too little in common with such a part is left at once, halves of the others are looked at.
    """
    n, codes = len(text), np.frombuffer(long_text.encode("utf-32-le", "surrogatepass"), np.uint32)
    need, step, last = least * n - 1e-6, 1 << max(0, n.bit_length() - 4), len(long_text) - n
    first = np.arange(0, last + 1, step)
    while True:
        width = n + step - 1
        many = max(1, PART_CHARS // width)
        first = np.concatenate([x[_common_with_parts(text, codes, x, width) >= need] for x in np.split(first, range(many, len(first), many))])
        if step == 1 or not len(first):
            break
        step //= 2
        first = np.stack([first, first + step], axis=1).ravel()
        first = first[first <= last]
    parts = (long_text[k : k + n] for k in first.tolist())
    return any(matched_chars(text, part, need, CharRows(part, rare=True)) >= need for part in parts)


def evidence_part(text: str, said: str, least: float) -> tuple[str, float]:
    """The part of what was said that is compared with a line, and its ratio (0 where it is below ``least``)."""
    part = len(said) > 1.8 * len(text)
    if not text or (part and not may_be_like_part(text, said, least)) or (not part and abs(len(said) - len(text)) > max(4, len(text) // 2)):
        return said, 0.0
    said = closest_part(said, text) if part else said
    if said == text:
        return said, 1.0
    both, ready = len(text) + len(said), CharRows(said, rare=True)
    need = least * both / 2 - 1e-6
    if common_lengths(text, [CharRows(said)])[0] < need:
        return said, 0.0
    return said, 2.0 * max(0, matched_chars(text, said, need, ready)) / both


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def shingles(text: Column, n: int) -> Column:
    """Distinct runs of n words (all words, if fewer): shifted copies of the word list, side by side."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    runs = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(F.size(w) - n + 1, F.lit(0))).alias(f"w{i}") for i in range(n)])
    joined = F.transform(runs, lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(n)]))
    return F.array_distinct(F.when(F.size(w) >= n, joined).otherwise(F.array(F.array_join(w, " "))))


def containing(passages: DataFrame, texts: DataFrame, n: int = 5) -> DataFrame:
    """``item_id, doc_id``: the texts that contain a passage as it stands. Candidates share the passage's second word run (its first word may be cut by what precedes it)."""
    w = F.filter(F.split("passage", r"\s+"), lambda x: x != "")
    p = passages.select("item_id", F.col("text").alias("passage")).withColumn("key", F.xxhash64(F.array_join(F.slice(w, 2, n), " ")))
    # Hashes of word runs travel, texts only for the candidates.
    t = texts.select("doc_id", F.explode(F.array_distinct(F.transform(shingles(F.col("text"), n), lambda x: F.xxhash64(x)))).alias("key"))
    pairs = t.join(p.select("key", "item_id"), "key").select("item_id", "doc_id").distinct()
    return texts.select("doc_id", "text").join(pairs, "doc_id").join(p.drop("key"), "item_id").where(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id").distinct()


# ---- keywords ----


def keyword_map(keywords: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """(written form in N2, word) in dictionary order; of equal forms the later word counts, in the first one's place."""
    n2 = lambda t: "".join(c for c in t if c.isalnum()).lower()
    out: dict[str, str] = {}
    for word, aliases in keywords:
        for t in (word, *aliases):
            if n2(t):
                out[n2(t)] = word
    return list(out.items())


def correct_by_keywords(lines: DataFrame, keywords: list[tuple[str, list[str]]], least: float = 0.72) -> DataFrame:
    """``lines`` with ``fixed`` and ``changed``: a known wrong form in a line becomes its word (the last that applies counts); else a line that is
    like a whole word (similarity of ``least``, lengths within 4) becomes it. The dictionary is a stated list, of a size to ship with the plan."""
    text, n2 = F.col("text"), normal_alnum(F.coalesce("text", F.lit("")))
    forms = [(f, w) for f, w in keyword_map(keywords) if f != "".join(c for c in w if c.isalnum()).lower()]
    fixed = text
    if forms:
        zero = F.struct(text.alias("fixed"), n2.alias("n2"))

        def step(acc: Column, k: Column) -> Column:
            hit = acc["n2"].contains(k["form"]) & ~text.contains(k["word"]) & text.contains(k["form"])
            new = F.replace(text, k["form"], k["word"])
            return F.struct(F.when(hit, new).otherwise(acc["fixed"]).alias("fixed"), F.when(hit, normal_alnum(new)).otherwise(acc["n2"]).alias("n2"))

        fixed = F.aggregate(F.array(*[F.struct(F.lit(f).alias("form"), F.lit(w).alias("word")) for f, w in forms]), zero, step, lambda acc: acc["fixed"])
    words = [("".join(c for c in w if c.isalnum()).lower(), w) for w in sorted({w for w, _ in keywords})]

    @F.pandas_udf(StringType())
    def whole_word(texts: pd.Series) -> pd.Series:
        def best(t: str | None) -> str | None:
            near = [(similarity(t, n), -i) for i, (n, _) in enumerate(words) if abs(len(n) - len(t or "")) <= 4] if t else []
            top = max(near, default=(0.0, 0))
            return words[-top[1]][1] if top[0] >= least else None

        return texts.map(best)

    long = F.length(n2) >= 2
    out = lines.withColumn("fixed", F.when(long, fixed).otherwise(text))
    out = out.withColumn("fixed", F.when(long & (F.col("fixed") == text), F.coalesce(whole_word(n2), text)).otherwise(F.col("fixed")))
    return out.withColumn("changed", F.col("fixed") != text)


# ---- chat evidence ----


def phrase_counts(evidence: DataFrame) -> DataFrame:
    """``rec_id, phrase, n``: chat texts of 3 to 12 letters in N2 form, gift names, and names of senders twice, of ``rec_id, kind, text, gift, user_name``."""
    said = evidence.where("kind = 'chat'").select("rec_id", normal_alnum(F.col("text")).alias("phrase"), F.lit(1).alias("n")).where(F.length("phrase").between(LEAST_CHARS, 12))
    gifts = evidence.where("gift <> ''").select("rec_id", normal_alnum(F.col("gift")).alias("phrase"), F.lit(1).alias("n"))
    names = evidence.where("user_name <> ''").select("rec_id", normal_alnum(F.col("user_name")).alias("phrase"), F.lit(2).alias("n"))
    return said.unionByName(gifts).unionByName(names).groupBy("rec_id", "phrase").agg(F.sum("n").cast("long").alias("n"))


def _evidence(least: float):
    @F.pandas_udf(StructType([StructField("part", StringType()), StructField("score", DoubleType())]))
    def run(text: pd.Series, said: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([evidence_part(t, c, least) for t, c in zip(text, said, strict=True)], columns=["part", "score"])

    return run


def said_near(lines: DataFrame, evidence: DataFrame, known: DataFrame, width_ms: int = 12_000) -> DataFrame:
    """``rec_id, line_idx, text, nt, kind, said, nc, at, opened``: each line with the evidence in time buckets within one and a half widths of its start that may count.

    What is no paid text or gift's name must be a ``known`` phrase (``rec_id, part``): where a recording has none as long as the part that is compared, there is no pair.
    """
    bucket = (F.rint(F.col("t_ms") / width_ms) * width_ms).cast("long")
    said = evidence.where("text <> ''").select("rec_id", bucket.alias("bucket"), F.when(F.col("kind") == "chat", "chat").otherwise("sc").alias("kind"), F.col("text").alias("said"), F.struct(F.col("kind") != "chat", "ord", F.lit(0)).alias("at"))
    gifts = evidence.where("gift <> ''").select("rec_id", bucket.alias("bucket"), F.lit("gift").alias("kind"), F.col("gift").alias("said"), F.struct(F.lit(True), "ord", F.lit(1)).alias("at"))
    pool = said.unionByName(gifts).withColumn("nc", normal_alnum(F.col("said"))).where(F.length("nc") >= F.when(F.col("kind") == "gift", 2).otherwise(LEAST_CHARS))
    # Of what a bucket holds many times over, the first counts.
    pool = written(pool.groupBy("rec_id", "bucket", "kind", "said", "nc").agg(F.min("at").alias("at")), "said")  # read twice
    pool = pool.join(pool.groupBy("rec_id", "bucket").agg(F.min("at").alias("opened")), ["rec_id", "bucket"]).where(F.length("nc") >= LEAST_CHARS)
    first, last = F.ceil((F.col("start_ms") - 1.5 * width_ms) / width_ms).cast("long"), F.floor((F.col("start_ms") + 1.5 * width_ms) / width_ms).cast("long")
    near = lines.select("rec_id", "line_idx", "text", normal_alnum(F.col("text")).alias("nt"), F.explode(F.sequence(first, last)).alias("bucket")).where(F.length("nt") >= LEAST_CHARS).withColumn("bucket", F.col("bucket") * width_ms)
    sizes = known.groupBy("rec_id").agg(F.collect_set(F.length("part")).alias("sizes"))
    size = F.when(F.length("nc") > 1.8 * F.length("nt"), F.length("nt")).otherwise(F.length("nc"))
    pairs = near.join(sizes, "rec_id", "left").join(pool, ["rec_id", "bucket"])
    return pairs.where(F.col("kind").isin("sc", "gift") | F.array_contains("sizes", size)).drop("sizes", "bucket")


def correct_by_chat(lines: DataFrame, evidence: DataFrame, width_ms: int = 12_000, low: float = 0.55, high: float = 0.985, least: int = 2) -> DataFrame:
    """``rec_id, line_idx, text, fixed, score, kind``: each line's best evidence, from ``rec_id, ord, t_ms, kind, text, gift, user_name``.

    Evidence lies near the line (see :func:`said_near`), is alike but not equal, and is a paid text or a gift's name or
    counts ``least`` in :func:`phrase_counts`. A recording of 20 lines or more of which over half would change is left alone.
    """
    known = written(phrase_counts(evidence).where(F.col("n") >= least).select("rec_id", F.col("phrase").alias("part"), F.lit(True).alias("known")), "known")  # read twice
    # Not deterministic, so that the filter on the score stays where it is: else parts are found twice, and before the pairs are dealt out.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = said_near(lines, evidence, known, width_ms).repartition(parts, "rec_id", "line_idx", "said")
    c = c.withColumn("e", _evidence(low).asNondeterministic()("nt", "nc")).where((F.col("e.score") >= low) & (F.col("e.score") < high))
    c = c.withColumn("part", F.col("e.part")).join(known, ["rec_id", "part"], "left").where(F.col("kind").isin("sc", "gift") | F.col("known"))
    w = Window.partitionBy("rec_id", "line_idx").orderBy(F.desc("e.score"), "opened", "at")
    best = c.withColumn("r", F.row_number().over(w)).where("r = 1").select("rec_id", "line_idx", "text", F.trim("said").alias("fixed"), F.round("e.score", 4).alias("score"), "kind")
    best = written(best.where(normal_alnum(F.col("fixed")) != normal_alnum(F.col("text"))), "told")  # counted, and read again
    share = lines.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_lines")).join(best.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_fixed")), "rec_id")
    ok = share.where(~((F.col("n_lines") >= 20) & (2 * F.col("n_fixed") > F.col("n_lines")))).select("rec_id")
    return best.join(ok, "rec_id", "left_semi")


# ---- lyrics ----


def subtitle_rows(lines: DataFrame) -> DataFrame:
    """``rec_id, line_idx, n2, start_ms, end_ms`` of the lines with three letters or digits or more."""
    return lines.select("rec_id", "line_idx", normal_alnum(F.col("text")).alias("n2"), "start_ms", "end_ms").where(F.length("n2") >= LEAST_CHARS)


def line_windows(rows: DataFrame, most: int = 3) -> DataFrame:
    """``rec_id, first, last, wtext``: each run of 1 to ``most`` neighbouring rows."""
    w = Window.partitionBy("rec_id").orderBy("line_idx")
    part = F.array(*[F.struct(F.lead("line_idx", k).over(w).alias("last"), F.lead("n2", k).over(w).alias("t")) for k in range(most)])
    runs = rows.select("rec_id", F.col("line_idx").alias("first"), part.alias("p")).select("rec_id", "first", "p", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    runs = runs.where(F.get("p", F.col("k") - 1)["last"].isNotNull())
    return runs.select("rec_id", "first", F.get("p", F.col("k") - 1)["last"].alias("last"), F.array_join(F.transform(F.slice("p", F.lit(1), F.col("k")), lambda x: x["t"]), "").alias("wtext"))


def _histograms(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.int16)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS, minlength=BUCKETS)
    return out


def window_scores(windows: DataFrame, lyrics: DataFrame, least: float = 0.55) -> DataFrame:
    """``rec_id, first, last, wlen, doc, lyric_idx, llen, score`` of the windows and lyric rows (``doc, lyric_idx, n2``) that are alike.

    The lyric rows are the stated set: blocks of ``LYRIC_BLOCK`` of them are broadcast, and all windows run against each. An automaton finds the rows that
    a window holds. Of the other pairs within the length band, those whose lengths, common characters or common subsequence (of a window with all its rows
    at once) cannot reach the score are left out; the score decides on the rest.
    """
    spark = windows.sparkSession
    numbered = lyrics.where(F.length("n2") >= LEAST_CHARS)
    blocks = -(-numbered.count() // LYRIC_BLOCK)
    out = "rec_id long, first long, last long, wlen int, doc long, lyric_idx long, llen int, score double"
    found = None
    windows = windows.select("rec_id", "first", "last", "wtext").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rec_id", "first", "last")
    for b in range(blocks):
        mine = numbered.where(F.pmod(F.xxhash64("doc", "lyric_idx"), F.lit(blocks)) == b).select("doc", "lyric_idx", "n2").collect()
        shared = spark.sparkContext.broadcast([(r["doc"], r["lyric_idx"], r["n2"]) for r in mine])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            if not shared.value:
                return
            rows = sorted(shared.value, key=lambda r: len(r[2]))
            texts = [r[2] for r in rows]
            ready = [CharRows(t) for t in texts]
            held, size = _histograms(texts), np.array([len(t) for t in texts])
            equal: dict[str, list[int]] = {}
            for k, t in enumerate(texts):
                equal.setdefault(t, []).append(k)
            inside = ahocorasick.Automaton()
            for t, own in equal.items():
                inside.add_word(t, own)
            inside.make_automaton()
            for pdf in batches:
                got = []
                for rec, first, last, t, h in zip(pdf["rec_id"], pdf["first"], pdf["last"], pdf["wtext"], _histograms(pdf["wtext"].tolist()), strict=True):
                    n = len(t)
                    low, high = np.searchsorted(size, n - max(10, n)), np.searchsorted(size, n + max(10, n), "right")
                    found = {k: 1.0 for _, own in inside.iter(t) for k in own if low <= k < high}
                    need = (least - 1e-4) * np.minimum(n, (size[low:high] + n) / 2)
                    near = low + np.flatnonzero(size[low:high] >= need)
                    near = near[np.minimum(held[near], h).sum(1) >= need[near - low]]
                    near = np.array([k for k in near.tolist() if k not in found], np.int64)
                    near = near[common_lengths(t, [ready[k] for k in near]) >= need[near - low]]
                    found |= {k: s for k in near.tolist() if (s := similarity(t, texts[k], least, ready[k])) >= least}
                    got += [(rec, first, last, n, *rows[k][:2], len(texts[k]), s) for k, s in sorted(found.items())]
                yield pd.DataFrame(got, columns=[c.split(" ")[0] for c in out.split(", ")])

        part = windows.mapInPandas(run, out)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], out)


def assign_lyrics(scores: DataFrame, lyrics: DataFrame, top: int = 8, back: int = 30) -> DataFrame:
    """``doc, rec_id, lyric_idx, line_idx, merged_to, score``: lyric rows placed on windows, in lyric order.

    Each row keeps its ``top`` best windows (score to two places, then closeness of length, then place); it takes the first whose line no row
    has taken and, unless its text came before in the document, that is not more than ``back`` lines behind the last one placed.
    """
    two = F.floor(F.col("score") * 100 + 0.5)
    w = Window.partitionBy("doc", "rec_id", "lyric_idx").orderBy(F.desc(two), F.abs(F.col("wlen") - F.col("llen")), "first", "last")
    best = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).join(lyrics.select("doc", "lyric_idx", "n2"), ["doc", "lyric_idx"])
    order = ["doc", "rec_id", "lyric_idx", "r"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = row = None
        lines, texts, furthest = set(), set(), -1
        for pdf in batches:
            got = []
            for x in pdf.itertuples(index=False):
                if (x.doc, x.rec_id) != at:
                    at, row, lines, texts, furthest = (x.doc, x.rec_id), None, set(), set(), -1
                if x.lyric_idx != row:
                    row, repeat, placed = x.lyric_idx, x.n2 in texts, False
                    texts.add(x.n2)
                if placed or x.first in lines or (not repeat and x.first < furthest - back):
                    continue
                placed = True
                lines.add(x.first)
                furthest = furthest if repeat else max(furthest, x.first)
                got.append((x.doc, x.rec_id, x.lyric_idx, x.first, x.last, x.score))
            yield pd.DataFrame(got, columns=["doc", "rec_id", "lyric_idx", "line_idx", "merged_to", "score"])

    dealt = best.select(*order, "first", "last", "score", "n2").repartition("doc", "rec_id").sortWithinPartitions(*order)
    return dealt.mapInPandas(place, "doc long, rec_id long, lyric_idx long, line_idx long, merged_to long, score double")


def dedupe_by_line(matches: DataFrame) -> DataFrame:
    """The best match of each window, then of each line (of equals the first lyric row)."""
    for keys in (["doc", "rec_id", "line_idx", "merged_to"], ["doc", "rec_id", "line_idx"]):
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "lyric_idx", "merged_to")
        matches = matches.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return matches


def match_reports(placed: DataFrame, gap: int = 6) -> DataFrame:
    """Score of each document against each recording: its best run of placed lines, runs ending where lines are over ``gap`` apart."""
    w = Window.partitionBy("doc", "rec_id").orderBy("line_idx")
    run = F.sum(F.when(F.col("line_idx") - F.lag("line_idx").over(w) > gap, 1).otherwise(0)).over(w)
    r = placed.withColumn("run", run).groupBy("doc", "rec_id", "run").agg(F.avg("score").alias("avg"), F.count(F.lit(1)).alias("n"))
    full = F.least(F.lit(1.0), F.col("n") / 3)
    best = r.groupBy("doc", "rec_id").agg(F.max_by(F.struct("avg", "n"), F.struct(F.col("avg") * full, -F.col("run"))).alias("b"), F.sum("n").alias("n_matches"))
    return best.select("doc", "rec_id", F.round(F.col("b.avg") * (0.7 + 0.3 * F.least(F.lit(1.0), F.col("b.n") / 3)), 4).alias("score"), "n_matches")


def best_documents(reports: DataFrame) -> DataFrame:
    """``rec_id, doc, score``: each recording's document with the largest score, the first of equals."""
    return reports.groupBy("rec_id").agg(F.max_by(F.struct("doc", "score"), F.struct("score", -F.col("doc"))).alias("b")).select("rec_id", "b.doc", "b.score")


def titled(docs: DataFrame, titles: list[str]) -> DataFrame:
    """The documents whose title equals, contains or lies in one of the stated titles, in N2 form; all of them without titles."""
    n2 = normal_alnum(F.col("title"))
    wanted = [t for t in ("".join(c for c in x if c.isalnum()).lower() for x in titles) if t]
    hit = F.lit(not wanted)
    for t in wanted:
        hit = hit | n2.contains(t) | F.lit(t).contains(n2)
    return docs.where(hit)


def lyric_plans(lines: DataFrame, matches: DataFrame, lyrics: DataFrame, least: float = 0.75, alike: float = 0.45) -> DataFrame:
    """``rec_id, line_idx, last, fixed, end_ms``: which runs of lines become which lyric row.

    Of the matches with a score of ``least`` in line order: lines are used once, and so is each lyric text; it must be no shorter than
    what it replaces, not equal to it, and alike (``alike`` or more).
    """
    m = matches.where(F.col("score") >= least).select("rec_id", "doc", "lyric_idx", F.col("line_idx").alias("first"), F.greatest("merged_to", "line_idx").alias("last"))
    m = m.join(lyrics.select("doc", "lyric_idx", F.trim("text").alias("fixed"), normal_alnum(F.col("text")).alias("nf")), ["doc", "lyric_idx"])
    each = m.withColumn("line_idx", F.explode(F.sequence("first", "last"))).join(lines.select("rec_id", "line_idx", "text", "end_ms"), ["rec_id", "line_idx"])
    old = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "")
    whole = each.groupBy("rec_id", "first", "last", "fixed", "nf").agg(normal_alnum(old).alias("old"), F.max_by("end_ms", "line_idx").alias("end_ms"))
    ok = whole.where((F.col("nf") != "") & (F.length("nf") >= F.length("old")) & (F.col("nf") != F.col("old"))).where(similarity_udf("old", "nf") >= alike)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rec, until, texts = None, -1, set()
        for pdf in batches:
            keep = []
            for r, first, last, nf in zip(pdf["rec_id"], pdf["first"], pdf["last"], pdf["nf"], strict=True):
                if r != rec:
                    rec, until, texts = r, -1, set()
                free = first > until and nf not in texts
                keep.append(free)
                if free:
                    until = last
                    texts.add(nf)
            yield pdf.loc[np.array(keep, bool), ["rec_id", "first", "last", "fixed", "end_ms"]]

    dealt = ok.select("rec_id", "first", "last", "fixed", "end_ms", "nf").repartition("rec_id").sortWithinPartitions("rec_id", "first", "last", "fixed")
    return dealt.mapInPandas(choose, "rec_id long, first long, last long, fixed string, end_ms long").withColumnRenamed("first", "line_idx")


def apply_plans(lines: DataFrame, plans: DataFrame) -> DataFrame:
    """``rec_id, line_idx, start_ms, end_ms, text``: a planned run becomes one line with its lyric; the rest stays. Numbered anew."""
    gone = plans.withColumn("line_idx", F.explode(F.sequence(F.col("line_idx"), F.col("last")))).select("rec_id", "line_idx", "last", F.lit(True).alias("in_run"))
    heads = plans.select("rec_id", "line_idx", "fixed", F.col("end_ms").alias("plan_end"))
    t = lines.join(gone, ["rec_id", "line_idx"], "left").join(heads, ["rec_id", "line_idx"], "left").where(F.col("in_run").isNull() | F.col("fixed").isNotNull())
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("line_idx")) - 1
    return t.select("rec_id", n.cast("long").alias("line_idx"), "start_ms", F.coalesce("plan_end", "end_ms").alias("end_ms"), F.coalesce("fixed", "text").alias("text"))


def match_lyrics(lines: DataFrame, lyrics: DataFrame, least: float = 0.55) -> DataFrame:
    """Windows, scores and placing in one: the matches of every document with every recording. ``lyrics``: ``doc, lyric_idx, text``."""
    normal = lyrics.select("doc", "lyric_idx", normal_alnum(F.col("text")).alias("n2"))
    return dedupe_by_line(assign_lyrics(window_scores(line_windows(subtitle_rows(lines)), normal, least), normal))


def post_correct(lines: DataFrame, keywords: list[tuple[str, list[str]]], evidence: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Keywords first, then chat evidence, then the best document's lyrics; each sees what the last one left. ``rec_id, line_idx, start_ms, end_ms, text``.

    What several steps read is written, so that nothing is matched twice.
    """
    plain = ["rec_id", "line_idx", "start_ms", "end_ms", "text"]
    one = written(correct_by_keywords(lines.select(plain), keywords).withColumn("text", F.col("fixed")).select(plain), "keyed")
    told = correct_by_chat(one, evidence).select("rec_id", "line_idx", "fixed")
    two = written(one.join(told, ["rec_id", "line_idx"], "left").withColumn("text", F.coalesce("fixed", "text")).select(plain), "corrected")
    matches = written(match_lyrics(two, lyrics), "matches")
    mine = matches.join(best_documents(match_reports(matches)).select("rec_id", "doc"), ["rec_id", "doc"], "left_semi")
    return apply_plans(two, written(lyric_plans(two, mine, lyrics), "plans"))


def in_stages(lines: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, dict[str, str]]:
    """Stages one after the other, each written before the next begins: one that fails is left out, and what it said is returned by its name; the others go on from what was there."""
    failed: dict[str, str] = {}
    for name, stage in stages:
        try:
            lines = written(stage(lines), name)
        except Exception as why:  # noqa: BLE001  whatever a stage's job dies of, the lines before it are good
            failed[name] = f"{type(why).__name__}: {why}"
    return lines, failed


def isolated_correct(lines: DataFrame, keywords: list[tuple[str, list[str]]], evidence: DataFrame, lyrics: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """:func:`post_correct` whose stages fail by themselves: the lines, and the stages that failed."""
    plain = ["rec_id", "line_idx", "start_ms", "end_ms", "text"]

    def by_words(t: DataFrame) -> DataFrame:
        return correct_by_keywords(t, keywords).withColumn("text", F.col("fixed")).select(plain)

    def by_chat(t: DataFrame) -> DataFrame:
        told = correct_by_chat(t, evidence).select("rec_id", "line_idx", "fixed")
        return t.join(told, ["rec_id", "line_idx"], "left").withColumn("text", F.coalesce("fixed", "text")).select(plain)

    def by_lyrics(t: DataFrame) -> DataFrame:
        matches = match_lyrics(t, lyrics)
        mine = matches.join(best_documents(match_reports(matches)).select("rec_id", "doc"), ["rec_id", "doc"], "left_semi")
        return apply_plans(t, lyric_plans(t, mine, lyrics))

    return in_stages(lines.select(plain), [("keywords", by_words), ("chat", by_chat), ("lyrics", by_lyrics)])


# ---- evidence for line breaks ----


def lyric_hints(atoms: list[str], lyric: list[str]) -> list[int]:
    """The atoms (in N2 form) before which a lyric row begins, as places of the atoms that end a line; never the first or last."""
    full, words = "".join(atoms), [x for x in lyric if x]
    if len(full) < LEAST_CHARS or not words:
        return []
    starts = set(np.cumsum([0, *map(len, words)])[:-1].tolist())
    at = np.cumsum([0, *map(len, atoms)])[:-1].tolist()
    to = {i + k: j + k for i, j, size in matching_blocks(full, "".join(words)) for k in range(size)}
    ends = [i - 1 for i in range(1, len(atoms)) if to.get(at[i]) in starts]
    return [i for i in ends if 0 < i < len(atoms) - 1]


def chat_hints(atoms: list[str], said: list[str]) -> list[int]:
    """The atoms that end where a chat text ends within their joined text; never the last."""
    full = "".join(atoms)
    end_of: dict[int, int] = {}
    for i, e in enumerate(np.cumsum([len(a) for a in atoms]).tolist()):
        end_of.setdefault(e, i)
    out = set()
    for t in {x for x in said if len(x) >= LEAST_CHARS} if len(full) >= LEAST_CHARS else ():
        at = full.find(t)
        while at >= 0:
            i = end_of.get(at + len(t))
            if i is not None and i < len(atoms) - 1:
                out.add(i)
            at = full.find(t, at + len(t))
    return sorted(out)


def _hint_udf(f):
    @F.pandas_udf(ArrayType(IntegerType()))
    def run(atoms: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([f(list(a), list(o) if o is not None else []) for a, o in zip(atoms, other, strict=True)])

    return run


def boundary_hints(atoms: DataFrame, lyrics: DataFrame, chat: DataFrame, window_ms: int = 12_000) -> DataFrame:
    """``atoms`` with ``hint``: 2 before a lyric row of the stretch's document (``rec_id, block, lyric_idx, text``), 1 after a chat text said near it (``rec_id, t_ms, text``), else 0."""
    own = [c for c in atoms.columns if c not in ("rec_id", "block", "pos")]
    w = atoms.groupBy("rec_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", normal_alnum(F.col("text")).alias("t"), F.struct(*own).alias("own")))).alias("a"), F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    texts = F.transform("a", lambda x: x["t"])
    lyr = lyrics.groupBy("rec_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("lyric_idx", normal_alnum(F.col("text")).alias("t")))), lambda x: x["t"]).alias("lyric"))
    near = w.select("rec_id", "block", "s", "e").join(chat.select("rec_id", "t_ms", normal_alnum(F.col("text")).alias("t")), "rec_id").where(F.col("t_ms").between(F.col("s") - window_ms, F.col("e") + window_ms))
    said = near.groupBy("rec_id", "block").agg(F.collect_set("t").alias("said"))
    both = w.join(lyr, ["rec_id", "block"], "left").join(said, ["rec_id", "block"], "left")
    both = both.select("rec_id", "block", "a", _hint_udf(lyric_hints)(texts, F.col("lyric")).alias("ly"), _hint_udf(chat_hints)(texts, F.col("said")).alias("ch"))
    place = both.select("rec_id", "block", F.posexplode("a").alias("i", "x"), "ly", "ch")
    hint = F.when(F.array_contains("ly", F.col("i")), 2).when(F.array_contains("ch", F.col("i")), 1).otherwise(0)
    return place.select("rec_id", "block", "x.pos", "x.own.*", hint.alias("hint"))


def library_lookup(wanted: DataFrame, docs: DataFrame, least: float = 0.7) -> DataFrame:
    """``want_id, doc, tier``: for ``want_id, title, artist``, the document of equal title and artist, else the first of equal title, else the title most alike."""
    n2 = lambda c: normal_alnum(F.coalesce(F.col(c), F.lit("")))
    d = docs.select("doc", F.col("title").alias("dt"), n2("title").alias("t"), n2("artist").alias("a"))
    w = wanted.select("want_id", "title", n2("title").alias("t"), n2("artist").alias("a"))
    exact = w.join(d.select("doc", "t", "a"), ["t", "a"]).select("want_id", F.lit(1).alias("tier"), "doc", F.lit(1.0).alias("score"))
    same = w.join(d.select("doc", F.col("dt").alias("title")), "title").select("want_id", F.lit(2).alias("tier"), "doc", F.lit(1.0).alias("score"))
    found = exact.unionByName(same)
    rest = w.where("t <> ''").join(found.select("want_id").distinct(), "want_id", "left_anti")
    scored = window_scores(rest.select(F.col("want_id").alias("rec_id"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), F.col("t").alias("wtext")), d.select("doc", F.lit(0).cast("long").alias("lyric_idx"), F.col("t").alias("n2")), least)
    alike = scored.select(F.col("rec_id").alias("want_id"), F.lit(3).alias("tier"), "doc", "score")
    w1 = Window.partitionBy("want_id").orderBy("tier", F.desc("score"), "doc")
    return found.unionByName(alike).withColumn("r", F.row_number().over(w1)).where("r = 1").select("want_id", "doc", "tier")


def longest_hit_run(hits: list[float], least: float = 0.6) -> list[int]:
    """Places of the longest run of lines with a hit ratio of ``least``, one miss between two allowed; the first of equals."""
    runs: list[list[int]] = []
    for i in [i for i, h in enumerate(hits) if h >= least]:
        if runs and i - runs[-1][-1] <= 2:
            runs[-1].append(i)
        else:
            runs.append([i])
    return max(runs, key=len, default=[])
