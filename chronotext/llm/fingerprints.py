"""Document fingerprints: a homomorphic multiset hash of a text's paragraph pieces, in built-in expressions only.

A text is cut into pieces: sentences within paragraphs (paragraphs alone would be too few for a likeness), the longest cut every ``PIECE`` characters. Each piece hashes to a
vector of 128 bytes, and the fingerprint is the lane-wise sum over all pieces modulo 2**32. Runs of line breaks are pieces, too. So
the order of paragraphs does not matter, equal texts have equal fingerprints, and inserting or deleting pieces adds
or subtracts their vectors (:func:`combine`), without the rest of the text.

Centred at their mean, the lanes are a random projection of the piece counts: the cosine of two sums estimates that of
the two multisets, with a standard error near 1/sqrt(128). :func:`likeness` is that cosine, never below 0, and 1 exactly
for equal fingerprints.

Defined results: null text counts as empty, whose fingerprint is all zero; two empty texts have likeness 1, an empty and
another 0; null ids sort first; rows that repeat an id follow each other by hash of text, and each takes the
next row as its next document; a single row is its own next. A text may have some 8 million pieces before a lane's sum
could leave 32 bits. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

PIECE = 120
PIECES = rf"[^\n.!?]{{1,{PIECE}}}[.!?]*|[.!?]+|\n+"
HASHES, LANES = 16, 128
_MODULUS = 1 << 32
_NULL_ID = -(1 << 63)


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def _sums(rows: DataFrame, keys: list[str], piece: str, counts: Column) -> DataFrame:
    """``keys, lanes array<long>, np`` : a row for each of the hashes of a piece, so that the code for one stays small enough to be compiled."""
    each = rows.select(*keys, counts.alias("one"), piece, F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))).alias("i"))
    h = each.select(*keys, "one", "i", F.when(F.col("one") > 0, F.xxhash64("i", piece)).otherwise(0).alias("h"))
    lane = [F.shiftrightunsigned("h", 8 * j).bitwiseAND(F.lit(0xFF)) for j in range(8)]
    summed = h.groupBy(*keys, "i").agg(*[F.sum(x).alias(f"l{j}") for j, x in enumerate(lane)], F.sum("one").alias("np"))
    names = [f"l{j}" for j in range(8)]
    lists = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("ls"), F.max("np").alias("np"))
    return lists.select(*keys, F.flatten(F.transform("ls", lambda x: F.array(*[F.pmod(x[n], F.lit(_MODULUS)) for n in names]))).alias("lanes"), "np")


def fingerprint(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys, lanes array<long>, np`` (the number of pieces) for each combination of keys; rows of equal keys add up."""
    # An empty text keeps its row through a null piece, which counts nothing.
    exploded = rows.select(*keys, F.explode(F.concat(F.array(F.lit(None).cast("string")), pieces(F.col(text_col)))).alias("piece"))
    return _sums(exploded, keys, "piece", F.col("piece").isNotNull().cast("long"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union of two multisets of pieces (or, with sign -1, of their difference)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y * sign, F.lit(_MODULUS)))


def digest(lanes: Column) -> Column:
    """The lanes' hex digest."""
    return F.sha2(F.array_join(F.transform(lanes, lambda x: F.hex(x)), ","), 256)


def _centred(lanes: Column, n: Column) -> Column:
    """Twice the lanes less their mean."""
    return F.transform(lanes, lambda x: (x * 2 - n * 255).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """0 to 1; see the module's text."""
    x, y = _centred(a, na), _centred(b, nb)
    cosine = _dot(x, y) / F.sqrt(_dot(x, x) * _dot(y, y))
    return F.when(a == b, F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), F.lit(0.0)))


def next_rows(keys: DataFrame) -> DataFrame:
    """``id, k, n`` -> with ``next_id, next_k`` and ``prev_id, prev_k, prev_n`` in ascending order, around the end.

    Sorted in ranges: each range looks ahead for itself, and a table with one row for each range joins its ends.
    """
    spark = keys.sparkSession
    parts = partitions(spark)
    ranged = keys.repartitionByRange(parts, "id", "k").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("id", "k")
    inside = ranged.select("*", F.lead(F.struct("id", "k")).over(w).alias("next"), F.lag(F.struct("id", "k", "n")).over(w).alias("prev"))
    ends = ranged.groupBy("part").agg(F.min(F.struct("id", "k")).alias("first"), F.max(F.struct("id", "k", "n")).alias("last"))
    e = Window.orderBy("part")  # one row for each range
    whole = e.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(e), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(e), F.last("last").over(whole)).alias("before"),
    )
    joined = inside.join(ends, "part").select("id", "k", "n", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))
    return joined.select("id", "k", "n", F.col("next.id").alias("next_id"), F.col("next.k").alias("next_k"), F.col("prev.id").alias("prev_id"), F.col("prev.k").alias("prev_k"), F.col("prev.n").alias("prev_n"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form and their likeness; see ``op2`` in the README for the edit."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("id").orderBy("h")
    numbered = rows.withColumn("h", F.xxhash64("text")).withColumn("k", F.row_number().over(order)).drop("h")
    keys = rows.select("id", F.xxhash64("text").alias("h"), F.char_length("text").cast("long").alias("n")).withColumn("k", F.row_number().over(order)).drop("h")
    around = next_rows(keys)

    # Joined by id alone, so that the texts keep the one partitioning that the row numbers needed; k is a residual.
    a, m = numbered.alias("a"), around.alias("m")
    here = a.join(m, (F.col("a.id") == F.col("m.id")) & (F.col("a.k") - F.col("m.k") == 0)).select("a.id", "a.k", "a.text", "m.n", "m.next_id", "m.next_k", "m.prev_id", "m.prev_k", "m.prev_n")
    heads = here.select(F.col("prev_id").alias("id"), F.col("prev_k").alias("k"), F.expr("left(text, cast(prev_n div 4 as int))").alias("head")).alias("h")
    x = here.alias("x")
    edited = x.join(heads, (F.col("x.id") == F.col("h.id")) & (F.col("x.k") - F.col("h.k") == 0)).select(
        "x.id", "x.k", "x.n", "x.next_id", "x.next_k", "text", F.concat(F.expr("left(text, cast(n - n div 4 as int))"), F.col("head")).alias("edited")
    )
    both = edited.select("id", "k", "n", "next_id", "next_k", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("v"), "text"), F.struct(F.lit(1).alias("v"), F.col("edited").alias("text")))).alias("t"))
    base = ["id", "k", "n", "next_id", "next_k", "edited_sha256"]
    side = fingerprint(both.select(*base, F.col("t.v").alias("v"), F.col("t.text").alias("text")), [*base, "v"], "text")
    per = side.groupBy(*base).agg(F.array_sort(F.collect_list(F.struct("v", "lanes", "np"))).alias("two")).select(
        *base, *[F.col("two")[v][x].alias(f"{x}{v}") for v in (0, 1) for x in ("lanes", "np")]
    )
    f, g = per.alias("f"), per.select(F.col("id").alias("gid"), F.col("k").alias("gk"), F.col("lanes0").alias("next_lanes"), F.col("np0").alias("next_np")).alias("g")
    done = f.join(g, (F.col("next_id") == F.col("gid")) & (F.col("next_k") - F.col("gk") == 0))
    return done.select(
        F.when(F.col("id") != _NULL_ID, F.col("id")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        digest(F.col("lanes0")).alias("fingerprint"),
        digest(F.col("lanes1")).alias("edited_fingerprint"),
        likeness(F.col("lanes0"), F.col("np0"), F.col("lanes1"), F.col("np1")).alias("near_edited"),
        likeness(F.col("lanes0"), F.col("np0"), F.col("next_lanes"), F.col("next_np")).alias("near_next"),
    )
