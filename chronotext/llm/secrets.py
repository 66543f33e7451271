"""Secret scans: pattern matches, and high-entropy tokens judged by how many owners in the corpus hold them.

Each text is scanned once for the base kinds (assignments, access keys, long hex runs) and for generic tokens. The values
found are hashed and counted over the whole corpus: by distinct repositories and owners, each level aggregated before
the next is shuffled, so a token that a third of all rows hold arrives as a few rows. A value that ``copied_from`` or
more owners hold, or so many repositories, is a copied example; one that a single owner holds in fewer and that looks random is live. Live generic tokens
are added to the base spans as kind ``owner``; base spans always stay, with their status counted.

Everything is built-in expressions. Positions come from the lengths of the pieces between matches, in code points.

Defined results: null text counts as empty and has no spans; a null owner or repository is one of its own; repeated rows
(ids too) are scanned one by one, but count once for an owner; a generic token that overlaps a base span is not
added. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("assign", "access", "hex", "owner")
#: Fixed patterns; letters of the assignment's names match in either case (A-Z only), group 2 is the value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short cannot hold a longer match, so the least length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
GENERIC = r"[A-Za-z0-9+/_-]{20,}={0,2}"


def _matches(text: Column, pattern: str, group: int, kind: int) -> Column:
    """All leftmost non-overlapping matches: array of (start, kind, end, value); value is the named group."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(whole, lambda m: F.char_length(m)).alias("len"), F.transform(between, lambda p: F.char_length(p)).alias("gap"), value.alias("value"))
    empty = F.lit(None).cast("array<struct<start:int,kind:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + F.coalesce(s["gap"], F.lit(0))
        end = at + F.coalesce(s["len"], F.lit(0))
        found = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), s["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(s["len"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(found))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(start["out"])


def _looks_random(value: Column) -> Column:
    """Letters and digits, and many different characters for its length."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def scan_secrets(docs: DataFrame, owner_col: str, repo_cols: list[str], id_col: str = "doc_id", text_col: str = "text", copied_from: int = 3) -> DataFrame:
    """``row_id, doc_id, text_hash, base_spans, all_spans, n_live, n_copied`` for every row.

    Spans are arrays of (start, kind, end) by start, then kind; the strings and digests derive from them.
    """
    found = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(owner_col).cast("string"), F.lit("\0"))).alias("owner"),
        F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repo_cols]).alias("repo"),
        F.xxhash64(text_col).alias("text_hash"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = found.select(
        "row_id", "doc_id", "text_hash", "owner", "repo",
        F.concat(F.filter(_matches(F.col("text"), ASSIGN, 2, 0), lambda m: F.char_length(m["value"]) >= 8), _matches(F.col("text"), ACCESS, 0, 1), _matches(F.col("text"), HEX, 0, 2)).alias("base"),
        _matches(F.col("text"), GENERIC, 0, 3).alias("generic"),
    )
    apart = F.filter("generic", lambda g: _looks_random(g["value"]) & ~F.exists("base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])))
    found = cut(found.select("row_id", "doc_id", "text_hash", "owner", "repo", "base", apart.alias("generic")))

    each = found.select("row_id", "owner", "repo", F.explode(F.concat("base", "generic")).alias("m")).select(
        "row_id", "owner", "repo", "m.start", "m.kind", "m.end", F.sha2("m.value", 256).alias("hash"), _looks_random(F.col("m.value")).alias("random")
    )
    held = (
        each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    )
    judged = each.join(cut(held), "hash")  # both sides are plain shuffles, so that a hot value is split
    copied = (F.col("owners") >= copied_from) | (F.col("repos") >= copied_from)
    live = F.col("random") & (F.col("owners") == 1) & ~copied
    status = judged.where((F.col("kind") < 3) | live).groupBy("row_id").agg(
        F.collect_list(F.when((F.col("kind") == 3) & live, F.struct("start", "kind", "end"))).alias("added"),
        F.sum(live.cast("long")).alias("n_live"), F.sum(copied.cast("long")).alias("n_copied"),
    )
    plain = lambda a: F.transform(a, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.join(status, "row_id", "left").select(
        "row_id", "doc_id", "text_hash",
        F.array_sort(plain("base")).alias("base_spans"),
        F.array_sort(F.concat(plain("base"), F.coalesce("added", none))).alias("all_spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def span_string(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", name(m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def digest_columns(scanned: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base_spans", lambda m: m["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(span_string(F.col("base_spans")), 256).alias("base_sha256"), span_string(F.col("all_spans")).alias("spans"), "n_live", "n_copied",
    )


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of :func:`scan_secrets` replaced by ``[SECRET]``; overlapping spans become one."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)

    def step(acc: Column, m: Column) -> Column:
        fresh = m["start"] >= acc["at"]
        piece = F.substring(text, acc["at"] + 1, F.greatest(m["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece, F.lit("[SECRET]"))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    # Only texts with spans; those with equal id and text have equal spans.
    spans = scanned.where(F.size("all_spans") > 0).select(key("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("all_spans").alias("__spans")).dropDuplicates(["__id", "__hash"])
    joined = docs.join(spans, (key(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNotNull(), clean).otherwise(text)).drop("__id", "__hash", "__spans")
