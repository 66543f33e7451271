"""Analytics of chat and gift logs (``rec_id, ord, t_ms, kind, term, cents`` rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patterns import occurring


def ranked_terms(weighted: DataFrame, k: int = 20, least: int = 2, stop: tuple[str, ...] = ()) -> DataFrame:
    """``rec_id, term, score, rank`` of ``rec_id, term, weight, first``: the best 4k are taken first, then filtered, then k; ties by first use."""
    n = weighted.groupBy("rec_id", "term").agg(F.sum("weight").cast("long").alias("score"), F.min("first").alias("first"))
    order = Window.partitionBy("rec_id").orderBy(F.desc("score"), "first")
    top = n.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 4 * k)
    ok = (F.col("score") >= least) & ~F.col("term").rlike("^[0-9]+$") & F.length("term").between(2, 12)
    if stop:
        ok &= ~F.col("term").isin(*stop)
    return top.where(ok).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("rec_id", "term", "score", "rank")


def hotwords(log: DataFrame, k: int = 20, least: int = 2, stop: tuple[str, ...] = ()) -> DataFrame:
    """Weighted terms per recording: a chat term counts 1, a gift's 2."""
    return ranked_terms(log.select("rec_id", "term", F.when(F.col("kind") == "chat", 1).otherwise(2).alias("weight"), F.col("ord").alias("first")), k, least, stop)


def log_hotwords(log: DataFrame, words: Column, k: int = 60, least: int = 2, stop: tuple[str, ...] = ()) -> DataFrame:
    """The same for a log with senders and texts (``rec_id, ord, kind, user_name, text, gift``): a chat's sender counts 3, each of its ``words`` 1, a gift's name 2, its sender 2."""
    chat = log.where("kind = 'chat'")
    at = lambda i: F.struct(F.col("kind") != "chat", "ord", i.cast("int"))
    row = lambda t, term, w, i: t.select("rec_id", term.alias("term"), F.lit(w).alias("weight"), at(i).alias("first")).where("term <> ''")
    said = chat.select("*", F.posexplode(words).alias("__i", "__w"))
    gifts = log.where("kind <> 'chat'")
    parts = [row(chat, F.trim("user_name"), 3, F.lit(0)), row(said, F.col("__w"), 1, F.col("__i") + 1), row(gifts, F.col("gift"), 2, F.lit(0)), row(gifts, F.col("user_name"), 2, F.lit(1))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ranked_terms(every, k, least, stop)


def top_sender(log: DataFrame, by: str, sender: str) -> DataFrame:
    """The most frequent sender; of equals, the one seen first."""
    n = log.groupBy(by, sender).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return n.groupBy(by).agg(F.max_by(F.struct(sender, "n"), F.struct("n", -F.col("first"))).alias("m")).select(by, f"m.{sender}", "m.n")


def log_summary(log: DataFrame) -> DataFrame:
    kind = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}")
    return log.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), *[kind(k) for k in ("chat", "gift", "sc", "guard")], F.max("t_ms").alias("duration_ms"), F.sum(F.when(F.col("kind") != "chat", F.col("cents")).otherwise(0)).cast("long").alias("cents"))


def merge_logs(logs: list[DataFrame]) -> DataFrame:
    """Union of sources; chat of the same tenth of a second and text counts once (the first source's), gifts all stay."""
    rows = None
    for i, log in enumerate(logs):
        rows = log.withColumn("src", F.lit(i)) if rows is None else rows.unionByName(log.withColumn("src", F.lit(i)))
    tenth = F.rint(F.col("t_ms") / 100).cast("long")
    chat = rows.where("kind = 'chat'").withColumn("tenth", tenth)
    first = chat.groupBy("rec_id", "tenth", "term").agg(F.min_by(F.struct(*[c for c in rows.columns]), F.struct("src", "ord")).alias("x")).select("x.*")
    return first.unionByName(rows.where("kind <> 'chat'")).drop("src")


def merged_headers(headers: list[DataFrame], fields: list[str]) -> DataFrame:
    """``rec_id`` and each field's first value that is not empty, in the sources' order."""
    rows = None
    for i, h in enumerate(headers):
        one = h.select("rec_id", F.lit(i).alias("src"), *fields)
        rows = one if rows is None else rows.unionByName(one)
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("src")))
    return rows.groupBy("rec_id").agg(*[F.coalesce(first(c), F.lit("")).alias(c) for c in fields])


def prompt_terms(sources: list[DataFrame]) -> DataFrame:
    """``rec_id, terms`` of ``rec_id, rank, term`` sources: ordered union, each term where it comes first."""
    rows = None
    for i, s in enumerate(sources):
        one = s.select("rec_id", F.struct(F.lit(i), F.col("rank").cast("long")).alias("at"), "term")
        rows = one if rows is None else rows.unionByName(one)
    first = rows.where("term <> ''").groupBy("rec_id", "term").agg(F.min("at").alias("at"))
    return first.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]), " ").alias("terms"))


def song_titles(requests: DataFrame, chat: DataFrame, titles: DataFrame, norm) -> DataFrame:
    """``rec_id, titles``: requested names in order (``rec_id, at, name``), then the library's titles (``ord, title``) that a chat text contains.

    A recording's chat texts are counted once each, and pass through one automaton of all titles; ``ord`` is a title's own.
    """
    asked = requests.where("name <> ''").groupBy("rec_id", F.col("name").alias("title")).agg(F.min(F.struct(F.lit(0), F.col("at").cast("long"))).alias("at"))
    said = chat.select("rec_id", norm(F.col("text")).alias("n")).distinct()
    known = titles.select("ord", "title", norm(F.col("title")).alias("t")).where("t <> ''")
    numbered = known.withColumn("pid", F.col("ord").cast("long"))
    hits = occurring(said, ["rec_id"], "n", numbered, "pid", "t").distinct()
    found = hits.join(numbered.select("pid", "ord", "title"), "pid").groupBy("rec_id", "title").agg(F.min(F.struct(F.lit(1), F.col("ord").cast("long"))).alias("at"))
    both = asked.unionByName(found).groupBy("rec_id", "title").agg(F.min("at").alias("at"))
    return both.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]), "|").alias("titles"))
