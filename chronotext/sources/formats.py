"""Readers and writers of subtitle, lyric and log files, as expressions over whole texts or lines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ass_time, lrc_time, parse_time, srt_time

STAMP = r"(\d+:\d+:\d+[.,]\d{1,3}|\d+:\d+[.,]\d{1,3})\s*-->\s*(\d+:\d+:\d+[.,]\d{1,3}|\d+:\d+[.,]\d{1,3})"


#: Fixed value: rows that name who made a song.
CREDIT = r"^(?i)\s*(作词|作曲|编曲|制作人|演唱|原唱|词|曲|OP|SP|出品|监制|统筹|混音|母带)\s*[:：\-]\s*.{0,40}$"


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """SRT or VTT files: ``path, line_idx, start_ms, end_ms, text``."""
    return parse_subtitles(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), "path", "value")


def parse_subtitles(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks between blank lines; the rows after the first time stamp are the text; blocks without one are skipped. Sorted by time."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")
    rows = subtitle_fields(texts.select(key, F.posexplode(F.split(clean, r"\n[ \t]*\n+")).alias("ord", "b")), [key, "ord"])
    w = Window.partitionBy(key).orderBy("start_ms", "end_ms", "ord")
    return rows.withColumn("line_idx", (F.row_number().over(w) - 1).cast("long")).select(key, "line_idx", "start_ms", "end_ms", "text")


def subtitle_fields(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start_ms, end_ms, text`` of the blocks ``b`` that hold a time stamp."""
    stamp = lambda i: parse_time(F.regexp_extract("b", STAMP, i))
    body = F.trim(F.regexp_extract("b", rf"(?s){STAMP}[^\n]*\n?(.*)$", 3), F.lit("\n"))
    return blocks.where(F.col("b").rlike(STAMP)).select(*keys, stamp(1).alias("start_ms"), stamp(2).alias("end_ms"), body.alias("text"))


def parse_lrc(rows: DataFrame, key: str, row: str, ord_col: str) -> DataFrame:
    """Lyric rows with one or more leading stamps, each a line of its own; metadata and empty rows go."""
    lead = r"^((?:\[\d+:\d+(?:[.:]\d{1,3})?\])+)"
    stamps = F.regexp_extract_all(F.regexp_extract(row, lead, 1), F.lit(r"\[(\d+:\d+(?:[.:]\d{1,3})?)\]"), F.lit(1))
    text = F.trim(F.regexp_replace(row, lead, ""))
    t = rows.where(F.col(row).rlike(lead)).select(key, F.col(ord_col).alias("ord"), F.explode(stamps).alias("s"), text.alias("text")).where("text <> ''")
    ms = parse_time(F.regexp_replace("s", r":(\d{1,3})$", ":$1"))
    w = Window.partitionBy(key).orderBy("t_ms", "ord")
    return t.select(key, "ord", ms.alias("t_ms"), "text").withColumn("line_idx", (F.row_number().over(w) - 1).cast("long")).select(key, "line_idx", "t_ms", "text")


def parse_plain(rows: DataFrame, key: str, row: str, ord_col: str, credit: str = CREDIT) -> DataFrame:
    """Lyric rows without stamps, metadata and credits."""
    text = F.trim(F.regexp_replace(row, r"\[[^\]]*\]", ""))
    return rows.select(key, F.col(ord_col).alias("line_idx"), text.alias("text")).where((F.col("text") != "") & ~F.col("text").rlike(credit))


# Fixed values of the log format: guard names by level, and the name of a paid message.
GUARDS = {"1": "总督", "2": "提督", "3": "舰长"}
PAID = "醒目留言"


def unescaped(t: Column) -> Column:
    """The five named entities of XML."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return t


def parse_log_xml(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Chat, gift, paid and guard nodes by pattern, so that a file cut short still gives its complete nodes.

    ``key, ord, t, kind, user_id, user_name, text, gift, count, price``, ``ord`` counting by time from 0; a bad number counts as 0,
    a missing or zero count as 1; chat without text goes.
    """
    nodes = F.regexp_extract_all(text, F.lit(r"(?s)<(d|gift|sc|guard)\b[^>]*?(?:/>|>.*?</\1>)"), F.lit(0))
    rows = log_fields(texts.select(key, F.posexplode(nodes).alias("at", "n")), [key, "at"])
    ord_ = (F.row_number().over(Window.partitionBy(key).orderBy("t", "at")) - 1).cast("long")
    return rows.withColumn("ord", ord_).select(key, "ord", *rows.columns[2:])


def log_fields(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, t, kind, user_id, user_name, text, gift, count, price`` of the nodes ``n``; chat without text goes."""
    attr = lambda name: F.nullif(unescaped(F.regexp_extract("n", rf'\b{name}="([^"]*)"', 1)), F.lit(""))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    tag, p = F.regexp_extract("n", r"^<(\w+)", 1), F.split(attr("p"), ",")
    body = unescaped(F.regexp_extract("n", r"(?s)^<[^>]*>(.*)</\w+>$", 1))
    guard = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in GUARDS.items() for x in pair]), F.coalesce(attr("level"), F.lit("3"))), F.lit(GUARDS["3"]))
    return nodes.select(
        *keys, F.when(tag == "d", number(F.get(p, F.lit(0)))).otherwise(number(attr("ts"))).alias("t"), F.when(tag == "d", "chat").otherwise(tag).alias("kind"),
        F.when(tag == "d", F.get(p, F.lit(6))).otherwise(attr("uid")).alias("user_id"), attr("user").alias("user_name"), F.trim(body).alias("text"),
        F.when(tag == "gift", attr("giftname")).when(tag == "sc", F.lit(PAID)).when(tag == "guard", guard).alias("gift"),
        F.coalesce(F.nullif(number(attr("giftcount")).cast("long"), F.lit(0)), F.lit(1)).alias("count"), number(attr("price")).alias("price"),
    ).where((F.col("kind") != "chat") | (F.col("text") != ""))


def parse_log_json(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Lenient JSON lines: alternative names for kind, time, text and user; a bad time counts as 0; bad rows and chat without text are skipped."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(line, f"$.{n}"), F.lit("")) for n in names], F.lit(""))
    kind = F.upper(pick("type", "cmd"))
    paid = kind.contains("GIFT") | kind.contains("SUPER") | kind.contains("GUARD")
    name = F.when(paid & kind.contains("SUPER"), "sc").when(paid, "gift").otherwise("chat")
    user = pick("uname", "user_name", "username", "nickname", "name", "user.name", "user.uname", "user")
    out = rows.where(F.get_json_object(line, "$").isNotNull() & F.col(line).rlike(r"^\s*\{")).select(
        key, F.coalesce(pick("time", "timestamp", "ts").try_cast("double"), F.lit(0.0)).alias("t"), name.alias("kind"), pick("text", "content", "msg").alias("text"), user.alias("user_name")
    )
    return out.where((F.col("kind") != "chat") | (F.col("text") != ""))


def number_lines(rows: DataFrame) -> DataFrame:
    """Drops empty lines and numbers the rest from 1 per recording."""
    return rows.where("text <> ''").withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms", "line_idx")).cast("long"))


def srt_blocks(rows: DataFrame, prefix: Column | None = None) -> DataFrame:
    text = F.concat(prefix, F.col("text")) if prefix is not None else F.col("text")
    return number_lines(rows).select("rec_id", "n", F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), text).alias("block"))


def vtt_blocks(rows: DataFrame) -> DataFrame:
    voice = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("<v "), "speaker", F.lit(">"))).otherwise("")
    return number_lines(rows).select("rec_id", "n", F.concat(srt_time(F.col("start_ms"), "."), F.lit(" --> "), srt_time(F.col("end_ms"), "."), F.lit("\n"), voice, "text").alias("block"))


def lrc_rows(rows: DataFrame) -> DataFrame:
    return number_lines(rows).select("rec_id", "n", F.concat(F.lit("["), lrc_time(F.col("start_ms")), F.lit("]"), "text").alias("block"))


def ass_events(rows: DataFrame, stretch_ms: int = 1000, gap_ms: int = 50) -> DataFrame:
    """Karaoke events; a line lasts to just before the next when the gap is at most ``stretch_ms``; words share its time evenly."""
    t = number_lines(rows)
    nxt = F.lead("start_ms").over(Window.partitionBy("rec_id").orderBy("n"))
    gap = nxt - F.col("end_ms")
    t = t.withColumn("__e", F.when((gap > 0) & (gap <= stretch_ms), nxt - gap_ms).otherwise(F.col("end_ms")))
    t = t.withColumn("__w", F.split("text", " ")).withColumn("__k", F.size("__w"))
    words = F.col("__w")
    span = F.col("end_ms") - F.col("start_ms")
    cs = lambda ms: F.floor((ms + 5) / 10)
    at = lambda i: F.col("start_ms") + F.floor(span * i / F.col("__k"))
    parts = F.transform(words, lambda w, i: F.concat(F.lit("{\\k"), F.greatest(F.lit(1), cs(F.when(i + 1 == F.col("__k"), F.col("__e")).otherwise(at(i + 1))) - cs(at(i))).cast("string"), F.lit("}"), w))
    return t.select("rec_id", "n", F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("__e")), F.lit(",Default,,0,0,0,,"), F.array_join(parts, " ")).alias("block"))


def documents(blocks: DataFrame, sep: str = "\n\n", head: str = "", tail: str = "\n") -> DataFrame:
    """One text per recording from its numbered blocks."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), sep)
    return blocks.groupBy("rec_id").agg(F.concat(F.lit(head), joined, F.lit(tail)).alias("text"))


def write_texts(texts: DataFrame, path: str) -> None:
    """One row of text per recording, in a folder ``rec_id=...`` of its own as partitioned tables have it, of any store that pyarrow opens.

    A partitioned write takes some 20 ms for each small file, so tasks write the files themselves: a file counts once it has its name, which a second try of
    its task gives again.
    """
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at)
    store.delete_dir_contents(at)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = fs.FileSystem.from_uri(path)
        task, seen = TaskContext.get(), Counter()
        for pdf in batches:
            for rec, text in zip(pdf["rec"], pdf["text"], strict=True):
                folder = f"{at}/rec_id={'__HIVE_DEFAULT_PARTITION__' if rec is None else quote(rec, safe=' ')}"
                name = f"part-{task.partitionId():05d}-{seen[rec]}.txt"
                seen[rec] += 1
                store.create_dir(folder)
                with store.open_output_stream(draft := f"{folder}/_{name}.{task.taskAttemptId()}") as out:
                    out.write(f"{text or ''}\n".encode())
                store.move(draft, f"{folder}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    texts.select(F.col("rec_id").cast("string").alias("rec"), "text").mapInPandas(write, "n long").agg(F.sum("n")).collect()
