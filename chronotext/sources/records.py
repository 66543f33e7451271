"""Readers of logs, lyric files, line JSON, recognition responses and word lists, as expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import decode_udf, tokens_udf
from ..functions.text import once
from .formats import parse_log_json, parse_log_xml, parse_lrc, parse_plain

# Fixed values.
LRC_META = r"^(?i)\[(ti|ar|al|by|offset|re|ve|length|au):.*\]\s*$"
STAMPS = r"[<\[]\d{1,2}:\d{2}(?:[:.]\d{1,3})?[>\]]"
INFO_TAG = "BililiveRecorderRecordInfo"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole files, whatever their encoding."""
    return spark.read.format("binaryFile").load(path).select("path", decode_udf("content").alias("text"))


def record_info(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, streamer, title, room_id, start_time`` from a log's first header node; empty where it has none."""
    node = F.regexp_extract(text, rf"<{INFO_TAG}\b[^>]*>", 0)
    attr = lambda name: F.trim(F.regexp_extract(node, rf'\b{name}="([^"]*)"', 1))
    return texts.select(key, attr("name").alias("streamer"), attr("title").alias("title"), attr("roomid").alias("room_id"), attr("start_time").alias("start_time"))


def repaired_xml(text: Column) -> Column:
    """A log cut short: its header and complete nodes, wrapped anew."""
    nodes = F.regexp_extract_all(text, F.lit(r"(?s)<(d|gift|sc|guard)\b[^>]*?(?:/>|>.*?</\1>)"), F.lit(0))
    return F.concat(F.lit("<i>"), F.regexp_extract(text, rf"<{INFO_TAG}\b[^>]*/?>", 0), F.array_join(nodes, ""), F.lit("</i>"))


def parse_logs(texts: DataFrame) -> DataFrame:
    """``path, t, kind, user_name, text`` of ``path, text`` files by extension: XML logs and JSON lines; other files give nothing."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    shown = ["path", "t", "kind", "user_name", "text"]
    rows = texts.where(ext.isin("jsonl", "json")).select("path", F.explode(F.split("text", r"\r?\n")).alias("row"))
    return parse_log_xml(texts.where(ext == "xml"), "path", "text").select(shown).unionByName(parse_log_json(rows, "path", "row").select(shown))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(read_texts(spark, path))


def _rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("ord", "row")).withColumn("row", F.trim("row"))


def title_artist(path: Column) -> Column:
    """``title, artist`` of a lyric file's name, artist first where a dash parts two names."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    out = F.struct(F.trim(stem).alias("title"), F.lit("").alias("artist"))
    for dash in ("—", "–", "-", " - "):  # the last that applies wins
        at = F.instr(stem, dash)
        a, b = F.trim(F.substring(stem, F.lit(1), at - 1)), F.trim(F.substring(stem, at + len(dash), F.length(stem)))
        out = F.when((at > 0) & (a != "") & (b != ""), F.struct(b.alias("title"), a.alias("artist"))).otherwise(out)
    return out


def lyric_documents(files: DataFrame) -> DataFrame:
    """``path, title, artist, synced, lines array<struct<text, t_ms>>`` of ``path, text``: stamped rows if a file has any, else its plain ones."""
    rows = _rows(files, "path", "text").where(~F.col("row").rlike(LRC_META))
    stamped = parse_lrc(rows, "path", "row", "ord").select("path", "line_idx", "text", "t_ms", F.lit(True).alias("synced"))
    plain = rows.where("row <> ''").select("path", F.col("ord").cast("long").alias("line_idx"), F.col("row").alias("text"), F.lit(None).cast("long").alias("t_ms"), F.lit(False).alias("synced"))
    every = stamped.unionByName(plain).groupBy("path", "synced").agg(F.array_sort(F.collect_list(F.struct("line_idx", "text", "t_ms"))).alias("l"))
    best = every.groupBy("path").agg(F.max_by(F.struct("synced", "l"), "synced").alias("b"))
    lines = F.coalesce(F.transform("b.l", lambda x: F.struct(x["text"].alias("text"), x["t_ms"].alias("t_ms"))), F.expr("cast(array() as array<struct<text:string,t_ms:bigint>>)"))
    return files.select("path", title_artist(F.col("path")).alias("n")).join(best, "path", "left").select("path", "n.title", "n.artist", F.coalesce("b.synced", F.lit(False)).alias("synced"), lines.alias("lines"))


def lyric_rows(files: DataFrame) -> DataFrame:
    """Plain rows without credits: ``path, line_idx, text``."""
    return parse_plain(_rows(files, "path", "text").where(~F.col("row").rlike(LRC_META)), "path", "row", "ord")


def lyric_tokens(files: DataFrame) -> DataFrame:
    """``path, line_idx, tokens`` of rows without stamps and metadata that have a token."""
    rows = _rows(files, "path", "text").withColumn("row", F.trim(F.regexp_replace("row", STAMPS, "")))
    return rows.where((F.col("row") != "") & ~F.col("row").rlike(LRC_META)).select("path", F.col("ord").alias("line_idx"), tokens_udf("row").alias("tokens")).where(F.size("tokens") > 0)


LINE = "struct<lines:array<struct<start:double,end:double,text:string,speaker:string,low_confidence:boolean,style:map<string,string>,words:array<struct<text:string,start:double,end:double>>>>>"


def parse_line_json(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_idx, start_ms, end_ms, text, speaker, words`` of line JSON: words with text, else one for the line; lines with neither go."""
    rows = texts.select(key, F.posexplode(F.from_json(text, LINE)["lines"]).alias("line_idx", "l"))
    ms = lambda s: F.floor(s * 1000 + 0.5).cast("long")
    timed = lambda w: F.struct(w["text"].alias("text"), ms(F.coalesce(w["start"], F.lit(0.0))).alias("start_ms"), ms(F.coalesce(w["end"], F.lit(0.0))).alias("end_ms"))
    own = F.transform(F.filter(F.col("l.words"), lambda w: F.coalesce(w["text"], F.lit("")) != ""), timed)
    words = F.when(F.size(own) > 0, own).when(F.coalesce("l.text", F.lit("")) != "", F.array(timed(F.col("l"))))
    out = rows.select(key, F.col("line_idx").cast("long").alias("line_idx"), F.coalesce("l.speaker", F.lit("")).alias("speaker"), words.alias("words")).where("words is not null")
    return out.select(key, "line_idx", F.element_at("words", 1)["start_ms"].alias("start_ms"), F.element_at("words", -1)["end_ms"].alias("end_ms"), F.array_join(F.transform("words", lambda w: w["text"]), "").alias("text"), "speaker", "words")


_WORD = "struct<text:string,word:string,start:double,end:double,prob:double,probability:double>"
_SEGMENT = f"array<struct<start:double,start_time:double,end:double,end_time:double,text:string,sentence:string,words:array<{_WORD}>,avg_logprob:double,no_speech_prob:double>>"


def letters(text: Column) -> Column:
    """A text's characters but its spaces."""
    return F.filter(F.split(_spaceless(text), ""), lambda c: c != "")


def _spaceless(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def spread(chars: Column, start: Column, step: Column) -> Column:
    """Characters as words, one after the other, ``step`` each."""
    word = lambda z, c, i: F.struct(c.alias("text"), (z["a"] + z["d"] * i).alias("start"), (z["a"] + z["d"] * (i + 1)).alias("end"), F.lit(1.0).alias("prob"))
    return once(F.struct(chars.alias("c"), start.alias("a"), step.alias("d")), lambda z: F.transform(z["c"], lambda c, i: word(z, c, i)))


def parse_responses(texts: DataFrame, key: str, text: str, strict: bool = True) -> DataFrame:
    """``key, seg_idx, start, end, text, words, avg_logprob, no_speech_prob``: recognition responses of any of the usual shapes.

    Segments under ``segments``, ``results`` or ``data``, or as the list itself; alternative names of fields; a text without words
    is spread over its time; segments with neither go; sorted by start. An unknown shape is an error, or gives no rows if ``strict`` is off; null
    texts and empty lists give none.
    """
    names = ("segments", "results", "data")
    held = F.from_json(text, f"struct<{','.join(f'{n}:{_SEGMENT}' for n in names)}>")
    keyed = once(held, lambda o: F.coalesce(*[F.when(F.size(o[n]) > 0, o[n]) for n in names]))
    listed = F.from_json(text, _SEGMENT)
    if strict:
        known = F.lit(False)
        for n in names:
            known = known | F.coalesce(F.get_json_object(text, f"$.{n}").startswith("["), F.lit(False))
        known = known | F.col(text).rlike(r"^\s*\[") | F.col(text).isNull()
        listed = F.when(known, listed).otherwise(F.raise_error(F.concat(F.lit("a recognition response of unknown shape: "), F.substring(text, 1, 60))))
    seg = F.coalesce(keyed, listed)
    s = texts.select(key, F.posexplode(seg).alias("ord", "s"))
    start = F.coalesce("s.start", "s.start_time", F.lit(0.0))
    s = s.withColumn("start", start).withColumn("end", F.coalesce("s.end", "s.end_time", "start")).withColumn("text", F.trim(F.coalesce(F.nullif(F.col("s.text"), F.lit("")), "s.sentence", F.lit(""))))

    def named(w: Column) -> Column:
        at = F.coalesce(w["start"], F.col("start"))
        return F.struct(F.coalesce(F.nullif(w["text"], F.lit("")), w["word"], F.lit("")).alias("text"), at.alias("start"), F.coalesce(w["end"], at).alias("end"), F.coalesce(w["prob"], w["probability"], F.lit(1.0)).alias("prob"))

    own = F.filter(F.transform(F.coalesce("s.words", F.array().cast(f"array<{_WORD}>")), named), lambda w: w["text"] != "")
    # Segments are numbered before a text is spread, so that no letters are sorted.
    n = F.row_number().over(Window.partitionBy(key).orderBy("start", "ord")) - 1
    s = s.withColumn("__own", own).withColumn("__n", F.length(_spaceless(F.col("text")))).where((F.size("__own") > 0) | (F.col("__n") > 0)).withColumn("seg_idx", n.cast("long"))
    step = F.greatest(F.lit(0.0), F.col("end") - F.col("start")) / F.greatest(F.lit(1), F.col("__n"))
    words = F.when(F.size("__own") > 0, F.col("__own")).otherwise(spread(letters(F.col("text")), F.col("start"), step))
    s = s.withColumn("words", words)
    whole = F.when(F.col("text") != "", F.col("text")).otherwise(F.array_join(F.transform("words", lambda w: w["text"]), ""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return s.select(key, "seg_idx", "start", "end", whole.alias("text"), "words", zero("s.avg_logprob").alias("avg_logprob"), zero("s.no_speech_prob").alias("no_speech_prob"))


def stamped_words(text: Column, times: Column) -> Column:
    """Words of a text from the times of its letters and digits (``array<array<long>>`` of start and end); what follows a letter is shown with it."""
    shown = F.regexp_extract_all(F.trim(text), F.lit(r"(?s)[\p{L}\p{N}][^\p{L}\p{N}]*"), F.lit(0))
    n = F.least(F.size(shown), F.size(times))
    return F.zip_with(F.slice(shown, F.lit(1), n), F.slice(times, F.lit(1), n), lambda w, t: F.struct(w.alias("text"), t[0].alias("start_ms"), t[1].alias("end_ms")))


def keyword_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ord, word, alias, note`` of lists with a word a row, ``word|alias,alias|note``; blank rows and comments go."""
    rows = _rows(texts, key, text).where("row <> '' and not startswith(row, '#')")
    parts = F.transform(F.split("row", r"\|"), lambda p: F.trim(p))
    alias = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    return rows.select(key, "ord", F.get(parts, F.lit(0)).alias("word"), alias.alias("alias"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("note")).where("word <> ''")
