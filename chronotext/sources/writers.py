"""Writers of styled karaoke, line JSON, timelines and reports, and the fan-out to several formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ass_time
from .formats import documents, lrc_rows, number_lines, srt_blocks, vtt_blocks

# Fixed values of the subtitle format.
ALIGN = {"bottom": 2, "middle": 5, "top": 8}
ASS_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: 1920
PlayResY: 1080
WrapStyle: 0

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
{styles}

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def ass_colour(c: Column) -> Column:
    """``#RRGGBB`` as ``&H00BBGGRR``; white for anything else."""
    s = F.upper(F.ltrim(F.trim(F.coalesce(c, F.lit(""))), F.lit("#")))
    part = lambda i: F.substring(s, i, 2)
    return F.when(s.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("&H00"), part(5), part(3), part(1))).otherwise("&H00FFFFFF")


def _align(anchor: Column) -> Column:
    out = F.lit(2)
    for name, at in ALIGN.items():
        out = F.when(anchor == name, at).otherwise(out)
    return out


def ass_style(name: str, style: Column, fallback: str) -> Column:
    """A style row from a map (size, color, outline, anchor, bg)."""
    filled = lambda k, other: F.coalesce(F.nullif(style[k], F.lit("")), F.lit(other))
    box = F.coalesce(style["bg"], F.lit("")) != ""
    return F.concat(
        F.lit(f"Style: {name},Microsoft YaHei,"), filled("size", "90"), F.lit(","), ass_colour(filled("color", fallback)), F.lit(",&H0000FFFF,&H00000000,"),
        F.when(box, "&H80000000").otherwise("&H64000000"), F.lit(",0,0,0,0,100,100,0,0,"), F.when(box, "3").otherwise("1"), F.lit(","), F.coalesce(style["outline"], F.lit("3")),
        F.lit(",0,"), _align(F.coalesce(style["anchor"], F.lit(""))).cast("string"), F.lit(",20,20,60,1"),
    )


def ass_override(line: Column, shared: Column) -> Column:
    """Inline tags for what a line's style sets otherwise than the shared one."""
    other = lambda k: (F.coalesce(line[k], F.lit("")) != "") & ~F.equal_null(line[k], shared[k])
    tags = F.concat(
        F.when(other("size"), F.concat(F.lit("\\fs"), line["size"])).otherwise(""),
        F.when(other("color"), F.concat(F.lit("\\c"), ass_colour(line["color"]))).otherwise(""),
        F.when(other("anchor"), F.concat(F.lit("\\an"), _align(line["anchor"]).cast("string"))).otherwise(""),
        F.when((line["anchor"] == "free") & line["x"].isNotNull() & line["y"].isNotNull(), F.concat(F.lit("\\pos("), line["x"], F.lit(","), line["y"], F.lit(")"))).otherwise(""),
    )
    return F.when(tags != "", F.concat(F.lit("{"), tags, F.lit("}"))).otherwise("")


def karaoke_events(lines: DataFrame, style: Column, speakers: bool = False, stretch_ms: int = 1000, gap_ms: int = 50) -> DataFrame:
    """``rec_id, n, block`` of ``rec_id, line_idx, start_ms, end_ms, speaker, low_confidence, style, words``.

    A line lasts to just before the next when the gap is at most ``stretch_ms``; each word takes its own time, the last one to the line's end.
    """
    t = number_lines(lines.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), "")))
    nxt = F.lead("start_ms").over(Window.partitionBy("rec_id").orderBy("n"))
    gap = nxt - F.col("end_ms")
    t = t.withColumn("__e", F.when((gap > 0) & (gap <= stretch_ms), nxt - gap_ms).otherwise(F.col("end_ms")))
    cs = lambda ms: F.floor((ms + 5) / 10)
    last = F.size("words") - 1
    parts = F.transform("words", lambda w, i: F.concat(F.lit("{\\k"), F.greatest(F.lit(1), cs(F.when(i == last, F.col("__e")).otherwise(w["end_ms"])) - cs(w["start_ms"])).cast("string"), F.lit("}"), w["text"]))
    named = F.when(F.coalesce("low_confidence", F.lit(False)), "LowConf").otherwise("Default")
    actor = F.coalesce("speaker", F.lit("")) if speakers else F.lit("")
    block = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("__e")), F.lit(","), named, F.lit(","), actor, F.lit(",0,0,0,,"), ass_override(F.col("style"), style), F.array_join(parts, ""))
    return t.select("rec_id", "n", block.alias("block"))


def ass_documents(events: DataFrame, style: Column) -> DataFrame:
    styles = F.concat(ass_style("Default", style, "#FFFFFF"), F.lit("\n"), ass_style("LowConf", style, "#FFA500"))
    before, after = ASS_HEAD.split("{styles}")
    return documents(events, "\n").select("rec_id", F.concat(F.lit(before), styles, F.lit(after), "text").alias("text"))


def lrc_documents(lines: DataFrame, title: Column | None = None, tool: str = "chronotext") -> DataFrame:
    """Lyric files with their tags; a recording without lines has none."""
    head = F.lit(f"[re:{tool}]\n") if title is None else F.concat(F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("[ti:"), title, F.lit("]\n"))).otherwise(""), F.lit(f"[re:{tool}]\n"))
    return documents(lrc_rows(lines), "\n").select("rec_id", F.concat(head, "text").alias("text"))


def line_json(lines: DataFrame) -> DataFrame:
    """``rec_id, text``: the lines that have words as JSON, times in seconds with three places."""
    s = lambda ms: F.round(ms / 1000, 3)
    words = F.transform("words", lambda w: F.struct(w["text"].alias("text"), s(w["start_ms"]).alias("start"), s(w["end_ms"]).alias("end")))
    line = F.struct(
        s(F.col("start_ms")).alias("start"), s(F.col("end_ms")).alias("end"), "text", F.coalesce("speaker", F.lit("")).alias("speaker"), F.coalesce("low_confidence", F.lit(False)).alias("low_confidence"), words.alias("words")
    )
    rows = lines.where(F.size("words") > 0).select("rec_id", F.struct("line_idx", line.alias("l")).alias("x"))
    return rows.groupBy("rec_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]).alias("lines"))).alias("text"))


def _clock(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60)))


def song_timelines(songs: DataFrame) -> DataFrame:
    """Markdown of the titled songs ``rec_id, start_ms, end_ms, title, artist, source`` of each recording."""
    more = lambda c, a, b: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(a), F.col(c), F.lit(b))).otherwise("")
    row = F.concat(F.lit("- ["), _clock(F.col("start_ms")), F.lit(" - "), _clock(F.col("end_ms")), F.lit("] 《"), "title", F.lit("》"), more("artist", "- ", ""), more("source", "（", "）"))
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms", "end_ms"))
    blocks = songs.where("title <> ''").select("rec_id", n.alias("n"), row.alias("block"))
    return documents(blocks, "\n", head="# Songs\n\n")


def report_markdown(report: DataFrame, metrics: dict[str, str], sections: list[tuple[str, dict[str, str], DataFrame]] = ()) -> DataFrame:
    """``rec_id, text``: a table of the named columns of a report, ``metrics`` giving each one's title, and a table for each section that has rows.

    A section is a heading, its columns with their titles, and rows ``rec_id, n`` and the columns, in the order of ``n`` from 1, which is shown first.
    """
    rows = [F.concat(F.lit(f"| {title} | "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(" |")) for c, title in metrics.items()]
    out = report.select("rec_id", F.concat(F.lit("# Report\n\n| metric | value |\n|---|---:|\n"), F.concat_ws("\n", *rows), F.lit("\n")).alias("text"))
    for heading, columns, own in sections:
        cells = F.concat(F.lit("| "), F.col("n").cast("string"), *[F.concat(F.lit(" | "), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]+", " ")) for c in columns], F.lit(" |"))
        head = f"\n## {heading}\n\n| # | {' | '.join(columns.values())} |\n|---|{'---|' * len(columns)}\n"
        table = documents(own.select("rec_id", "n", cells.alias("block")), "\n", head=head).withColumnRenamed("text", "__more")
        out = out.join(table, "rec_id", "left").select("rec_id", F.concat("text", F.coalesce("__more", F.lit(""))).alias("text"))
    return out


def completed(lines: DataFrame) -> DataFrame:
    """Lines with what the richer formats show: a word for the whole line, no speaker, sure and without a style of its own, where they have nothing else."""
    word = F.array(F.struct("text", "start_ms", "end_ms"))
    defaults = {"words": word, "speaker": F.lit(""), "low_confidence": F.lit(False), "style": F.lit(None).cast("map<string,string>")}
    for c, value in defaults.items():
        if c not in lines.columns:
            lines = lines.withColumn(c, value)
    return lines.withColumn("words", F.when(F.size("words") > 0, F.col("words")).otherwise(word))


FORMATS = {
    "srt": lambda lines: documents(srt_blocks(lines)),
    "vtt": lambda lines: documents(vtt_blocks(lines), head="WEBVTT\n\n"),
    "lrc": lrc_documents,
    "ass": lambda lines: (lambda style: ass_documents(karaoke_events(completed(lines), style), style))(F.create_map().cast("map<string,string>")),
    "json": lambda lines: line_json(completed(lines)),
}


def export(lines: DataFrame, formats: list[str]) -> DataFrame:
    """``rec_id, format, text`` in each format that is known; others are skipped."""
    out = None
    for f in dict.fromkeys(formats):
        if f in FORMATS:
            one = FORMATS[f](lines).select("rec_id", F.lit(f).alias("format"), "text")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else lines.select("rec_id", F.lit("").alias("format"), F.lit("").alias("text")).limit(0)


def write_export(lines: DataFrame, formats: list[str], path: str) -> None:
    """Each recording's files under ``path``, a folder for each format."""
    export(lines, formats).write.mode("overwrite").partitionBy("format", "rec_id").text(path)
