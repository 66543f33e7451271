"""Queries over readers and writers: files built from the tables, read back, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalars import decoded
from ..sources import folders
from ..sources import formats as fm
from ..sources import records as rc
from ..sources import splits as sp
from ..sources import writers as wr
from .registry import registry
from .views import live_log, ref_line, table, with_views

QUERIES, ORACLE, query = registry()


def _xml(spark, d):
    """A log file for each recording: chat, gifts, paid texts and guards; every third one is cut short."""
    t = F.col("t_ms") / 1000
    s = lambda x: F.lit(x)
    user = F.concat(s(' user="u&amp;'), "term", s('"'))
    chat = F.concat(s('<d p="'), t.cast("string"), s(',1,25,255,9,0,'), F.col("ord").cast("string"), s(',0"'), user, s(">a &lt; "), "term", s("</d>"))
    gift = F.concat(s('<gift ts="'), t.cast("string"), s('"'), user, s(' giftname="'), "term", s('" giftcount="0" price="x"/>'))
    paid = F.concat(s('<sc ts="'), t.cast("string"), s('"'), user, s(' price="'), F.col("cents").cast("string"), s('">'), "term", s("</sc>"))
    guard = F.concat(s('<guard ts="'), t.cast("string"), s('"'), user, s(' level="'), (F.col("ord") % 5).cast("string"), s('" giftcount="2"/>'))
    node = F.when(F.col("kind") == "chat", chat).when(F.col("kind") == "gift", gift).when(F.col("kind") == "sc", paid).otherwise(guard)
    rows = live_log(spark, d).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), node.alias("n")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["n"]), "\n")
    head = F.concat(s(f'<i><{rc.INFO_TAG} name=" streamer'), F.col("rec_id").cast("string"), s('" title="t" roomid="7" start_time="2024-01-01T00:00:00"/>\n'))
    return rows.select("rec_id", F.concat(head, body, F.when(F.col("rec_id") % 3 == 0, '<d p="1,1').otherwise("</i>")).alias("text"))


LOG = with_views("live_log")
SECONDS = "t_ms / 1000.0"


@query(f"""{LOG} select rec_id, row_number() over (partition by rec_id order by t_ms, ord) - 1 as "ord", t_ms, kind, case when kind = 'chat' then cast(ord as varchar) end as user_id, 'u&' || term as user_name,
case kind when 'chat' then 'a < ' || term when 'sc' then term else '' end as "text", case kind when 'gift' then term when 'sc' then '醒目留言' when 'guard' then case ord % 5 when 1 then '总督' when 2 then '提督' else '舰长' end end as gift,
cast(case when kind = 'guard' then 2 else 1 end as bigint) as "count", cast(case when kind = 'sc' then cents else 0 end as double) as price from live_log""")
def log_xml_rows(spark, d):
    """XML logs, some of them cut short, read back."""
    ms = F.floor(F.col("t") * 1000 + 0.5).cast("long")
    return fm.parse_log_xml(_xml(spark, d), "rec_id", "text").select("rec_id", "ord", ms.alias("t_ms"), "kind", "user_id", "user_name", "text", "gift", "count", "price")


@query(f"""{LOG} select rec_id, t_ms, kind, case when kind = 'chat' then cast(ord as varchar) end as user_id, 'u&' || term as user_name,
case kind when 'chat' then 'a < ' || term when 'sc' then term else '' end as "text", cast(case when kind = 'guard' then 2 else 1 end as bigint) as "count" from live_log""")
def split_log_rows(spark, d):
    """The same logs as files, read by ranges of 64 KB."""
    folder = folders.fresh(spark, "logs")
    fm.write_texts(_xml(spark, d), folder)
    ms, rec = F.floor(F.col("t") * 1000 + 0.5).cast("long"), F.regexp_extract("path", r"rec_id=(\d+)", 1).cast("long")
    return sp.read_log_rows(spark, folder, 1 << 16).select(rec.alias("rec_id"), ms.alias("t_ms"), "kind", "user_id", "user_name", "text", "count")


@query(f"{with_views('ref_line')} select rec_id, start_ms, end_ms, text from ref_line where text <> ''")
def split_subtitle_rows(spark, d):
    """Subtitle files read by ranges of 4 KB."""
    folder = folders.fresh(spark, "subtitles")
    fm.write_texts(fm.documents(fm.srt_blocks(ref_line(spark, d))), folder)
    rec = F.regexp_extract("path", r"rec_id=(\d+)", 1).cast("long")
    return sp.read_subtitle_rows(spark, folder, 1 << 12).select(rec.alias("rec_id"), "start_ms", "end_ms", "text")


@query(f"{LOG} select distinct rec_id, 'streamer' || rec_id as streamer, 't' as title, '7' as room_id, '2024-01-01T00:00:00' as start_time, true as repaired from live_log")
def log_headers(spark, d):
    x = _xml(spark, d)
    fixed = x.select("rec_id", rc.repaired_xml(F.col("text")).alias("text"))
    ok = fixed.select("rec_id", (F.col("text").startswith("<i><") & F.col("text").endswith("></i>") & ~F.col("text").endswith("1,1</i>")).alias("repaired"))
    return rc.record_info(fixed, "rec_id", "text").join(ok, "rec_id")


def _json(spark, d):
    names = [("type", "time", "text", "uname"), ("cmd", "timestamp", "content", "nickname"), ("type", "ts", "msg", "username")]
    kind = F.when(F.col("kind") == "chat", "DANMU").when(F.col("kind") == "gift", "SEND_GIFT").when(F.col("kind") == "sc", "SUPER_CHAT").otherwise("GUARD_BUY")
    one = [F.to_json(F.struct(kind.alias(a), (F.col("t_ms") / 1000).alias(b), F.col("term").alias(c), F.concat(F.lit("u"), "term").alias(e))) for a, b, c, e in names]
    row = F.when(F.col("ord") % 3 == 0, one[0]).when(F.col("ord") % 3 == 1, one[1]).otherwise(one[2])
    return live_log(spark, d).select("rec_id", "ord", row.alias("row")).withColumn("row", F.when(F.col("ord") % 7 == 6, F.lit("{broken")).otherwise(F.col("row")))


@query(f"{LOG} select rec_id, t_ms, case kind when 'guard' then 'gift' else kind end as kind, term as \"text\", 'u' || term as user_name from live_log where ord % 7 <> 6")
def log_json_rows(spark, d):
    """JSON lines with all the names that tools use; broken rows are skipped."""
    r = fm.parse_log_json(_json(spark, d), "rec_id", "row")
    return r.select("rec_id", F.floor(F.col("t") * 1000 + 0.5).cast("long").alias("t_ms"), "kind", "text", "user_name")


@query(f"""{LOG} select 'l' || rec_id || '.xml' as path, kind, count(*) as n from live_log group by rec_id, kind
union all select 'l' || rec_id || '.jsonl', case kind when 'guard' then 'gift' else kind end, count(*) from live_log where ord % 7 <> 6 group by all""")
def log_files(spark, d):
    """Files of both kinds by extension; others give nothing."""
    rows = _json(spark, d).groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "row"))), lambda x: x["row"]), "\n").alias("text"))
    named = lambda t, ext: t.select(F.concat(F.lit("l"), F.col("rec_id").cast("string"), F.lit(ext)).alias("path"), "text")
    files = named(_xml(spark, d), ".xml").unionByName(named(rows, ".jsonl")).unionByName(named(rows, ".txt"))
    return rc.parse_logs(files).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, md5(text) as text_md5 from documents")
def decoded_texts(spark, d):
    """Bytes with and without a mark, decoded."""
    raw = F.encode("text", "UTF-8")
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(raw).alias("raw"))
    return t.select("doc_id", F.md5(decoded(F.col("raw"))).alias("text_md5"))


def _lyric_files(spark, d):
    """A lyric file for each benchmark text: stamped rows (with a tag and a row of two stamps), plain rows for every third."""
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("i", "row")).withColumn("row", F.trim(F.regexp_replace("row", r"\s+", " ")))
    stamp = lambda ms: F.concat(F.lit("["), tx.lrc_time(ms), F.lit("]"))
    ms = F.col("i") * 3210
    plain = F.col("item_id") % 3 == 0
    line = F.when(plain, F.col("row")).otherwise(F.concat(stamp(ms), F.when(F.col("i") == 1, stamp(ms + 60_000)).otherwise(""), F.col("row")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]), "\r\n")
    name = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("/in/Singer - Song"), F.col("item_id").cast("string"), F.lit(".lrc"))).otherwise(F.concat(F.lit("Song"), F.col("item_id").cast("string"), F.lit(".txt")))
    return rows.groupBy("item_id").agg(body.alias("text")).select(name.alias("path"), F.concat(F.lit("[ti:x]\r\n词：someone\r\n"), "text").alias("text"), "item_id")


FILES = r"""r0 as (select item_id, unnest(string_split_regex(text, '\. ')) as row, unnest(range(0, len(string_split_regex(text, '\. ')))) as i from benchmark),
r as (select case when item_id % 2 = 0 then '/in/Singer - Song' || item_id || '.lrc' else 'Song' || item_id || '.txt' end as path, item_id, i, trim(regexp_replace(row, '\s+', ' ', 'g')) as row from r0),
st as (select path, item_id, i, row, i * 3210 + m as ms from r cross join (values (0), (60000)) v(m) where item_id % 3 <> 0 and (m = 0 or i = 1) and row <> '')"""


@query(f"""with {FILES} select path, row_number() over (partition by path order by (ms + 5) // 10, i) - 1 as line_idx, cast((ms + 5) // 10 * 10 as bigint) as t_ms, row as "text" from st""")
def lrc_file_rows(spark, d):
    rows = _lyric_files(spark, d).select("path", F.posexplode(F.split("text", "\r\n")).alias("ord", "row"))
    return fm.parse_lrc(rows, "path", "row", "ord")


@query(f"""with {FILES} select path, cast(i + 2 as integer) as line_idx, row as "text" from r where row <> ''""")
def plain_file_rows(spark, d):
    """Rows without stamps, tags and credits."""
    return rc.lyric_rows(_lyric_files(spark, d).drop("item_id"))


@query(f"""with {FILES}, g as (select path, any_value(item_id) as item_id from r group by path)
select g.path, 'Song' || item_id as title, case when item_id % 2 = 0 then 'Singer' else '' end as artist, item_id % 3 <> 0 as synced,
 cast(case when item_id % 3 = 0 then (select count(*) + 1 from r x where x.path = g.path and x.row <> '') else (select count(*) from st x where x.path = g.path) end as bigint) as n_lines from g""")
def lyric_files(spark, d):
    """Stamped or plain, with title and artist from the name; a credit is a plain line of a plain file."""
    return rc.lyric_documents(_lyric_files(spark, d).drop("item_id")).select("path", "title", "artist", "synced", F.size("lines").cast("long").alias("n_lines"))


@query(rf"""with {FILES} select path, cast(i + 2 as integer) as line_idx, cast(len(regexp_extract_all(row, '[0-9A-Za-z'']+')) as bigint) as n_tokens, lower(array_to_string(regexp_extract_all(row, '[0-9A-Za-z'']+'), ' ')) as align
from r where len(regexp_extract_all(row, '[0-9A-Za-z'']+')) > 0""")
def lyric_token_rows(spark, d):
    """Rows as tokens, Latin ones here; the credit's CJK characters are tokens of their own and left out."""
    t = rc.lyric_tokens(_lyric_files(spark, d).drop("item_id")).where("line_idx > 1")
    return t.select("path", "line_idx", F.size("tokens").cast("long").alias("n_tokens"), F.lower(F.array_join(F.transform("tokens", lambda x: x["align"]), " ")).alias("align"))


def with_words(lines):
    """Words between spaces with even shares of the line's time; a word keeps the space before it."""
    w = F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0))
    at = lambda z, i: (z["a"] + F.floor((z["e"] - z["a"]) * i / F.size(z["w"]))).cast("long")
    word = lambda z, x, i: F.struct(x.alias("text"), at(z, i).alias("start_ms"), at(z, i + 1).alias("end_ms"))
    found = tx.once(F.struct(w.alias("w"), F.col("start_ms").alias("a"), F.col("end_ms").alias("e")), lambda z: F.transform(z["w"], lambda x, i: word(z, x, i)))
    return lines.withColumn("words", found)


@query(f"""{with_views('ref_line')}, x as (select *, len(regexp_extract_all(text, '\\s*\\S+')) as n from ref_line)
select rec_id, row_number() over (partition by rec_id order by line_idx) - 1 as line_idx, start_ms, end_ms, array_to_string(regexp_extract_all(text, '\\s*\\S+'), '') as "text", speaker, n as n_words from x where n > 0""")
def line_json_round_trip(spark, d):
    lines = with_words(ref_line(spark, d)).withColumn("low_confidence", F.col("line_idx") % 2 == 0)
    return rc.parse_line_json(wr.line_json(lines), "rec_id", "text").select("rec_id", "line_idx", "start_ms", "end_ms", "text", "speaker", F.size("words").cast("long").alias("n_words"))


@query(f"""{with_views('ref_line')}, x as (select *, replace(replace(trim(text), chr(10), ' '), '"', '') as t from ref_line),
y as (select *, len(replace(t, ' ', '')) as n from x where t <> '')
select rec_id, row_number() over (partition by rec_id order by line_idx) - 1 as seg_idx, t as "text", n as n_words, start_ms, case when n > 0 then start_ms + (end_ms - start_ms) * (n // 2) // n end as middle_ms from y""")
def response_segments(spark, d):
    """Recognition responses in three shapes; texts without words are spread over their time."""
    lines = ref_line(spark, d).withColumn("t", F.replace(F.replace(F.trim("text"), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit(""))).withColumn("s", F.col("start_ms") / 1000).withColumn("e", F.col("end_ms") / 1000)
    rows = lines.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "s", "e", "t"))).alias("x"))
    one = F.transform("x", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), x["t"].alias("text")))
    two = F.transform("x", lambda x: F.struct(x["s"].alias("start_time"), x["e"].alias("end_time"), x["t"].alias("sentence")))
    text = F.when(F.col("rec_id") % 3 == 0, F.to_json(F.struct(one.alias("segments")))).when(F.col("rec_id") % 3 == 1, F.to_json(F.struct(two.alias("results")))).otherwise(F.to_json(one))
    r = rc.parse_responses(rows.select("rec_id", text.alias("text")), "rec_id", "text")
    ms = lambda c: F.floor(c * 1000 + 1e-6).cast("long")
    return r.select("rec_id", "seg_idx", "text", F.size("words").cast("long").alias("n_words"), F.floor(F.col("start") * 1000 + 0.5).cast("long").alias("start_ms"), ms(F.get("words", F.floor(F.size("words") / 2).cast("int"))["start"]).alias("middle_ms"))


@query(f"""{with_views('ref_line')}, x as (select rec_id, line_idx, start_ms, regexp_extract_all(trim(text), '[\\p{{L}}\\p{{N}}][^\\p{{L}}\\p{{N}}]*') as w from ref_line), y as (select *, w[1:20] as v from x)
select rec_id, line_idx, cast(len(v) as bigint) as n_words, array_to_string(v, '|') as shown, case when len(v) > 0 then start_ms + len(v) * 40 end as end_ms from y""")
def stamped_words(spark, d):
    """Times for the first twenty letters; marks are shown with the letter before them."""
    times = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.array(F.col("start_ms") + i * 40, F.col("start_ms") + i * 40 + 40))
    t = ref_line(spark, d).withColumn("w", rc.stamped_words(F.col("text"), times))
    return t.select("rec_id", "line_idx", F.size("w").cast("long").alias("n_words"), F.array_join(F.transform("w", lambda x: x["text"]), "|").alias("shown"), F.try_element_at("w", F.lit(-1))["end_ms"].alias("end_ms"))


@query("""select p_brand as list, cast((row_number() over (partition by p_brand order by p_partkey) - 1) * 3 + 2 as integer) as "ord", p_name as word, p_type || '/x' as alias, 'n' || p_size as note from part""")
def keyword_list(spark, d):
    """Word lists, a file for each brand, with comments and blank rows between."""
    row = F.concat("p_name", F.lit("| "), "p_type", F.lit(",, x |n"), F.col("p_size").cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: F.concat(F.lit("# note\n\n"), x["r"])), "\n")
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("list")).agg(body.alias("text"))
    return rc.keyword_rows(t, "list", "text").select("list", "ord", "word", F.array_join("alias", "/").alias("alias"), "note")


@query(f"""{with_views('ref_line')} select rec_id, line_idx, start_ms, case when start_ms % 7 = 0 then null else start_ms // 1000 * 1000 end as whole_ms from ref_line""")
def parsed_times(spark, d):
    """Time codes with hours, without, and whole seconds, parsed; anything else is null."""
    s = F.floor(F.col("start_ms") / 1000).cast("long").cast("string")
    t = ref_line(spark, d).withColumn("long", tx.srt_time(F.col("start_ms"))).withColumn("short", F.when(F.col("start_ms") % 7 == 0, F.concat(s, F.lit("s"))).otherwise(s))
    return t.select("rec_id", "line_idx", tx.parse_time(F.col("long")).alias("start_ms"), tx.parse_time(F.col("short")).alias("whole_ms"))


N = f"{with_views('ref_line')}, t as (select *, row_number() over (partition by rec_id order by start_ms, line_idx) as n from ref_line where text <> '')"
CS = "({0} + 5) // 10"
LRC = "'[' || lpad(cast({0} // 6000 as varchar), 2, '0') || ':' || lpad(cast({0} // 100 % 60 as varchar), 2, '0') || '.' || lpad(cast({0} % 100 as varchar), 2, '0') || ']' || text".format(CS.format("start_ms"))
HMS = "lpad(cast({0} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({0} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({0} // 1000 % 60 as varchar), 2, '0') || '{1}' || lpad(cast({0} % 1000 as varchar), 3, '0')"


@query(f"""{N} select rec_id, '[ti:r' || rec_id || ']' || chr(10) || '[re:chronotext]' || chr(10) || string_agg({LRC}, chr(10) order by n) || chr(10) as "text" from t group by rec_id""")
def lrc_files(spark, d):
    lines = ref_line(spark, d)
    titled = wr.lrc_documents(lines, F.concat(F.lit("r"), F.col("rec_id").cast("string")))
    return titled


@query(f"""{N}, b as (select rec_id, 'srt' as format, string_agg(cast(n as varchar) || chr(10) || {HMS.format('start_ms', ',')} || ' --> ' || {HMS.format('end_ms', ',')} || chr(10) || text, chr(10) || chr(10) order by n) || chr(10) as x from t group by rec_id
union all select rec_id, 'vtt', 'WEBVTT' || chr(10) || chr(10) || string_agg({HMS.format('start_ms', '.')} || ' --> ' || {HMS.format('end_ms', '.')} || chr(10) || '<v ' || speaker || '>' || text, chr(10) || chr(10) order by n) || chr(10) from t group by rec_id
union all select rec_id, 'lrc', '[re:chronotext]' || chr(10) || string_agg({LRC}, chr(10) order by n) || chr(10) from t group by rec_id) select rec_id, format, md5(x) as text_md5 from b""")
def exported_files(spark, d):
    """Three known formats and one that is not."""
    return wr.export(ref_line(spark, d), ["srt", "vtt", "xyz", "lrc", "srt"]).select("rec_id", "format", F.md5("text").alias("text_md5"))


ASS = "cast(({0}) // 360000 as varchar) || ':' || lpad(cast(({0}) // 6000 % 60 as varchar), 2, '0') || ':' || lpad(cast(({0}) // 100 % 60 as varchar), 2, '0') || '.' || lpad(cast(({0}) % 100 as varchar), 2, '0')"
STYLE = "map_from_arrays(array('size', 'color', 'anchor'), array('90', '#ffffff', 'bottom'))"


def _styled(spark, d):
    style = F.when(F.col("line_idx") % 3 == 0, F.expr("map('size', '60', 'color', '#12ab3c', 'anchor', 'top')")).when(F.col("line_idx") % 3 == 1, F.expr("map('anchor', 'free', 'x', '10', 'y', '20')"))
    return with_words(ref_line(spark, d)).withColumn("low_confidence", F.col("line_idx") % 2 == 1).withColumn("style", style)


@query(f"""{N}, x as (select *, lead(start_ms) over (partition by rec_id order by n) as nx, regexp_extract_all(text, '\\s*\\S+') as w from t), e as (select *, case when nx - end_ms > 0 and nx - end_ms <= 1000 then nx - 50 else end_ms end as le from x),
a as (select *, list_transform(range(0, len(w)), lambda i: '{{\\k' || cast(greatest(1, (case when i + 1 = len(w) then le else start_ms + (end_ms - start_ms) * (i + 1) // len(w) end + 5) // 10 - (start_ms + (end_ms - start_ms) * i // len(w) + 5) // 10) as varchar) || '}}' || w[i + 1]) as parts from e)
select rec_id, n, 'Dialogue: 0,' || {ASS.format(CS.format('start_ms'))} || ',' || {ASS.format(CS.format('le'))} || case when line_idx % 2 = 1 then ',LowConf,' else ',Default,' end || speaker || ',0,0,0,,'
 || case line_idx % 3 when 0 then '{{\\fs60\\c&H003CAB12\\an8}}' when 1 then '{{\\an2\\pos(10,20)}}' else '' end || array_to_string(parts, '') as block from a""")
def ass_words(spark, d):
    """Karaoke with the words' own times, speakers, marked lines and styles of single lines."""
    return wr.karaoke_events(_styled(spark, d), F.expr(STYLE), speakers=True)


@query("""select n_nationkey, '&H00' || upper(lpad(to_hex(n_nationkey * 10), 2, '0')) || '0B' || '0A' as colour, 'Style: Default,Microsoft YaHei,' || (n_nationkey + 20) || ',&H00' || upper(lpad(to_hex(n_nationkey * 10), 2, '0')) || '0B0A,&H0000FFFF,&H00000000,'
|| case when n_nationkey % 2 = 1 then '&H80000000' else '&H64000000' end || ',0,0,0,0,100,100,0,0,' || case when n_nationkey % 2 = 1 then '3' else '1' end || ',3,0,' || case n_nationkey % 3 when 0 then '8' when 1 then '5' else '2' end || ',20,20,60,1' as style from nation""")
def ass_styles(spark, d):
    k = F.col("n_nationkey")
    colour = F.concat(F.lit("#0a0b"), F.lpad(F.lower(F.hex(k * 10)), 2, "0"))
    anchor = F.when(k % 3 == 0, "top").when(k % 3 == 1, "middle").otherwise("left")
    style = F.create_map(F.lit("size"), (k + 20).cast("string"), F.lit("color"), colour, F.lit("anchor"), anchor, F.lit("bg"), F.when(k % 2 == 1, "1").otherwise(""))
    return table(spark, d, "nation").select("n_nationkey", wr.ass_colour(colour).alias("colour"), wr.ass_style("Default", style, "#FFFFFF").alias("style"))


@query(f"""{with_views('ref_line')} select rec_id, '# Songs' || chr(10) || chr(10) || string_agg('- [' || lpad(cast(start_ms // 3600000 as varchar), 2, '0') || ':' || lpad(cast(start_ms // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast(start_ms // 1000 % 60 as varchar), 2, '0')
 || ' - ' || lpad(cast(end_ms // 3600000 as varchar), 2, '0') || ':' || lpad(cast(end_ms // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast(end_ms // 1000 % 60 as varchar), 2, '0') || '] 《s' || line_idx || '》' || case when line_idx % 2 = 0 then '- ' || speaker else '' end || '（log）', chr(10) order by start_ms, end_ms) || chr(10) as "text"
from ref_line where line_idx % 3 <> 2 group by rec_id""")
def song_timeline(spark, d):
    title = F.when(F.col("line_idx") % 3 != 2, F.concat(F.lit("s"), F.col("line_idx").cast("string"))).otherwise("")
    artist = F.when(F.col("line_idx") % 2 == 0, F.col("speaker"))
    return wr.song_timelines(ref_line(spark, d).select("rec_id", "start_ms", "end_ms", title.alias("title"), artist.alias("artist"), F.lit("log").alias("source")))


@query(f"""{with_views('ref_line')}, a as (select rec_id, count(*) as n, count(*) filter (where speaker = 'user') as u from ref_line group by rec_id)
select rec_id, '# Report' || chr(10) || chr(10) || '| metric | value |' || chr(10) || '|---|---:|' || chr(10) || '| lines | ' || n || ' |' || chr(10) || '| asked | ' || u || ' |' || chr(10) as "text" from a""")
def report_files(spark, d):
    a = ref_line(spark, d).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("speaker") == "user").cast("long")).alias("u"))
    return wr.report_markdown(a, {"n": "lines", "u": "asked"})
