"""Queries over edits, formats, segmentation, matching and the version store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as ed
from ..operators import matching as mt
from ..operators import sweeps as sw
from ..sources import formats as fm
from .views import hyp_line, ref_line, table, with_views

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


REF = with_views("ref_line")
HYP = with_views("hyp_line")


@query(f"""{HYP}, n as (select *, lead(start_ms) over (partition by rec_id order by line_idx) as nx from hyp_line)
select rec_id, count(*) as n_lines, round(sum(end_ms - start_ms) / count(*), 6) as mean_ms, round(sum(length(text)) / count(*), 6) as mean_chars, count(*) filter (where end_ms - start_ms < 400) as n_short,
count(*) filter (where length(text) > 20) as n_long, count(*) filter (where end_ms > nx) as n_overlap from n group by rec_id""")
def qc_stats(spark, d):
    return ed.line_stats(hyp_line(spark, d))


@query(f"""{HYP}, n as (select *, lead(start_ms) over (partition by rec_id order by line_idx) as nx from hyp_line)
select rec_id, line_idx, start_ms, cast(case when end_ms > nx then greatest(start_ms + 100, nx - 20) else end_ms end as bigint) as end_ms, text from n""")
def fix_overlaps(spark, d):
    return ed.fix_overlaps(hyp_line(spark, d))


@query(f"""{REF}, k as (select *, cast(greatest(1, ceil(length(text) / 80.0)) as bigint) as k from ref_line), p as (select *, unnest(range(0, k)) as i from k),
a as (select *, length(text) * i // k as c0, length(text) * (i + 1) // k as c1 from p),
b as (select rec_id, line_idx, i, cast(start_ms + (end_ms - start_ms) * c0 // greatest(1, length(text)) as bigint) as start_ms, cast(case when i + 1 = k then end_ms else start_ms + (end_ms - start_ms) * c1 // greatest(1, length(text)) end as bigint) as end_ms, substr(text, c0 + 1, c1 - c0) as text from a)
select rec_id, row_number() over (partition by rec_id order by line_idx, i) - 1 as line_idx, start_ms, end_ms, text from b""")
def split_long_lines(spark, d):
    return ed.split_long(ref_line(spark, d), 80)


@query(f"""{REF}, a as (select *, line_idx % 3 = 1 and 5 < length(text) as hit, start_ms + (end_ms - start_ms) * 5 // greatest(1, length(text)) as c from ref_line),
b as (select rec_id, line_idx, 0 as p, start_ms, case when hit then c else end_ms end as end_ms, case when hit then substr(text, 1, 5) else text end as text from a union all select rec_id, line_idx, 1, c, end_ms, substr(text, 6) from a where hit)
select rec_id, row_number() over (partition by rec_id order by line_idx, p) - 1 as line_idx, start_ms, end_ms, text from b""")
def edit_split(spark, d):
    return ed.split_line(ref_line(spark, d), F.col("line_idx") % 3 == 1, F.lit(5))


@query(f"""{REF}, b as (select rec_id, case when line_idx between 1 and 2 then 1 else line_idx end as g, min(start_ms) as start_ms, max(end_ms) as end_ms, string_agg(text, '' order by line_idx) as text from ref_line group by all)
select rec_id, row_number() over (partition by rec_id order by g) - 1 as line_idx, start_ms, end_ms, text from b""")
def edit_merge(spark, d):
    return ed.merge_lines(ref_line(spark, d), F.lit(1), F.lit(2))


@query(f"""{REF} select rec_id, line_idx, cast(case when line_idx % 2 = 0 then greatest(0, start_ms - 3000) else start_ms end as bigint) as start_ms,
cast(case when line_idx % 2 = 0 then greatest(greatest(0, start_ms - 3000) + 10, end_ms - 3000) else end_ms end as bigint) as end_ms, text from ref_line""")
def edit_shift(spark, d):
    return ed.shift_lines(ref_line(spark, d), F.col("line_idx") % 2 == 0, -3000)


@query(f"{REF} select rec_id, line_idx, start_ms * 25 // 24 as start_ms, end_ms * 25 // 24 as end_ms, text from ref_line")
def edit_retime(spark, d):
    return ed.retime(ref_line(spark, d), 25, 24)


@query(f"""{REF}, b as (select rec_id, line_idx, 0 as p, start_ms, end_ms, text from ref_line union all select rec_id, line_idx, 1, end_ms, end_ms + (end_ms - start_ms), text from ref_line where line_idx % 4 = 0)
select rec_id, row_number() over (partition by rec_id order by line_idx, p) - 1 as line_idx, start_ms, cast(end_ms as bigint) as end_ms, text from b""")
def edit_duplicate(spark, d):
    return ed.duplicate_lines(ref_line(spark, d), F.col("line_idx") % 4 == 0)


@query(f"""{REF}, w as (select *, coalesce(lag(end_ms) over (partition by rec_id order by line_idx) + 10, 0) as l, lead(start_ms) over (partition by rec_id order by line_idx) - 10 as h from ref_line),
s as (select *, greatest(l, start_ms - 500) as ns from w) select rec_id, line_idx, cast(case when line_idx = 1 then ns else start_ms end as bigint) as start_ms,
cast(case when line_idx = 1 then greatest(ns + 100, least(end_ms + 500, coalesce(h, end_ms + 500))) else end_ms end as bigint) as end_ms, text from s""")
def edit_update(spark, d):
    return ed.update_line(ref_line(spark, d), F.col("line_idx") == 1, F.col("start_ms") - 500, F.col("end_ms") + 500)


@query(f"""{REF}, c as (select rec_id, line_idx, start_ms, end_ms, text from ref_line where line_idx < 2), m as (select rec_id, min(start_ms) as m from c group by rec_id),
u as (select rec_id, line_idx, start_ms, end_ms, text, 0 as p from ref_line union all select rec_id, line_idx, start_ms - m + 5000, end_ms - m + 5000, text, 1 from c join m using (rec_id))
select rec_id, row_number() over (partition by rec_id order by start_ms, p, line_idx) - 1 as line_idx, start_ms, end_ms, text from u""")
def edit_paste(spark, d):
    lines = ref_line(spark, d)
    return ed.paste_lines(lines, lines.where("line_idx < 2"), 5000)


@query(f"{REF} select rec_id, row_number() over (partition by rec_id order by line_idx) - 1 as line_idx, start_ms, end_ms, text from ref_line where line_idx % 5 <> 2")
def edit_delete(spark, d):
    return ed.delete_lines(ref_line(spark, d), F.col("line_idx") % 5 == 2)


N = f"{REF}, t as (select *, row_number() over (partition by rec_id order by start_ms, line_idx) as n from ref_line where text <> '')"
HMS = "lpad(cast({0} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({0} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({0} // 1000 % 60 as varchar), 2, '0') || '{1}' || lpad(cast({0} % 1000 as varchar), 3, '0')"
CS = "(({0}) + 5) // 10"
ASS = "cast(({0}) // 360000 as varchar) || ':' || lpad(cast(({0}) // 6000 % 60 as varchar), 2, '0') || ':' || lpad(cast(({0}) // 100 % 60 as varchar), 2, '0') || '.' || lpad(cast(({0}) % 100 as varchar), 2, '0')"


@query(f"{N} select rec_id, n, cast(n as varchar) || chr(10) || {HMS.format('start_ms', ',')} || ' --> ' || {HMS.format('end_ms', ',')} || chr(10) || '[' || speaker || '] ' || text as block from t")
def srt_lines(spark, d):
    return fm.srt_blocks(ref_line(spark, d), F.concat(F.lit("["), F.col("speaker"), F.lit("] ")))


@query(f"{N} select rec_id, n, {HMS.format('start_ms', '.')} || ' --> ' || {HMS.format('end_ms', '.')} || chr(10) || '<v ' || speaker || '>' || text as block from t")
def vtt_lines(spark, d):
    return fm.vtt_blocks(ref_line(spark, d))


@query(f"""{N} select rec_id, n, '[' || lpad(cast({CS.format('start_ms')} // 6000 as varchar), 2, '0') || ':' || lpad(cast({CS.format('start_ms')} // 100 % 60 as varchar), 2, '0') || '.' || lpad(cast({CS.format('start_ms')} % 100 as varchar), 2, '0') || ']' || text as block from t""")
def lrc_lines(spark, d):
    return fm.lrc_rows(ref_line(spark, d))


@query(f"""{N}, x as (select *, lead(start_ms) over (partition by rec_id order by n) as nx from t), e as (select *, case when nx - end_ms > 0 and nx - end_ms <= 1000 then nx - 50 else end_ms end as le, string_split(text, ' ') as w from x),
a as (select *, list_transform(range(0, len(w)), lambda i: '{{\\k' || cast(greatest(1, (case when i + 1 = len(w) then le else start_ms + (end_ms - start_ms) * (i + 1) // len(w) end + 5) // 10 - (start_ms + (end_ms - start_ms) * i // len(w) + 5) // 10) as varchar) || '}}' || w[i + 1]) as parts from e)
select rec_id, n, 'Dialogue: 0,' || {ASS.format(CS.format('start_ms'))} || ',' || {ASS.format(CS.format('le'))} || ',Default,,0,0,0,,' || array_to_string(parts, ' ') as block from a""")
def ass_karaoke(spark, d):
    return fm.ass_events(ref_line(spark, d))


@query(f"{N} select rec_id, n - 1 as line_idx, start_ms, end_ms, regexp_replace(text, '\\n', ' ', 'g') as text from t")
def srt_round_trip(spark, d):
    """Lines written as subtitle files and read back."""
    lines = ref_line(spark, d).withColumn("text", F.regexp_replace("text", "\n", " "))
    return fm.parse_subtitles(fm.documents(fm.srt_blocks(lines)), "rec_id", "text")


OPS = """op_log as (select user_id as project, event_id as seq, case event_type when 'error' then 'undo' when 'signup' then 'redo' else 'save' end as op, regexp_extract(props, '[0-9]+', 0) as payload from events)"""


@query(f"""with recursive {OPS}, o as (select *, row_number() over (partition by project order by seq) as k from op_log),
f(project, k, v, p) as (select project, cast(0 as bigint), cast([] as varchar[]), cast(0 as bigint) from (select distinct project from o) t
 union all select o.project, o.k, case when op = 'save' then list_append(v[1:p], payload)[-60:] else v end, case op when 'save' then least(60, p + 1) when 'undo' then greatest(0, p - 1) else least(len(v), p + 1) end from f join o on o.project = f.project and o.k = f.k + 1),
l as (select *, row_number() over (partition by project order by k desc) as z from f)
select project, p as version, len(v) as n_versions, case when p > 0 then v[p] end as payload from l where z = 1""")
def undo_redo_state(spark, d):
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("save")
    return ed.current_version(table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), op.alias("op"), F.regexp_extract("props", "[0-9]+", 0).alias("payload")))


@query("""with f as (select doc_id as path_id, n_chars as size, doc_id as mtime from documents), k as (select *, sum(size) over (order by mtime desc, path_id desc) as total from f where mtime >= 50)
select path_id, 'ttl' as why from f where mtime < 50 union all select path_id, 'capacity' from k where total > 1000000""")
def cache_eviction(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path_id"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), F.expr("doc_id div 1000").alias("day"))
    return ed.evict(files, 50, 1_000_000, "day")


@query("select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)")
def passage_match(spark, d):
    return mt.containing(table(spark, d, "benchmark"), table(spark, d, "documents"))


def _atoms(spark, d):
    """Words of lines with even shares of the line's time; a line is a stretch of speech."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    lines = ref_line(spark, d).withColumn("w", w).withColumn("n", F.size("w"))
    a = lines.select("rec_id", F.col("line_idx").alias("block"), "start_ms", "end_ms", "n", F.posexplode("w").alias("pos", "text"))
    at = lambda i: (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * i / F.col("n"))).cast("long")
    return a.select("rec_id", "block", F.col("pos").cast("long").alias("pos"), "text", at(F.col("pos")).alias("start_ms"), at(F.col("pos") + 1).alias("end_ms"))


ATOMS = f"""{with_views('ref_line', recursive=True)}, l as (select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from ref_line),
u as (select rec_id, line_idx as block, start_ms, end_ms, len(w) as n, unnest(w) as text, unnest(range(0, len(w))) as pos from l),
atoms as (select rec_id, block, pos, text, start_ms + (end_ms - start_ms) * pos // n as start_ms, start_ms + (end_ms - start_ms) * (pos + 1) // n as end_ms from u)"""


@query(f"""{ATOMS}, f(rec_id, block, pos, line, s, c, stop) as (select rec_id, block, pos, cast(0 as bigint), start_ms, length(text), regexp_matches(text, '[.!?]$') from atoms where pos = 0
 union all select a.rec_id, a.block, a.pos, line + case when stop or a.end_ms - s > 5000 or c + length(a.text) > 25 then 1 else 0 end, case when stop or a.end_ms - s > 5000 or c + length(a.text) > 25 then a.start_ms else s end,
 case when stop or a.end_ms - s > 5000 or c + length(a.text) > 25 then length(a.text) else c + length(a.text) end, regexp_matches(a.text, '[.!?]$') from f join atoms a on a.rec_id = f.rec_id and a.block = f.block and a.pos = f.pos + 1)
select rec_id, block, pos, line from f""")
def greedy_aggregate(spark, d):
    return sw.aggregate_words(_atoms(spark, d))
