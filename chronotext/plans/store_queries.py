"""Queries over stores and histories, and over recordings that spread over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as bl
from ..operators import edits as ed
from ..operators import refine as rf
from ..sources import folders, stores
from .registry import registry
from .views import live_log_compact, ref_line, table, with_views

QUERIES, ORACLE, query = registry()


# ---- stores ----


def _words(spark, d):
    p = table(spark, d, "part")
    word = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string"))
    return p.select(F.col("p_partkey").alias("seq"), word.alias("word"), F.array(F.col("p_brand"), F.lit(" ")).alias("alias"), F.col("p_type").alias("category"), F.col("p_partkey").cast("string").alias("note"))


#: A word's key, and the last row of each key.
WORDS = """w as (select p_partkey as seq, p_name || ' ' || (p_partkey % 50) as word, lower(regexp_replace(p_name || (p_partkey % 50), '[^\\p{L}\\p{N}]', '', 'g')) as k, p_brand as alias, p_type as category, cast(p_partkey as varchar) as note from part),
one as (select * from w qualify row_number() over (partition by k order by seq desc) = 1),
late as (select * from w where seq % 3 = 0 qualify row_number() over (partition by k order by seq desc) = 1),
gone as (select distinct k from w where seq % 11 = 0), off as (select distinct k from w where seq % 7 = 0),
two as (select k, coalesce(l.word, o.word) as word, coalesce(l.alias, o.alias) as alias, coalesce(l.category || '!', o.category) as category, coalesce(l.note, o.note) as note from one o left join late l using (k)),
three as (select *, k not in (select k from off) as enabled from two where k not in (select k from gone))"""


@query(f"with {WORDS} select row_number() over (order by category, word) as place, word, alias, category, note, enabled from three")
def keyword_store(spark, d):
    """Words in four batches: added, some replaced, some removed, some switched off; in list order."""
    s, w = stores.KeywordStore(spark, folders.fresh(spark, "keywords"), 8), _words(spark, d)
    s.add(w)
    s.add(w.where("seq % 3 = 0").withColumn("category", F.concat("category", F.lit("!"))))
    s.remove(w.where("seq % 11 = 0").select("seq", "word"))
    s.set_enabled(w.where("seq % 7 = 0").select("seq", "word", F.lit(False).alias("enabled")))
    return s.ordered().select("place", "word", F.array_join("alias", ",").alias("alias"), "category", "note", "enabled")


@query(f"""with {WORDS} select 1 as version, count(*) as n, 0 as n_off from one union all select 2, count(*), 0 from two union all select 3, count(*), 0 from two where k not in (select k from gone)
union all select 4, count(*), count(*) filter (where not enabled) from three""")
def keyword_versions(spark, d):
    """Every version stays readable."""
    s, w = stores.KeywordStore(spark, folders.fresh(spark, "keywords"), 8), _words(spark, d)
    done = [s.add(w), s.add(w.where("seq % 3 = 0")), s.remove(w.where("seq % 11 = 0").select("seq", "word")), s.set_enabled(w.where("seq % 7 = 0").select("seq", "word", F.lit(False).alias("enabled")))]
    out = None
    for v in done:
        n = s.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("enabled"), 1)).alias("n_off"))
        out = n if out is None else out.union(n)
    return out


@query("""with docs as (select item_id as seq, 'Song ' || (item_id % 15) as title, 'singer ' || (item_id % 4) as artist, text from benchmark),
keyed as (select title, artist, max_by(text, seq) as text, min(seq) as came from docs group by title, artist),
asked as (select n_nationkey as seq, 'Song ' || (n_nationkey % 15) as title, case when n_nationkey % 2 = 0 then 'singer ' || (n_nationkey % 4) else '' end as artist from nation),
exact as (select a.* from asked a join keyed using (title, artist)),
loose as (select *, row_number() over (partition by title order by seq) as nth from asked where (title, artist) not in (select (title, artist) from keyed)),
rest as (select *, row_number() over (partition by title order by came) as nth from keyed where (title, artist) not in (select (title, artist) from exact)),
gone as (select r.title, r.artist from rest r join loose using (title, nth) union all select title, artist from exact),
kept as (select * from keyed where (title, artist) not in (select (title, artist) from gone))
select row_number() over (order by artist, title) as place, title, artist, md5(text) as text_md5 from kept""")
def lyric_store(spark, d):
    """Lyrics by title and artist, copies replaced, then removed by request: exactly, or the title's first."""
    s = stores.LyricStore(spark, folders.fresh(spark, "lyrics"), 8)
    lines = F.array(F.struct(F.col("text"), F.lit(None).cast("long").alias("t_ms")))
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), F.concat(F.lit(" Song "), (F.col("item_id") % 15).cast("string")).alias("title"), F.concat(F.lit("singer "), (F.col("item_id") % 4).cast("string")).alias("artist"), F.lit("import").alias("source"), F.lit(False).alias("synced"), lines.alias("lines"))
    s.add(docs)
    n = F.col("n_nationkey").cast("long")
    s.remove(table(spark, d, "nation").select(n.alias("seq"), F.concat(F.lit("Song "), (n % 15).cast("string")).alias("title"), F.when(n % 2 == 0, F.concat(F.lit("singer "), (n % 4).cast("string"))).alias("artist")))
    return s.ordered().select("place", "title", "artist", F.md5(F.col("lines")[0]["text"]).alias("text_md5"))


# ---- histories ----


OPS = """op_log as (select user_id as project, event_id as seq, case event_type when 'error' then 'undo' when 'signup' then 'redo' else 'save' end as op, regexp_extract(props, '[0-9]+', 0) as payload from events)"""


def _ops(spark, d):
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("save")
    return table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), op.alias("op"), F.regexp_extract("props", "[0-9]+", 0).alias("payload"))


@query(f"""with recursive {OPS}, o as (select *, row_number() over (partition by project order by seq) as k from op_log),
f(project, k, seq, v, p) as (select project, cast(0 as bigint), cast(-1 as bigint), cast([] as varchar[]), cast(0 as bigint) from (select distinct project from o) t
 union all select o.project, o.k, o.seq, case when op = 'save' then list_append(v[1:p], payload)[-60:] else v end, case op when 'save' then least(60, p + 1) when 'undo' then greatest(0, p - 1) else least(len(v), p + 1) end from f join o on o.project = f.project and o.k = f.k + 1)
select project, seq, p as version, len(v) as n_versions, case when p > 0 then v[p] end as payload from f where k > 0 and seq % 5 = 0""")
def history_as_of(spark, d):
    """The state after every fifth operation, each from the nearest snapshot of sixteen."""
    log = _ops(spark, d)
    return ed.state_as_of(log, log.where("seq % 5 = 0").select("project", "seq"), folders.written(ed.snapshots(log, 16)), 16)


@query("""with s as (select o_custkey as project, o_orderkey as saved, o_orderpriority as payload from orders where o_orderkey % 2 = 0), a as (select o_custkey as project, o_orderkey as saved, o_orderpriority as payload from orders where o_orderkey % 2 = 1),
u as (select *, false as recovered from s union all select *, true from a)
select project, max(saved) as saved, max_by(payload, saved) as payload, max_by(recovered, saved) as recovered from u group by project""")
def recovered_projects(spark, d):
    """Saves and autosaves: the newer of both."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("payload"))
    return ed.recovered(o.where("at % 2 = 0"), o.where("at % 2 = 1")).withColumnRenamed("at", "saved")


@query(f"""{with_views('ref_line')}, r as (select *, end_ms - start_ms as d, row_number() over (partition by rec_id order by end_ms - start_ms) - 1 as r, count(*) over (partition by rec_id) as n from ref_line),
g as (select rec_id, min_by(start_ms, line_idx) as start_ms, coalesce(nullif(max(d) filter (where r = n // 2), 0), 2000) as d, max(end_ms) as total from r group by rec_id)
select rec_id, start_ms, greatest(5000, least(least(600000, greatest(5000, total)), 800 * d // 36)) as span_ms from g""")
def readable_spans(spark, d):
    """How much of a recording a view shows so that its lines can be read."""
    return ed.readable_spans(ref_line(spark, d))


# ---- recordings over many tasks ----


@query(f"""{with_views('live_log_compact')}, f as (select rec_id, t_ms // 100 as frame_idx, max(cents) as level from live_log_compact where cents is not null group by all),
m as (select a.rec_id, a.frame_idx, avg(b.level) as level from f a join f b on b.rec_id = a.rec_id and b.frame_idx between a.frame_idx - 2 and a.frame_idx + 2 group by all),
w as (select *, lag(frame_idx) over (partition by rec_id order by frame_idx) as p from m where level >= 2000), g as (select *, sum(case when p is null or frame_idx - p > 11 then 1 else 0 end) over (partition by rec_id order by frame_idx) as run from w),
r as (select rec_id, run, min(frame_idx) filter (where level >= 6000) as a, max(frame_idx) as b from g group by all), k as (select rec_id, greatest(0, a - 3) as a, b + 3 as b from r where a is not null and b - a + 1 >= 3),
o as (select *, max(b) over (partition by rec_id order by a, b rows between unbounded preceding and 1 preceding) as reach from k), i as (select *, sum(case when reach is null or a - reach > 1 then 1 else 0 end) over (partition by rec_id order by a, b) as n from o)
select rec_id, min(a) as first_frame, max(b) as last_frame from i group by rec_id, n""")
def speech_blocks(spark, d):
    """Loud stretches of the log in tenths of a second, found in blocks of ten seconds with context and merged at the seams."""
    frames = live_log_compact(spark, d).groupBy("rec_id", F.expr("t_ms div 100").alias("frame_idx")).agg(F.max("cents").alias("level"))
    return bl.speech_spans(frames, ["rec_id"], 6000, 2000, 2, 10, 3, 3, 100)


def _sound(spark, d):
    """Frames of 100 ms of all recordings of the lines: what the log was worth in them."""
    spine = ref_line(spark, d).groupBy("rec_id").agg(F.max("end_ms").alias("m")).select("rec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 100).cast("long") + 20)).alias("frame_idx"))
    n = live_log_compact(spark, d).groupBy("rec_id", F.expr("t_ms div 100").alias("frame_idx")).agg(F.sum("cents").alias("level"))
    return spine.join(n, ["rec_id", "frame_idx"], "left").select("rec_id", "frame_idx", F.coalesce("level", F.lit(0)).alias("level"))


#: Even halves of whole numbers, as rounding of times to frames has them.
FRAME = "case when {0} % 100 = 50 then ({0} // 100) + ({0} // 100) % 2 else ({0} + 50) // 100 end"
SOUND = f"""sp as (select rec_id, unnest(range(0, max(end_ms) // 100 + 21)) as f from ref_line group by rec_id), ev as (select rec_id, t_ms // 100 as f, sum(cents) as level from live_log_compact group by all),
fr as (select sp.rec_id, sp.f, coalesce(level, 0) as level from sp left join ev on ev.rec_id = sp.rec_id and ev.f = sp.f),
ln as (select *, {FRAME.format('start_ms')} as si, {FRAME.format('end_ms')} as ei from ref_line),
fl as (select ln.rec_id, line_idx, quantile_cont(level, 0.1) filter (where f >= si - 25 - 20 and f < si + 15 + 20) as sf, quantile_cont(level, 0.1) filter (where f >= ei - 2 - 20 and f < ei + 2 + 20) as ef from ln join fr on fr.rec_id = ln.rec_id and fr.f between least(si - 45, ei - 22) and greatest(si + 35, ei + 22) group by all),
hit as (select ln.rec_id, ln.line_idx, min(f) filter (where f >= si - 25 and f < si + 15 and level > sf + 3000) * 100 as onset, (max(f) filter (where f >= ei - 2 and f < ei + 2 and level > ef + 1500) + 1) * 100 as offs
 from ln join fl on fl.rec_id = ln.rec_id and fl.line_idx = ln.line_idx join fr on fr.rec_id = ln.rec_id and fr.f between least(si - 25, ei - 2) and greatest(si + 15, ei + 2) group by all)"""
PARTED = """k0 as (select rec_id, line_idx, s as start_ms, e as end_ms, os, oe, row_number() over (partition by rec_id order by line_idx) as k from moved),
f(rec_id, k, line_idx, s, e, qs, qe, qi) as (select rec_id, k, line_idx, start_ms, end_ms, cast(null as bigint), cast(null as bigint), cast(null as bigint) from k0 where k = 1
 union all select o.rec_id, o.k, o.line_idx, case when hit then greatest(ne + 15, m + 15) else o.start_ms end, case when hit and o.end_ms <= greatest(ne + 15, m + 15) then greatest(ne + 15, m + 15) + 120 else o.end_ms end, ps, case when hit then ne else pe end, pi
 from (select f.rec_id, f.k, f.s as ps, f.e as pe, f.line_idx as pi, f.e > o.start_ms - 30 as hit, (o.start_ms + f.e) // 2 as m, greatest(f.s + 120, (o.start_ms + f.e) // 2 - 15) as ne from f join k0 o on o.rec_id = f.rec_id and o.k = f.k + 1) x join k0 o on o.rec_id = x.rec_id and o.k = x.k + 1),
done as (select rec_id, qi as line_idx, qs as start_ms, cast(qe as bigint) as end_ms from f where qi is not null union all select rec_id, line_idx, s, e from (select *, row_number() over (partition by rec_id order by k desc) as r from f) t where r = 1)"""


def _worded(spark, d):
    """Lines with a word for each of two halves of their time."""
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("long")
    w = lambda t, a, b: F.struct(t.alias("text"), a.alias("start_ms"), b.alias("end_ms"))
    return ref_line(spark, d).withColumn("words", F.array(w(F.substring("text", 1, 2), F.col("start_ms"), middle), w(F.expr("substr(text, 3)"), middle, F.col("end_ms"))))


@query(f"""{with_views('ref_line', 'live_log_compact', recursive=True)}, {SOUND},
x as (select ln.rec_id, ln.line_idx, ln.start_ms as os, ln.end_ms as oe, coalesce(case when abs(onset - start_ms) <= 2000 then onset end, start_ms) as s, coalesce(case when abs(offs - end_ms) <= 800 then offs end, end_ms) as o from ln left join hit using (rec_id, line_idx)),
y as (select *, case when oe - 180 > s + 120 then least(oe - 180, o) else o end as e1 from x), moved as (select rec_id, line_idx, os, oe, s, case when e1 <= s then s + 120 else e1 end as e from y), {PARTED}
select done.rec_id, done.line_idx, done.start_ms, done.end_ms, cast(floor(moved.s + (((os + oe) // 2) - os) * (moved.e - moved.s) / greatest(1, oe - os) + 0.5) as bigint) as middle_ms from done join moved using (rec_id, line_idx)""")
def refined_lines(spark, d):
    """Onset and offset of each line in the log's activity, words in proportion, neighbours apart."""
    out = rf.refine_lines(_worded(spark, d), _sound(spark, d), 100, 2500, 1500, 3000, 1500, 2000, 800, width=64)
    return out.select("rec_id", "line_idx", F.col("words")[0]["start_ms"].alias("start_ms"), F.element_at("words", -1)["end_ms"].alias("end_ms"), F.col("words")[0]["end_ms"].alias("middle_ms"))


@query(f"""{with_views('ref_line', 'live_log_compact', recursive=True)}, {SOUND},
x as (select ln.rec_id, ln.line_idx, ln.start_ms as os, ln.end_ms as oe, coalesce(case when abs(onset - start_ms) <= 2000 then onset - start_ms end, 0) as d from ln left join hit using (rec_id, line_idx)),
moved as (select rec_id, line_idx, os, oe, os + d as s, oe + d as e from x), {PARTED}
select rec_id, line_idx, start_ms, end_ms from done""")
def snapped_lines(spark, d):
    """Whole lines moved to the first rise of the log's activity around their start."""
    return rf.snap_to_speech(ref_line(spark, d), _sound(spark, d), 100, 2500, 1500, 3000, 2000, width=64).select("rec_id", "line_idx", "start_ms", "end_ms")
