"""Queries over line tables and logs: joins, merges, windows, pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normal_alnum
from ..operators import intervals as iv
from ..operators import pairing as pr
from ..operators import sweeps as sw
from .views import hyp_line, live_log, live_log_compact, ref_line, table, with_views

QUERIES: dict = {}
ORACLE: dict = {}


def _spans(spark, d):
    """Log events as short intervals."""
    return live_log_compact(spark, d).select("rec_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 400).alias("end_ms"), "ord", "kind", "term")


def overlap_join(spark, d):
    p = iv.overlap_join(ref_line(spark, d), hyp_line(spark, d), "rec_id", 10_000)
    return p.select("rec_id", F.col("line_idx").alias("i"), F.col("line_idx_r").alias("j"), "overlap_ms")


CAND = """cand as (select r.rec_id, r.line_idx as i, h.line_idx as j, least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms) as ov
 from ref_line r join hyp_line h on r.rec_id = h.rec_id and least(r.end_ms, h.end_ms) > greatest(r.start_ms, h.start_ms))"""
ORACLE["overlap_join"] = f"{with_views('hyp_line')}, {CAND} select rec_id, i, j, cast(ov as bigint) as overlap_ms from cand"


def overlap_semi(spark, d):
    return iv.overlap_join(ref_line(spark, d), _spans(spark, d), "rec_id", 10_000, "left_semi").select("rec_id", "line_idx")


def overlap_anti_replace(spark, d):
    """Lines under a log span are replaced by the span's own line."""
    kept = iv.overlap_join(ref_line(spark, d), _spans(spark, d), "rec_id", 10_000, "left_anti").select("rec_id", "start_ms", "end_ms", "text")
    return kept.unionByName(_spans(spark, d).select("rec_id", "start_ms", "end_ms", F.col("term").alias("text")))


SPANS = "spans as (select rec_id, t_ms as start_ms, t_ms + 400 as end_ms, ord, kind, term from live_log_compact)"
HIT = "exists (select 1 from spans s where s.rec_id = r.rec_id and least(r.end_ms, s.end_ms) > greatest(r.start_ms, s.start_ms))"
ORACLE["overlap_semi"] = f"{with_views('ref_line', 'live_log_compact')}, {SPANS} select rec_id, line_idx from ref_line r where {HIT}"
ORACLE["overlap_anti_replace"] = f"{with_views('ref_line', 'live_log_compact')}, {SPANS} select rec_id, start_ms, end_ms, text from ref_line r where not {HIT} union all select rec_id, start_ms, end_ms, term from spans"


def nearest_request(spark, d):
    n = iv.nearest_join(ref_line(spark, d).select("rec_id", "line_idx", "start_ms", "end_ms"), live_log_compact(spark, d).where("kind = 'sc'"), "rec_id", 300_000, 60_000, 120_000, ["term"], "ord")
    return n.select("rec_id", "line_idx", "near_ms", "near_term")


ORACLE["nearest_request"] = f"""{with_views('ref_line', 'live_log_compact')},
c as (select r.rec_id, r.line_idx, l.t_ms, l.term, row_number() over (partition by r.rec_id, r.line_idx order by abs(l.t_ms - r.start_ms), l.ord) as k
 from ref_line r join live_log_compact l on l.rec_id = r.rec_id and l.kind = 'sc' and l.t_ms between r.start_ms - 300000 and r.end_ms + 60000)
select rec_id, line_idx, t_ms as near_ms, term as near_term from c where k = 1"""


def event_support(spark, d):
    """0.6 for an event near a line, 0.4 for a request in a wider range, the larger of both, else 0."""
    lines = ref_line(spark, d).select("rec_id", "line_idx", "start_ms", "end_ms")
    log = live_log_compact(spark, d)
    near = lambda b, a, rows: iv.nearest_join(lines, rows, "rec_id", b, a, 30_000, ["kind"], "ord").select("rec_id", "line_idx")
    hits = near(8000, 2000, log.where("kind <> 'sc'")).withColumn("s", F.lit(0.6)).unionByName(near(30000, 30000, log.where("kind = 'sc'")).withColumn("s", F.lit(0.4)))
    return lines.select("rec_id", "line_idx").join(hits.groupBy("rec_id", "line_idx").agg(F.max("s").alias("support")), ["rec_id", "line_idx"], "left").fillna(0.0, ["support"])


ORACLE["event_support"] = f"""{with_views('ref_line', 'live_log_compact')}
select r.rec_id, r.line_idx, cast(case when exists (select 1 from live_log_compact l where l.rec_id = r.rec_id and l.kind <> 'sc' and l.t_ms between r.start_ms - 8000 and r.end_ms + 2000) then 0.6
 when exists (select 1 from live_log_compact l where l.rec_id = r.rec_id and l.kind = 'sc' and l.t_ms between r.start_ms - 30000 and r.end_ms + 30000) then 0.4 else 0 end as double) as support from ref_line r"""


def transcript_lookup(spark, d):
    """The texts of the candidate lines under each reference line, joined in order."""
    p = iv.overlap_join(ref_line(spark, d), hyp_line(spark, d), "rec_id", 10_000)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms_r", "line_idx_r", "text_r"))), lambda x: x["text_r"]), " ")
    return p.groupBy("rec_id", "line_idx").agg(joined.alias("transcript"))


ORACLE["transcript_lookup"] = f"""{with_views('hyp_line')}
select r.rec_id, r.line_idx, string_agg(h.text, ' ' order by h.start_ms, h.line_idx) as transcript from ref_line r join hyp_line h
 on r.rec_id = h.rec_id and least(r.end_ms, h.end_ms) > greatest(r.start_ms, h.start_ms) group by r.rec_id, r.line_idx"""


def _merged(name, gap, least, pad, frame="rows"):
    """``frame``: with ``range`` equal spans share a run's number, whichever of them a sort puts first."""

    def query(spark, d):
        return iv.gap_merge(_spans(spark, d), ["rec_id"], gap, least, pad)

    QUERIES[name] = query
    ORACLE[name] = f"""{with_views('live_log_compact')}, {SPANS},
a as (select *, max(end_ms) over (partition by rec_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from spans),
b as (select *, sum(case when reach is null or start_ms - reach > {gap} then 1 else 0 end) over (partition by rec_id order by start_ms, end_ms {frame} between unbounded preceding and current row) as island from a),
c as (select rec_id, min(start_ms) as s, max(end_ms) as e, count(*) as n from b group by rec_id, island)
select rec_id, cast(greatest(0, s - {pad}) as bigint) as start_ms, cast(e + {pad} as bigint) as end_ms, n from c where e - s >= {least}"""


_merged("gap_merge", 350, 0, 0, "range")
_merged("song_blocks", 12000, 25000, 0)
_merged("merge_regions", 1000, 500, 250, "range")
_merged("keep_windows", 350, 401, 0, "range")


def thin_events(spark, d):
    return sw.thin(live_log_compact(spark, d), ["rec_id"], "t_ms", 3000)


ORACLE["thin_events"] = f"""{with_views('live_log_compact', recursive=True)},
o as (select rec_id, t_ms, row_number() over (partition by rec_id order by t_ms) as k from live_log_compact),
f(rec_id, k, t_ms, last, kept) as (select rec_id, k, t_ms, t_ms, true from o where k = 1
 union all select o.rec_id, o.k, o.t_ms, case when o.t_ms - f.last > 3000 then o.t_ms else f.last end, o.t_ms - f.last > 3000 from f join o on o.rec_id = f.rec_id and o.k = f.k + 1)
select rec_id, t_ms from f where kept"""


def split_windows(spark, d):
    return iv.split_windows(ref_line(spark, d).select("rec_id", "line_idx", "start_ms", "end_ms"), 1500, 400).select("rec_id", "line_idx", F.col("part").cast("long").alias("part"), "part_start", "part_end")


ORACLE["split_windows"] = f"""{with_views('ref_line')},
n as (select *, cast(greatest(1, round_even((end_ms - start_ms) / 1500.0, 0)) as bigint) as n from ref_line),
p as (select rec_id, line_idx, start_ms, end_ms, n, unnest(range(0, n)) as part from n),
q as (select rec_id, line_idx, cast(part as bigint) as part, start_ms + ((end_ms - start_ms) * part) // n as part_start, start_ms + ((end_ms - start_ms) * (part + 1)) // n as part_end from p)
select * from q where part_end - part_start >= 400"""


def _durations(spark, d):
    return ref_line(spark, d).groupBy("rec_id").agg(F.max("end_ms").alias("duration_ms"))


def chunk_plan(spark, d):
    return iv.plan_chunks(_durations(spark, d), 20_000, 2_000).withColumn("chunk", F.col("chunk").cast("long"))


CHUNKS = """dur as (select rec_id, max(end_ms) as duration_ms from ref_line group by rec_id),
c as (select rec_id, duration_ms, unnest(range(0, cast(greatest(1, ceil(duration_ms / 20000.0)) as bigint))) as chunk from dur),
chunks as (select rec_id, duration_ms, cast(chunk as bigint) as chunk, cast(greatest(0, chunk*20000 - 2000) as bigint) as chunk_start, cast(least(least((chunk+1)*20000, duration_ms) + 2000, duration_ms) as bigint) as chunk_end,
 cast(chunk*20000 as bigint) as keep_start, cast(least((chunk+1)*20000, duration_ms) as bigint) as keep_end from c)"""
ORACLE["chunk_plan"] = f"{with_views('ref_line')}, {CHUNKS} select * from chunks"


def chunk_ownership(spark, d):
    """Each line belongs to the chunk whose exclusive range holds its midpoint."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("long")
    lines = ref_line(spark, d).withColumn("chunk", F.floor(mid / 20_000).cast("long"))
    return lines.join(chunk_plan(spark, d), ["rec_id", "chunk"]).where((mid >= F.col("keep_start")) & (mid < F.col("keep_end"))).select("rec_id", "line_idx", "chunk")


ORACLE["chunk_ownership"] = f"{with_views('ref_line')}, {CHUNKS} select r.rec_id, r.line_idx, c.chunk from ref_line r join chunks c on c.rec_id = r.rec_id and (r.start_ms + r.end_ms) // 2 >= c.keep_start and (r.start_ms + r.end_ms) // 2 < c.keep_end"


def line_windows_1_3(spark, d):
    return iv.runs_of_lines(ref_line(spark, d), ["rec_id"], "line_idx").select("rec_id", "line_idx", F.col("n_lines").cast("long").alias("n_lines"), "start_ms", "end_ms", F.md5("text").alias("text_md5"))


ORACLE["line_windows_1_3"] = f"""{with_views('ref_line')},
o as (select *, row_number() over (partition by rec_id order by line_idx) as k from ref_line),
w as (select a.rec_id, a.line_idx, cast(n as bigint) as n_lines, a.start_ms, max(b.end_ms) as end_ms, string_agg(b.text, '' order by b.k) as text, count(*) as c
 from o a cross join (values (1), (2), (3)) v(n) join o b on b.rec_id = a.rec_id and b.k between a.k and a.k + n - 1 group by a.rec_id, a.line_idx, n, a.start_ms)
select rec_id, line_idx, n_lines, start_ms, end_ms, md5(text) as text_md5 from w where c = n_lines"""


def eval_pairs(spark, d):
    return pr.greedy_pairs(ref_line(spark, d), hyp_line(spark, d))


GREEDY = f"""{with_views('hyp_line', recursive=True)}, {CAND},
o as (select *, row_number() over (partition by rec_id order by ov desc, i, j) as k from cand),
f(rec_id, k, i, j, ov, ui, uj, taken) as (
 select rec_id, k, i, j, ov, [i], [j], true from o where k = 1
 union all select o.rec_id, o.k, o.i, o.j, o.ov, case when list_contains(ui, o.i) or list_contains(uj, o.j) then ui else list_append(ui, o.i) end,
  case when list_contains(ui, o.i) or list_contains(uj, o.j) then uj else list_append(uj, o.j) end, not (list_contains(ui, o.i) or list_contains(uj, o.j))
 from f join o on o.rec_id = f.rec_id and o.k = f.k + 1),
pairs as (select rec_id, i, j, ov from f where taken)"""
ORACLE["eval_pairs"] = f"{GREEDY} select rec_id, i, j, cast(ov as bigint) as overlap_ms from pairs"


def eval_missing(spark, d):
    pairs = eval_pairs(spark, d).select("rec_id", F.col("i").alias("line_idx"))
    return ref_line(spark, d).join(pairs, ["rec_id", "line_idx"], "left_anti").select("rec_id", "line_idx", "start_ms", "end_ms", "text")


def eval_extra(spark, d):
    pairs = eval_pairs(spark, d).select("rec_id", F.col("j").alias("line_idx"))
    return hyp_line(spark, d).join(pairs, ["rec_id", "line_idx"], "left_anti").select("rec_id", "line_idx", "start_ms", "end_ms", "text")


ORACLE["eval_missing"] = f"{GREEDY} select rec_id, line_idx, start_ms, end_ms, text from ref_line r where not exists (select 1 from pairs p where p.rec_id = r.rec_id and p.i = r.line_idx)"
ORACLE["eval_extra"] = f"{GREEDY} select rec_id, line_idx, start_ms, end_ms, text from hyp_line h where not exists (select 1 from pairs p where p.rec_id = h.rec_id and p.j = h.line_idx)"


def eval_report(spark, d):
    ref, hyp = ref_line(spark, d), hyp_line(spark, d)
    return pr.report(pr.paired_lines(ref, hyp, pr.greedy_pairs(ref, hyp), normal_alnum), hyp)


#: DuckDB counts edits in bytes: each accented letter first becomes an unused control character of its own.
ACCENTS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
FOLD = "(" + " || ".join(f"chr({i})" for i in (*range(1, 9), *range(14, 27))) + ")"
NORM2 = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
LINES = f"""lines as (select r.rec_id, r.line_idx as i, p.j, abs(r.start_ms - h.start_ms) as se, abs(r.end_ms - h.end_ms) as ee, {NORM2.format('r.text')} as rt, {NORM2.format('h.text')} as ht
 from ref_line r left join pairs p on p.rec_id = r.rec_id and p.i = r.line_idx left join hyp_line h on h.rec_id = r.rec_id and h.line_idx = p.j)"""
ORACLE["eval_report"] = f"""{GREEDY}, {LINES},
a as (select rec_id, count(*) as n_ref, count(j) as n_pairs, sum(case when rt = ht then 1 else 0 end) as et, sum(case when se <= 300 and ee <= 300 then 1 else 0 end) as xt, sum(se) as ss, sum(ee) as es,
 list_sort(list(se) filter (where se is not null)) as l from lines group by rec_id), h as (select rec_id, count(*) as n_hyp from hyp_line group by rec_id)
select a.rec_id, n_ref, coalesce(n_hyp, 0) as n_hyp, n_pairs, n_ref - n_pairs as n_missing, coalesce(n_hyp, 0) - n_pairs as n_extra, round(et / n_ref, 6) as exact_text_rate, round(xt / n_ref, 6) as exact_time_rate,
 round(ss / greatest(1, n_pairs), 6) as start_err_mean, round(es / greatest(1, n_pairs), 6) as end_err_mean, l[cast(floor(0.9 * (len(l) - 1)) as bigint) + 1] as start_p90_ms
from a left join h using (rec_id)"""


def eval_report_full(spark, d):
    """With the similarity fallback for lines that overlap nothing."""
    ref, hyp = ref_line(spark, d), hyp_line(spark, d)
    pairs = pr.greedy_pairs(ref, hyp)
    every = pairs.unionByName(pr.similarity_fallback(ref, hyp, pairs, normal_alnum))
    return pr.report(pr.paired_lines(ref, hyp, every, normal_alnum), hyp)


def eval_boundary_cases(spark, d):
    """Why a line is not exact: missing, different text, near text, time shift; candidates without a line are extra."""
    ref, hyp = ref_line(spark, d), hyp_line(spark, d)
    pairs = pr.greedy_pairs(ref, hyp)
    lines = pr.paired_lines(ref, hyp, pairs, normal_alnum)
    near = F.col("edits") * 10 <= F.col("ref_len") * 4
    kind = F.when(F.col("j").isNull(), "missing").when(~F.col("exact_text"), F.when(near, "near_text").otherwise("different_text")).when(~F.col("exact_time"), "time_shift")
    extra = hyp.join(pairs.select("rec_id", F.col("j").alias("line_idx")), ["rec_id", "line_idx"], "left_anti").select("rec_id", F.col("line_idx").alias("i"), F.lit("extra").alias("kind"))
    return lines.select("rec_id", "i", kind.alias("kind")).where("kind is not null").unionByName(extra)


LEV = f"levenshtein(translate(rt, '{ACCENTS}', {FOLD}), translate(ht, '{ACCENTS}', {FOLD}))"
ORACLE["eval_boundary_cases"] = f"""{GREEDY}, {LINES}
select rec_id, i, kind from (select rec_id, i, case when j is null then 'missing' when rt <> ht then case when {LEV} * 10 <= length(rt) * 4 then 'near_text' else 'different_text' end
 when not (se <= 300 and ee <= 300) then 'time_shift' end as kind from lines) t where kind is not null
union all select rec_id, line_idx, 'extra' from hyp_line h where not exists (select 1 from pairs p where p.rec_id = h.rec_id and p.j = h.line_idx)"""


def eval_worst_lines(spark, d):
    """The three lines of a recording with the most edits for their length; missing lines first."""
    from pyspark.sql import Window

    ref, hyp = ref_line(spark, d), hyp_line(spark, d)
    lines = pr.paired_lines(ref, hyp, pr.greedy_pairs(ref, hyp), normal_alnum)
    sim = F.coalesce(F.round(1 - F.col("edits") / F.greatest(F.lit(1), F.col("ref_len")), 4), F.lit(0.0))
    ranked = lines.select("rec_id", "i", sim.alias("text_sim")).withColumn("rank", F.row_number().over(Window.partitionBy("rec_id").orderBy("text_sim", "i")).cast("long"))
    return ranked.where("rank <= 3")


ORACLE["eval_worst_lines"] = f"""{GREEDY}, {LINES}, s as (select rec_id, i, coalesce(round(1 - {LEV} / greatest(1, length(rt)), 4), 0.0) as text_sim from lines),
r as (select *, row_number() over (partition by rec_id order by text_sim, i) as rank from s) select * from r where rank <= 3"""


def cer_per_line(spark, d):
    """Against the next line of the recording, whole texts normalised."""
    from pyspark.sql import Window

    from ..functions.text import cer

    nxt = F.lead("text").over(Window.partitionBy("rec_id").orderBy("line_idx"))
    t = ref_line(spark, d).withColumn("next", nxt).where("next is not null")
    return t.select("rec_id", "line_idx", F.round(cer(normal_alnum(F.col("next")), normal_alnum(F.col("text"))), 6).alias("cer"))


ORACLE["cer_per_line"] = f"""{with_views('ref_line')}, n as (select rec_id, line_idx, {NORM2.format('text')} as rt, lead({NORM2.format('text')}) over (partition by rec_id order by line_idx) as ht from ref_line)
select rec_id, line_idx, round(case when length(rt) = 0 then case when length(ht) = 0 then 0.0 else 1.0 end else {LEV} / length(rt) end, 6) as cer from n where ht is not null"""


def cer_per_recording(spark, d):
    """Whole-text error rate of the candidate against the reference, for recordings of at most 2,000 characters."""
    whole = lambda df: df.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "line_idx", "text"))), lambda x: normal_alnum(x["text"])), "").alias("t"))
    r, h = whole(ref_line(spark, d)), whole(hyp_line(spark, d)).withColumnRenamed("t", "h")
    from ..functions.scalars import whole_cer

    both = r.join(h, "rec_id", "left").withColumn("h", F.coalesce("h", F.lit("")))
    return both.select("rec_id", F.length("t").cast("long").alias("n_ref"), F.round(whole_cer(F.col("h"), F.col("t")), 6).alias("cer"))


cer_per_recording.__doc__ = "Whole-text error rate of the candidate against the reference."
ORACLE["cer_per_recording"] = f"""{with_views('hyp_line')},
r as (select rec_id, string_agg({NORM2.format('text')}, '' order by start_ms, line_idx) as rt from ref_line group by rec_id),
h as (select rec_id, string_agg({NORM2.format('text')}, '' order by start_ms, line_idx) as ht from hyp_line group by rec_id),
b as (select rec_id, rt, coalesce(ht, '') as ht from r left join h using (rec_id))
select rec_id, length(rt) as n_ref, round(case when length(rt) = 0 then case when length(ht) = 0 then 0.0 else 1.0 end else {LEV} / length(rt) end, 6) as cer from b"""


def chat_density(spark, d):
    """Chat messages in ten-minute bins of each recording's log, empty bins filled."""
    log = live_log(spark, d)
    spine = log.groupBy("rec_id").agg(F.max("t_ms").alias("m")).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("m div 86400000"))))
    n = log.where("kind = 'chat'").groupBy("rec_id", F.expr("t_ms div 86400000").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(n, ["rec_id", "bin"], "left").select("rec_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


chat_density.__doc__ = "Chat messages in one-day bins of each recording's log, empty bins filled."
ORACLE["chat_density"] = f"""{with_views('live_log')}, s as (select rec_id, unnest(range(0, max(t_ms) // 86400000 + 1)) as bin from live_log group by rec_id),
n as (select rec_id, t_ms // 86400000 as bin, count(*) as n from live_log where kind = 'chat' group by all) select rec_id, bin, coalesce(n, 0) as n from s left join n using (rec_id, bin)"""


def ship_density(spark, d):
    """The same count at the size of lineitem: lines shipped in 30-day bins for each supplier, empty bins filled."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    t = table(spark, d, "lineitem").select("l_suppkey", F.expr("0").alias("z"), day.alias("day"))
    n = t.groupBy("l_suppkey", F.expr("day div 30").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = n.groupBy("l_suppkey").agg(F.max("bin").alias("m")).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), "m")))
    return spine.join(n, ["l_suppkey", "bin"], "left").select("l_suppkey", "bin", F.coalesce("n", F.lit(0)).alias("n"))


ORACLE["ship_density"] = """with n as (select l_suppkey, date_diff('day', date '1992-01-01', cast(l_shipdate as date)) // 30 as bin, count(*) as n from lineitem group by all),
s as (select l_suppkey, unnest(range(0, max(bin) + 1)) as bin from n group by l_suppkey) select l_suppkey, bin, coalesce(n, 0) as n from s left join n using (l_suppkey, bin)"""

QUERIES |= {
    f.__name__: f
    for f in (
        overlap_join, overlap_semi, overlap_anti_replace, nearest_request, event_support, transcript_lookup, thin_events, split_windows, chunk_plan, chunk_ownership, line_windows_1_3,
        eval_pairs, eval_missing, eval_extra, eval_report, eval_report_full, eval_boundary_cases, eval_worst_lines, cer_per_line, cer_per_recording, chat_density, ship_density,
    )
}
