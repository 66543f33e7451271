"""Queries over logs, texts, features and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import livelog as lv
from ..operators import signals as sg
from ..operators import sweeps as sw
from ..operators import vectors as vc
from .views import activity, feature, live_log, live_log_compact, ref_line, table, with_views

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""{with_views('live_log')}, n as (select rec_id, term, cast(sum(case kind when 'chat' then 1 else 2 end) as bigint) as score, min(ord) as f from live_log group by all),
r as (select *, row_number() over (partition by rec_id order by score desc, f) as k from n),
q as (select *, row_number() over (partition by rec_id order by score desc, f) as rank from r where k <= 80 and score >= 2 and not regexp_matches(term, '^[0-9]+$') and length(term) between 2 and 12)
select rec_id, term, score, rank from q where rank <= 20""")
def hotwords(spark, d):
    return lv.hotwords(live_log(spark, d))


@query(f"""{with_views('live_log')}, n as (select term, rec_id, count(*) as n, min(ord) as f from live_log group by all),
r as (select *, row_number() over (partition by term order by n desc, f) as k from n) select term, rec_id, n from r where k = 1""")
def top_sender(spark, d):
    return lv.top_sender(live_log(spark, d), "term", "rec_id")


@query(f"""{with_views('live_log')} select rec_id, count(*) as n, count(*) filter (where kind = 'chat') as n_chat, count(*) filter (where kind = 'gift') as n_gift, count(*) filter (where kind = 'sc') as n_sc,
count(*) filter (where kind = 'guard') as n_guard, max(t_ms) as duration_ms, cast(sum(case when kind <> 'chat' then cents else 0 end) as bigint) as cents from live_log group by rec_id""")
def log_summary(spark, d):
    return lv.log_summary(live_log(spark, d))


@query(f"""{with_views('live_log_compact')}, u as (select 0 as src, * from live_log_compact union all select 1 as src, rec_id, ord, t_ms + 10 as t_ms, kind, term, cents from live_log_compact),
c as (select *, row_number() over (partition by rec_id, cast(round_even(t_ms / 100.0, 0) as bigint), term order by src, ord) as k from u where kind = 'chat')
select rec_id, ord, t_ms, kind, term, cents from c where k = 1 union all select rec_id, ord, t_ms, kind, term, cents from u where kind <> 'chat'""")
def merge_logs(spark, d):
    log = live_log_compact(spark, d)
    return lv.merge_logs([log, log.withColumn("t_ms", F.col("t_ms") + 10)])


@query(f"""{with_views('live_log_compact', recursive=True)}, o as (select *, row_number() over (partition by rec_id, term order by t_ms, ord) as k from live_log_compact),
f(rec_id, term, k, ord, t, kept, ends) as (select rec_id, term, k, ord, t_ms, true, [t_ms + 400] from o where k = 1
 union all select o.rec_id, o.term, o.k, o.ord, o.t_ms, len(list_filter(ends, lambda e: e <= o.t_ms and o.t_ms - e <= 30000)) = 0,
 case when len(list_filter(ends, lambda e: e <= o.t_ms and o.t_ms - e <= 30000)) = 0 then list_append(ends, o.t_ms + 400) else ends end
 from f join o on o.rec_id = f.rec_id and o.term = f.term and o.k = f.k + 1)
select rec_id, term, ord, t as start_ms, t + 400 as end_ms from f where kept""")
def exact_repeat_suppression(spark, d):
    rows = live_log_compact(spark, d).select("rec_id", "term", "ord", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 400).alias("end_ms"))
    return sw.suppress_repeats(rows, ["rec_id"], "term", 30_000)


@query(r"""with t as (select doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '\[[^\]\[]*\]', '', 'g'), '[A-Za-z]{2,8}') as ts from documents)
select doc_id, cast(len(ts) as bigint) as n_terms, cast(len(list_distinct(ts)) as bigint) as n_distinct, md5(array_to_string(ts, ' ')) as terms_md5 from t""")
def terms(spark, d):
    ts = table(spark, d, "documents").select("doc_id", tx.terms(F.col("text"), "A-Za-z").alias("ts"))
    return ts.select("doc_id", F.size("ts").cast("long").alias("n_terms"), F.size(F.array_distinct("ts")).cast("long").alias("n_distinct"), F.md5(F.array_join("ts", " ")).alias("terms_md5"))


@query(r"""with c as (select conv_id, turn, regexp_extract(regexp_replace(text, '\[[^\]\[]*\]', '', 'g'), '(?:with|avec|mit|con)[ ]+([^\n]+)', 1) as raw from conversations where regexp_matches(text, 'with|avec|mit|con')),
a as (select conv_id, turn, trim(regexp_split_to_array(trim(raw), '[，,。！!？?~～\s]')[1]) as name from c),
b as (select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(name, '^(?:th|la|de)', ''), '^(?:th|la|de)', ''), '^(?:th|la|de)', '') as name from a),
e as (select conv_id, turn, trim(regexp_replace(name, '(?:ed|ing)$', '')) as name from b) select conv_id, turn, name from e where length(name) between 2 and 30""")
def request_names(spark, d):
    """With Latin words for the request pattern, the prefixes and the suffix."""
    name = tx.request_name(F.col("text"), "with|avec|mit|con", r"(?:with|avec|mit|con)[ ]+([^\n]+)", ["^(?:th|la|de)"], "(?:ed|ing)$", quotes=r"《([^》]{1,30})》")
    return table(spark, d, "conversations").select("conv_id", "turn", name.alias("name")).where("name is not null")


@query(r"select doc_id, length(regexp_replace(text, '\[[^\]\[]*\]', '', 'g')) as n_left, md5(regexp_replace(text, '\[[^\]\[]*\]', '', 'g')) as text_md5 from documents")
def emote_strip(spark, d):
    t = F.regexp_replace("text", r"\[[^\]\[]*\]", "")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n_left"), F.md5(t).alias("text_md5"))


@query(r"""with n as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as label from pages)
select page_id, href, label, count(*) as n from n group by all""")
def markup_nodes(spark, d):
    """Link nodes of whole pages by pattern, which a truncated page cannot break."""
    p = r'<a href="([^"]*)">([^<]*)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(p), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(p), F.lit(2)).alias("label"))
    return table(spark, d, "pages").select("page_id", F.explode(both).alias("x")).groupBy("page_id", "x.href", "x.label").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with t as (select page_id, substr(html, 1, length(html) * 2 // 3) as html from pages), n as (select page_id, unnest(regexp_extract_all(html, '<(?:p|h1|li)>[^<]*</(?:p|h1|li)>')) as node from t)
select page_id, count(*) as n_nodes, cast(sum(length(node)) as bigint) as chars from n group by page_id""")
def markup_repair(spark, d):
    """Complete nodes of pages cut at two thirds of their length."""
    cut = F.expr("left(html, cast(length(html) * 2 div 3 as int))")
    nodes = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(cut, F.lit(r"<(?:p|h1|li)>[^<]*</(?:p|h1|li)>"), F.lit(0))).alias("node"))
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.length("node")).cast("long").alias("chars"))


@query(r"""select doc_id, md5(trim(lower(regexp_replace(text, '[\s\x0b\x{3000},，、。.！!？?；;：:…·—\-_~～"''“”‘’（）()\[\]【】《》〈〉<>/\\|@#$%\^&*+=`]', '', 'g')))) as n1_md5,
md5(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) as n2_md5, md5(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) as n3_md5 from documents""")
def normal_forms(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(tx.normal_text(t)).alias("n1_md5"), F.md5(tx.normal_alnum(t)).alias("n2_md5"), F.md5(tx.normal_key(t)).alias("n3_md5"))


@query(r"""select doc_id, cast(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as bigint) as n_mail,
cast(len(regexp_extract_all(text, '\+?[0-9][0-9 -]{7,14}[0-9]')) as bigint) as n_phone, cast(len(regexp_extract_all(text, '[A-Za-z0-9_-]{32,}')) as bigint) as n_token from documents
where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+?[0-9][0-9 -]{7,14}[0-9]|[A-Za-z0-9_-]{32,}')""")
def pii_scan(spark, d):
    """Counts of mail addresses, phone numbers and token-like runs."""
    rules = {"n_mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "n_phone": r"\+?[0-9][0-9 -]{7,14}[0-9]", "n_token": r"[A-Za-z0-9_-]{32,}"}
    hits = table(spark, d, "documents").where(F.col("text").rlike("|".join(rules.values())))
    return hits.select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in rules.items()])


DOT = "list_sum(list_transform(list_zip({}, {}), lambda z: cast(z[1] as double) * cast(z[2] as double)))"
E = """e as (select vec_id, label, vec_id // 8 as block, embedding as v from embeddings),
m as (select label, i, avg(cast(x as double)) as x from (select label, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from e where label in (0, 1)) t group by label, i),
m2 as (select label, list(x order by i) as v from m group by label),
p as (select label as profile, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as pv from m2)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.expr("vec_id div 8").alias("block"), F.col("embedding").alias("v"))


def _similar(spark, d):
    v = _vectors(spark, d)
    profiles = vc.centroids(v.where("label in (0, 1)"), "label", "v").withColumnRenamed("label", "profile")
    return vc.profile_similarity(v, profiles, "v", ["vec_id", "block"])


SIM = f"with {E}, s as (select vec_id, block, profile, {DOT.format('v', 'pv')} as sim from e cross join p)"


@query(f"{SIM} select vec_id, profile, round(sim, 6) as sim from s")
def profile_similarity(spark, d):
    return _similar(spark, d).select("vec_id", "profile", F.round("sim", 6).alias("sim"))


@query(f"""{SIM}, w as (select block, vec_id, max(case when profile = 0 then sim end) as speak, max(case when profile = 1 then sim end) as sing from s group by block, vec_id)
select block, round(avg(speak), 6) as speak_sim, round(avg(sing), 6) as sing_sim, round(avg(case when greatest(speak, sing) >= 0.1 then 1.0 else 0.0 end), 6) as vote, avg(case when greatest(speak, sing) >= 0.1 then 1.0 else 0.0 end) >= 0.5 as is_streamer,
 avg(sing) > avg(speak) as singing from w group by block""")
def window_vote(spark, d):
    """Per segment of windows: mean similarities, the share of windows over the threshold, and the verdicts."""
    w = _similar(spark, d).groupBy("block", "vec_id").agg(F.max(F.when(F.col("profile") == 0, F.col("sim"))).alias("speak"), F.max(F.when(F.col("profile") == 1, F.col("sim"))).alias("sing"))
    vote = F.avg((F.greatest("speak", "sing") >= 0.1).cast("double"))
    return w.groupBy("block").agg(F.round(F.avg("speak"), 6).alias("speak_sim"), F.round(F.avg("sing"), 6).alias("sing_sim"), F.round(vote, 6).alias("vote"), (vote >= 0.5).alias("is_streamer"), (F.avg("sing") > F.avg("speak")).alias("singing"))


@query(f"""{SIM}, f as (select block, quantile_cont(sim, 0.95) as f from s where profile = 0 group by block)
select block, round(least(0.62, greatest(0.05, f)), 3) as speak_threshold, round(least(0.62, greatest(0.04, f - 0.08)), 3) as sing_threshold from f""")
def adaptive_threshold(spark, d):
    f = _similar(spark, d).where("profile = 0").groupBy("block").agg(F.percentile("sim", 0.95).alias("f"))
    adapt = lambda base, x: F.round(F.least(F.lit(0.62), F.greatest(F.lit(base), x)), 3)
    return f.select("block", adapt(0.05, F.col("f")).alias("speak_threshold"), adapt(0.04, F.col("f") - 0.08).alias("sing_threshold"))


SIMS = f"with {E}, n as (select label, count(*) as n from e group by label), s as (select a.label, a.vec_id, b.vec_id as other, round({DOT.format('a.v', 'b.v')}, 9) as sim from e a join e b on a.label = b.label and a.vec_id <> b.vec_id)"
COH = """, r as (select s.*, n, row_number() over (partition by s.label, vec_id order by sim desc, other) as k from s join n on n.label = s.label), c as (select label, vec_id, avg(sim) as cohesion from r where k <= least(n - 1, {}) group by label, vec_id)"""


@query(f"{SIMS}{COH.format('3')} select label, vec_id, round(cohesion, 6) as cohesion from c")
def knn_cohesion(spark, d):
    """All windows of a recording (here a label) against each other."""
    return vc.neighbours(_vectors(spark, d), "vec_id", "label", "v", 3).select("label", "vec_id", F.round("cohesion", 6).alias("cohesion"))


@query(f"""{SIMS}{COH.format('greatest(3, cast(floor(n * 0.35) as bigint))')}, seed as (select label, vec_id as seed from (select *, row_number() over (partition by label order by round(cohesion, 9) desc, vec_id) as k from c) t where k = 1),
near as (select s.label, s.other as vec_id, n, row_number() over (partition by s.label order by s.sim desc, s.other) as k from s join seed on s.label = seed.label and s.vec_id = seed.seed join n on n.label = s.label),
u as (select label, vec_id from near where k <= greatest(3, cast(floor(n * 0.5) as bigint)) union all select label, seed from seed),
x as (select label, i, avg(cast(x as double)) as x from (select u.label, unnest(e.v) as x, unnest(range(1, len(e.v) + 1)) as i from u join e on e.vec_id = u.vec_id) t group by label, i),
y as (select label, sqrt(sum(x * x)) as l from x group by label)
select x.label, any_value(seed.seed) as seed, round(sum(x / l * i), 5) as moment from x join y on y.label = x.label join seed on seed.label = x.label group by x.label""")
def enroll_centroid(spark, d):
    """The most cohesive window of each recording and the half nearest to it, averaged."""
    c = vc.enrolled_centroids(_vectors(spark, d), "vec_id", "label", "v")
    return c.select("label", "seed", F.round(F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5).alias("moment"))


@query(f"""with {E}, b as (select label, block, i, avg(cast(x as double)) as x from (select label, block, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from e) t group by label, block, i),
c0 as (select label, block, list(x order by i) as v from b group by label, block), c as (select label, block, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as cv from c0),
q as (select c.label, c.block, avg({DOT.format('e.v', 'c.cv')}) as internal, any_value({DOT.format('c.cv', 'p.pv')}) as to_speak from c join e on e.label = c.label and e.block = c.block join p on p.profile = 0 group by c.label, c.block)
select label, block, round(internal, 6) as internal, round(to_speak, 6) as to_speak from q where round(internal, 9) >= 0.70 and round(to_speak, 9) between 0.15 and 0.62""")
def singing_profile(spark, d):
    """Blocks of one voice that are coherent, and neither too near to nor too far from the speech profile."""
    v = _vectors(spark, d).withColumn("g", F.struct("label", "block"))
    c = vc.centroids(v, "g", "v").withColumnRenamed("vec", "cv")
    inner = v.join(c, "g").groupBy("g", "cv").agg(F.avg(vc.dot(F.col("v"), F.col("cv"))).alias("internal"))
    speak = vc.centroids(_vectors(spark, d).where("label = 0"), "label", "v").select(F.col("vec").alias("pv"))
    q = inner.crossJoin(F.broadcast(speak)).select("g.label", "g.block", "internal", vc.dot(F.col("cv"), F.col("pv")).alias("to_speak"))  # one row
    return q.where((F.round("internal", 9) >= 0.70) & F.round("to_speak", 9).between(0.15, 0.62)).select("label", "block", F.round("internal", 6).alias("internal"), F.round("to_speak", 6).alias("to_speak"))


CLIP = "least(1.0, greatest(0.0, {}))"
MUSIC = CLIP.format(f"0.40*{CLIP.format('(bass_ratio-0.10)/0.30')} + 0.20*{CLIP.format('(high_ratio-0.05)/0.18')} + 0.25*{CLIP.format('(flatness-0.06)/0.25')} + coalesce(case when side_ratio is not null then 0.15*{CLIP.format('(side_ratio-0.10)/0.35')} end, 0.0)")


@query(f"{with_views('feature')} select win, round({MUSIC}, 6) as music from feature")
def music_score(spark, d):
    return feature(spark, d).select("win", F.round(vc.music_presence(F.col("bass_ratio"), F.col("high_ratio"), F.col("flatness"), F.col("side_ratio")), 6).alias("music"))


#: Fixed weights of the factors.
WEIGHTS = {"sim": 1.00, "music": 0.55, "side": 0.35, "flat": 0.05, "loud": 0.10}


@query(f"""{with_views('feature')}, m as (select *, {MUSIC} as music, {CLIP.format('vocal_sim')} as sim from feature),
s as (select *, sim - 0.55*music*(1.0-sim) - coalesce(case when side_ratio is not null then 0.35*greatest(0.0, side_ratio-0.12) end, 0.0) - 0.05*greatest(0.0, flatness-0.12) - 0.10*greatest(0.0, 0.85-loud_cv) as score from m),
w as (select *, score >= 0.12 as keep, list_filter([case when sim < 0.35 then 'low similarity' when sim < 0.50 then 'medium similarity' end, case when music > 0.45 then 'music' end, case when side_ratio > 0.25 then 'wide stereo' end], lambda x: x is not null) as why from s)
select win, round(score, 6) as score, keep, array_to_string(case when not keep and len(why) = 0 then ['low score'] else why end, '; ') as reasons from w""")
def keep_decision(spark, d):
    f = feature(spark, d).withColumn("music", vc.music_presence(F.col("bass_ratio"), F.col("high_ratio"), F.col("flatness"), F.col("side_ratio")))
    return vc.keep_decision(f, WEIGHTS, 0.12).select("win", F.round("score", 6).alias("score"), "keep", F.array_join("why", "; ").alias("reasons"))


@query(f"""{with_views('feature')}, m as (select *, {MUSIC} as music, {CLIP.format('vocal_sim')} as sim, case when win % 3 = 0 then win % 10 / 5.0 end as support from feature),
s as (select *, sim - 0.55*music*(1.0-sim) - coalesce(case when side_ratio is not null then 0.35*greatest(0.0, side_ratio-0.12) end, 0.0) - 0.05*greatest(0.0, flatness-0.12) - 0.10*greatest(0.0, 0.85-loud_cv) + 0.10*{CLIP.format('coalesce(support, 0.0)')} as score from m)
select win, round(score, 6) as score, score >= 0.12 as keep, coalesce(support > 0.3, false) as told from s""")
def supported_decision(spark, d):
    """The same with what the context says for a row."""
    f = feature(spark, d).withColumn("music", vc.music_presence(F.col("bass_ratio"), F.col("high_ratio"), F.col("flatness"), F.col("side_ratio")))
    f = f.withColumn("support", F.when(F.col("win") % 3 == 0, F.col("win") % 10 / 5.0))
    return vc.keep_decision(f, WEIGHTS, 0.12, F.col("support")).select("win", F.round("score", 6).alias("score"), "keep", F.array_contains("why", "context").alias("told"))


@query(f"{with_views('activity')} select round(quantile_cont(level, 0.10), 6) as p10, round(quantile_cont(level, 0.15), 6) as p15, round(quantile_cont(level, 0.95), 6) as p95 from activity")
def percentile_floor(spark, d):
    return sg.floors(activity(spark, d), "level")


@query(f"""{with_views('activity')}, q as (select quantile_cont(level, 0.15) as f from activity), s as (select frame_idx from activity, q where level > f * 2),
a as (select frame_idx, lag(frame_idx) over (order by frame_idx) as p from s), b as (select frame_idx, sum(case when p is null or frame_idx - p - 1 > 3 then 1 else 0 end) over (order by frame_idx) as g from a)
select min(frame_idx) as first_frame, max(frame_idx) as last_frame from b group by g having max(frame_idx) - min(frame_idx) + 1 >= 2""")
def activity_islands(spark, d):
    a = activity(spark, d)
    low = sg.floors(a, "level", (0.15,)).withColumnRenamed("p15", "f")
    return sg.active_islands(a.crossJoin(F.broadcast(low)), F.col("level") > F.col("f") * 2, 3, 2)  # one row is broadcast


@query("""with t as (select l_suppkey, date_diff('day', date '1992-01-01', cast(l_shipdate as date)) // 90 as w, cast(l_quantity as double) as x from lineitem),
p as (select l_suppkey, quantile_cont(m, 0.5) as w from (select l_suppkey, w, quantile_cont(x, 0.5) as m, count(*) as n from t group by all) q where n >= 3 group by l_suppkey), a as (select l_suppkey, quantile_cont(x, 0.5) as a from t group by l_suppkey)
select l_suppkey, round(greatest(-30.0, least(30.0, coalesce(w, a))), 6) as shift from a left join p using (l_suppkey)""")
def median_of_medians(spark, d):
    """Two-level median of lineitem quantities per supplier: 90-day windows of three rows or more."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    t = table(spark, d, "lineitem").select("l_suppkey", F.floor(day / 90).alias("w"), F.col("l_quantity").alias("x"))
    return sg.median_shift(t, ["l_suppkey"], "w", "x", 3, 30.0)


@query(f"""{with_views('ref_line', 'live_log_compact')}, c as (select f, count(*) as c from (select unnest(range(start_ms // 100, end_ms // 100 + 1)) as f from ref_line) t group by f), x as (select t_ms // 100 as f, count(*) as n from live_log_compact group by all),
g as (select x.f, x.n, coalesce(c.c, 0) as a from x left join c on c.f = x.f), l as (select unnest(range(-12, 13)) as lag),
j as (select lag, cast(a.a as bigint) as a, cast(b.n as bigint) as b from l cross join g a join g b on b.f = a.f + lag),
m as (select lag, count(*) as n, sum(a) as sx, sum(b) as sy, sum(a*a) as sxx, sum(b*b) as syy, sum(a*b) as sxy from j group by lag)
select cast(lag as integer) as lag, n, round((n*sxy - sx*sy) / nullif(sqrt(cast(n*sxx - sx*sx as double)) * sqrt(cast(n*syy - sy*sy as double)), 0), 6) as corr from m""")
def lag_search(spark, d):
    """Lines that cover a frame against its event count, for lags of -12..12 tenths of a second."""
    frames = ref_line(spark, d).select(F.explode(F.sequence(F.expr("start_ms div 100"), F.expr("end_ms div 100"))).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("c"))
    n = live_log_compact(spark, d).groupBy(F.expr("t_ms div 100").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    g = n.join(frames, "f", "left").select("f", F.coalesce("c", F.lit(0)).alias("on"))
    return sg.lag_search(g, n, "f", "on", "n", range(-12, 13))


@query(f"""{with_views('activity')}, l as (select a.frame_idx as first_frame, a.frame_idx + 2 as last_frame from activity a where a.frame_idx % 50 = 0),
n as (select first_frame, last_frame, frame_idx, level from l join activity a on a.frame_idx between greatest(0, first_frame - 10) and last_frame + 10),
f as (select first_frame, quantile_cont(level, 0.10) as f from n group by first_frame)
select n.first_frame, n.last_frame, min(frame_idx) as onset, max(frame_idx) as "offset" from n join f on f.first_frame = n.first_frame where level >= f + 500 group by all""")
def onset_search(spark, d):
    a = activity(spark, d)
    lines = a.where("frame_idx % 50 = 0").select(F.col("frame_idx").alias("first_frame"), (F.col("frame_idx") + 2).alias("last_frame"))
    return sg.onset(lines, a.select("frame_idx", "level"), 10, 0.10, 500)
