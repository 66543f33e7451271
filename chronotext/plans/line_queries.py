"""Queries over filters, merges, edits, log analytics and signals of recordings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import char_hit_ratio
from ..functions.text import normal_alnum
from ..operators import edits as ed
from ..operators import intervals as iv
from ..operators import livelog as lv
from ..operators import signals as sg
from ..operators import sweeps as sw
from ..sources import folders
from .format_queries import with_words
from .registry import registry
from .scalar_queries import N2
from .views import feature, hyp_line, live_log, live_log_compact, ref_line, table, with_views

QUERIES, ORACLE, query = registry()
REF, LOG = with_views("ref_line"), with_views("live_log")


# ---- filters ----


@query("select l_orderkey, l_linenumber from lineitem where l_quantity / 10 <= 2.4 and l_tax * 12 <= 0.90 and not (l_discount <> 0 and -l_discount * 20 < -1.2) and l_linenumber <> 4")
def segment_filter(spark, d):
    """Recognised segments, of lineitem's figures: too repetitive, without speech or unlikely ones go, and those without words."""
    from ..operators.recognition import keep_segment

    t = table(spark, d, "lineitem")
    figures = dict(compression_ratio=F.col("l_quantity") / 10, no_speech_prob=F.col("l_tax") * 12, avg_logprob=-F.col("l_discount") * 20, n_words=F.when(F.col("l_linenumber") == 4, 0).otherwise(3))
    return t.where(keep_segment(**figures)).select("l_orderkey", "l_linenumber")


@query(f"{REF} select rec_id, line_idx from ref_line where contains(text, 'th') and end_ms > 2000 and start_ms < 9000")
def text_and_range(spark, d):
    """Lines that hold a text, within a time range that they overlap."""
    return ref_line(spark, d).where(F.col("text").contains("th") & (F.col("end_ms") > 2000) & (F.col("start_ms") < 9000)).select("rec_id", "line_idx")


@query(f"{REF} select rec_id, count(*) as n from ref_line where start_ms < 8000 group by rec_id")
def duration_clip(spark, d):
    return ref_line(spark, d).where(F.col("start_ms") < 8000).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"))


@query("select page_id, regexp_extract(url, '\\.([a-z0-9]+)(?:[/?#]|$)', 1) in ('com', 'net') as known from pages")
def extension_membership(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"\.([a-z0-9]+)(?:[/?#]|$)", 1).isin("com", "net").alias("known"))


RULES = {"mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "number": r"[0-9]{6,}", "word": r"the"}


def _rule(name: str, pattern: str) -> str:
    return f"""select doc_id, '{name}' as rule, cast(count(m) filter (where not contains(near, '<') and not contains(near, '...')) as bigint) as n from (
 select doc_id, m, substr(text, cast(greatest(0, a - 30) + 1 as bigint), cast(a + length(m) + 30 - greatest(0, a - 30) as bigint)) as near from (
  select doc_id, text, m, sum(length(g)) over w + sum(coalesce(length(m), 0)) over w - coalesce(length(m), 0) as a from (
   select doc_id, text, unnest(string_split_regex(text, '{pattern}')) as g, unnest(regexp_extract_all(text, '{pattern}')) as m, unnest(range(0, len(string_split_regex(text, '{pattern}')))) as i from documents) u
  window w as (partition by doc_id order by i rows unbounded preceding)) v) x group by doc_id"""


@query(" union all ".join(_rule(k, p) for k, p in RULES.items()))
def masked_scan(spark, d):
    """Matches of a table of rules; those near a placeholder do not count."""
    from ..functions.scalars import rule_hits

    t = table(spark, d, "documents")
    rows = [t.select("doc_id", F.lit(k).alias("rule"), rule_hits(F.col("text"), p, ("<", "...")).alias("n")) for k, p in RULES.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


SPANS = "spans as (select rec_id, t_ms as start_ms, t_ms + 400 as end_ms from live_log_compact where kind = 'gift' and rec_id % 3 <> 0)"


@query(f"""{with_views('ref_line', 'live_log_compact')}, {SPANS} select rec_id, line_idx from ref_line r where rec_id not in (select rec_id from spans)
or exists (select 1 from spans s where s.rec_id = r.rec_id and least(r.end_ms, s.end_ms) > greatest(r.start_ms, s.start_ms))""")
def keep_inside(spark, d):
    """Lines under a gift; recordings without gifts keep all."""
    spans = live_log_compact(spark, d).where("kind = 'gift' and rec_id % 3 <> 0").select("rec_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 400).alias("end_ms"))
    return iv.keep_inside(ref_line(spark, d), spans, "rec_id", 10_000).select("rec_id", "line_idx")


@query(f"{REF} select rec_id, round(sum(case when line_idx % 3 = 0 then (end_ms - start_ms) / 1000 else 0 end), 3) as kept_s, round(sum((end_ms - start_ms) / 1000), 3) as total_s from ref_line group by rec_id")
def kept_seconds(spark, d):
    return iv.kept_seconds(ref_line(spark, d), F.col("line_idx") % 3 == 0)


# ---- merges ----


def _runs(gap: int) -> str:
    return f"""{with_views('live_log_compact')}, s as (select rec_id, t_ms as start_ms, t_ms + 400 as end_ms, ord from live_log_compact),
m as (select *, max(end_ms) over (partition by rec_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from s),
g as (select *, sum(case when reach is null or start_ms - reach > {gap} then 1 else 0 end) over (partition by rec_id order by start_ms, end_ms range unbounded preceding) as g from m),
r as (select rec_id, min(start_ms) as s, max(end_ms) as e, count(*) as n from g group by rec_id, g)"""


def _log_spans(spark, d):
    return live_log_compact(spark, d).select("rec_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 400).alias("end_ms"))


@query(f"{_runs(1000)} select rec_id, cast(greatest(0, s - 250) as bigint) as start_ms, cast(least(e + 250, 40000) as bigint) as end_ms, n from r where e - s >= 500")
def merge_regions(spark, d):
    """Gaps of a second merge; short runs go before padding, which the recording's end cuts."""
    return iv.gap_merge(_log_spans(spark, d), ["rec_id"], 1000, 500, 250, F.lit(40_000))


@query(f"{_runs(0)} select rec_id, s as start_ms, e as end_ms, n from r")
def merge_spans(spark, d):
    return iv.gap_merge(_log_spans(spark, d), ["rec_id"], 0)


@query(f"""{with_views('hyp_line')}, c as (select r.rec_id, r.line_idx, h.start_ms as span_start, h.end_ms as span_end, least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms) as ov, abs(h.start_ms + h.end_ms - r.start_ms - r.end_ms) as apart
 from ref_line r join hyp_line h on h.rec_id = r.rec_id),
k as (select *, row_number() over (partition by rec_id, line_idx order by greatest(0, ov) desc, case when ov > 0 then 0 else apart end, span_start, span_end) as k from c) select rec_id, line_idx, span_start, span_end from k where k = 1""")
def best_spans(spark, d):
    return iv.best_span(ref_line(spark, d), hyp_line(spark, d), "rec_id", "line_idx")


# ---- edits ----


@query(f"""{REF}, w as (select rec_id, line_idx, start_ms, end_ms, case when line_idx % 2 = 1 then case when end_ms - (start_ms + 700) < 200 then greatest(0, end_ms - 200) else start_ms + 700 end else start_ms end as s from ref_line),
p as (select r.rec_id, r.line_idx, len(regexp_extract_all(text, '\\s*\\S+')) as n from ref_line r)
select w.rec_id, w.line_idx, cast(s as bigint) as start_ms, w.end_ms, case when n > 0 then cast(s + floor(((w.end_ms - start_ms) * (n // 2) // n) * (w.end_ms - s) / greatest(1, w.end_ms - start_ms) + 0.5) as bigint) end as middle_ms from w join p using (rec_id, line_idx)""")
def edge_retime(spark, d):
    """The start of every other line dragged by 0.7 s; its words keep their share."""
    lines = with_words(ref_line(spark, d))
    out = ed.retime_edge(lines, F.col("line_idx") % 2 == 1, start=F.col("start_ms") + 700)
    return out.select("rec_id", "line_idx", "start_ms", "end_ms", F.get("words", F.floor(F.size("words") / 2).cast("int"))["start_ms"].alias("middle_ms"))


@query(f"{REF} select rec_id, line_idx, case when line_idx % 3 = 0 then '60' when line_idx % 2 = 0 then '20' end as size from ref_line where line_idx % 5 <> 1 union all select rec_id, line_idx, null from ref_line where line_idx % 5 = 1")
def line_styles(spark, d):
    """Styles set, set anew and taken away."""
    t = ref_line(spark, d).withColumn("style", F.lit(None).cast("map<string,string>"))
    t = ed.set_style(ed.set_style(t, F.col("line_idx") % 2 == 0, {"size": "20"}), F.col("line_idx") % 3 == 0, {"size": "60", "color": "#fff"})
    return ed.set_style(t, F.col("line_idx") % 5 == 1, {}).select("rec_id", "line_idx", F.col("style")["size"].alias("size"))


@query(f"""{REF}, n as (select rec_id, start_ms, end_ms, text, 0 as p, line_idx as k from ref_line union all select rec_id, start_ms + 300, start_ms + 900, 'new', 1, -1 from ref_line where line_idx = 1)
select rec_id, row_number() over (partition by rec_id order by start_ms, p, k) - 1 as line_idx, start_ms, end_ms, text from n""")
def inserted_lines(spark, d):
    lines = ref_line(spark, d)
    new = lines.where("line_idx = 1").select("rec_id", (F.col("start_ms") + 300).alias("start_ms"), (F.col("start_ms") + 900).alias("end_ms"), F.lit("new").alias("text"))
    return ed.insert_line(lines, new.unionByName(new.withColumn("end_ms", F.col("start_ms"))))


@query("select o_custkey as project from orders where o_orderstatus = 'F' group by o_custkey having date '1998-12-31' - max(cast(o_orderdate as date)) > 900")
def old_drafts(spark, d):
    p = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("project")).agg(F.max(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))).alias("updated"))
    return ed.old_drafts(p.withColumn("draft", F.lit(True)), 10591, 900)


@query("""with e as (select user_id as project, event_id as seq, (epoch_us(ts) // 1000) as t, event_type = 'purchase' as forced from events), n as (select *, lead(t) over (partition by project order by t, seq) as n from e)
select project, seq from n where forced or n is null or n - t >= 600000""")
def autosaves(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("t_ms"), (F.col("event_type") == "purchase").alias("forced"))
    return ed.autosaves(e, 600_000)


@query(f"""{REF}, w as (select rec_id, line_idx, start_ms, end_ms, len(regexp_extract_all(text, '\\s*\\S+')) as n from ref_line)
select rec_id, line_idx, cast(greatest(0, start_ms - 1500) as bigint) as first_ms, cast(greatest(greatest(0, start_ms + (end_ms - start_ms) * (n - 1) // n - 1500) + 10, end_ms - 1500) as bigint) as last_ms, start_ms * 25 // 24 as slow_ms from w where n > 0""")
def word_shift(spark, d):
    """Words moved back by 1.5 s, and stretched."""
    t = with_words(ref_line(spark, d)).where(F.size("words") > 0)
    moved, slow = ed.shift_words(F.col("words"), -1500), ed.retime_words(F.col("words"), 25, 24)
    return t.select("rec_id", "line_idx", F.element_at(moved, 1)["start_ms"].alias("first_ms"), F.element_at(moved, -1)["end_ms"].alias("last_ms"), F.element_at(slow, 1)["start_ms"].alias("slow_ms"))


@query(f"{REF} select rec_id, line_idx, 'x' || line_idx as text, end_ms + 5 as end_ms, cast(1 as bigint) as n_words, start_ms as word_ms from ref_line")
def replaced_text(spark, d):
    t = ed.replace_text(with_words(ref_line(spark, d)), F.concat(F.lit("x"), F.col("line_idx").cast("string")), F.col("end_ms") + 5)
    return t.select("rec_id", "line_idx", "text", "end_ms", F.size("words").cast("long").alias("n_words"), F.get("words", F.lit(0))["start_ms"].alias("word_ms"))


# ---- logs ----


def _named_log(spark, d):
    """The log with senders and gifts of the terms' own names."""
    return live_log(spark, d).select("rec_id", "ord", "t_ms", "kind", F.concat(F.lit("u"), F.col("term")).alias("user_name"), F.when(F.col("kind").isin("chat", "sc"), F.concat(F.lit("say "), F.col("term"))).alias("text"), F.when(F.col("kind") == "gift", F.col("term")).alias("gift"))


NAMED = f"{LOG}, l as (select rec_id, ord, t_ms, kind, 'u' || term as user_name, case when kind in ('chat', 'sc') then 'say ' || term end as text, case when kind = 'gift' then term end as gift from live_log)"


@query(rf"""{NAMED}, w as (select rec_id, user_name as term, 3 as w, 0 as g, ord, 0 as i from l where kind = 'chat' union all select rec_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')), 1, 0, ord, unnest(range(1, len(regexp_extract_all(text, '[A-Za-z0-9]+')) + 1)) from l where kind = 'chat'
 union all select rec_id, gift, 2, 1, ord, 0 from l where kind <> 'chat' and gift is not null union all select rec_id, user_name, 2, 1, ord, 1 from l where kind <> 'chat'),
n as (select rec_id, term, cast(sum(w) as bigint) as score, min((g, ord, i)) as f from w group by all), r as (select *, row_number() over (partition by rec_id order by score desc, f) as k from n),
q as (select *, row_number() over (partition by rec_id order by score desc, f) as rank from r where k <= 48 and score >= 2 and term <> 'say' and length(term) between 2 and 12 and not regexp_matches(term, '^[0-9]+$'))
select rec_id, term, score, rank from q where rank <= 12""")
def sender_hotwords(spark, d):
    """Terms with senders and gifts weighed in."""
    return lv.log_hotwords(_named_log(spark, d), F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)), 12, 2, ("say",))


@query(f"""{NAMED}, p as (select rec_id, {N2.format('text')} as phrase, 1 as n from l where kind = 'chat' and length({N2.format('text')}) between 3 and 12 union all select rec_id, {N2.format('gift')}, 1 from l where gift is not null union all select rec_id, {N2.format('user_name')}, 2 from l)
select rec_id, phrase, cast(sum(n) as bigint) as n from p group by all""")
def phrase_counts(spark, d):
    from ..operators.matching import phrase_counts as counts

    return counts(_named_log(spark, d))


@query(f"""{LOG}, h as (select rec_id, case when rec_id % 2 = 0 then 't1' else '' end as t1, 't2' as t2, case when rec_id % 3 = 0 then '' else 'r' || rec_id end as r1 from (select distinct rec_id from live_log) x) select rec_id, case when t1 <> '' then t1 else t2 end as title, r1 as room_id from h""")
def merged_headers(spark, d):
    """The first title and room that any source gives."""
    h = live_log(spark, d).select("rec_id").distinct()
    one = h.select("rec_id", F.when(F.col("rec_id") % 2 == 0, "t1").otherwise("").alias("title"), F.when(F.col("rec_id") % 3 != 0, F.concat(F.lit("r"), F.col("rec_id").cast("string"))).alias("room_id"))
    return lv.merged_headers([one, h.select("rec_id", F.lit("t2").alias("title"), F.lit("").alias("room_id"))], ["title", "room_id"])


@query(f"""{LOG}, c as (select rec_id, term, min(ord) as o from live_log where kind = 'chat' group by all), r as (select rec_id, term, row_number() over (partition by rec_id order by o) as k from c),
s as (select rec_id, term, (1, k) as a from r where k <= 10 union all select distinct rec_id, x, (0, i) from live_log, (values ('k5', 1), ('word', 2)) v(x, i) union all select distinct rec_id, x, (2, i) from live_log, (values ('word', 1), ('last', 2)) v(x, i)),
f as (select rec_id, term, min(a) as a from s group by all) select rec_id, string_agg(term, ' ' order by a) as terms from f group by rec_id""")
def prompt_terms(spark, d):
    """A dictionary's words, then the log's first ten terms, then fixed ones, each once."""
    log = live_log(spark, d)
    chat = log.where("kind = 'chat'").groupBy("rec_id", "term").agg(F.min("ord").alias("o"))
    first = chat.withColumn("rank", F.row_number().over(Window.partitionBy("rec_id").orderBy("o"))).where("rank <= 10")
    ids = log.select("rec_id").distinct()
    fixed = lambda *w: ids.select("rec_id", F.posexplode(F.array(*map(F.lit, w))).alias("rank", "term"))
    return lv.prompt_terms([fixed("k5", "word"), first.select("rec_id", "rank", "term"), fixed("word", "last")])


@query(f"""{LOG}, t as (select rec_id, 'r' || term as title, (0, min(ord)) as a from live_log where kind = 'sc' and ord % 4 = 0 group by all union all
select rec_id, title, (1, i) from (select distinct rec_id, term from live_log where kind = 'chat') l, (values ('K-7!', 7), ('k12', 12), ('zz', 3), ('--', 4)) v(title, i) where {N2.format('title')} <> '' and contains(term, {N2.format('title')})),
f as (select rec_id, title, min(a) as a from t group by all) select rec_id, string_agg(title, '|' order by a) as titles from f group by rec_id""")
def song_titles(spark, d):
    """Requested names, then the library's titles that the chat names."""
    log = live_log(spark, d)
    asked = log.where("kind = 'sc' and ord % 4 = 0").select("rec_id", F.col("ord").alias("at"), F.concat(F.lit("r"), "term").alias("name"))
    titles = spark.createDataFrame([(7, "K-7!"), (12, "k12"), (3, "zz"), (4, "--")], "ord int, title string")
    return lv.song_titles(asked, log.where("kind = 'chat'").select("rec_id", F.col("term").alias("text")), titles, normal_alnum)


@query(f"""{LOG}, s as (select rec_id, count(*) as n, max(t_ms) as duration_ms, count(*) filter (where kind = 'sc') as n_requests from live_log group by rec_id), t as (select rec_id, term, count(*) as c, min(ord) as o from live_log where kind = 'chat' group by all),
k as (select *, row_number() over (partition by rec_id order by c desc, o) as k from t where c >= 2 and length(term) >= 2), w as (select rec_id, string_agg(term, ' ' order by k) as words from k where k <= 3 group by rec_id)
select rec_id, n, duration_ms, n_requests, coalesce(words, '') as words from s left join w using (rec_id)""")
def live_summaries(spark, d):
    """Counts, requests and the three best terms of each log in one row."""
    log = live_log(spark, d)
    s = lv.log_summary(log).select("rec_id", "n", "duration_ms", F.col("n_sc").alias("n_requests"))
    w = lv.hotwords(log.where("kind = 'chat'"), 3).groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("words"))
    return s.join(w, "rec_id", "left").withColumn("words", F.coalesce("words", F.lit("")))


@query("""select o_custkey as project, row_number() over (order by max(o_orderdate) desc, o_custkey) as place from orders group by o_custkey""")
def project_list(spark, d):
    """All projects, newest first."""
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.max("o_orderdate").alias("updated"))
    return folders.placed(p, [F.desc("updated"), F.col("project")]).select("project", "place")


@query("""with r as (select p_partkey, p_brand, round(1 - p_size / 60.0, 4) as score, p_size % 2 = 0 as synced, case p_type when 'ECONOMY' then 0 when 'STANDARD' then 1 else 9 end as src from part)
select p_brand, p_partkey, row_number() over (partition by p_brand order by score desc, synced desc, src, p_partkey) as rank from r where score >= 0.3""")
def search_order(spark, d):
    """Results by score, synced ones first, then by source."""
    from ..operators.recognition import search_order as order

    source = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(9)
    t = table(spark, d, "part").select("p_partkey", "p_brand", F.round(1 - F.col("p_size") / 60.0, 4).alias("score"), (F.col("p_size") % 2 == 0).alias("synced"), source.alias("source"))
    return order(t, "p_brand", "p_partkey", 0.3).select("p_brand", "p_partkey", "rank")


# ---- passes ----


@query(f"""{with_views('hyp_line', recursive=True)}, u as (select rec_id, line_idx * 2 as line_idx, start_ms, end_ms, text from ref_line union all select rec_id, line_idx * 2 + 1, start_ms, end_ms, substr(text, 3) from hyp_line),
o as (select *, row_number() over (partition by rec_id order by start_ms, end_ms, line_idx) as k from u),
f(rec_id, k, kept) as (select distinct rec_id, cast(0 as bigint), cast([] as struct(i bigint, s bigint, e bigint, t varchar)[]) from o
 union all select o.rec_id, o.k, case when d is null then list_append(kept, {{'i': o.line_idx, 's': o.start_ms, 'e': o.end_ms, 't': o.text}})
  when length(replace(o.text, ' ', '')) > length(replace(kept[d].t, ' ', '')) then list_concat(list_append(kept[1:d-1], {{'i': o.line_idx, 's': o.start_ms, 'e': o.end_ms, 't': o.text}}), kept[d+1:]) else kept end
 from (select f.rec_id, f.kept, o.k, o.line_idx, o.start_ms, o.end_ms, o.text, list_position(list_transform(f.kept, lambda p: least(o.end_ms, p.e) - greatest(o.start_ms, p.s) > 0
   and least(o.end_ms, p.e) - greatest(o.start_ms, p.s) >= 0.6 * least(o.end_ms - o.start_ms, p.e - p.s)
   and (contains(replace(p.t, ' ', ''), replace(o.text, ' ', '')) or contains(replace(o.text, ' ', ''), replace(p.t, ' ', '')))), true) as d from f join o on o.rec_id = f.rec_id and o.k = f.k + 1) x join o on o.rec_id = x.rec_id and o.k = x.k),
z as (select rec_id, unnest(kept) as p from (select *, row_number() over (partition by rec_id order by k desc) as r from f) t where r = 1)
select rec_id, p.i as line_idx, p.s as start_ms, p.e as end_ms, p.t as text from z""")
def chunk_seams(spark, d):
    """Lines of two overlapping decodes: of copies across the seam the longer stays."""
    u = ref_line(spark, d).select("rec_id", (F.col("line_idx") * 2).cast("long").alias("line_idx"), "start_ms", "end_ms", "text")
    return sw.seam_dedupe(u.unionByName(hyp_line(spark, d).select("rec_id", (F.col("line_idx") * 2 + 1).cast("long").alias("line_idx"), "start_ms", "end_ms", F.expr("substr(text, 3)").alias("text"))))


#: Letters and digits of a text, and the steps of a pass over two decodes: texts seen (by the line that holds them), the line kept last and where it may begin.
KEY = r"regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')"
GIVEN = """case when f.fl is not null and f.ls < f.fl then f.fl else f.ls end"""


@query(f"""{with_views('hyp_line', recursive=True)}, u as (select rec_id, line_idx * 2 as i, start_ms as s, end_ms as e, text from ref_line union all select rec_id, line_idx * 2 + 1, start_ms, end_ms, text from hyp_line),
o as (select rec_id, i, s, case when e <= s then s + 10 else e end as e, text, {KEY} as k, row_number() over (partition by rec_id order by s, i) as n from u where text <> ''),
f(rec_id, n, seen, li, ls, le, lt, lk, fl, gi, gs, ge, gt) as (
 select distinct rec_id, cast(0 as bigint), cast([] as struct(i bigint, k varchar, e bigint)[]), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as varchar), cast(null as varchar), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as varchar) from o
 union all select rec_id, n, case when again then seen when grows then list_append(list_transform(held, lambda x: case when x.i = li then {{'i': x.i, 'k': x.k, 'e': e}} else x end), {{'i': i, 'k': k, 'e': e}}) when length(k) >= 4 then list_append(held, {{'i': i, 'k': k, 'e': e}}) else held end,
  case when again or alike then li else i end, case when grows or not (again or alike) then s else ls end, case when grows or not (again or alike) then e else le end, case when grows or not (again or alike) then text else lt end, case when grows or not (again or alike) then k else lk end,
  case when again or alike or li is null then fl else ne end, case when not (again or alike) then li end, case when not (again or alike) then ns end, case when not (again or alike) and li is not null then ne end, case when not (again or alike) then lt end
 from (select *, case when e1 > s then greatest(ns + 50, s) else e1 end as ne, alike and length(k) > length(lk) as grows from (select *, case when le <= ns and fl is not null then ns + 50 else le end as e1 from (
  select f.rec_id, o.n, f.seen, list_filter(f.seen, lambda x: o.s - x.e <= 25000) as held, f.li, f.ls, f.le, f.lt, f.lk, f.fl, o.i, o.s, o.e, o.text, o.k, {GIVEN} as ns,
   length(o.k) >= 4 and len(list_filter(f.seen, lambda x: x.k = o.k and o.s - x.e <= 25000 and x.e <= o.s + 50)) > 0 as again,
   not (length(o.k) >= 4 and len(list_filter(f.seen, lambda x: x.k = o.k and o.s - x.e <= 25000 and x.e <= o.s + 50)) > 0) and coalesce(length(o.k) >= 3 and o.s - f.le < 1000 and f.lk <> '' and (contains(f.lk, o.k) or contains(o.k, f.lk)), false) as alike
  from f join o on o.rec_id = f.rec_id and o.n = f.n + 1) a) b) c),
z as (select *, {GIVEN} as ns from (select *, row_number() over (partition by rec_id order by n desc) as r from f) f where r = 1)
select rec_id, gi as line_idx, gs as start_ms, ge as end_ms, gt as text from f where gi is not null
union all select rec_id, li, ns, case when le <= ns and fl is not null then ns + 50 else le end, lt from z where li is not null""")
def finalized_lines(spark, d):
    """Two decodes as one table, finished."""
    u = ref_line(spark, d).select("rec_id", (F.col("line_idx") * 2).cast("long").alias("line_idx"), "start_ms", "end_ms", "text")
    return sw.finalize_lines(u.unionByName(hyp_line(spark, d).select("rec_id", (F.col("line_idx") * 2 + 1).cast("long").alias("line_idx"), "start_ms", "end_ms", "text")))


@query(f"""{with_views('hyp_line', recursive=True)}, o as (select rec_id, start_ms, end_ms, text, row_number() over (partition by rec_id order by line_idx) as k, line_idx from hyp_line),
f(rec_id, k, line_idx, s, e, text, os, oe, oi, ot) as (select rec_id, k, line_idx, start_ms, end_ms, text, cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as varchar) from o where k = 1
 union all select o.rec_id, o.k, o.line_idx, case when hit then greatest(ne + 15, m + 15) else o.start_ms end, case when hit and o.end_ms <= greatest(ne + 15, m + 15) then greatest(ne + 15, m + 15) + 120 else o.end_ms end, o.text,
  ps, case when hit then ne else pe end, pi, pt
 from (select f.rec_id, f.k, f.s as ps, f.e as pe, f.line_idx as pi, f.text as pt, f.e > o.start_ms - 30 as hit, (o.start_ms + f.e) // 2 as m, greatest(f.s + 120, (o.start_ms + f.e) // 2 - 15) as ne from f join o on o.rec_id = f.rec_id and o.k = f.k + 1) x join o on o.rec_id = x.rec_id and o.k = x.k + 1)
select rec_id, oi as line_idx, os as start_ms, cast(oe as bigint) as end_ms, ot as text from f where oi is not null
union all select rec_id, line_idx, s, e, text from (select *, row_number() over (partition by rec_id order by k desc) as r from f) t where r = 1""")
def middle_splits(spark, d):
    """Candidate lines that overlap part around the middle of their edge, one after the other."""
    return sw.split_at_middles(hyp_line(spark, d))


# ---- signals ----


@query(f"""{with_views('ref_line', 'live_log_compact')}, n as (select rec_id, count(*) as n_lines, (max(end_ms) + 2000) // 20 + 1 as n from ref_line group by rec_id),
c as (select distinct rec_id, unnest(range(start_ms // 20, end_ms // 20 + 1)) as f from ref_line), a as (select distinct l.rec_id, t_ms // 20 as f from live_log_compact l join n on n.rec_id = l.rec_id where t_ms // 20 < n and t_ms >= 0),
x as (select rec_id, count(*) as sx from c group by rec_id), y as (select rec_id, count(*) as sy from a group by rec_id), l as (select unnest(range(-60, 61)) as lag),
k as (select a.rec_id, lag, count(*) as k from a cross join l join c on c.rec_id = a.rec_id and c.f = a.f - lag group by all),
s as (select n.rec_id, l.lag, round(coalesce((n * coalesce(k, 0) - sx * sy) / nullif(sqrt(cast(sx * (n - sx) as double)) * sqrt(cast(sy * (n - sy) as double)), 0), 0), 6) as corr from n join x using (rec_id) join y using (rec_id) cross join l left join k on k.rec_id = n.rec_id and k.lag = l.lag where n_lines >= 3),
b as (select *, row_number() over (partition by rec_id order by corr desc, lag) as r from s)
select n.rec_id, cast(coalesce(b.lag, 0) as integer) as lag, coalesce(b.corr, 0.0) as corr from n left join b on b.rec_id = n.rec_id and r = 1""")
def coverage_lags(spark, d):
    """Lines against the log's activity in 20 ms frames, for lags of up to 1.2 s: the best of each recording."""
    return sg.coverage_lag(ref_line(spark, d), live_log_compact(spark, d), 20, 60, F.col("end_ms") + 2000, 3)


@query(f"""{with_views('ref_line', 'live_log_compact')}, g as (select rec_id, line_idx, end_ms // 20 as e, lead(start_ms) over (partition by rec_id order by line_idx) // 20 as s from ref_line),
p as (select rec_id, line_idx, (e + s) / 2 as middle from g where s is not null), fr as (select rec_id, unnest(range(0, max(end_ms) // 20 + 40)) as f from ref_line group by rec_id), ev as (select rec_id, t_ms // 20 as f, count(*) as n from live_log_compact group by all),
q as (select p.rec_id, p.line_idx, p.middle, fr.f, row_number() over (partition by p.rec_id, p.line_idx order by fr.f) as r from p join fr on fr.rec_id = p.rec_id and fr.f between greatest(0, floor(middle - 70)) and floor(middle + 17) - 1 left join ev on ev.rec_id = fr.rec_id and ev.f = fr.f where coalesce(n, 0) <= 0),
u as (select rec_id, line_idx, middle, min(f) as a, max(f) as b from q group by rec_id, line_idx, middle, f - r), best as (select *, row_number() over (partition by rec_id, line_idx order by b - a desc, a) as k from u),
d as (select rec_id, (a + b) / 2 - middle as d from best where k = 1 and b > a and abs((a + b) / 2 - middle) <= 60)
select rec_id, round(case when count(*) >= 3 then quantile_cont(d, 0.5) else 0 end, 3) as shift from d group by rec_id""")
def quiet_shifts(spark, d):
    """Middles of the gaps between lines against the longest runs of frames without events around them."""
    lines, log = ref_line(spark, d), live_log_compact(spark, d)
    w = Window.partitionBy("rec_id").orderBy("line_idx")
    f = lambda c: F.floor(c / 20).cast("long")
    last = f(F.max("end_ms").over(Window.partitionBy("rec_id"))) + 39
    pairs = lines.select("rec_id", F.col("line_idx").alias("gap_id"), ((f(F.col("end_ms")) + f(F.lead("start_ms").over(w))) / 2).alias("middle"), last.alias("last")).where("middle is not null")
    return sg.quiet_shift(pairs, log.select("rec_id", f(F.col("t_ms")).alias("frame_idx")), ["rec_id"], 70, 17, 60)


@query(f"""{REF}, x as (select rec_id, line_idx, start_ms, end_ms, text, case when line_idx % 3 = 0 then start_ms + 120 else start_ms end as s, case when line_idx % 4 = 0 then end_ms - 400 else end_ms end as e from ref_line),
y as (select *, case when end_ms - 180 > s + 120 then least(end_ms - 180, e) else e end as e1 from x), z as (select *, case when e1 <= s then s + 120 else e1 end as e2 from y)
select rec_id, line_idx, s as start_ms, e2 as end_ms, round((e2 - s) / greatest(1, end_ms - start_ms), 6) as scale from z""")
def refined_edges(spark, d):
    lines = ref_line(spark, d)
    edges = lines.select("rec_id", "line_idx", F.when(F.col("line_idx") % 3 == 0, F.col("start_ms") + 120).alias("onset_ms"), F.when(F.col("line_idx") % 4 == 0, F.col("end_ms") - 400).alias("offset_ms"))
    return sg.refined_edges(lines, edges).select("rec_id", "line_idx", "start_ms", "end_ms", "scale")


@query(f"""{with_views('feature')}, m as (select win, seg, vocal_sim as speak, vocal_sim / 2 + 0.1 as sing, case when win % 3 = 0 then 0.6 else 0.0 end as support, side_ratio from feature), v as (select *, greatest(speak, sing) as vocal from m)
select win, vocal + 0.1 * support >= 0.4 and not vocal < 0.5 * 0.72 as keep, not (vocal + 0.1 * support >= 0.4) as flagged from v""")
def voice_filter(spark, d):
    """Windows by voice and context: kept, and listed for review."""
    from ..operators.recognition import voice_filter as apply

    f = feature(spark, d).select("win", F.col("vocal_sim").alias("speak"), (F.col("vocal_sim") / 2 + 0.1).alias("sing"), F.when(F.col("win") % 3 == 0, 0.6).otherwise(0.0).alias("support"))
    scored = f.withColumn("keep", F.greatest("speak", "sing") + 0.1 * F.col("support") >= 0.4)
    return apply(scored, "filter", 0.5).select("win", "keep", "flagged")


# ---- lyrics by time ----


def _hits(spark, d):
    items = table(spark, d, "benchmark")
    b = items.select("item_id", F.posexplode(F.split("text", r"\. ")).alias("i", "row"))
    t = ref_line(spark, d).groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "").alias("t"))
    body = F.regexp_replace(normal_alnum(F.col("t")), "[aeiou]", "")
    # A recording's rows ask for its letters alone: each of them once.
    t = t.select("rec_id", F.array_join(F.array_distinct(F.split(body, "")), "").alias("letters"))
    b = b.withColumn("n2", normal_alnum(F.col("row")))
    return t.join(b, F.col("rec_id") % items.count() == F.col("item_id")).select("rec_id", F.col("i").cast("long").alias("i"), "row", char_hit_ratio(F.col("n2"), F.col("letters")).alias("hit"))


HITS = rf"""{REF}, b as (select item_id, unnest(string_split_regex(text, '\. ')) as row, unnest(range(0, len(string_split_regex(text, '\. ')))) as i from benchmark),
t as (select rec_id, regexp_replace({N2.format("string_agg(text, '' order by line_idx)")}, '[aeiou]', '', 'g') as body from ref_line group by rec_id),
h as (select rec_id, i, row, case when length({N2.format('row')}) > 0 then len(list_filter(string_split({N2.format('row')}, ''), lambda c: contains(body, c))) / length({N2.format('row')}) else 0.0 end as hit from t join b on rec_id % (select count(*) from benchmark) = item_id),
o as (select rec_id, i, i - lag(i) over (partition by rec_id order by i) as gap from h where hit >= 0.6), g as (select *, sum(case when gap is null or gap > 2 then 1 else 0 end) over (partition by rec_id order by i) as g from o),
r as (select rec_id, g, count(*) as n, min(i) as a, max(i) as z from g group by rec_id, g), best as (select *, row_number() over (partition by rec_id order by n desc, a) as k from r)"""


@query(f"{HITS} select rec_id, a as first_row, z as last_row, n as n_rows from best where k = 1")
def sung_windows(spark, d):
    """The rows of a text that a recording holds: the longest run of rows with six of ten letters there, one miss between two allowed."""
    from ..operators.recognition import longest_hit_run

    return longest_hit_run(_hits(spark, d), ["rec_id"], "i", "hit")


@query(f"{HITS}, c as (select rec_id, i, length({N2.format('row')}) as n, sum(length({N2.format('row')})) over (partition by rec_id order by i) as total from h where i >= 1) select rec_id, i from c where total - n < 60 * 1.15")
def budget_windows(spark, d):
    """Rows from the second on until they hold 1.15 times sixty letters."""
    from ..operators.recognition import budget_window

    return budget_window(_hits(spark, d).where("i >= 1"), ["rec_id"], "i", F.length(normal_alnum(F.col("row"))), F.lit(60)).select("rec_id", "i")


@query(f"""{REF}, t as (select rec_id, line_idx, text, line_idx * 2500 as t_ms from ref_line where line_idx >= 1), b as (select rec_id, min(t_ms) as base from t group by rec_id),
x as (select rec_id, line_idx, 1000 + t_ms - base as s, coalesce(1000 + lead(t_ms) over (partition by rec_id order by t_ms) - base, 1000 + t_ms - base + 4000) as e from t join b using (rec_id))
select rec_id, line_idx, s as start_ms, least(greatest(e, s + 400), 7000) as end_ms from x where s <= 7000""")
def lyric_times(spark, d):
    """Stamped rows moved to a block from 1 to 6 seconds."""
    from ..operators.recognition import align_rows

    rows = ref_line(spark, d).where("line_idx >= 1").select("rec_id", "line_idx", (F.col("line_idx") * 2500).alias("t_ms"), "text")
    return align_rows(rows, ["rec_id"], F.lit(1000), F.lit(6000)).select("rec_id", "line_idx", "start_ms", "end_ms")


@query(f"""{REF}, l as (select rec_id, line_idx, length({N2.format('text')}) as n from ref_line where length({N2.format('text')}) > 0), c as (select *, sum(n) over (partition by rec_id order by line_idx) - n as a from l)
select rec_id, line_idx, a * 40 as start_ms, least(a + n, 90) * 40 as end_ms, cast(least(a + n, 90) - a as bigint) as n_words from c where a < 90""")
def aligned_lines(spark, d):
    """Ninety characters with times, dealt to lines by their numbers of letters."""
    from ..operators.recognition import lines_from_characters

    lines = ref_line(spark, d).select("rec_id", "line_idx", F.length(normal_alnum(F.col("text"))).alias("n"))
    chars = lines.select("rec_id").distinct().select("rec_id", F.explode(F.sequence(F.lit(0), F.lit(89))).alias("pos")).select("rec_id", "pos", (F.col("pos") * 40).alias("start_ms"), (F.col("pos") * 40 + 40).alias("end_ms"))
    return lines_from_characters(chars, lines).select("rec_id", "line_idx", "start_ms", "end_ms", "n_words")


@query(f"""{_runs(2000)}, p as (select rec_id, s, e, case when e - s >= 2000 then greatest(1, (e - s) // 4000) end as k from r) , q as (select rec_id, s, e, unnest(range(0, k)) as j, k from p where k is not null)
select rec_id, s as start_ms, e as end_ms, j as probe, cast(s + (e - s) * (2 * j + 1) // (2 * k) as bigint) as probe_ms from q""")
def block_probes(spark, d):
    """Song blocks (gaps of two seconds merge, two seconds at least) and evenly spaced probes in each, one for four seconds."""
    from ..operators.recognition import probes

    return probes(iv.gap_merge(_log_spans(spark, d), ["rec_id"], 2000, 2000), 4000).select("rec_id", "start_ms", "end_ms", "probe", "probe_ms")
