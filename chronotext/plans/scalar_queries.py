"""Queries over small functions of names, rates, times and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import matching as mt
from .registry import registry
from .views import ref_line, table, with_views

QUERIES, ORACLE, query = registry()
N2 = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
REF = with_views("ref_line")


@query(f"""select c_custkey, n_name, {N2.format("c_name")} <> '' and {N2.format("n_name")} <> '' and not contains({N2.format("c_name")}, {N2.format("n_name")}) and not contains({N2.format("n_name")}, {N2.format("c_name")}) as mismatch
from (select c_custkey, case when c_custkey % 3 = 0 then 'The ' || lower(n_name) || '!' when c_custkey % 3 = 1 then '--' else c_name end as c_name, n_name from customer join nation on c_nationkey = n_nationkey) t""")
def artist_mismatches(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("The "), F.lower("n_name"), F.lit("!"))).when(k % 3 == 1, "--").otherwise(F.col("c_name"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", "n_name", sc.artist_mismatch(name, F.col("n_name")).alias("mismatch"))


@query(rf"""{REF}, c as (select rec_id, line_idx, regexp_replace(text, '[嗯啊哦唉呀吧呢嘛]+', '', 'g') as t from ref_line),
p as (select *, list_filter(string_split_regex(t, '[，。！？、,.!?\s\x0b]+'), lambda x: length(x) >= 6) as ps from c),
q as (select *, list_filter(ps, lambda x: length(x) = list_max(list_transform(ps, lambda y: length(y))))[1] as best from p)
select rec_id, line_idx, substr(coalesce(best, t), 1, 24) as query from q""")
def transcript_queries(spark, d):
    return ref_line(spark, d).select("rec_id", "line_idx", sc.transcript_query(F.col("text")).alias("query"))


@query("""with s as (select event_id, value as span from events), c as (select event_id, greatest(5.0, least(least(600.0, greatest(5.0, 400.0)), span)) as clamped from s)
select event_id, round(clamped, 6) as clamped, cast(floor((ln(600.0) - ln(clamped)) / (ln(600.0) - ln(5.0)) * 1000 + 0.5) as bigint) as slider, round(exp(ln(600.0) - (event_id % 1001) / 1000.0 * (ln(600.0) - ln(5.0))), 6) as span from c""")
def span_mapping(spark, d):
    c = table(spark, d, "events").select("event_id", sc.clamp_span(F.col("value"), F.lit(400.0)).alias("c"))
    return c.select("event_id", F.round("c", 6).alias("clamped"), sc.span_to_slider(F.col("c")).alias("slider"), F.round(sc.slider_to_span(F.col("event_id") % 1001), 6).alias("span"))


@query("select p_partkey, substr(md5(p_name || chr(0) || cast(p_size as varchar) || chr(0) || p_type || chr(0)), 1, 20) as key from part")
def cache_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.cache_key(F.col("p_name"), F.col("p_size"), F.col("p_type")).alias("key"))


@query("""with f as (select p_partkey, case p_partkey % 6 when 0 then 23.98 when 1 then 29.98 when 2 then 59.95 when 3 then 25.0 when 4 then 24.01 else 12.5 + p_size end as fps from part),
c(k, t) as (values (23.976, '24000/1001'), (24.0, '24/1'), (25.0, '25/1'), (29.97, '30000/1001'), (30.0, '30/1'), (50.0, '50/1'), (59.94, '60000/1001'), (60.0, '60/1'), (120.0, '120/1'))
select p_partkey, coalesce((select arg_min(t, k) from c where abs(fps - k) < 0.02), regexp_replace(cast(cast(fps as double) as varchar), '\\.0$', '') || '/1') as rate, round(cast(coalesce((select min(k) from c where abs(fps - k) < 0.02), fps) as double), 3) as value from f""")
def frame_rates(spark, d):
    k = F.col("p_partkey") % 6
    fps = F.when(k == 0, 23.98).when(k == 1, 29.98).when(k == 2, 59.95).when(k == 3, 25.0).when(k == 4, 24.01).otherwise(12.5 + F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", sc.frame_rate(fps).alias("r")).select("p_partkey", F.col("r.text").alias("rate"), F.col("r.value").alias("value"))


@query(f"""{REF} select rec_id, line_idx, case when end_ms - start_ms > 3000 then (start_ms + end_ms) / 2.0 - 1500 else cast(start_ms as double) end as crop_start, case when end_ms - start_ms > 3000 then (start_ms + end_ms) / 2.0 + 1500 else cast(end_ms as double) end as crop_end from ref_line""")
def centre_crops(spark, d):
    c = ref_line(spark, d).select("rec_id", "line_idx", sc.centre_crop(F.col("start_ms"), F.col("end_ms"), 3000).alias("c"))
    return c.select("rec_id", "line_idx", F.col("c.start").alias("crop_start"), F.col("c.end").alias("crop_end"))


@query("""with n as (select p_partkey, case p_partkey % 5 when 0 then '  ' when 1 then repeat(p_name, 8) when 2 then p_name || '?' when 3 then '.' || p_name else p_name end as name from part)
select p_partkey, case when trim(name) = '' then 'empty' when length(trim(name)) > 64 then 'longer than 64 characters' when regexp_matches(trim(name), '[/\\\\:*?"<>|]') then 'forbidden character' when starts_with(trim(name), '.') then 'starts with a dot' end as fault from n""")
def name_faults(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    name = F.when(k == 0, "  ").when(k == 1, F.repeat(n, 8)).when(k == 2, F.concat(n, F.lit("?"))).when(k == 3, F.concat(F.lit("."), n)).otherwise(n)
    return table(spark, d, "part").select("p_partkey", sc.profile_name_fault(name).alias("fault"))


@query("select event_id, case when event_id % 5 = 4 then 0.0 else epoch_us(ts) / 1e6 - case event_id % 2 when 0 then 0 else 28800 end end as seconds from events")
def iso_times(spark, d):
    """Nine-digit fractions, with and without an offset; broken ones are 0."""
    t = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 5 == 4, "yesterday").otherwise(F.concat(t, F.lit("123"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+08:00")))
    return table(spark, d, "events").select("event_id", sc.iso_seconds(text).alias("seconds"))


@query(r"""with p as (select doc_id, regexp_extract_all(text, '(?s).{23,39}?[，。！？；、,.!?; ]|.{40}|.+') as ps from documents), t as (select doc_id, list_filter(list_transform(ps, lambda x: case when length(x) >= 24 and regexp_matches(x, '[，。！？；、,.!?; ]$') then trim(x) else x end), lambda x: trim(x) <> '') as ps from p)
select doc_id, cast(len(ps) as bigint) as n_parts, md5(array_to_string(ps, '|')) as parts_md5 from t""")
def split_texts(spark, d):
    p = table(spark, d, "documents").select("doc_id", sc.split_text(F.col("text"), 40).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_parts"), F.md5(F.array_join("p", "|")).alias("parts_md5"))


@query(rf"""{REF}, a as (select rec_id, line_idx, list_filter(string_split_regex(text, '[\s\x0b]+'), lambda x: x <> '') as w from ref_line),
g as (select *, list_transform(range(1, len(w) + 1), lambda i: case when i > 1 and regexp_matches(right(w[i-1], 1), '^[\p{{L}}\p{{N}}]$') and regexp_matches(left(w[i], 1), '^[\p{{L}}\p{{N}}]$') then ' ' || w[i] else w[i] end) as p from a)
select rec_id, line_idx, md5(array_to_string(p, '')) as text_md5 from g""")
def joined_atoms(spark, d):
    """Words without their spaces, joined anew: a space only where two letters meet."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return ref_line(spark, d).select("rec_id", "line_idx", F.md5(sc.join_atoms(w)).alias("text_md5"))


@query(r"""with t as (select doc_id, case when doc_id % 2 = 0 then text || '歌词测试' else text end as t from documents)
select doc_id, round(case when length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) > 0 then len(regexp_extract_all(t, '[一-鿿]')) / length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) else 0.0 end, 6) as ratio from t""")
def cjk_ratios(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("歌词测试"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.round(tx.cjk_ratio(t), 6).alias("ratio"))


@query(f"""{REF}, f as (select rec_id, line_idx, start_ms * 25 // 1000 as n from ref_line) select rec_id, line_idx, lpad(cast(n // 90000 as varchar), 2, '0') || ':' || lpad(cast(n // 1500 % 60 as varchar), 2, '0') || ':' || lpad(cast(n // 25 % 60 as varchar), 2, '0') || ':' || lpad(cast(n % 25 as varchar), 2, '0') as timecode from f""")
def timecodes(spark, d):
    return ref_line(spark, d).select("rec_id", "line_idx", tx.frame_timecode(F.col("start_ms"), 25).alias("timecode"))


@query("""with recursive p as (select n.n_nationkey, m.n_nationkey as other, n.n_name as a, reverse(m.n_name) || r_name as b from nation n join nation m on n.n_nationkey <= m.n_nationkey join region on m.n_regionkey = r_regionkey),
f(n_nationkey, other, i, row) as (select n_nationkey, other, 0, list_transform(range(0, length(b) + 1), lambda x: cast(0 as bigint)) from p
 union all select f.n_nationkey, f.other, i + 1, list_transform(range(0, length(b) + 1), lambda j: greatest(row[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: substr(b, cast(k as bigint), 1) = substr(a, i + 1, 1)), lambda k: row[k] + 1)), 0)))
 from f join p on p.n_nationkey = f.n_nationkey and p.other = f.other where i < length(a))
select f.n_nationkey, f.other, row[len(row)] as lcs from f join p using (n_nationkey, other) where i = length(a)""")
def lcs_lengths(spark, d):
    """Nation names against reversed ones, in pairs of a fixed small table."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    m = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("other"), F.concat(F.reverse("n_name"), "r_name").alias("b"))
    return n.join(m, F.col("n_nationkey") <= F.col("other")).select("n_nationkey", "other", sc.lcs_udf("n_name", "b").alias("lcs"))


@query(rf"""{REF}, t as (select rec_id, line_idx, regexp_replace(text, '[\s\x0b]', '', 'g') as m from ref_line), s as (select *, regexp_replace(m, '[，。！？；、：,.!?;:]', '', 'g') as src from t),
c as (select rec_id, line_idx, unnest(string_split(m, '')) as ch, unnest(range(1, length(m) + 1)) as i from s where m <> ''),
k as (select *, sum(case when ch in ('，','。','！','？','；','、','：',',','.','!','?',';',':') then 0 else 1 end) over (partition by rec_id, line_idx order by i) as before from c),
b as (select rec_id, line_idx, list_sort(list(distinct cast(before - 1 as integer))) as l from k where ch in ('，','。','！','？','；','、','：',',','.','!','?',';',':') and before > 0 group by rec_id, line_idx)
select s.rec_id, s.line_idx, coalesce(array_to_string(l, ','), '') as breaks from s left join b using (rec_id, line_idx)""")
def punctuation_breaks(spark, d):
    """Texts mapped back to themselves without punctuation: the characters that a mark follows."""
    m = F.regexp_replace("text", r"\s", "")
    t = ref_line(spark, d).select("rec_id", "line_idx", m.alias("m"), F.regexp_replace(m, "[，。！？；、：,.!?;:]", "").alias("s"))
    return t.select("rec_id", "line_idx", F.array_join(sc.breaks_udf("m", "s").cast("array<string>"), ",").alias("breaks"))


@query()
def text_coverage(spark, d):
    """How well each line's text is covered by the benchmark text of its number: three scores, and the part most like the line (tests hold them against plain forms)."""
    items = table(spark, d, "benchmark")
    b = items.select("item_id", F.filter(F.transform(F.split("text", r"\. "), tx.normal_alnum), lambda x: x != "").alias("lines"))
    t = ref_line(spark, d).join(b, F.col("rec_id") % items.count() == F.col("item_id")).withColumn("n", tx.normal_alnum(F.col("text")))
    t = t.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rec_id", "line_idx")  # texts are compared in all tasks
    whole = F.array_join("lines", "")
    return t.select("rec_id", "line_idx", sc.coverage_udf("n", whole).alias("coverage"), sc.layout_udf("n", "lines").alias("layout"), sc.window_udf("n", "lines").alias("window"), mt.closest_udf(whole, F.col("n")).alias("closest"))
