"""Queries over segmentation, lyric matching, correction by evidence and whole reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normal_alnum
from ..operators import dictionary as dc
from ..operators import matching as mt
from ..operators import pairing as pr
from ..operators import segment as sm
from ..operators import songs
from ..operators import sweeps as sw
from .edit_queries import ATOMS, _atoms
from .registry import registry
from .scalar_queries import N2
from .views import hyp_line, ref_line, table, with_views

QUERIES, ORACLE, query = registry()
REF = with_views("ref_line")


def _lyrics(spark, d):
    """Benchmark texts as documents, their sentences as rows."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), F.posexplode(F.split("text", r"\. ")).alias("lyric_idx", "text"))
    return rows.select("doc", F.col("lyric_idx").cast("long").alias("lyric_idx"), "text").where("length(text) > 3")


# ---- segmentation ----

EDGE = """(case when c > 14.4 then 1.5 else 1.0 end) * power((c - 9.0) / 9.0, 2) + 0.5 * power(greatest(0.0, (span - 3000) / 3000), 2)"""


@query(f"""{ATOMS}, w as (select *, length(trim(text)) as c, lead(start_ms) over (partition by rec_id, block order by pos) - end_ms as gap from atoms),
v as (select rec_id, block, list(c order by pos) as c, list(start_ms order by pos) as s, list(end_ms order by pos) as e, list(text order by pos) as t,
 list(case when gap is null then 0.0 when gap >= 280 then 0.8 * least(1.0, gap / 500) when contains('.!?。！？…', right(rtrim(text), 1)) then 3.0 when contains(',;:，、；：', right(rtrim(text), 1)) then 1.2 else 0.0 end order by pos) as worth from w group by rec_id, block),
f(rec_id, block, k, cost, took) as (select rec_id, block, cast(0 as bigint), cast([0.0] as double[]), cast([] as bigint[]) from v
 union all select rec_id, block, k, list_append(cost, b.x), list_append(took, b.n) from (select f.rec_id, f.block, f.k + 1 as k, f.cost, f.took,
  list_sort(list_transform(list_filter(range(greatest(0, f.k - 16), f.k + 1), lambda i: i = f.k or v.e[f.k + 1] - v.s[i + 1] <= 8500), lambda i: {{'x': round(f.cost[i + 1] + list_extract(list_transform([{{'c': list_sum(v.c[i + 1 : f.k + 1]), 'span': v.e[f.k + 1] - v.s[i + 1]}}], lambda z: {EDGE.replace('(c ', '(z.c ').replace('when c ', 'when z.c ').replace('span', 'z.span')}), 1) - v.worth[f.k + 1], 9), 'i': i, 'n': f.k + 1 - i}}))[1] as b
  from f join v on v.rec_id = f.rec_id and v.block = f.block where f.k < len(v.c)) q),
g(rec_id, block, p, took) as (select rec_id, block, k, took from f where k = len(took) and k = (select len(v.c) from v where v.rec_id = f.rec_id and v.block = f.block)
 union all select rec_id, block, p - took[p], took from g where p > 0),
cuts as (select rec_id, block, p as a, lead(p) over (partition by rec_id, block order by p) as z from g),
n as (select rec_id, block, row_number() over (partition by rec_id, block order by a) - 1 as line, a, z from cuts where z is not null)
select n.rec_id, n.block, line, v.s[a + 1] as start_ms, v.e[z] as end_ms, z - a as n_atoms from n join v on v.rec_id = n.rec_id and v.block = n.block""")
def dp_segmentation(spark, d):
    """Least-cost lines of the words of each turn."""
    a = F.col("atoms")
    return sm.segment(_atoms(spark, d)).select("rec_id", "block", "line", F.element_at(a, 1)["start_ms"].alias("start_ms"), F.element_at(a, -1)["end_ms"].alias("end_ms"), F.size(a).cast("long").alias("n_atoms"))


@query()
def hinted_lines(spark, d):
    """Lines that follow lyric and chat evidence, tidied (tests hold the parts against plain forms)."""
    atoms = _atoms(spark, d)
    lines = ref_line(spark, d)
    lyr = lines.select("rec_id", F.col("line_idx").alias("block"), F.posexplode(F.split("text", r"[.,]")).alias("lyric_idx", "text")).where(F.col("block") % 2 == 0)
    chat = lines.select("rec_id", F.col("start_ms").alias("t_ms"), F.substring_index("text", " ", 3).alias("text"))
    return sm.line_texts(sm.tidy_lines(sm.segment(mt.boundary_hints(atoms, lyr, chat))))


@query(rf"""{REF}, w as (select rec_id, line_idx as block, unnest(string_split_regex(trim(text), '[\s\x0b]+')) as t, unnest(range(0, len(string_split_regex(trim(text), '[\s\x0b]+')))) as pos, start_ms from ref_line),
x as (select rec_id, block, pos, start_ms + pos * 100 as s, case when pos % 4 = 0 then '歌词' || left(t, 0) || '，' when pos % 4 = 1 then '..' else regexp_replace(t, '[^\p{{L}}\p{{N}}]+$', '') end as t from w),
a as (select rec_id, block, pos, 0 as k, s, s + 50 as e, '歌' as t from x where pos % 4 = 0 union all select rec_id, block, pos, 1, s + 50, s + 100, '词，' || case when (select count(*) from x y where y.rec_id = x.rec_id and y.block = x.block and y.pos = x.pos + 1) > 0 then '..' else '' end from x where pos % 4 = 0
 union all select rec_id, block, pos, 0, s, s + 100, t from x where pos % 4 > 1 and t <> '')
select rec_id, block, row_number() over (partition by rec_id, block order by pos, k) - 1 as pos, t as text, s as start_ms, e as end_ms from a""")
def atom_split(spark, d):
    """Words, two CJK characters with a comma, and words of marks alone, as atoms."""
    words = ref_line(spark, d).select("rec_id", F.col("line_idx").alias("block"), "start_ms", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "t"))
    s = F.col("start_ms") + F.col("pos") * 100
    text = F.when(F.col("pos") % 4 == 0, "歌词，").when(F.col("pos") % 4 == 1, "..").otherwise(F.regexp_replace("t", r"[^\p{L}\p{N}]+$", ""))
    return sm.split_atoms(words.select("rec_id", "block", F.col("pos").cast("long").alias("pos"), text.alias("text"), s.alias("start_ms"), (s + 100).alias("end_ms")))


# ---- lyrics ----


@query()
def lyric_scores(spark, d):
    """Runs of one to three lines and lyric rows that are alike, all pairs of the length band judged."""
    lyrics = _lyrics(spark, d).select("doc", "lyric_idx", normal_alnum(F.col("text")).alias("n2"))
    return mt.window_scores(mt.line_windows(mt.subtitle_rows(ref_line(spark, d))), lyrics)


@query()
def lyric_assignment(spark, d):
    """Lyric rows placed on lines of recordings, in lyric order."""
    return mt.match_lyrics(ref_line(spark, d), _lyrics(spark, d))


@query()
def lyric_reports(spark, d):
    """Each document's score for each recording, and which one is the recording's best."""
    r = mt.match_reports(lyric_assignment(spark, d))
    best = mt.best_documents(r).select("rec_id", "doc", F.lit(True).alias("best"))
    return r.join(best, ["rec_id", "doc"], "left").withColumn("best", F.coalesce("best", F.lit(False)))


@query()
def lyric_replacement(spark, d):
    """Lines replaced by the lyrics of the best document."""
    lines, lyrics = ref_line(spark, d), _lyrics(spark, d)
    matches = mt.match_lyrics(lines, lyrics)
    mine = matches.join(mt.best_documents(mt.match_reports(matches)).select("rec_id", "doc"), ["rec_id", "doc"], "left_semi")
    return mt.apply_plans(lines, mt.lyric_plans(lines, mine, lyrics, 0.6))


@query(f"""select p_partkey, 'x' as x, contains({N2.format('p_name')}, 'redgear') or contains('redgear', {N2.format('p_name')}) or contains({N2.format('p_name')}, 'steelring') as hit from part where contains({N2.format('p_name')}, 'redgear') or contains('redgear', {N2.format('p_name')}) or contains({N2.format('p_name')}, 'steelring')""")
def title_filter(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"))
    return mt.titled(t, ["Red gear!", "STEEL-ring", "--"]).select("p_partkey", F.lit("x").alias("x"), F.lit(True).alias("hit"))


@query("""with w as (select c_custkey, n_name as title, case when c_custkey % 2 = 0 then 'r' || c_nationkey % 5 else 'nobody' end as artist, c_nationkey from customer join nation on c_nationkey = n_nationkey)
select c_custkey as want_id, cast(n_nationkey as bigint) as doc, case when artist = 'r' || n_nationkey % 5 then 1 else 2 end as tier from w join nation n on n.n_name = w.title""")
def title_lookup(spark, d):
    """By title and artist, else by title alone."""
    n = table(spark, d, "nation")
    docs = n.select(F.col("n_nationkey").cast("long").alias("doc"), F.col("n_name").alias("title"), F.concat(F.lit("R"), (F.col("n_nationkey") % 5).cast("string")).alias("artist"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    artist = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string"))).otherwise("nobody")
    return mt.library_lookup(c.select(F.col("c_custkey").cast("long").alias("want_id"), F.col("n_name").alias("title"), artist.alias("artist")), docs)


def _versions(spark, d):
    """Benchmark texts as songs, several of one title."""
    title = F.concat(F.lit("Song "), (F.col("item_id") % 15).cast("string"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), title.alias("title"), "text")


def _sung(spark, d):
    """What was recognised: turns of conversations, and benchmark texts of which every ninth letter is missing and the first half is sung."""
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("block"), "text")
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    sung = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("rec_id"), F.lit(0).cast("long").alias("block"), F.regexp_replace(half, "(.{8}).", "$1").alias("text"))
    return talk.unionByName(sung)


@query()
def ranked_lyrics(spark, d):
    """The five documents most like each stretch (tests hold them against all pairs)."""
    return songs.ranked(_sung(spark, d), ["rec_id", "block"], _versions(spark, d), 5)


@query()
def resolved_songs(spark, d):
    """Stretches and their songs: by request where there is one, else by transcript (tests hold them against all pairs)."""
    b = _sung(spark, d)
    asked = b.where("rec_id % 3 = 0").select("rec_id", "block", F.concat(F.lit("song-"), F.abs(F.col("rec_id") % 20).cast("string")).alias("name"))
    return songs.retrieve(b, asked, _versions(spark, d))


@query()
def sung_offsets(spark, d):
    """Where each sung stretch begins in its song's rows (tests hold them against the plain search)."""
    sung = _sung(spark, d).where("rec_id < 0").withColumn("doc", -1 - F.col("rec_id"))
    return songs.sung_windows(sung, _lyrics(spark, d))


# ---- correction ----

WORDS = [("the", ["tha", "thn"]), ("und", ["unn"]), ("que", ["ques", "qua"]), ("there", ["theth"])]
FORMS = mt.keyword_map(WORDS)


#: The longest common run of x and y, the first of equals in x, then in y.
RUN = """list_sort(flatten(list_transform(range(1, length(x) + 1), lambda i: flatten(list_transform(range(1, length(y) + 1), lambda j:
 list_transform(list_filter(range(1, least(length(x) - i, length(y) - j) + 2), lambda n: substr(x, i, n) = substr(y, j, n)), lambda n: {'s': -n, 'i': i, 'j': j}))))))[1]"""


def _folded() -> str:
    """The dictionary's forms applied one after the other, each a step of common table expressions; then the whole words that an unchanged line is like, by matching blocks."""
    steps, at = [f"k0 as (select rec_id, line_idx, text, text as fixed, {N2.format('text')} as n, {N2.format('text')} as n2 from ref_line)"], 0
    for form, word in FORMS:
        if form == word:
            continue
        hit = f"contains(n, '{form}') and not contains(text, '{word}') and contains(text, '{form}')"
        new = f"replace(text, '{form}', '{word}')"
        steps.append(f"k{at + 1} as (select rec_id, line_idx, text, case when {hit} then {new} else fixed end as fixed, case when {hit} then {N2.format(new)} else n end as n, n2 from k{at})")
        at += 1
    words = ", ".join(f"('{w}')" for w, _ in WORDS)
    return f"""{with_views("ref_line", recursive=True)}, {', '.join(steps)}, words as (select word, {N2.format('word')} as w from (values {words}) v(word)),
near as (select distinct n2 as t, w from k{at}, words where fixed = text and length(n2) >= 2 and abs(length(n2) - length(w)) <= 4),
parts(t, w, x, y, b) as (select t, w, x, y, {RUN} from (select t, w, t as x, w as y from near) z
 union all select t, w, x, y, {RUN} from (select t, w, case when side = 0 then substr(x, 1, b.i - 1) else substr(x, b.i - b.s) end as x, case when side = 0 then substr(y, 1, b.j - 1) else substr(y, b.j - b.s) end as y
  from parts cross join (values (0), (1)) v(side) where b is not null) z),
alike as (select t, w, case when contains(t, w) or contains(w, t) then 1.0 else round(coalesce(sum(-b.s), 0) / least(length(t), (length(t) + length(w)) / 2.0), 4) end as score from parts group by t, w),
best as (select t, word, row_number() over (partition by t order by score desc, word) as r from alike join words using (w) where score >= 0.72),
done as (select rec_id, line_idx, text, case when fixed = text then coalesce(word, text) else fixed end as fixed from k{at} left join best on r = 1 and t = n2)
select rec_id, line_idx, md5(fixed) as fixed_md5, fixed <> text as changed from done"""


@query(_folded())
def keyword_replace(spark, d):
    """Known wrong forms become their words; else a line that is like a whole word becomes it."""
    return mt.correct_by_keywords(ref_line(spark, d), WORDS).select("rec_id", "line_idx", F.md5("fixed").alias("fixed_md5"), "changed")


@query(_folded())
def dictionary_replace(spark, d):
    """The same from a table of words, by automata."""
    words = spark.createDataFrame([(i, w, a) for i, (w, a) in enumerate(WORDS)], "place long, word string, alias array<string>")
    return dc.correct_by_dictionary(ref_line(spark, d), words).select("rec_id", "line_idx", F.md5("fixed").alias("fixed_md5"), "changed")


def _evidence(spark, d):
    """A chat that says each reference line twice near its time; every fifth line is a paid text said once."""
    said = ref_line(spark, d).select("rec_id", F.col("start_ms").alias("t_ms"), F.when(F.col("line_idx") % 5 == 0, "sc").otherwise("chat").alias("kind"), "text", (F.col("line_idx") * 2).alias("ord"))
    more = said.where("kind = 'chat'").withColumn("t_ms", F.col("t_ms") + 500).withColumn("ord", F.col("ord") + 1)
    return said.unionByName(more).withColumn("gift", F.lit(None).cast("string")).withColumn("user_name", F.lit(""))


@query()
def chat_correction(spark, d):
    """Candidate lines corrected by what a chat said."""
    return mt.correct_by_chat(hyp_line(spark, d), _evidence(spark, d))


@query()
def post_correction(spark, d):
    """Keywords, then chat, then lyrics."""
    return mt.post_correct(hyp_line(spark, d), WORDS, _evidence(spark, d), _lyrics(spark, d))


# ---- reports ----


@query()
def accuracy_report(spark, d):
    """Pairs with the fallback, rates, errors, error rate and recall."""
    return pr.accuracy(ref_line(spark, d), hyp_line(spark, d), normal_alnum)


@query()
def finished_recording(spark, d):
    """Candidate lines freed of repeats and overlaps, then reported against the reference."""
    return pr.accuracy(ref_line(spark, d), sw.finalize_lines(hyp_line(spark, d)), normal_alnum)
