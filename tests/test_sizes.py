"""Queries whose work must grow with their input, and rules that copies of a table must not change."""

import difflib
import io
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronotext.functions import scalars as sc
from chronotext.functions.text import normal_alnum
from chronotext.operators import blocks as bl
from chronotext.operators import matching as mt
from chronotext.operators import pairing as pr
from chronotext.operators import refine as rf
from chronotext.operators import signals as sg
from chronotext.operators import songs
from chronotext.operators import vectors as vc
from chronotext.plans import catalog, views
from chronotext.plans.format_queries import with_words
from chronotext.sources import formats as fm
from chronotext.sources import records as rc
from chronotext.sources import splits as sp

SF = "/root/testdata/sf0.01"


def test_long_texts_are_spread_in_one_pass(spark):
    """a letter's time came with the letters counted anew for each letter."""
    n = 40_000
    t = spark.createDataFrame([(1, '{"segments": [{"start": 0, "end": %d, "text": "%s"}]}' % (n, "ab " * (n // 2)))], "k long, t string")
    began = time.time()
    got = rc.parse_responses(t, "k", "t").select("seg_idx", F.size("words").alias("n"), F.col("words")[n - 1]["end"].alias("e")).first()
    assert tuple(got) == (0, n, float(n)) and time.time() - began < 60


def test_letters_are_characters_but_spaces(spark):
    t = spark.createDataFrame([("a b",), ("",), ("  ",), ("é𝄞\tx ",)], "t string")
    assert [r[0] for r in t.select(rc.letters(F.col("t"))).collect()] == [["a", "b"], [], [], ["é", "𝄞", "\t", "x"]]


def test_long_lines_have_words_in_one_pass(spark):
    """a word's time came with the words found anew for each word."""
    n = 30_000
    t = spark.createDataFrame([(" a" * n, 0, n * 10)], "text string, start_ms long, end_ms long")
    began = time.time()
    got = with_words(t).where(F.size("words") > 0).select(F.size("words"), F.col("words")[n - 1]["start_ms"], F.col("words")[n - 1]["end_ms"]).first()
    assert tuple(got) == (n, n * 10 - 10, n * 10) and time.time() - began < 60


def test_unknown_responses_after_known_ones(spark):
    t = spark.createDataFrame([(1, '{"results": [], "data": [{"sentence": "x", "end_time": 1}]}')], "k long, t string")
    assert rc.parse_responses(t, "k", "t").first()["text"] == "x"
    with pytest.raises(Exception, match="unknown shape"):
        rc.parse_responses(spark.createDataFrame([(1, '{"segments": 1}')], "k long, t string"), "k", "t").collect()


@pytest.mark.parametrize("name", ["gap_merge", "keep_windows", "merge_regions", "merge_spans"])
def test_merged_runs_do_not_hang_on_ties(spark, name):
    """The SQL numbered runs by a second sort, which dealt equal spans otherwise than the first."""
    c = duckdb.connect()
    c.execute(f"create table events as select event_id + 1000000 * k as event_id, ts, user_id, event_type, value, props from '{SF}/events.parquet', range(60) r(k) order by random()")
    once = c.execute(f"with e as materialized ({catalog.ORACLE[name].replace('from events)', f'''from '{SF}/events.parquet')''')}) select rec_id, start_ms, end_ms, n * 60 as n from e").fetchall()
    assert sorted(c.execute(f"select rec_id, start_ms, end_ms, n from ({catalog.ORACLE[name]})").fetchall()) == sorted(once)


@pytest.mark.parametrize("name", ["keyword_replace", "dictionary_replace"])
def test_lines_like_a_whole_word(name, spark, tmp_path):
    """the SQL left out the rule for lines that are like a whole word, which larger tables hold."""
    rng = random.Random(3)
    texts = ["There!", "Thre", "the", "QUE?", "unds", "th re", "Théré.", "a the b tha", "", "-", "t"] + ["".join(rng.choices("theruqnd -.É", k=rng.randint(1, 11))) for _ in range(4000)]
    c = duckdb.connect()
    rows = pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "role": "user", "text": texts})
    c.execute("create table conversations as select conv_id, cast(turn as bigint) as turn, role, text from rows")
    c.execute(f"copy conversations to '{tmp_path}/conversations.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path)).select("rec_id", "line_idx", "fixed_md5", "changed").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(f"select rec_id, line_idx, fixed_md5, changed from ({catalog.ORACLE[name]})").fetchall())
    assert sum(r.changed for r in got) > 100


def test_matching_blocks_are_those_of_difflib():
    """blocks are looked up, not paired character by character."""
    rng, parts = random.Random(2), ["th", "the", "er", "an", "in", "tion", "x", "é", "zz"]
    for most in (5, 30, 90) * 60:
        a, b = ("".join(rng.choices(parts, k=rng.randint(0, most))) for _ in "ab")
        want = [m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        assert sorted(sc._blocks(a, b)) == sorted(want) and mt.matched_chars(a, b) == sum(want)


def test_ranked_texts_are_dealt_out(spark):
    """texts of one file were all compared in one task."""
    t = spark.createDataFrame([(1, i, f"the line {i}") for i in range(200)], "rec_id long, block long, text string").coalesce(1)
    docs = spark.createDataFrame([(1, "a", "the line")], "doc long, title string, text string")
    plan = songs.ranked(t, ["rec_id", "block"], docs, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan.split("MapInPandas")[1]


def test_similarities_stay_in_their_task(spark):
    """a third of all pairs' similarities were shuffled and ranked by a window, and vectors travelled once for each 512 rows."""
    m = np.random.default_rng(4).normal(size=(700, 6)).astype(np.float32)
    t = spark.createDataFrame([(i % 2, i, [float(x) for x in v]) for i, v in enumerate(m)], "rec long, id long, v array<float>")
    got = vc.neighbours(t, "id", "rec", "v", 3, 0.35)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    for rec in (0, 1):
        own = m[rec::2].astype(float)
        sims = np.round(own @ own.T, 9)
        np.fill_diagonal(sims, -np.inf)
        want = np.sort(sims, axis=1)[:, -122:].mean(axis=1)
        rows = got.where(f"rec = {rec}").orderBy("id").collect()
        assert [r.n_near for r in rows] == [122] * 350 and np.allclose([r.cohesion for r in rows], want, atol=1e-12)


def test_small_ranges_share_tasks():
    """each range was a task, and each read megabytes on past its end."""
    bounds = {f"{i:05d}": (0, 3000 + i) for i in range(40_000)}
    parts = sp.ranges(bounds, 1 << 12)
    assert len(parts) <= 2 * sp.TASKS
    held = sorted(r for p in parts for r in p.parts)
    assert all(0 < high - low <= 1 << 12 for _, low, high in held)
    whole: dict[str, int] = {}
    for path, low, high in held:
        assert whole.get(path, 0) == low
        whole[path] = high
    assert whole == {path: high for path, (_, high) in bounds.items()}


@pytest.mark.parametrize("inside", [sp.nodes_in, sp.blocks_in])
def test_a_range_reads_little_past_its_end(inside):
    raw = b'<d p="1">a</d>\n\n' * 200_000

    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    file = Counted(raw)
    assert len(list(inside(file, 1 << 16, 1 << 17))) == 4096 and file.got < 1 << 19


def test_texts_are_files_of_their_own(spark, tmp_path):
    """the commit of a table with a folder for each recording."""
    t = spark.createDataFrame([("a/b", "x\ny"), (None, "z"), ("c", None), ("c", "w")], "rec_id string, text string")
    for _ in range(2):
        fm.write_texts(t, str(tmp_path))
    got = spark.read.text(str(tmp_path), wholetext=True)
    assert sorted((r.rec_id or "", r.value) for r in got.collect()) == [("", "z\n"), ("a/b", "x\ny\n"), ("c", "\n"), ("c", "w\n")]


def test_covered_frames_are_not_laid_out(spark):
    """each covered frame of a line was a row."""
    rng = random.Random(5)
    starts = [rng.randrange(0, 40_000) for _ in range(30)]
    lines = [(1, a, a + rng.randrange(0, 900)) for a in starts]
    events = sorted({rng.randrange(-200, 41_000) for _ in range(300)})
    cover, act = np.zeros(3000, int), np.zeros(3000, int)
    n = max(e for *_, e in lines) // 20 + 1
    for _, a, b in lines:
        cover[a // 20 : b // 20 + 1] = 1
    act[[t // 20 for t in events if 0 <= t // 20 < n]] = 1
    at = np.flatnonzero(act)
    sx, sy = cover.sum(), act.sum()
    corr = [round((n * cover[at[(at - lag >= 0) & (at - lag < 3000)] - lag].sum() - sx * sy) / (np.sqrt(sx * (n - sx)) * np.sqrt(sy * (n - sy))), 6) for lag in range(-60, 61)]
    t = spark.createDataFrame([*lines, (2, 0, 2_000_000_000)], "rec_id long, start_ms long, end_ms long")
    e = spark.createDataFrame([*((1, t) for t in events), (2, 1_000_000_000)], "rec_id long, t_ms long")
    for width in (37, 1_000):
        got = {r.rec_id: (r.lag, r.corr) for r in sg.coverage_lag(t if width == 1_000 else t.where("rec_id = 1"), e, 20, 60, F.col("end_ms"), 1, width).collect()}
        assert got[1][0] == int(np.argmax(corr)) - 60 and abs(got[1][1] - max(corr)) < 1e-6
    assert got[2] == (-60, 0.0)


def test_quiet_frames_need_no_rows(spark):
    """each frame around a gap was a row, joined with a row for each frame of the recording."""
    rng = random.Random(6)
    pairs = [(1, i, rng.randrange(0, 2_000) / 2, 990) for i in range(200)]
    loud = {rng.randrange(-50, 1_100) for _ in range(300)}
    moved = []
    for _, _, middle, last in pairs:
        runs, run = [], []
        for f in [*range(max(0, int(np.floor(middle - 70))), min(last + 1, int(np.floor(middle + 17)))), None]:
            if f is None or f in loud:
                runs.append(run)
                run = []
            else:
                run = [*run, f]
        best = max(runs, key=len)
        if len(best) > 1 and abs((best[0] + best[-1]) / 2 - middle) <= 60:
            moved.append((best[0] + best[-1]) / 2 - middle)
    p = spark.createDataFrame(pairs, "rec_id long, gap_id long, middle double, last long")
    f = spark.createDataFrame([(1, x) for x in loud] * 2, "rec_id long, frame_idx long")
    for width in (20, 1_000):
        assert sg.quiet_shift(p, f, ["rec_id"], 70, 17, 60, width=width).collect() == [(1, round(float(np.median(moved)), 3))]


def test_groups_over_batches():
    """each small group was a message of its own."""
    keys = [k for k in (None, 1, 2, 5, 5) for _ in range(k or 3)] + [9] * 30
    rows = pa.table({"k": pa.array(keys, pa.int64()), "x": pa.array(range(len(keys)), pa.int64())})
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("s", pa.int64())])
    total = lambda t: pa.table({"k": [t["k"][0].as_py()], "n": [t.num_rows], "s": [sum(t["x"].to_pylist())]}, schema)
    want = [{"k": k, "n": keys.count(k), "s": sum(i for i, x in enumerate(keys) if x == k)} for k in dict.fromkeys(keys)]
    for size in (1, 2, 7, 100):
        got = list(bl.group_by_group(total, ["k"], schema)(iter(rows.to_batches(max_chunksize=size))))
        assert [r for b in got for r in b.to_pylist()] == want
    assert len(got) == 2 and list(bl.group_by_group(total, ["k"], schema)(iter([]))) == []


def test_blocks_are_not_messages(spark):
    """tables of blocks travelled to Python one by one, and were worked out anew for each use."""
    f = spark.range(400).select((F.col("id") % 2).alias("rec_id"), F.expr("id div 2").alias("frame_idx"), F.expr("case when id % 40 < 20 then 9000.0 else 0.0 end").alias("level"))
    lines = spark.range(6).select((F.col("id") % 2).alias("rec_id"), F.expr("id div 2").alias("line_idx"), (F.expr("id div 2") * 4000 + 500).alias("start_ms"), (F.expr("id div 2") * 4000 + 2500).alias("end_ms"), F.lit("x").alias("text"))
    for out in (bl.speech_spans(f, ["rec_id"], 6000, 2000, 0, 3, 3, 0, 16), rf.snap_to_speech(lines, f, 100, 2500, 1500, 3000, 2000, width=16)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMap" not in plan and "MapInArrow" not in plan and out.count()


def test_valid_texts_stay_in_spark(spark):
    """every text went to Python, in batches of thousands of whole texts."""
    mark = b"\xef\xbb\xbf"
    raw = [b"", mark, b"a", mark + b"a", mark * 2 + b"b", "甲乙é𝄞".encode(), mark + "甲".encode(), "甲乙".encode("gb18030"), mark + "甲乙".encode("gb18030"), b"\xff\xfe\xff", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\x80", b"a\x00b", mark[:2], None]
    t = spark.createDataFrame(list(enumerate(raw)), "i int, raw binary")
    assert [r[0] for r in t.orderBy("i").select(sc.decoded(F.col("raw"))).collect()] == [sc.decode_bytes(r) for r in raw]
    seen = t.select(F.when(~F.is_valid_utf8(F.col("raw").cast("string")), 1).alias("x")).where("x = 1").count()
    plan = catalog.QUERIES["decoded_texts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert seen < len(raw) and "is_valid_utf8" in plan.lower() or "isvalidutf8" in plan.lower() or "isValid" in plan


def test_subsequences_bound_lyric_rows(spark):
    """a window was compared letter by letter with each row that has its letters, in whatever order."""
    r = random.Random(15)
    word = lambda n, letters="abcdef歌": "".join(r.choice(letters) for _ in range(n))
    texts = [word(n) for n in [*range(1, 40), 63, 64, 65, 127, 300]]
    ready = [mt.CharRows(t) for t in texts]
    for t in [word(n) for n in (0, 1, 7, 8, 50, 200)] + texts[-3:] + [word(30, "xyz")]:
        got = mt.common_lengths(t, ready).tolist()
        assert got == [sc.lcs_length(x, t) for x in texts]
        assert all(n >= mt.matched_chars(t, x) for n, x in zip(got, texts, strict=True))
    assert mt.common_lengths("ab", []).tolist() == []
    windows = [(1, i, i, word(r.choice([3, 9, 20, 60]))) for i in range(60)] + [(2, i, i, t + word(i)) for i, t in enumerate(texts[2:12])] + [(3, i, i, t[1:-1]) for i, t in enumerate(texts[5:15])]
    rows = [(7, i, t) for i, t in enumerate(texts + texts[:10])]
    want = {(*w[:3], len(w[3]), *x[:2], len(x[2]), s) for w in windows for x in rows if len(x[2]) >= 3 and abs(len(x[2]) - len(w[3])) <= max(10, len(w[3])) and (s := mt.similarity(w[3], x[2])) >= 0.55}
    found = mt.window_scores(spark.createDataFrame(windows, "rec_id long, first long, last long, wtext string"), spark.createDataFrame(rows, "doc long, lyric_idx long, n2 string"))
    assert {tuple(x) for x in found.collect()} == want and len({x[-1] for x in want}) > 20


def test_a_body_is_not_read_for_each_letter(spark):
    """each letter of a row had its recording's whole body made anew and searched."""
    t = spark.range(400).select(F.concat(F.lit("abcxyzé歌𝔸"), F.col("id").cast("string")).alias("line"), F.repeat(F.lit("ab, ca𝔸01-"), 20_000).alias("body"))
    began = time.time()
    got = t.select("line", sc.char_hit_ratio(F.col("line"), F.array_join(F.array_distinct(F.split(F.lower("body"), "")), "")).alias("hit")).collect()
    assert time.time() - began < 60
    assert all(x.hit == sum(c in "abca𝔸01" for c in x.line) / len(x.line) for x in got)
    plain = spark.createDataFrame([("abcd", "badbad"), ("", "abc"), ("xyz", ""), ("歌歌a", "歌")], "line string, body string")
    assert [x[0] for x in plain.select(sc.char_hit_ratio(F.col("line"), F.col("body"))).collect()] == [0.75, 0.0, 0.0, 2 / 3]
    plan = catalog.QUERIES["sung_windows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in "".join(x for x in plan.splitlines() if " AS hit#" in x)


def test_lyric_hints_look_runs_up():
    """matching blocks of a stretch and its lyric came from difflib, each letter of one with its equals in the other."""
    r = random.Random(28)
    for _ in range(300):
        a, b = ("".join(r.choice("abc歌") for _ in range(r.randint(0, 40))) for _ in range(2))
        b = r.choice([a, b, a[3:20] + b, b + a[::2]])
        want = {(m.a + k, m.b + k) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(m.size)}
        assert {(i + k, j + k) for i, j, n in sc.matching_blocks(a, b) for k in range(n)} == want
    words = ["".join(r.choice("ab") for _ in range(10)) for _ in range(2_500)]
    began = time.time()
    assert mt.lyric_hints(words, ["".join(words[i : i + 5]) for i in range(0, 2_500, 5)]) == list(range(4, 2_498, 5))
    assert time.time() - began < 20  # difflib: 300 million steps


def test_hints_need_no_second_look_at_the_atoms(spark):
    """atoms were made and shuffled twice, to be joined with their own places."""
    atoms = spark.createDataFrame([(1, 0, 0, "ab", 0, 10, "x"), (1, 0, 1, "cd", 10, 20, "y"), (1, 0, 2, "ef", 20, 30, None), (1, 0, 3, "gh", 30, 40, "z"), (1, 1, 0, "ij", 50, 60, "w")], "rec_id long, block long, pos long, text string, start_ms long, end_ms long, note string")
    lyrics = spark.createDataFrame([(1, 0, 0, "ab cd"), (1, 0, 1, "ef gh")], "rec_id long, block long, lyric_idx long, text string")
    chat = spark.createDataFrame([(1, 100, "d, ef")], "rec_id long, t_ms long, text string")
    got = mt.boundary_hints(atoms, lyrics, chat)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 4  # 5 before
    rows = [tuple(x) for x in got.orderBy("block", "pos").collect()]
    assert rows == [(1, 0, 0, "ab", 0, 10, "x", 0), (1, 0, 1, "cd", 10, 20, "y", 2), (1, 0, 2, "ef", 20, 30, None, 1), (1, 0, 3, "gh", 30, 40, "z", 0), (1, 1, 0, "ij", 50, 60, "w", 0)]


def test_songs_are_compared_in_all_tasks(spark):
    """small joined rows were put together in one task before Python compared them, pairs twice."""
    docs = spark.createDataFrame([(i, "Song", f"la{i} " * 9) for i in range(5)], "doc long, title string, text string")
    blocks = spark.createDataFrame([(i, 0, f"la{i % 7} " * 8) for i in range(40)], "rec_id long, block long, text string")
    asked = blocks.where("rec_id % 2 = 0").select("rec_id", "block", F.lit("song").alias("name"))
    with pytest.MonkeyPatch.context() as m:
        plans = []
        m.setattr(songs, "written", lambda t, what: plans.append(t._jdf.queryExecution().optimizedPlan().toString()) or t)
        got = songs.retrieve(blocks, asked, docs)
    assert len(plans) == 2 and plans[0].count("alike(") == 1
    last = lambda plan, name: plan[plan.index(name) :].split("ArrowEvalPython", 1)[-1]
    assert "RepartitionByExpression" in last(plans[0], "alike(") and "RepartitionByExpression" in last(plans[1], "choose(")
    assert got.count() == 40


def test_similarities_of_pairs():
    """each pair prepared its document anew."""
    r = random.Random(27)
    texts = ["".join(r.choice("abcde") for _ in range(r.randint(0, 30))) for _ in range(40)]
    pairs = [(a, b) for a in texts for b in [*texts, a[2:9], a + "x"]]
    for least in (0.0, 0.35, 0.7):
        got = mt.similarities([a for a, _ in pairs], [b for _, b in pairs], least).tolist()
        assert [x if x >= least else 0 for x in got] == [s if (s := mt.similarity(a, b)) >= least else 0 for a, b in pairs]


def test_whole_texts_are_dealt_out(spark):
    """joined texts were put together in few tasks, in batches of thousands, before Python compared them; ratios were taken twice."""
    ref, hyp = (view(spark, SF) for view in (views.ref_line, views.hyp_line))
    plan = pr.accuracy(ref, hyp, normal_alnum)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    udf = lambda name: [i for i, x in enumerate(plan) if "ArrowEvalPython" in x and f"{name}(" in x]
    assert len(udf("ratio_udf")) == 1
    for name in ("ratio_udf", "run"):
        assert any("RepartitionByExpression" in x for i in udf(name) for x in plan[i + 1 : i + 5])
