"""Operators on hand-built rows."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronotext.functions import scalars as sc
from chronotext.functions import text as tx
from chronotext.operators import edits as ed
from chronotext.operators import intervals as iv
from chronotext.operators import matching as mt
from chronotext.operators import pairing as pr
from chronotext.operators import segment as sm
from chronotext.operators import sweeps as sw
from chronotext.sources import formats as fm

LINE = "rec_id long, line_idx long, start_ms long, end_ms long, text string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def lines(spark, *rs):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rs)], LINE)


def test_gap_merge_and_split(spark):
    x = lines(spark, (0, 5000, "a"), (5200, 10000, "b"), (12000, 15000, "c"))
    assert rows(iv.gap_merge(x, ["rec_id"], 350), "start_ms", "end_ms") == [(0, 10000), (12000, 15000)]
    parts = iv.split_windows(lines(spark, (0, 4000, "a")), 1500, 400)
    assert rows(parts, "part_start", "part_end") == [(0, 1333), (1333, 2666), (2666, 4000)]


def test_thin_compares_with_last_kept(spark):
    x = spark.createDataFrame([(1, t) for t in (0, 300, 600, 1200, 1500)], "k long, t long")
    assert rows(sw.thin(x, ["k"], "t", 500), "t") == [(0,), (600,), (1200,)]


def test_overlap_join_equals_nested_loop(spark):
    a = lines(spark, *[(i * 700, i * 700 + 2500, "x") for i in range(20)])
    b = lines(spark, *[(i * 900 + 100, i * 900 + 1300, "y") for i in range(20)])
    got = rows(iv.overlap_join(a, b, "rec_id", 1000), "line_idx", "line_idx_r", "overlap_ms")
    want = sorted((i, j, min(i * 700 + 2500, j * 900 + 1300) - max(i * 700, j * 900 + 100)) for i in range(20) for j in range(20) if min(i * 700 + 2500, j * 900 + 1300) > max(i * 700, j * 900 + 100))
    assert got == want


def test_pairs_and_report(spark):
    ref = lines(spark, (0, 1000, "one"), (1000, 2000, "two"), (5000, 6000, "three"))
    hyp = lines(spark, (100, 1100, "one"), (1100, 2100, "twx"), (9000, 9500, "four"))
    pairs = pr.greedy_pairs(ref, hyp)
    assert rows(pairs, "i", "j", "overlap_ms") == [(0, 0, 900), (1, 1, 900)]
    r = pr.report(pr.paired_lines(ref, hyp, pairs, tx.normal_alnum), hyp).first()
    assert (r.n_ref, r.n_hyp, r.n_pairs, r.n_missing, r.n_extra, r.start_p90_ms) == (3, 3, 2, 1, 1, 100)
    more = pr.similarity_fallback(ref, lines(spark, (90000, 91000, "threx")), pr.greedy_pairs(ref, lines(spark, (90000, 91000, "threx"))), tx.normal_alnum)
    assert rows(more, "i", "j") == [(2, 0)]


def test_time_codes(spark):
    x = spark.createDataFrame([("01:02.500",), ("00:01:02,500",), ("12.5",), ("bad",)], "t string")
    assert [r[0] for r in x.select(tx.parse_time(F.col("t"))).collect()] == [62500, 62500, 12500, None]
    y = spark.createDataFrame([(3723456,)], "ms long").select(tx.srt_time(F.col("ms")), tx.lrc_time(F.col("ms")), tx.ass_time(F.col("ms")), tx.frame_timecode(F.col("ms"), 25)).first()
    assert tuple(y) == ("01:02:03,456", "62:03.46", "1:02:03.46", "01:02:03:11")


def test_request_names_and_terms(spark):
    x = spark.createDataFrame([("点一首七里香",), ("想听《晴天》谢谢",), ("hello",)], "t string")
    name = tx.request_name(F.col("t"), "点一首|想听", r"(?:想听|点一首)\s*(.+)$", ["^(?:一首|个)", "^(?:唱|来|点|听)"], "(?:谢谢)$")
    assert [r[0] for r in x.select(name).collect()] == ["七里香", "晴天", None]
    t = spark.createDataFrame([("[笑]主播好厉害 abc 1",)], "t string").select(tx.terms(F.col("t"))).first()[0]
    assert t == ["主播好厉害", "abc"]


def test_subtitle_texts(spark):
    srt = "﻿1\r\n00:00:07,083 --> 00:00:08,5\r\nHi\r\nthere\r\n\r\nno stamp\r\n\r\n00:00:01.000 --> 00:00:02.000\r\nFirst\r\n"
    got = fm.parse_subtitles(spark.createDataFrame([(1, srt)], "rec_id long, v string"), "rec_id", "v")
    assert rows(got, "line_idx", "start_ms", "end_ms", "text") == [(0, 1000, 2000, "First"), (1, 7083, 8500, "Hi\nthere")]
    lrc = spark.createDataFrame([(1, 0, "[ti:x]"), (1, 1, "[00:05.00][00:01.50]la"), (1, 2, "[00:03.00]")], "d long, o long, r string")
    assert rows(fm.parse_lrc(lrc, "d", "r", "o"), "t_ms", "text") == [(1500, "la"), (5000, "la")]


def test_log_files(spark):
    xml = '<i><d p="1.5,1,25,16777215,0,0,u1" user="Ann">hi</d><gift ts="2" user="Bob" giftname="rose" giftcount="3" price="x"/><guard ts="4" user="C" level="1"/><d p="bad" user="D">cut'
    got = fm.parse_log_xml(spark.createDataFrame([(1, xml)], "k long, v string"), "k", "v")
    assert [tuple(r) for r in got.select("t", "kind", "user_id", "user_name", "text", "gift", "count", "price").orderBy("ord").collect()] == [
        (1.5, "chat", "u1", "Ann", "hi", None, 1, 0.0), (2.0, "gift", None, "Bob", "", "rose", 3, 0.0), (4.0, "guard", None, "C", "", "总督", 1, 0.0),
    ]
    js = spark.createDataFrame([(1, '{"cmd":"SEND_GIFT","time":3,"user":{"name":"A"}}'), (1, "oops"), (1, '{"ts":"4.5","msg":"x","uname":"B"}'), (1, '{"type":"SUPER_CHAT","ts":1}'), (1, '{"time":9}')], "k long, v string")
    assert sorted((r.t, r.kind, r.text, r.user_name) for r in fm.parse_log_json(js, "k", "v").collect()) == [(1.0, "sc", "", ""), (3.0, "gift", "", "A"), (4.5, "chat", "x", "B")]


def test_repeats_and_seams(spark):
    x = spark.createDataFrame([(1, "a", 0, 0, 500), (1, "a", 1, 1000, 1500), (1, "a", 2, 300000, 300500)], "rec_id long, k string, ord long, start_ms long, end_ms long")
    assert rows(sw.suppress_repeats(x, ["rec_id"], "k", 25000), "ord") == [(0,), (2,)]


def test_edits(spark):
    x = lines(spark, (0, 1000, "abcdef"), (1000, 1500, "gh"), (1400, 2000, "ij"))
    assert rows(ed.split_line(x, F.col("line_idx") == 0, F.lit(2)), "line_idx", "start_ms", "end_ms", "text")[:2] == [(0, 0, 333, "ab"), (1, 333, 1000, "cdef")]
    assert rows(ed.merge_lines(x, F.lit(1), F.lit(2)), "line_idx", "text") == [(0, "abcdef"), (1, "ghij")]
    assert rows(ed.fix_overlaps(x), "end_ms") == [(1000,), (1380,), (2000,)]
    assert rows(ed.shift_lines(x, F.lit(True), -1200), "start_ms", "end_ms") == [(0, 10), (0, 300), (200, 800)]
    with pytest.raises(ValueError):
        ed.retime(x, 0, 1)
    log = spark.createDataFrame([(1, i, op, p) for i, (op, p) in enumerate([("save", "a"), ("save", "b"), ("undo", ""), ("save", "c"), ("undo", ""), ("redo", ""), ("redo", "")])], "project long, seq long, op string, payload string")
    assert tuple(ed.current_version(log).first()) == (1, 2, 2, "c")


def test_segmentation_is_least_cost(spark):
    """Against all divisions of short stretches."""
    t = sm.Tuning(target=3.0, most_atoms=4, most_ms=1500)
    r = random.Random(3)
    rows, want = [], {}

    def cost(a, spans):
        total = 0.0
        for i, j in spans:
            c, span = sum(len(x[0]) for x in a[i:j]), a[j - 1][2] - a[i][1]
            if j - i > t.most_atoms or (span > t.most_ms and j - i > 1):
                return float("inf")
            total += ((c - t.target) / t.target) ** 2 * (1.5 if c > 14 else 1.0) + t.duration * max(0.0, (span - 3000) / 3000) ** 2
            if j < len(a):
                gap, end, hint = a[j][1] - a[j - 1][2], a[j - 1][0][-1], a[j - 1][3]
                total -= t.lyric if hint == 2 else t.clause if hint == 1 else t.pause * min(1, gap / 500) if gap >= t.pause_ms else t.sentence if end in ".!?" else t.clause if end in ",;" else 0.0
        return total

    for block in range(12):
        at, a = 0, []
        for _ in range(r.randint(1, 9)):
            at += r.choice([0, 50, 300, 700])
            a.append(("".join(r.choice("abc") for _ in range(r.randint(1, 5))) + r.choice(["", "", ",", "."]), at, at + r.choice([200, 900]), r.choice([0, 0, 0, 1, 2])))
            at = a[-1][2]
        rows += [(1, block, i, *x) for i, x in enumerate(a)]
        n = len(a)
        every = []
        for cuts in itertools.product([0, 1], repeat=n - 1):
            ends = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
            every.append(cost(a, list(zip(ends, ends[1:], strict=False))))
        want[block] = (min(every), a)
    atoms = spark.createDataFrame(rows, "rec_id long, block long, pos long, text string, start_ms long, end_ms long, hint int").repartition(3)
    found = {}
    for x in sm.segment(atoms, t).collect():
        found.setdefault(x.block, []).append((x.line, len(x.atoms)))
    for block, (least, a) in want.items():
        at, spans = 0, []
        for _, n in sorted(found[block]):
            spans.append((at, at + n))
            at += n
        assert at == len(a) and abs(cost(a, spans) - least) < 1e-6


def test_tidy_lines_and_texts(spark):
    atoms = [(0, ", so ", 0, 100), (1, "many", 100, 200), (2, "words", 700, 800), (3, "here.", 800, 900)]
    x = spark.createDataFrame([(1, 0, 0, atoms), (1, 0, 1, [(4, "...", 900, 950)])], "rec_id long, block long, line long, atoms array<struct<pos:long,text:string,start_ms:long,end_ms:long>>")
    assert rows(sm.line_texts(sm.tidy_lines(x)), "line", "text") == [(0, "so many words here.")]


def test_finalize_against_plain(spark):
    r = random.Random(8)
    texts = ["good morning", "good", "good morning all", "la la la la", "x!", "", "bye"]
    rs = sorted((r.randrange(0, 60_000, 250), r.randrange(0, 3000, 250), r.choice(texts)) for _ in range(120))
    rs = [(s, s + d, t) for s, d, t in rs]
    key = lambda t: "".join(c for c in t if c.isalnum())
    kept, seen = [], {}
    for s, e, t in [[s, e if e > s else s + 10, t] for s, e, t in rs if t]:
        line = [s, e, t]
        k = key(t)
        if len(k) >= 4:
            if any(x[1] <= s + 50 and s - x[1] <= 25_000 for x in seen.get(k, [])):
                continue
            seen.setdefault(k, []).append(line)
        if kept and k and len(k) >= 3 and s - kept[-1][1] < 1000 and key(kept[-1][2]) and (k in key(kept[-1][2]) or key(kept[-1][2]) in k):
            if len(k) > len(key(kept[-1][2])):
                kept[-1][:] = line
            continue
        kept.append(line)
    for x, y in itertools.pairwise(kept):
        if x[1] > y[0]:
            x[1] = max(x[0] + 50, y[0])
        y[0] = max(y[0], x[1])
        if y[1] <= y[0]:
            y[1] = y[0] + 50
    got = rows(sw.finalize_lines(lines(spark, *rs)), "start_ms", "end_ms", "text")
    assert got == sorted(map(tuple, kept))


def test_recall_and_scores():
    r = random.Random(2)
    for _ in range(60):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(40))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, c in enumerate(a):
            for j, e in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if c == e else max(table[i][j + 1], table[i + 1][j])
        assert sc.lcs_length(a, b) == table[-1][-1]
        full = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert mt.matched_chars(a, b) == full and mt.matched_chars(a, b, full) in (full, -1) and (not a or not b or mt.matched_chars(a, b, full) == full)
    assert sc.coverage("abcdefgh", "xxabcdyy") == 0.5 and sc.coverage("", "a") == 0.0
    assert sc.closest_part("xxhelloyy", "hallo") == "hello"
    assert sc.breaks_after("ab, c. ", "abc") == [1, 2]
    assert sc.tokens("，你好, it's") == [("你", "，你"), ("好", "好, "), ("it's", "it's")]
    assert [sc.decode_bytes("歌词".encode(e)) for e in ("utf-8-sig", "utf-8", "gb18030")] == ["歌词"] * 3 and sc.decode_bytes(None) is None


def test_lyrics_against_plain(spark):
    """All windows against all rows, then placing, row by row."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    song = [" ".join(word() for _ in range(5)) for _ in range(9)]
    song[6] = song[1]
    said = ["a"]
    for x in song:
        w = x.split()
        w[r.randrange(5)] = word()
        said += r.choice([[" ".join(w)], [" ".join(w[:2]), " ".join(w[2:])], [" ".join(w), " ".join(word() for _ in range(3))]])
    rs = [(i * 1000, i * 1000 + 900, t) for i, t in enumerate(said)]
    n2 = lambda t: "".join(c for c in t if c.isalnum()).lower()
    held = [(i, n2(t)) for i, (_, _, t) in enumerate(rs) if len(n2(t)) >= 3]
    runs = [(held[i][0], held[i + k][0], "".join(t for _, t in held[i : i + k + 1])) for i in range(len(held)) for k in range(3) if i + k < len(held)]
    taken, seen, last, want = set(), set(), -1, []
    for j, x in enumerate(map(n2, song)):
        c = [(round(s, 2), -abs(len(t) - len(x)), -a, -b, s) for a, b, t in runs if abs(len(t) - len(x)) <= max(10, len(t)) and (s := mt.similarity(t, x)) >= 0.55]
        again = x in seen
        for _, _, a, b, s in sorted(c, reverse=True)[:8]:
            if -a not in taken and (again or -a >= last - 30):
                taken.add(-a)
                last = last if again else max(last, -a)
                want.append((j, -a, -b, s))
                break
        if c:
            seen.add(x)
    docs = spark.createDataFrame([(4, i, t) for i, t in enumerate(song)], "doc long, lyric_idx long, text string")
    x = lines(spark, *rs)
    got = mt.match_lyrics(x, docs)
    assert rows(got, "lyric_idx", "line_idx", "merged_to", "score") == sorted(want) and len(want) >= 6
    report = mt.match_reports(got)
    assert report.first().score > 0.6 and mt.best_documents(report).first().doc == 4
    plans = mt.lyric_plans(x, got, docs, 0.6)
    out = mt.apply_plans(x, plans).orderBy("line_idx").collect()
    spans = plans.collect()
    assert spans and len(out) == len(rs) - sum(p.last - p.line_idx for p in spans) and {p.fixed for p in spans} <= {o.text for o in out}
    assert mt.match_lyrics(x, docs.limit(0)).count() == 0


def test_chat_and_keyword_correction(spark):
    x = lines(spark, (0, 900, "we love kittne so"), (5000, 5900, "nothing here"))
    e = [(1, 0, 100, "chat", "We love kitten so!", None, "ann"), (1, 1, 200, "chat", "we love kitten so", None, "bob"), (1, 2, 300, "chat", "we love kitteh so", None, "c"), (1, 3, 90_000, "sc", "nothing hear", None, "d")]
    got = mt.correct_by_chat(x, spark.createDataFrame(e, "rec_id long, ord long, t_ms long, kind string, text string, gift string, user_name string"))
    assert rows(got, "line_idx", "fixed", "kind") == []  # 14 letters are too many to be a phrase
    e = [(*y[:4], y[4].replace("we ", "").replace("We ", ""), *y[5:]) for y in e]
    x = lines(spark, (0, 900, "love kittne so"), (5000, 5900, "nothing here"))
    got = mt.correct_by_chat(x, spark.createDataFrame(e, "rec_id long, ord long, t_ms long, kind string, text string, gift string, user_name string"))
    assert rows(got, "line_idx", "fixed", "kind") == [(0, "love kitten so!", "chat")]
    words = [("Kitten", ["kittne"]), ("Nothing Hear", [])]
    assert rows(mt.correct_by_keywords(x, words), "line_idx", "fixed") == [(0, "love Kitten so"), (1, "Nothing Hear")]


def test_break_hints():
    atoms = ["ab", "cd", "ef", "gh", "ij"]
    assert mt.lyric_hints(atoms, ["abcd", "efgh", "ij"]) == [1, 3]
    assert mt.chat_hints(atoms, ["cdef", "xyz", "hij"]) == [2]
    assert mt.lyric_hints([], ["a"]) == [] and mt.chat_hints(atoms, []) == []


def test_similarity_rules():
    assert mt.similarity("", "a") == 0.0
    assert mt.similarity("abc", "xxabcxx") == 1.0
    assert 0 < mt.similarity("abcd", "abxd") < 1
