"""Long recordings in blocks, refining against plain forms, histories, and stores over batches."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.operators import blocks as bl
from chronotext.operators import edits as ed
from chronotext.operators import intervals as iv
from chronotext.operators import refine as rf
from chronotext.operators import sweeps as sw
from chronotext.sources import stores as st


def rows_of(df):
    return sorted(map(str, df.collect()))


def plain_speech(levels, on, off, smooth, hang, least, pad):
    """One pass over a whole recording: a dict of frames."""
    mean = {i: np.mean([levels[j] for j in range(i - smooth, i + smooth + 1) if j in levels]) for i in levels}
    spans, begin, last, weak = [], None, None, None
    for i in sorted(levels):
        if weak is not None and i - weak > hang + 1:
            if begin is not None:
                spans.append((begin, weak))
            begin = weak = None
        if mean[i] >= off:
            weak = i
            if mean[i] >= on and begin is None:
                begin = i
    if begin is not None:
        spans.append((begin, weak))
    out = []
    for a, b in spans:
        if b - a + 1 >= least:
            a, b = max(0, a - pad), b + pad
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return out


@pytest.mark.parametrize("width", [16, 64, 100_000])
def test_speech_in_blocks_is_that_of_the_whole(spark, width):
    r = random.Random(4)
    rows, want = [], []
    for rec in (1, 2, None):
        levels, level = {}, 0
        for i in range(900):
            level = max(0, min(40, level + r.choice([-6, -3, 0, 3, 6])))
            if r.random() > 0.15:
                levels[i] = level
        rows += [(rec, i, v) for i, v in levels.items()] + [(rec, 5, 0), (rec, None, 3), (rec, 7, None)]
        levels[5] = max(0, levels.get(5, 0))
        want += [(rec, a, b) for a, b in plain_speech(levels, 24, 9, 2, 4, 5, 3)]
    frames = spark.createDataFrame(rows, "rec long, frame_idx long, level long").select("*", F.lit(1).alias("block"), F.lit(2).alias("first")).repartition(5)
    got = bl.speech_spans(frames.select("rec", "frame_idx", "level"), ["rec"], 24, 9, 2, 4, 5, 3, width)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 10
    assert bl.speech_spans(frames.limit(0), ["rec"], 24, 9).count() == 0


def test_one_recording_spreads_over_tasks(spark):
    """A million frames of one recording: as many blocks, and the result of a single one."""
    frames = spark.range(1_000_000).select(F.lit(1).alias("rec"), F.col("id").alias("frame_idx"), (F.pmod(F.xxhash64(F.floor(F.col("id") / 37)), F.lit(100))).alias("level"))
    some, one = (bl.speech_spans(frames, ["rec"], 80, 30, 3, 20, 10, 0, w) for w in (50_000, 2_000_000))
    assert rows_of(some) == rows_of(one)
    assert bl.with_context(frames, "frame_idx", 50_000, 3).where("owned").groupBy("block").count().count() == 20


def test_islands_in_blocks(spark):
    r = random.Random(5)
    rows = [(k, s, s + r.choice([0, 1, 5, 300]), i) for i, (k, s) in enumerate((r.choice([None, 1, 2]), r.randint(0, 3000)) for _ in range(500))]
    df = spark.createDataFrame([*rows, *rows[:30]], "k long, start_ms long, end_ms long, n long")
    for gap in (0, 3, 40):
        want = iv.gap_merge(df, ["k"], gap).select("k", "start_ms", "end_ms")
        for width in (1, 50, 10_000):
            assert rows_of(bl.merged_in_blocks(df, ["k"], gap, width).select("k", "start_ms", "end_ms")) == rows_of(want)


def test_thinning(spark):
    r = random.Random(6)
    rows = [(r.choice([1, 2, None]), r.choice([None, *range(0, 4000, 7)])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k long, t_ms long").repartition(6)
    want = []
    for k in {x[0] for x in rows}:
        last = None
        for t in sorted(x[1] for x in rows if x[0] == k and x[1] is not None):
            if last is None or t - last > 50:
                want.append((k, t))
                last = t
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(str, map(tuple, sw.thin(df, ["k"], "t_ms", 50).collect()))) == sorted(map(str, want))
            assert sorted(map(str, map(tuple, bl.thinned(df, ["k"], "t_ms", 50, 300).collect()))) == sorted(map(str, want))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)


def lines_frame(spark, seed=7, n=400, span=200_000):
    r = random.Random(seed)
    rows = []
    for rec in (1, 2):
        for i in range(n):
            s = r.randint(0, span)
            rows.append((rec, i, s, s + r.choice([0, 40, 600, 3000]), r.choice(["hello there", "hello  there", "there", "abc", "", "again and again", "and again"])))
    return spark.createDataFrame(rows, "rec_id long, line_idx long, start_ms long, end_ms long, text string")


@pytest.mark.parametrize("width", [500, 20_000])
def test_sweeps_by_pauses(spark, width):
    for span in (200_000, 20_000_000):
        df = lines_frame(spark, span=span)
        assert rows_of(sw.seam_dedupe(df, width=width)) == rows_of(sw.seam_dedupe(df))
        assert rows_of(sw.finalize_lines(df, width=width)) == rows_of(sw.finalize_lines(df))


def plain_edge(levels, t, hop, before, after, up, most, first):
    i, n = int(round(t / hop)), max(levels, default=-1) + 1
    win = [j for j in range(max(0, i - before), min(n, i + after)) if j in levels]
    if not win:
        return None
    floor = np.percentile([levels[j] for j in range(max(0, i - before) - 20 if i - before > 0 else i - before - 20, i + after + 20) if j in levels], 10)
    loud = [j for j in win if levels[j] > floor + up]
    if not loud:
        return None
    found = (loud[0] if first else loud[-1] + 1) * hop
    return found if abs(found - t) <= most else None


@pytest.mark.parametrize("width", [70, 100_000])
def test_edges(spark, width):
    r = random.Random(8)
    levels = {rec: {i: r.choice([-60, -55, -50, -30, -10]) + r.random() for i in range(700) if r.random() > 0.05} for rec in (1, 2)}
    lines = [(rec, i, s, s + r.randint(50, 900), "x") for rec in (1, 2, 3) for i, s in enumerate(sorted(r.randint(0, 6900) for _ in range(60)))]
    frames = spark.createDataFrame([(rec, i, v) for rec, own in levels.items() for i, v in own.items()] + [(1, 5, None)], "rec_id long, frame_idx long, level double")
    df = spark.createDataFrame(lines, "rec_id long, line_idx long, start_ms long, end_ms long, text string")
    got = {(x.rec_id, x.line_idx): (x.onset_ms, x.offset_ms) for x in rf.edges(df, frames, 10, (25, 15, 6.0, 225), (20, 25, 3.0, 225), width).collect()}
    assert got == {(rec, i): (plain_edge(levels.get(rec, {}), s, 10, 25, 15, 6.0, 225, True), plain_edge(levels.get(rec, {}), e, 10, 20, 25, 3.0, 225, False)) for rec, i, s, e, _ in lines}
    assert sum(a is not None for a, _ in got.values()) > 10 and any(a is None for a, _ in got.values())
    whole = rf.refine_lines(df, frames, width=width)
    assert whole.count() == len(lines) and whole.where("end_ms <= start_ms").count() == 0
    assert rf.snap_to_speech(df.limit(0), frames).count() == 0


def test_history(spark):
    r = random.Random(9)
    log = [(p, s, r.choice(["save", "save", "undo", "redo"]), f"{p}/{s}") for p in (1, 2) for s in range(3, 400, 3)] + [(3, 1, "undo", None)]
    df = spark.createDataFrame(log, "project long, seq long, op string, payload string").repartition(4)

    def plain(p, upto):
        v, at = [], 0
        for q, s, op, x in sorted(log, key=lambda y: (y[0], y[1])):
            if q == p and s <= upto:
                if op == "save":
                    v = [*v[:at], x][-8:]
                    at = min(8, at + 1)
                else:
                    at = max(0, at - 1) if op == "undo" else min(len(v), at + 1)
        return at, len(v), v[at - 1] if at else None

    asked = [(p, s) for p in (1, 2, 3, 4) for s in (0, 3, 4, 57, 201, 399, 1000)]
    q = spark.createDataFrame(asked, "project long, seq long")
    for every in (1, 10, 1000):
        got = {(x.project, x.seq): (x.version, x.n_versions, x.payload) for x in ed.state_as_of(df, q, ed.snapshots(df, every, 8), every, 8).collect()}
        assert got == {(p, s): plain(p, s) for p, s in asked}
    assert {(x.project, x.version, x.n_versions, x.payload) for x in ed.current_version(df, 8).collect()} == {(p, *plain(p, 1000)) for p in (1, 2, 3)}


def test_recovery(spark):
    of = lambda rows: spark.createDataFrame(rows, "project long, at long, payload string")
    got = {tuple(r) for r in ed.recovered(of([(1, 5, "a"), (1, 9, "b"), (2, 3, "c")]), of([(1, 9, "x"), (2, 4, "y"), (3, 1, "z")])).collect()}
    assert got == {(1, 9, "b", False), (2, 4, "y", True), (3, 1, "z", True)}


def words(spark, rows):
    return spark.createDataFrame(rows, "seq long, word string, alias array<string>, category string")


def test_keyword_store(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="spark-store-")
    s = st.KeywordStore(spark, f"file://{path}", 4)
    assert s.version() == 0 and s.read().count() == 0 and s.ordered().count() == 0
    s.add(words(spark, [(1, " Alpha ", ["al", " "], "b"), (2, "x", None, "a"), (3, None, None, "a"), (4, "béta", None, "a"), (5, "ALPHA!", ["pha"], "a"), (6, "!!", None, "a")]))
    shown = lambda v=None: [(r.place, r.word, r.alias, r.category, r.enabled) for r in s.ordered(v).orderBy("place").collect()]
    first = [(1, "ALPHA!", ["pha"], "a", True), (2, "béta", [], "a", True)]
    assert shown() == first
    s.set_enabled(spark.createDataFrame([(1, "alpha", False), (2, "none", False)], "seq long, word string, enabled boolean"))
    s.add(words(spark, [(1, "gamma", None, "0")]))
    s.remove(words(spark, [(1, "be ta", None, None), (2, "bé-TA", None, None)]))
    last = [(1, "gamma", [], "0", True), (2, "ALPHA!", ["pha"], "a", False)]
    assert shown() == last and shown(1) == first and s.version() == 4
    # a write that dies before it is published
    monkeypatch.setattr(s, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.add(words(spark, [(1, "delta", None, "d")]))
    monkeypatch.undo()
    assert shown() == last and s.version() == 4
    # two writers of one version
    other = st.KeywordStore(spark, f"file://{path}", 4)
    monkeypatch.setattr(other, "version", lambda: 3)
    with pytest.raises(RuntimeError):
        other.add(words(spark, [(1, "epsilon", None, "e")]))
    assert shown() == last
    assert s.add(words(spark, [])) == 4


def test_batches_in_order(spark):
    """Changes of one batch count in their order, whatever the tasks."""
    r = random.Random(10)
    s = st.KeyedStore(spark, f"file://{tempfile.mkdtemp(prefix='spark-store-')}", "a long, b string", 3)
    state, n = {}, 0
    kind = "k string, seq long, op string, row struct<a: bigint, b: string>, change struct<a: bigint, b: string>"
    for _ in range(4):
        batch = []
        for seq in range(60):
            k, op = f"k{r.randint(0, 15)}", r.choice(["put", "set", "set", "remove"])
            n += 1
            row = (n, f"b{n}") if op == "put" else None
            change = r.choice([(n, None), (None, f"c{n}"), (n, f"d{n}")]) if op == "set" else None
            batch.append((k, seq, op, row, change))
            if op == "put":
                state[k] = row
            elif op == "remove":
                state.pop(k, None)
            elif k in state:
                state[k] = tuple(y if y is not None else x for x, y in zip(state[k], change, strict=True))
        s.merge(spark.createDataFrame(batch, kind).repartition(5))
        assert {x.k: (x.a, x.b) for x in s.keyed().collect()} == state
        # order of first coming, as a mapping keeps it
        order = [x.k for x in s.keyed().orderBy("added").collect()]
        assert order == list(state)


def lyrics(spark, rows):
    line = lambda t: [(t, None)] if t else []
    return spark.createDataFrame([(i, t, a, "import", False, line(x)) for i, t, a, x in rows], "seq long, title string, artist string, source string, synced boolean, lines array<struct<text: string, t_ms: bigint>>")


def test_lyric_store(spark):
    s = st.LyricStore(spark, f"file://{tempfile.mkdtemp(prefix='spark-store-')}", 4)
    s.add(lyrics(spark, [(1, "Song", "z", "1"), (2, "Song", "b", "2"), (3, "Other", None, "3"), (4, "Empty", "a", ""), (5, "so-ng", "Z", "4"), (6, " ", "a", "5")]))
    shown = lambda: [(r.place, r.title, r.artist, r.lines[0].text) for r in s.ordered().orderBy("place").collect()]
    assert shown() == [(1, "Other", "", "3"), (2, "未命名", "a", "5"), (3, "Song", "b", "2"), (4, "so-ng", "Z", "4")] or shown() == [(1, "Other", "", "3"), (2, "so-ng", "Z", "4"), (3, "未命名", "a", "5"), (4, "Song", "b", "2")]
    s.add(lyrics(spark, [(1, "Other", "", "6"), (2, "New", "n", "7"), (3, "New", "n", "8")]), overwrite=False)
    assert {(r.title, r.lines[0].text) for r in s.read().collect()} == {("Other", "3"), ("未命名", "5"), ("Song", "2"), ("so-ng", "4"), ("New", "7")}
    s.remove(spark.createDataFrame([(1, "Song", ""), (2, "New", "n"), (3, "None", "")], "seq long, title string, artist string"))
    assert {r.title for r in s.read().collect()} == {"Other", "未命名", "so-ng"}


def test_best_span(spark):
    r = random.Random(11)
    rows = [(k, i, s, s + r.randint(0, 50)) for k in (1, 2, 3) for i, s in enumerate(r.randint(0, 3000) for _ in range(120))]
    spans = [(k, s, s + r.randint(1, 60)) for k in (1, 2) for s in (r.randint(0, 3000) for _ in range(25))]

    def best(k, s, e):
        own = [(a, z) for q, a, z in spans if q == k]
        rank = lambda x: (-max(0, min(e, x[1]) - max(s, x[0])), abs(x[0] + x[1] - s - e) if min(e, x[1]) <= max(s, x[0]) else 0, *x)
        return min(own, key=rank) if own else None

    got = {(x.k, x.i): (x.span_start, x.span_end) for x in iv.best_span(spark.createDataFrame(rows, "k long, i long, start_ms long, end_ms long"), spark.createDataFrame(spans, "k long, start_ms long, end_ms long"), "k", "i", 100).collect()}
    assert got == {(k, i): b for k, i, s, e in rows if (b := best(k, s, e))}


def test_unknown_responses(spark):
    from chronotext.sources import records as rc

    good = spark.createDataFrame([("a", '{"segments": []}'), ("b", None), ("c", '[{"start": 1, "end": 2, "text": "ab"}]')], "k string, t string")
    assert [x.k for x in rc.parse_responses(good, "k", "t").collect()] == ["c"]
    bad = spark.createDataFrame([("a", '{"message": "no"}')], "k string, t string")
    with pytest.raises(Exception, match="unknown shape"):
        rc.parse_responses(bad, "k", "t").collect()
    assert rc.parse_responses(bad, "k", "t", strict=False).count() == 0
