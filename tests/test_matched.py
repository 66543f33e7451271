"""Many pairs of texts matched together: against each pair by itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.operators import matched as md
from chronotext.operators import matching as mt
from chronotext.operators import songs as sg
from chronotext.plans.scalar_queries import QUERIES


def some_text(rng, letters, *sizes):
    return "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))


@pytest.mark.parametrize("table", [0, 1 << 21])
def test_matched_together(table, monkeypatch):
    """each text met one document after the other."""
    monkeypatch.setattr(md, "TABLE", table)
    rng = random.Random(4)
    for letters in ["ab", "abc", "abcdefgh", "aé漢𠀀b"] * 40:
        texts = [some_text(rng, letters + "z", 0, 1, 3, 9, 30, 60) for _ in range(rng.choice([1, 3]))]
        others = [some_text(rng, letters + "y", 0, 1, 2, 5, 20, 50) for _ in range(6)] + [texts[0], texts[0][3:] + texts[0][:3]]
        parts, want = md.Parts.of(others), np.array([[mt.matched_chars(t, x) for x in others] for t in texts])
        assert (md.matched_with(texts, parts) == want).all()
        assert md.matched_with(texts, parts, text_first=False).tolist() == [[mt.matched_chars(x, t) for x in others] for t in texts]
        live = np.array([[rng.random() < 0.7 for _ in others] for _ in texts])
        assert (md.matched_with(texts, parts, live) == np.where(live, want, 0)).all()
        base = np.array([[max(1, min(len(t), (len(t) + len(x)) / 2)) for x in others] for t in texts])
        for top in (1, 3):
            got = md.matched_with(texts, parts, live, True, top, base)
            low = np.sort(np.where(live, want / base, 0), axis=1)[:, -top][:, None]
            exact = live & (want / base >= low - 1e-4)
            assert (got[exact] == want[exact]).all() and (got <= want).all()


def test_too_much_at_once_is_halved(monkeypatch):
    texts, others = ["ab" * 40, "aab" * 20, "xyz"], ["ab" * 30, "ba" * 20 + "c", "zyx", "aab" * 9]
    want = [[mt.matched_chars(t, x) for x in others] for t in texts]
    monkeypatch.setattr(md, "MOST_PAIRS", 50)
    assert md.matched_with(texts, md.Parts.of(others)) is None
    got = mt.matched_table(texts, others, md.Parts.of(others), np.ones((3, 4), bool), 4, np.ones((3, 4)), np.zeros(3))
    assert got.tolist() == want


def test_ranked_in_chunks(spark, monkeypatch):
    """F2: the best few of several chunks of documents, and of several runs of texts; equal scores come by title and document."""
    rng = random.Random(9)
    docs = [(i, f"t{i % 3}", some_text(rng, "abcde", 4, 30, 60)) for i in range(40)] + [(100 + i, "t1", "abcabcabc") for i in range(6)]
    texts = [(i, 0, some_text(rng, "abcde", 3, 20, 90)) for i in range(12)] + [(50, 0, "abcabcabc")]
    s, d = spark.createDataFrame(texts, "rec_id long, block long, text string"), spark.createDataFrame(docs, "doc long, title string, text string")
    want = []
    for rec, b, t in texts:
        found = sorted((-mt.similarity(t, x), title, doc) for doc, title, x in docs)[:5]
        want += [(rec, b, i, doc, -score) for i, (score, _, doc) in enumerate(found, 1)]
    assert sorted(map(tuple, sg.ranked(s, ["rec_id", "block"], d, 5).collect())) == sorted(want)
    size = np.array([3, 5, 9, 1, 1, 1])
    assert [x.tolist() for x in sg._runs_of(size, 8)] == [[0, 1], [2], [3, 4, 5]] and sg._runs_of(size[:0], 8) == []


# ---- evidence ----


def plain_part(long_text, target):
    n = len(target)
    ready = mt.CharRows(target, rare=True)
    return max((long_text[i : i + n] for i in range(len(long_text) - n + 1)), key=lambda p: mt.matched_chars(p, target, prepared=ready)) if len(long_text) > n else long_text


def plain_evidence(text, said):
    said = plain_part(said, text) if len(said) > 1.8 * len(text) else said
    return said, mt.ratio(text, said) if abs(len(said) - len(text)) <= max(4, len(text) // 2) else 0.0


def test_evidence_is_as_each_part_compared():
    rng, alike = random.Random(3), 0
    for letters in ["ab", "abcd", "etaoinshrdlucmfw", "aé漢𠀀b"] * 50:
        t = some_text(rng, letters, 1, 3, 8, 20, 40, 205)
        c = some_text(rng, letters, 3, 20, 90)
        if rng.random() < 0.5:
            c = c[:10] + "".join(x if rng.random() < 0.8 else rng.choice(letters) for x in t) + c[10:]
        want, got = plain_evidence(t, c), mt.evidence_part(t, c, 0.55)
        assert (got == want) if want[1] >= 0.55 else got[1] < 0.55
        alike += want[1] >= 0.55
        assert mt.closest_part(c, t) == plain_part(c, t)
    assert 40 < alike < 190


def test_closest_parts_together(monkeypatch):
    rng = random.Random(8)
    pairs = [(some_text(rng, "abcde", 0, 5, 40, 120), some_text(rng, "abcde", 0, 1, 4, 30, 90)) for _ in range(120)] + [("ab" * 150, "ba" * 105), ("", "")]
    want = [plain_part(x, t) if t else "" for x, t in pairs]
    for chars in (50, 2_000, 1 << 16):
        monkeypatch.setattr(mt, "PART_CHARS", chars)
        assert mt.closest_parts([x for x, _ in pairs], [t for _, t in pairs]) == want


def test_text_coverage_uses_whole_lines(spark, tmp_path):
    """the closest part was found for a line's first twelve letters."""
    passage = "A copper kettle sang. Beneath the crooked apple tree we danced until the lanterns died. Nobody slept"
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(0, 0, "user", "beneath the crooked apple tree we dansed"), (0, 1, "user", "copper"), (1, 0, "user", "x" * 300), (2, 0, "user", "...")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.rec_id, r.line_idx): r.closest for r in QUERIES["text_coverage"](spark, str(tmp_path)).collect()}
    whole = "".join(c for c in passage if c.isalnum()).lower()
    assert got == {(0, 0): "beneaththecrookedappletreewedanced", (0, 1): "copper", (1, 0): whole, (2, 0): ""}


def test_unlike_evidence_is_left_unread(monkeypatch):
    """a line was compared with each part of a longer chat text."""
    calls = []
    plain = mt.matched_chars
    monkeypatch.setattr(mt, "matched_chars", lambda *x, **k: calls.append(1) or plain(*x, **k))
    rng = random.Random(1)
    t, c = some_text(rng, "abcdefghijklmnopqrstuvwxyz", 150), some_text(rng, "abcdefghijklmnopqrstuvwxyz", 900)
    assert mt.evidence_part(t, c, 0.55)[1] == 0 and not calls


def test_chat_that_cannot_be_known_is_not_compared(spark):
    """chat texts were compared although no known phrase is as long as the part that counts."""
    lines = spark.createDataFrame([(1, i, t, i * 1000, i * 1000 + 900) for i, t in enumerate(["the quick brown foz", "hallo dar", "xx hallo dar yy zz", "golden harp is her"])], "rec_id long, line_idx long, text string, start_ms long, end_ms long")
    said = [(1, i, i * 1000, kind, t, None, "") for i, (kind, t) in enumerate([("chat", "the quick brown fox")] * 3 + [("chat", "hallo das")] * 2 + [("sc", "golden harp is here")])]
    evidence = spark.createDataFrame(said, "rec_id long, ord long, t_ms long, kind string, text string, gift string, user_name string")
    got = mt.correct_by_chat(lines, evidence)
    assert sorted((r.line_idx, r.fixed, r.kind) for r in got.collect()) == [(1, "hallo das", "chat"), (2, "hallo das", "chat"), (3, "golden harp is here", "sc")]
    known = mt.phrase_counts(evidence).where("n >= 2").select("rec_id", F.col("phrase").alias("part"))
    assert sorted({(r.line_idx, r.said) for r in mt.said_near(lines, evidence, known).where("kind = 'chat'").collect()}) == [(0, "hallo das"), (1, "hallo das"), (1, "the quick brown fox"), (2, "hallo das"), (3, "hallo das")]


def test_post_correction_matches_once(spark):
    """the plan held the steps again for every use: chat evidence four times, lyric matching four times and more."""
    lines = spark.createDataFrame([(1, 0, 0, 900, "the golden harq rings"), (1, 1, 1000, 1900, "over the silver see")], "rec_id long, line_idx long, start_ms long, end_ms long, text string")
    evidence = spark.createDataFrame([(1, 0, 1000, "sc", "over the silver sea", None, "")], "rec_id long, ord long, t_ms long, kind string, text string, gift string, user_name string")
    lyrics = spark.createDataFrame([(7, 0, "The golden harp rings"), (7, 1, "far away")], "doc long, lyric_idx long, text string")
    got = mt.post_correct(lines, [("rings", ["ringz"])], evidence, lyrics)
    assert sorted((r.line_idx, r.text) for r in got.collect()) == [(0, "The golden harp rings"), (1, "over the silver sea")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "MapInPandas" not in plan
