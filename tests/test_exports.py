"""All formats of an export, and reports with their lists."""

import json
import tempfile

from pyspark.sql import functions as F

from chronotext.sources import records as rc
from chronotext.sources import writers as wr


def lines(spark):
    rows = [(1, 0, 0, 1500, "first line"), (1, 1, 1600, 3000, ""), (1, 2, 3500, 4000, "third | here"), (2, 0, 10, 20, "甲")]
    return spark.createDataFrame(rows, "rec_id long, line_idx long, start_ms long, end_ms long, text string").withColumn("speaker", F.lit("s"))


def test_every_format(spark):
    got = {(r.rec_id, r.format): r.text for r in wr.export(lines(spark), ["srt", "ass", "json", "vtt", "lrc", "nothing", "ass"]).collect()}
    assert set(got) == {(r, f) for r in (1, 2) for f in ("srt", "ass", "json", "vtt", "lrc")}
    ass = got[1, "ass"]
    assert ass.startswith("[Script Info]") and ass.count("\nStyle: ") == 2 and [x.rsplit(",", 1)[1] for x in ass.split("\n") if x.startswith("Dialogue: ")] == ["{\\k150}first line", "{\\k50}third | here"]
    shown = json.loads(got[1, "json"])["lines"]
    assert [(x["start"], x["end"], x["text"], x["speaker"]) for x in shown if x["text"]] == [(0.0, 1.5, "first line", "s"), (3.5, 4.0, "third | here", "s")]
    back = rc.parse_line_json(spark.createDataFrame([(2, got[2, "json"])], "rec_id long, text string"), "rec_id", "text").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in back] == [(10, 20, "甲")]
    folder = tempfile.mkdtemp(prefix="spark-export-") + "/out"
    wr.write_export(lines(spark), ["ass", "json"], folder)
    assert {(r.format, r.rec_id) for r in spark.read.text(folder, wholetext=True).select("format", "rec_id").distinct().collect()} == {("ass", 1), ("ass", 2), ("json", 1), ("json", 2)}


def test_reports_with_lists(spark):
    report = spark.createDataFrame([(1, 3, 0.5), (2, 1, None)], "rec_id long, n_ref long, cer double")
    worst = spark.createDataFrame([(1, 2, "b|c", 0.25), (1, 1, "a\nx", None)], "rec_id long, n long, ref string, sim double")
    got = {r.rec_id: r.text for r in wr.report_markdown(report, {"n_ref": "lines", "cer": "error rate"}, [("Worst lines", {"ref": "reference", "sim": "alike"}, worst)]).collect()}
    head = "# Report\n\n| metric | value |\n|---|---:|\n"
    assert got[2] == head + "| lines | 1 |\n| error rate | - |\n"
    assert got[1] == head + "| lines | 3 |\n| error rate | 0.5 |\n\n## Worst lines\n\n| # | reference | alike |\n|---|---|---|\n| 1 | a x |  |\n| 2 | b c | 0.25 |\n"
