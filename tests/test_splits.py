"""Files that split by byte ranges: the same records whatever the ranges, in batches and streams."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from chronotext.sources import formats as fm
from chronotext.sources import splits as sp


def log_text(seed=1, n=120, tail="</i>"):
    r = random.Random(seed)
    rows = ['<i><head name="x"/>']
    for i in range(n):
        rows.append(
            r.choice(
                [
                    f'<d p="{r.random() * 100:.2f},1,25,9,0,0,{i},0" user="u&amp;{i}">text {i} 甲乙 &lt;d {"x" * r.randint(0, 60)}</d>',
                    f'<gift ts="{r.random() * 100:.2f}" user="g" giftname="rose" giftcount="{r.randint(0, 3)}"/>',
                    f'<sc ts="{i}" user="s" price="30">paid\nin lines {i}</sc>',
                    f'<guard ts="{i}" user="k" level="{i % 4}"/>',
                ]
            )
        )
    return r.choice(["\n", "", "\r\n"]).join(rows) + tail


def write(folder, name, text):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def shown(df, *drop):
    return sorted(map(str, df.drop("path", *drop).collect()))


@pytest.mark.parametrize("width", [37, 500, 1 << 26])
def test_log_ranges(spark, monkeypatch, width):
    monkeypatch.setattr(sp, "CHUNK", 64)
    folder = tempfile.mkdtemp(prefix="spark-logs-")
    texts = {"a.xml": log_text(1), "b.xml": log_text(2, tail='<d p="1,1'), "c.xml": log_text(3, tail='<d p="1,1,1">no end'), "d.xml": "", "e.xml": "<i></i>"}
    for name, text in texts.items():
        write(folder, name, text)
    write(folder, "_SUCCESS", "")
    got = sp.read_log_rows(spark, folder, width)
    assert got.rdd.getNumPartitions() >= min(3, sum(map(len, texts.values())) // width)
    want = fm.parse_log_xml(spark.createDataFrame(list(texts.items()), "path string, text string"), "path", "text")
    assert shown(got, "at") == shown(want, "ord")
    numbered = sp.by_time(got, "t", "at").select("path", "ord", "t", "text")
    assert sorted((r.path.rpartition("/")[2], r.ord, r.t, r.text) for r in numbered.collect()) == sorted(tuple(r) for r in want.select("path", "ord", "t", "text").collect())


def test_broken_nodes_do_not_depend_on_ranges(spark):
    folder = tempfile.mkdtemp(prefix="spark-logs-")
    write(folder, "a.xml", '<i><d p="1">open <d p="2,0,0,0,0,0,7">whole</d><gift ts="3" <sc ts="4">paid</sc><d p="5">last</i>')
    rows = [sorted((r.tag, r.record) for r in sp.read_records(spark, "log_nodes", folder, w).collect()) for w in (1, 5, 11, 1000)]
    assert rows[0] == rows[1] == rows[2] == rows[3] == [("d", '<d p="2,0,0,0,0,0,7">whole</d>'), ("sc", '<sc ts="4">paid</sc>')]


def test_filters_are_pushed(spark):
    folder = tempfile.mkdtemp(prefix="spark-logs-")
    for i in range(3):
        write(folder, f"{i}.xml", log_text(i))
    reader = sp._Pushed(sp.LogNodes, {"path": folder})
    paths = sorted(sp.sizes(folder))
    rest = list(reader.pushFilters([sp.EqualTo(("path",), paths[1]), sp.In(("tag",), ("gift", "sc")), sp.EqualTo(("offset",), 3)]))
    assert [f.attribute for f in rest] == [("offset",)] and {p[0] for part in reader.partitions() for p in part.parts} == {paths[1]}
    assert {t for b in reader.read(reader.partitions()[0]) for t in b.column(2).to_pylist()} == {"gift", "sc"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        all_rows = sp.read_records(spark, "log_nodes", folder).collect()
        some = sp.read_records(spark, "log_nodes", folder).where((F.col("tag") == "guard") & (F.col("path") == paths[2])).collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(map(str, some)) == sorted(str(r) for r in all_rows if r.tag == "guard" and r.path == paths[2])


SRT = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\nfirst\r\nrow\r\n\r\n \t\r\n\r\n2\r\n00:00:00,100 --> 00:00:01,000\r\nearlier 甲\r\n\r\nno stamp\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nlast"


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_subtitle_ranges(spark, monkeypatch, width):
    monkeypatch.setattr(sp, "CHUNK", 16)
    folder = tempfile.mkdtemp(prefix="spark-srt-")
    texts = {"a.srt": SRT, "b.srt": SRT.replace("\r\n", "\n") + "\n\n\n", "c.vtt": "WEBVTT\n\n00:01.000 --> 00:02.000\nx\n", "d.srt": "\n\n" + SRT}
    for name, text in texts.items():
        write(folder, name, text)
    want = fm.parse_subtitles(spark.createDataFrame(list(texts.items()), "path string, text string"), "path", "text")
    assert shown(sp.read_subtitle_rows(spark, folder, width), "at") == shown(want, "line_idx")


def test_wide_encodings(spark):
    folder = tempfile.mkdtemp(prefix="spark-logs-")
    write(folder, "a.xml", log_text(4).encode("utf-16"))
    write(folder, "b.xml", log_text(5).encode("gb18030"))
    want = fm.parse_log_xml(spark.createDataFrame([("a", log_text(4)), ("b", log_text(5))], "path string, text string"), "path", "text")
    assert shown(sp.read_log_rows(spark, folder, 200), "at") == shown(want, "ord")


def test_stream_over_a_growing_folder(spark):
    """Files that grow in the middle of nodes, and new ones; every batch takes what is complete."""
    folder, state = tempfile.mkdtemp(prefix="spark-logs-"), tempfile.mkdtemp(prefix="spark-stream-")
    whole = {"a.xml": log_text(6, 60).encode(), "b.xml": log_text(7, 40, tail='<d p="1,1').encode()}
    cuts = [{"a.xml": 700}, {"a.xml": 1501, "b.xml": 333}, {"a.xml": len(whole["a.xml"]), "b.xml": 334}, {"b.xml": len(whole["b.xml"])}]

    def run():
        q = sp.read_log_rows(spark, folder, 256, stream=True).writeStream.format("parquet").option("checkpointLocation", f"{state}/c").trigger(processingTime="0 seconds").start(f"{state}/out")
        q.processAllAvailable()
        q.stop()

    for step in cuts:
        for name, n in step.items():
            write(folder, name, whole[name][:n])
        run()  # each time anew, from its offsets
    want = fm.parse_log_xml(spark.createDataFrame([(k, v.decode()) for k, v in whole.items()], "path string, text string"), "path", "text")
    assert shown(spark.read.parquet(f"{state}/out"), "at") == shown(want, "ord")


def test_stream_of_subtitles_holds_the_last_block(spark):
    folder = tempfile.mkdtemp(prefix="spark-srt-")
    raw = SRT.encode()
    write(folder, "a.srt", raw)
    reader = sp._Stream(sp.SubtitleBlocks, {"path": folder})
    start, end = reader.initialOffset(), reader.latestOffset()
    first = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.column(2).to_pylist()]
    assert len(first) == 3 and not any("last" in r for r in first)
    write(folder, "a.srt", raw + b"\n\n")
    rest = [r for p in reader.partitions(end, reader.latestOffset()) for b in reader.read(p) for r in b.column(2).to_pylist()]
    assert len(rest) == 1 and "last" in rest[0]
