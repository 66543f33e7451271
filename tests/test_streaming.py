"""Streams of files give what the batch operators give."""

import os
import tempfile

from pyspark.sql import functions as F

from chronotext.operators import sweeps as sw
from chronotext.streaming import density as st


def test_thin_and_density(spark):
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    rows = [(k, t) for k in (1, 2) for t in range(10_000, 14_000, 300)]
    for part in (0, 1):
        half = [r for r in rows if (r[1] >= 11_800) == bool(part)]
        spark.createDataFrame(half, "k long, t_ms long").withColumn("ts", F.timestamp_millis("t_ms")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = "k long, t_ms long, ts timestamp"
    q = st.thin(st.read_log(spark, f"{folder}/in", schema, 2), "k", "t_ms", 500).writeStream.format("memory").queryName("thinned").option("checkpointLocation", os.path.join(folder, "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = sw.thin(spark.createDataFrame(rows, "k long, t_ms long"), ["k"], "t_ms", 500)
    assert sorted(map(tuple, spark.table("thinned").collect())) == sorted(map(tuple, batch.select("k", "t_ms").collect()))
    q = st.density(st.read_log(spark, f"{folder}/in", schema, 2), "ts", "1 second", "0 seconds", "k").writeStream.format("memory").queryName("dense").outputMode("complete").option("checkpointLocation", os.path.join(folder, "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dense").agg(F.sum("n")).first()[0] == len(rows)
