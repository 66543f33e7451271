"""Folders that driver and executors share, for files and tables between two jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, a temporary one on a single machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return f"file://{_own[0]}"


def fresh(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """A frame as a table in the shared folder, read back: its lineage ends there."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Adds each row's place from 1 in the whole order: ranges are sorted by themselves, and the driver sees their sizes alone."""
    spark = rows.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = written(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part, low, starts = F.shiftright("__at", 33), 1, []
    for r in t.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r.part, low))
        low += r["count"]
    start = spark.createDataFrame(starts, "__part long, __low long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return t.join(F.broadcast(start), part == F.col("__part")).withColumn(name, F.col("__low") + inside).drop("__at", "__part", "__low")
