"""Deterministic stand-ins for recordings: time-coded lines, a live log, activity and features, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a recording, a turn a line; a character lasts 40 ms and lines are 200 ms apart."""
    took = F.lit(40) * F.length("text") + 200
    end = F.sum(took).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    t = table(spark, sf_dir, "conversations").withColumn("e", end)
    return t.select(
        F.col("conv_id").alias("rec_id"), F.col("turn").alias("line_idx"), F.col("role").alias("speaker"), "text",
        (F.col("e") - 40 * F.length("text") - 200).cast("long").alias("start_ms"), (F.col("e") - 200).cast("long").alias("end_ms"),
    )


def hyp_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perturbed copy: lines missing, shifted, altered, some far away and reversed."""
    r, i = F.col("rec_id"), F.col("line_idx")
    far = F.when((r * 11 + i * 19) % 13 == 0, 600000).otherwise(0)
    t = ref_line(spark, sf_dir).where((r * 31 + i * 17) % 9 != 0).withColumn("far_ms", far)
    cutout = F.concat(F.substring("text", 1, 5), F.expr("substr(text, 7)"))
    text = F.when((F.col("far_ms") > 0) & (i % 2 == 0), F.reverse("text")).when((r * 5 + i * 3) % 4 == 0, cutout).otherwise(F.col("text"))
    return t.select(
        "rec_id", "line_idx", "speaker",
        (F.greatest(F.lit(0).cast("long"), F.col("start_ms") + ((r * 7 + i * 13) % 5 - 2) * 150) + F.col("far_ms")).cast("long").alias("start_ms"),
        (F.col("end_ms") + ((r * 3 + i * 11) % 7 - 3) * 120 + F.col("far_ms")).cast("long").alias("end_ms"),
        text.alias("text"),
    )


def live_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "gift").when(F.col("event_type") == "signup", "guard").when(F.col("event_type") == "error", "sc").otherwise("chat")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rec_id"), F.col("event_id").alias("ord"), F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div 1000").alias("t_ms"),
        kind.alias("kind"), F.concat(F.lit("k"), F.regexp_extract("props", "[0-9]+", 0)).alias("term"), F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def live_log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_log(spark, sf_dir).withColumn("t_ms", F.expr("t_ms div 50000"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute bins of the log: the frames of an activity signal."""
    return live_log(spark, sf_dir).groupBy(F.expr("t_ms div 600000").alias("frame_idx")).agg(F.sum("cents").cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.abs(F.col("embedding")[i].cast("double")) for i in range(6)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("win"), F.expr("vec_id div 5").alias("seg"), e[0].alias("bass_ratio"), e[1].alias("high_ratio"), e[2].alias("flatness"),
        F.when(F.col("vec_id") % 4 != 0, e[3]).alias("side_ratio"), (4 * e[4]).alias("loud_cv"), (3 * e[5]).alias("vocal_sim"),
    )


#: The same views as common table expressions for the oracle.
CTE = {
    "ref_line": """ref_line as (select conv_id as rec_id, turn as line_idx, role as speaker, text, cast(e - 40*length(text) - 200 as bigint) as start_ms, cast(e - 200 as bigint) as end_ms
 from (select *, sum(40*length(text)+200) over (partition by conv_id order by turn rows between unbounded preceding and current row) as e from conversations) t)""",
    "hyp_line": """hyp_line as (select rec_id, line_idx, speaker,
 cast(greatest(cast(0 as bigint), start_ms + ((rec_id*7 + line_idx*13) % 5 - 2) * 150) + far_ms as bigint) as start_ms,
 cast(end_ms + ((rec_id*3 + line_idx*11) % 7 - 3) * 120 + far_ms as bigint) as end_ms,
 case when far_ms > 0 and line_idx % 2 = 0 then reverse(text) when (rec_id*5 + line_idx*3) % 4 = 0 then concat(substr(text,1,5), substr(text,7)) else text end as text
 from (select *, case when (rec_id*11 + line_idx*19) % 13 = 0 then 600000 else 0 end as far_ms from ref_line) t where (rec_id*31 + line_idx*17) % 9 <> 0)""",
    "live_log": """live_log as (select user_id as rec_id, event_id as ord, (epoch_us(ts) - 1704067200000000) // 1000 as t_ms,
 case event_type when 'purchase' then 'gift' when 'signup' then 'guard' when 'error' then 'sc' else 'chat' end as kind,
 concat('k', regexp_extract(props, '[0-9]+', 0)) as term, cast(round(value*100) as bigint) as cents from events)""",
    "live_log_compact": "live_log_compact as (select rec_id, ord, t_ms // 50000 as t_ms, kind, term, cents from live_log)",
    "activity": "activity as (select t_ms // 600000 as frame_idx, cast(sum(cents) as bigint) as level, count(*) as n from live_log group by t_ms // 600000)",
    "feature": """feature as (select vec_id as win, vec_id // 5 as seg, abs(cast(embedding[1] as double)) as bass_ratio, abs(cast(embedding[2] as double)) as high_ratio, abs(cast(embedding[3] as double)) as flatness,
 case when vec_id % 4 = 0 then null else abs(cast(embedding[4] as double)) end as side_ratio, 4*abs(cast(embedding[5] as double)) as loud_cv, abs(cast(embedding[6] as double))*3 as vocal_sim from embeddings)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``with`` clause of the named views and those they need."""
    need = {"hyp_line": ["ref_line"], "live_log_compact": ["live_log"], "activity": ["live_log"]}
    order: list[str] = []
    for n in names:
        order += [x for x in [*need.get(n, []), n] if x not in order]
    return ("with recursive " if recursive else "with ") + ",\n".join(CTE[n] for n in order)
