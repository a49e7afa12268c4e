"""The packet table: one row for each packet, in arrival order per stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET = T.StructType([T.StructField(n, t) for n, t in (("stream_id", T.LongType()), ("seq", T.LongType()), ("kind", T.StringType()), ("pts", T.LongType()), ("dts", T.LongType()), ("is_key", T.BooleanType()), ("data", T.BinaryType()))])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as packets: users are streams, every four rows of a
    stream arrive in reverse, purchases are key frames, and ten rows a batch."""
    ms = F.expr("unix_millis(to_timestamp(concat(cast(ts as string), '+00:00')))")
    e = events(spark, sf_dir).withColumn("rn", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    seq = F.col("rn") - F.col("rn") % 4 + (3 - F.col("rn") % 4)
    p = e.select(
        F.col("user_id").alias("stream_id"),
        seq.alias("seq"),
        ms.alias("dts"),
        F.when(F.col("event_type").isin("signup", "error"), "audio").otherwise("video").alias("kind"),
        (F.col("event_type") == "purchase").alias("is_key"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        "props",
        "event_id",
        "event_type",
    )
    return p.withColumn("pts", F.col("dts") + (F.col("event_id") % 5 - 2) * 40).withColumn("batch_id", F.expr("seq div 10"))


#: The same in DuckDB, as common table expressions; o has the arrival ordinal i.
PACKETS_SQL = """
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events),
q AS (SELECT user_id AS stream_id, CAST(rn - rn % 4 + (3 - rn % 4) AS BIGINT) AS seq, epoch_us(ts) // 1000 AS dts,
  CASE WHEN event_type IN ('signup', 'error') THEN 'audio' ELSE 'video' END AS kind, event_type = 'purchase' AS is_key,
  CAST(round(value * 100) AS BIGINT) AS size, props, event_id, event_type, epoch_us(ts) // 1000 + (event_id % 5 - 2) * 40 AS pts,
  CAST(rn - rn % 4 + (3 - rn % 4) AS BIGINT) // 10 AS batch_id FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS i FROM q)"""
