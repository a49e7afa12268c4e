"""Health samples of streams and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import spaced
from .ordering import so_far, stream, drop_ratio

INTERVAL_MS, RING, IDLE_MS, ERROR_CHARS = 1000, 4096, 30_000, 512


def sampled(df: DataFrame, interval_ms: int = INTERVAL_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """(stream_id, seq, now_ms, rate_bps, pushed): a sample at the first tick
    that is interval_ms after the last one (or the start).  The rate is that of
    the bytes since then, 0 after an idle gap.  df: stream_id, seq, now_ms, size."""
    run = df.withColumn("bytes", F.sum("size").over(so_far())).withColumn("pushed", F.count("*").over(so_far()))
    rows = spaced(run, ["stream_id"], ["seq"], "now_ms", interval_ms, True, ("bytes", "pushed"))
    gap = F.col("now_ms") - F.lag("now_ms").over(stream())
    bits = 8 * (F.col("bytes") - F.lag("bytes").over(stream()))
    rate = F.when((gap <= idle_ms) & (gap > 0), bits * 1000.0 / gap).otherwise(0.0)
    first = F.row_number().over(stream())
    return rows.withColumn("rate_bps", rate).withColumn("n", first).where("n > 1").select("stream_id", "seq", "now_ms", "rate_bps", "pushed")


def ring(samples: DataFrame, capacity: int = RING) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("seq")))
    return samples.withColumn("n", n).where(F.col("n") <= max(capacity, 1)).drop("n")


def summary(samples: DataFrame) -> DataFrame:
    """One row for each stream over its samples(stream_id, seq, now_ms, rate_bps,
    lag_ms, rtt_ms, pushed, dropped).  Means of what is there; peaks are 0 at
    least; counters and the drop ratio are the last sample's; no rtt, null."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    out = samples.groupBy("stream_id").agg(
        F.count("*").alias("samples"),
        F.when(F.count("*") >= 2, (F.max_by("now_ms", "seq") - F.min_by("now_ms", "seq")) / 1000.0).otherwise(0.0).alias("span_secs"),
        F.avg("rate_bps").alias("avg_rate_bps"),
        F.greatest(F.max("rate_bps"), F.lit(0.0)).alias("peak_rate_bps"),
        F.avg("lag_ms").alias("avg_lag_ms"),
        F.greatest(F.max("lag_ms"), F.lit(0)).alias("max_lag_ms"),
        F.avg("rtt_ms").alias("avg_rtt_ms"),
        F.when(F.count("rtt_ms") > 0, F.greatest(F.max("rtt_ms"), F.lit(0.0))).alias("max_rtt_ms"),
        last("pushed"),
        last("dropped"),
    )
    return out.withColumn("drop_ratio", drop_ratio(F.col("dropped"), F.col("pushed")))


def event_counters(events: DataFrame) -> DataFrame:
    """(stream_id, reconnects, reconnect_attempts, last_error) of events(stream_id, seq, event, error)."""
    tells = F.col("event").isin("Disconnected", "GaveUp", "ReconnectAttempt") & F.col("error").isNotNull()
    return events.groupBy("stream_id").agg(
        F.count_if(F.col("event") == "Reconnected").alias("reconnects"),
        F.count_if(F.col("event") == "ReconnectAttempt").alias("reconnect_attempts"),
        F.substring(F.max_by("error", F.when(tells, F.col("seq"))), 1, ERROR_CHARS).alias("last_error"),
    )
