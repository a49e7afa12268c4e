"""Times relative to a stream's first packet, made monotonic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold
from .ordering import so_far, stream

TOLERANCE_MS = 100
U32 = 4_294_967_295


def normalized(df: DataFrame) -> DataFrame:
    """Adds ndts and npts, counted from the stream's first dts."""
    first = F.first("dts").over(stream())
    return df.withColumn("ndts", F.col("dts") - first).withColumn("npts", F.col("pts") - first)


def clamped(df: DataFrame) -> DataFrame:
    """ndts as a running maximum: every backward step is a small one."""
    return normalized(df).withColumn("ndts", F.max("ndts").over(so_far()))


def wire_time(ts: Column) -> Column:
    return F.greatest(F.lit(0), F.least(ts, F.lit(U32)))


def composition(cts: Column) -> Column:
    """A composition offset as a signed 24-bit number."""
    return F.greatest(F.lit(-8388608), F.least(cts, F.lit(8388607)))


def monotonic(df: DataFrame, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """(stream_id, seq, ndts, origin, rebased): a step back within the tolerance
    repeats the last time; a longer one moves the origin so that time goes on
    from there.  Nothing is dropped."""

    def step(state, row):
        origin, last = state or (row.dts, None)
        ts, rebased = row.dts - origin, False
        if last is not None and ts < last:
            if rebased := last - ts > tolerance:
                origin = row.dts - max(last, 0)
            ts = max(last, 0) if rebased else last
        return (origin, ts), [(row.stream_id, row.seq, ts, origin, rebased)]

    return ordered_fold(df.select("stream_id", "seq", "dts"), ["stream_id"], ["seq"], lambda: None, step, "stream_id long, seq long, ndts long, origin long, rebased boolean")


VIDEO_RATE = 90_000


def ticks(ms: Column, rate: Column | int) -> Column:
    """Milliseconds as ticks of a track's clock, none before zero."""
    return F.floor(F.greatest(ms, F.lit(0)) * rate / 1000).cast("long") if not isinstance(rate, int) or 1000 * (rate // 1000) != rate else F.greatest(ms, F.lit(0)) * (rate // 1000)
