"""Gates, sorting and bounded buffers, all as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def stream() -> WindowSpec:
    return Window.partitionBy("stream_id").orderBy("seq")


def so_far() -> WindowSpec:
    return stream().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return stream().rowsBetween(Window.unboundedPreceding, -1)


def whole() -> WindowSpec:
    return Window.partitionBy("stream_id")


#: Packets a buffer holds, and the length at which it is cut, by latency profile.
BUDGET = {"ultra_low": 30, "balanced": 120, "quality": 480}
CUT_AT = {"ultra_low": 15, "balanced": 120, "quality": None}


def by_profile(values: dict, profile: Column) -> Column:
    """The value of a latency profile's name; null for other names."""
    out = F.lit(None).cast("int")
    for name, value in values.items():
        out = F.when(profile == name, F.lit(value).cast("int")).otherwise(out)
    return out


def video_key() -> Column:
    return (F.col("kind") == "video") & F.col("is_key")


def key_gate(df: DataFrame) -> DataFrame:
    """Drops inter frames before the first video key; audio passes."""
    opened = F.coalesce(F.max(video_key()).over(so_far()), F.lit(False))
    return df.withColumn("opened", opened).where((F.col("kind") != "video") | F.col("opened")).drop("opened")


def start_gate(df: DataFrame) -> DataFrame:
    """Starts a stream at its first video key; audio waits if video came before
    it, and otherwise starts the stream itself, after which all video passes."""
    seen = F.coalesce(F.max(F.col("kind") == "video").over(before()), F.lit(False))
    starts = video_key() | ((F.col("kind") == "audio") & ~seen)
    return df.withColumn("started", F.coalesce(F.max(starts).over(so_far()), F.lit(False))).where("started").drop("started")


def before_end(df: DataFrame, is_end: Column) -> DataFrame:
    """The rows of each stream before the first one that ends it."""
    return df.withColumn("ended", F.coalesce(F.max(is_end).over(so_far()), F.lit(False))).where("not ended").drop("ended")


def stalled(now: Column, last_progress: Column, timeout: int) -> Column:
    """Whether a transport made no progress for `timeout`; one that reports none never stalls."""
    return F.coalesce(now - last_progress >= timeout, F.lit(False))


def sort_batches(df: DataFrame) -> DataFrame:
    """Adds ord, the place in its batch by dts; equal times keep the order of arrival."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy("stream_id", "batch_id").orderBy("dts", "seq")))


def newest(df: DataFrame, capacity: int) -> DataFrame:
    """What a buffer that evicts its oldest packet holds in the end; at least one packet."""
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("seq")))
    return df.withColumn("age", n).where(F.col("age") <= max(capacity, 1)).drop("age")


def buffer_counters(df: DataFrame, capacity: int) -> DataFrame:
    """(stream_id, pushed, dropped, drop_ratio); without room every push counts a drop."""
    n = F.count("*")
    return df.groupBy("stream_id").agg(n.alias("pushed"), F.greatest(n - capacity, F.lit(0)).alias("dropped")).withColumn("drop_ratio", drop_ratio(F.col("dropped"), F.col("pushed")))


def drop_ratio(dropped: Column, pushed: Column) -> Column:
    return F.when(pushed == 0, F.lit(0.0)).otherwise(dropped / pushed)


def from_latest_key(df: DataFrame) -> DataFrame:
    """What is left when a buffer is cut to its newest video key; without one, everything."""
    last = F.max(F.when(video_key(), F.col("seq"))).over(whole())
    return df.withColumn("cut", last).where(F.col("cut").isNull() | (F.col("seq") >= F.col("cut"))).drop("cut")


def take(df: DataFrame, n: int, freshest: bool = False) -> DataFrame:
    """The n oldest (or freshest) packets of each stream."""
    w = Window.partitionBy("stream_id").orderBy(F.desc("seq") if freshest else F.asc("seq"))
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def ends(df: DataFrame) -> DataFrame:
    """(stream_id, front, back): dts of the oldest and the newest packet."""
    return df.groupBy("stream_id").agg(F.min_by("dts", "seq").alias("front"), F.max_by("dts", "seq").alias("back"))


def sent_prefix(df: DataFrame, failed: Column) -> DataFrame:
    """Adds ord and sent: whether a batch's packet went out before the first that failed."""
    b = sort_batches(df).withColumn("bad", F.when(failed, F.col("ord")))
    first = F.min("bad").over(Window.partitionBy("stream_id", "batch_id"))
    return b.withColumn("sent", F.coalesce(F.col("ord") < first, F.lit(True))).drop("bad")


def restore_front(unsent: DataFrame, fresh: DataFrame) -> DataFrame:
    """Unsent packets go before the fresh ones of their stream, in their order."""
    return unsent.withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1))).withColumn("place", F.row_number().over(Window.partitionBy("stream_id").orderBy("part", "seq"))).drop("part")


def first_match(df: DataFrame, match: Column, most: int) -> DataFrame:
    """(stream_id, seq): the first row that matches among the first `most`; null if none does."""
    n = F.row_number().over(stream())
    return df.withColumn("n", n).where(F.col("n") <= most).groupBy("stream_id").agg(F.min(F.when(match, F.col("seq"))).alias("seq"))


def interleave(video: DataFrame, audio: DataFrame) -> DataFrame:
    """Two tracks as one stream in order of time, ties in order of arrival."""
    return video.unionByName(audio).withColumn("ord", F.row_number().over(Window.partitionBy("stream_id").orderBy("dts", "seq")))


def carry_last(df: DataFrame, col: str, out: str) -> DataFrame:
    """The last value of a column that wasn't null, up to each row."""
    return df.withColumn(out, F.last(col, ignorenulls=True).over(so_far()))
