"""Buffers under a latency profile, reconnecting sessions, acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import header_time
from .fold import ordered_fold, spaced
from .ordering import before, so_far, stream, video_key
from .timebase import clamped


def buffered(df: DataFrame, capacity: int, cut_at: int | None, per_batch: bool = False) -> DataFrame:
    """(stream_id, seq, first, held, dropped) after each push: the ordinal of the
    oldest packet held, how many are held, and drops so far.

    A push first evicts the oldest packet of a full buffer.  A buffer of cut_at
    packets or more is then cut to its newest video key, if it holds one: after
    every push, or (per_batch) after a batch's last.  What is held is always the
    newest packets, so the state is three numbers.
    """

    def step(s, row):
        i, first, key, dropped = s
        i += 1
        if i - first >= capacity:
            first, dropped = min(first + 1, i), dropped + 1
        if row.kind == "video" and row.is_key:
            key = i
        if cut_at is not None and (row.last or not per_batch) and i - first + 1 >= cut_at and key >= first:
            first, dropped = key, dropped + key - first
        return (i, first, key, dropped), [(row.stream_id, row.seq, first, i - first + 1, dropped)]

    last = F.lit(True)
    if per_batch:
        last = F.coalesce(F.lead("batch_id").over(stream()) != F.col("batch_id"), F.lit(True))
    return ordered_fold(df.withColumn("last", last).select("stream_id", "seq", "kind", "is_key", "last"), ["stream_id"], ["seq"], lambda: (0, 1, 0, 0), step, "stream_id long, seq long, first long, held long, dropped long")


def backoff(attempt: Column, initial_ms: int = 250, factor: float = 2.0, most_ms: int = 8000) -> Column:
    """The delay before an attempt, without jitter."""
    return F.least(F.lit(float(most_ms)), initial_ms * F.pow(F.lit(max(factor, 1.0)), attempt - 1))


def sessions(df: DataFrame, initial_ms: int = 250, factor: float = 2.0, most_ms: int = 8000, attempts: int | None = 12, stall_ms: int = 10_000, jitter=None) -> DataFrame:
    """(stream_id, seq, state, attempt, reconnects) after each tick of
    df(stream_id, seq, now_ms, write_ok, dial_ok, progress_ms, command).

    A session begins connected.  A failed write or a stall starts an immediate
    dial; a failed dial waits for its backoff; after `attempts` failures the
    session is exhausted until a `retry`; `finish` ends it.  jitter: a function
    of (attempt, delay) that gives the delay.
    """

    def step(s, row):
        state, attempt, due, reconnects = s
        if state != "Finished":
            if row.command == "finish":
                state = "Finished"
            elif row.command == "retry" and state == "Exhausted":
                state, attempt, due = "Reconnecting", 0, None
        stall = row.progress_ms == row.progress_ms and row.progress_ms is not None and row.now_ms - row.progress_ms >= stall_ms
        if state == "Connected" and (stall or not row.write_ok):
            state, attempt, due = "Reconnecting", 0, None
        if state == "Reconnecting" and (due is None or row.now_ms >= due):
            if row.dial_ok:
                state, attempt, due, reconnects = "Connected", 0, None, reconnects + 1
            else:
                attempt += 1
                if attempts is not None and attempt >= attempts:
                    state = "Exhausted"
                else:
                    wait = min(float(most_ms), initial_ms * max(factor, 1.0) ** (attempt - 1))
                    due = row.now_ms + (jitter(attempt, wait) if jitter else wait)
        return (state, attempt, due, reconnects), [(row.stream_id, row.seq, state, attempt, reconnects)]

    return ordered_fold(df.select("stream_id", "seq", "now_ms", "write_ok", "dial_ok", "progress_ms", "command"), ["stream_id"], ["seq"], lambda: ("Connected", 0, None, 0), step, "stream_id long, seq long, state string, attempt int, reconnects int")


def acknowledged(df: DataFrame, window: int) -> DataFrame:
    """(stream_id, seq, received): where the bytes received reach the last acknowledgement plus the window."""
    got = df.select("stream_id", "seq", F.sum("size").over(so_far()).alias("received"))
    return spaced(got, ["stream_id"], ["seq"], "received", window, False, start=0)


def reconnect_gate(df: DataFrame) -> DataFrame:
    """df(stream_id, seq, kind, is_key, connection, ...) without inter frames that a
    new connection can't decode: if the stream had a video key before, and the
    connection doesn't begin with one, its inter frames wait for its first key.
    Audio passes, and so does everything of the first connection."""
    own = Window.partitionBy("stream_id", "connection").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.coalesce(F.max(video_key()).over(own), F.lit(False))
    # a key before the connection's first row
    begin = F.min("seq").over(Window.partitionBy("stream_id", "connection"))
    first_key = F.min(F.when(video_key(), F.col("seq"))).over(Window.partitionBy("stream_id"))
    armed = F.coalesce(first_key < begin, F.lit(False))
    kept = df.withColumn("opened", opened).withColumn("armed", armed)
    return kept.where((F.col("connection") == 1) | ~F.col("armed") | (F.col("kind") != "video") | F.col("opened")).drop("opened", "armed")


def reattached(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets, headers) of df(stream_id, seq, kind, is_key, dts, connection).

    packets: what goes out, gated by reconnect_gate(), with ndts on the one time
    base that outlives its connections.  headers: (stream_id, connection,
    header_ts, video) for each connection, at the last time that went out before
    it; video: whether a video configuration is known by then and is sent again.
    """
    sent = clamped(reconnect_gate(df).withColumn("pts", F.col("dts")))
    each = sent.groupBy("stream_id", "connection").agg(F.max("ndts").alias("last"), F.max(video_key()).alias("keyed"))
    w = Window.partitionBy("stream_id").orderBy("connection").rowsBetween(Window.unboundedPreceding, -1)
    headers = each.select("stream_id", "connection", header_time(F.max("last").over(w)).alias("header_ts"), F.coalesce(F.max("keyed").over(w), F.lit(False)).alias("video"))
    return sent.select("stream_id", "seq", "connection", "ndts"), headers


def finished(df: DataFrame, is_end: Column) -> DataFrame:
    """(stream_id, muxed, ignored, bytes, finished): what is drained before the
    first row that ends a stream, and how many rows come with it or later and
    are ignored."""
    ended = F.coalesce(F.max(is_end).over(so_far()), F.lit(False))
    return df.withColumn("ended", ended).groupBy("stream_id").agg(F.count_if(~F.col("ended")).alias("muxed"), F.count_if("ended").alias("ignored"), F.sum(F.when(~F.col("ended"), F.col("size")).otherwise(0)).alias("bytes"), F.max("ended").alias("finished"))


def muxed(df: DataFrame, tolerance: int = 100) -> DataFrame:
    """(stream_id, seq, ndts, error) of df(stream_id, seq, kind, is_key, dts,
    configured): what a muxer says to each packet that comes without rebasing.

    configured: whether the packet holds its track's configuration.  A video key
    or an audio packet before one is a "config" error; a step back of more than
    `tolerance` an "ordering" error, and ndts is null; a smaller one repeats the
    last time.  Packets in error leave the time base as it is.
    """
    needs = (F.col("kind") != "video") | F.col("is_key")
    own = Window.partitionBy("stream_id", "kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # a key's or an audio packet's own configuration is written before it
    known = F.coalesce(F.max(needs & F.col("configured")).over(own), F.lit(False))
    rows = df.withColumn("unknown", needs & ~known)
    origin = F.first(F.when(~F.col("unknown"), F.col("dts")), ignorenulls=True).over(so_far())
    rows = rows.withColumn("nd", F.when(~F.col("unknown"), F.col("dts") - origin))
    last = F.greatest(F.coalesce(F.max("nd").over(before()), F.lit(0)), F.lit(0))
    rows = rows.withColumn("last", last)
    error = F.when(F.col("unknown"), "config").when(F.col("last") - F.col("nd") > tolerance, "ordering")
    return rows.withColumn("error", error).select("stream_id", "seq", F.when(F.col("error").isNull(), F.greatest("nd", "last")).alias("ndts"), "error")
