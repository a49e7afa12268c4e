"""Sinks for micro-batches: fan-out, recordings, single files written whole."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.scalars import FILE_HEADER, SCRIPT, adts, audio_body, audio_config, audio_config_tag, tag, video_body, video_config_tag, without_adts
from ..operators.timebase import monotonic, wire_time


class PacketSink(Protocol):
    """What packets go out to: configurations when they change, batches of
    packets, and the end.  bytes_written and progress_ms tell how far it is."""

    bytes_written: int
    progress_ms: int | None

    def codecs(self, video: bytes | None, audio: bytes | None) -> None: ...

    def write(self, batch: DataFrame, batch_id: int) -> None: ...

    def finish(self) -> None: ...


class Retiring:
    """A packet sink that its failure retires: it gets nothing more, and whoever
    feeds it goes on.  Configurations are merged with the last ones of the other
    track, and the end comes once."""

    def __init__(self, sink: PacketSink):
        self.sink, self.video, self.audio, self.retired, self.error = sink, None, None, False, None

    def _try(self, f, *args) -> None:
        if self.retired:
            return
        try:
            f(*args)
        except Exception as e:  # noqa: BLE001 - any failure retires a sink
            self.retired, self.error = True, str(e)

    def codecs(self, video: bytes | None = None, audio: bytes | None = None) -> None:
        if not self.retired:
            self.video, self.audio = video or self.video, audio or self.audio
            self._try(self.sink.codecs, self.video, self.audio)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self._try(self.sink.write, batch, batch_id)

    def finish(self) -> None:
        self._try(self.sink.finish)
        self.retired = True


class Independent:
    """Feeds several sinks, none of them the primary: each is retired by its own
    failure, which never is the feeder's; use it with foreachBatch."""

    def __init__(self, *sinks: PacketSink):
        self.sinks = [Retiring(s) for s in sinks]

    def attach(self, sink: PacketSink, video: bytes | None = None, audio: bytes | None = None) -> None:
        """Adds a sink, which is told the present configurations at once."""
        self.sinks.append(added := Retiring(sink))
        if video or audio:
            added.codecs(video, audio)

    def alive(self) -> int:
        return sum(not s.retired for s in self.sinks)

    def codecs(self, video: bytes | None = None, audio: bytes | None = None) -> None:
        for s in self.sinks:
            s.codecs(video, audio)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for s in self.sinks:
                s.write(batch, batch_id)
        finally:
            batch.unpersist()

    def finish(self) -> None:
        for s in self.sinks:
            s.finish()


class FanOut:
    """Writes every micro-batch to several sinks; use it with foreachBatch.

    The first sink is the primary: its failure is raised after the others were
    written, and it is never retired.  Others are retired at their first failure,
    which `status` keeps.  A batch that comes again is written again to sinks
    that hold their own batch numbers only if they ask for it.
    """

    def __init__(self, primary: Callable, *others: Callable):
        self.sinks = [primary, *others]
        self.status: dict[int, str] = {}

    def alive(self) -> int:
        return len(self.sinks) - len(self.status)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if not self.sinks:
            raise BrokenPipeError("no sink is left")
        batch.persist()
        failed = None
        try:
            for i, sink in enumerate(self.sinks):
                if i in self.status:
                    continue
                try:
                    sink(batch, batch_id)
                except Exception as e:  # noqa: BLE001 - any failure retires a sink
                    if i:
                        self.status[i] = str(e)
                    else:
                        failed = e
        finally:
            batch.unpersist()
        if failed:
            raise failed


def fanout_metrics(sinks: DataFrame) -> DataFrame:
    """(progress_ms, bytes, rtt_ms) of sinks(slot, alive, progress_ms, bytes, rtt_ms):
    the latest progress of the living, the primary's bytes, the first known rtt."""
    live = F.col("alive")
    return sinks.agg(F.max(F.when(live, F.col("progress_ms"))).alias("progress_ms"), F.max(F.when(F.col("slot") == 0, F.col("bytes"))).alias("bytes"), F.min_by("rtt_ms", F.when(live & F.col("rtt_ms").isNotNull(), F.col("slot"))).alias("rtt_ms"))


def parquet_sink(path: str) -> Callable:
    """Writes a batch below its number, so a batch that comes again replaces itself."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_whole(path: str, data: bytes) -> None:
    """A file appears whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temp = f"{path}.{os.getpid()}.tmp"
    with open(temp, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


class Folder:
    """Files by name in a local folder; each appears whole or not at all."""

    def __init__(self, path: str):
        self.path, self.bytes_written = path, 0

    def write(self, name: str, data: bytes) -> None:
        write_whole(os.path.join(self.path, name), data)
        self.bytes_written += len(data)

    def remove(self, name: str) -> None:
        """Removes a file; one that isn't there is none."""
        if os.path.exists(found := os.path.join(self.path, name)):
            os.remove(found)

    def names(self) -> list[str]:
        return sorted(os.listdir(self.path)) if os.path.isdir(self.path) else []


class Memory:
    """The same in memory."""

    def __init__(self):
        self.files, self.bytes_written = {}, 0

    def write(self, name: str, data: bytes) -> None:
        self.files[name] = bytes(data)
        self.bytes_written += len(data)

    def remove(self, name: str) -> None:
        self.files.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self.files)


def store(files: DataFrame, storage: Folder | Memory) -> None:
    """Writes files(name, data) one at a time, playlists last, so that a player
    never reads a list of what isn't there."""
    for r in files.select("name", "data", F.col("name").endswith(".m3u8").alias("last")).orderBy("last", "name").toLocalIterator():
        storage.write(r.name, bytes(r.data))


def recorded_tags(packets: DataFrame, width: int = 0, height: int = 0, framerate: float = 30.0, sample_rate: int = 44_100, tolerance: int = 100) -> DataFrame:
    """(stream_id, ord, bytes): each stream as one container file, cut into its
    header (-4), metadata (-3), video (-2) and audio configuration (-1), and tags
    by seq, on a time base of its own.  Configurations come from the packets
    where they hold them."""
    times = monotonic(packets, tolerance).select("stream_id", "seq", "ndts", "origin")
    p = packets.join(times, ["stream_id", "seq"])
    video = F.col("kind") == "video"
    cts = F.greatest(F.lit(-8388608), F.least(F.col("pts") - F.col("origin") - F.col("ndts"), F.lit(8388607)))
    prefixed = codecs.column(lambda d: codecs.join_prefixed(codecs.split_units(d)), "binary")
    body = F.when(video, video_body(F.col("is_key"), cts, prefixed("data"))).otherwise(audio_body(without_adts(F.col("data"))))
    rows = p.select("stream_id", F.col("seq").alias("ord"), tag(F.when(video, 9).otherwise(8), wire_time(F.col("ndts")), body).alias("bytes"))
    meta = codecs.metadata(width, height, framerate, sample_rate)
    streams = packets.select("stream_id").distinct()
    place = lambda n: F.lit(n).cast("long").alias("ord")
    head = streams.select("stream_id", place(-4), F.lit(FILE_HEADER).alias("bytes"))
    script = streams.select("stream_id", place(-3), tag(F.lit(SCRIPT), F.lit(0), F.lit(meta)))
    own = F.when(video & F.col("is_key"), codecs.config_of_col("data")).when(~video, audio_config(adts(F.col("data"))))
    found = packets.select("stream_id", "seq", video.alias("video"), own.alias("c")).where("c is not null").groupBy("stream_id", "video").agg(F.min_by("c", "seq").alias("c"))
    config = found.select("stream_id", F.when(F.col("video"), -2).otherwise(-1).cast("long"), F.when(F.col("video"), video_config_tag(F.lit(0), F.col("c"))).otherwise(audio_config_tag(F.lit(0), F.col("c"))))
    return head.union(script).union(config).union(rows)


def record(packets: DataFrame, path: str, **config) -> str:
    """Write recorded_tags as a table on any file system, each stream's pieces in
    order; Spark's committer keeps out what lost executors left half written."""
    recorded_tags(packets, **config).repartition("stream_id").sortWithinPartitions("stream_id", "ord").write.mode("overwrite").parquet(path)
    return path


def export_recordings(spark: SparkSession, path: str, folder: str) -> list[str]:
    """One local container file for each stream of a recorded table, piece by piece."""
    os.makedirs(folder, exist_ok=True)
    names, out, temp = [], None, ""
    try:
        for r in spark.read.parquet(path).orderBy("stream_id", "ord").toLocalIterator():
            name = f"{folder}/stream-{r.stream_id}.flv"
            if not names or names[-1] != name:
                if out:
                    out.close()
                    os.replace(temp, names[-1])
                names.append(name)
                temp = f"{name}.tmp"
                out = open(temp, "wb")
            out.write(r.bytes)
    finally:
        if out:
            out.close()
    if names:
        os.replace(temp, names[-1])
    return names
