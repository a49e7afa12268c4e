"""Key-aligned segments of streams, their durations and playlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import AUDIO_TRACK, VIDEO_TRACK, box
from ..functions.scalars import be
from .fold import ordered_fold
from .timebase import TOLERANCE_MS

TARGET_MS, WINDOW = 4000, 6
LAST_FRAME_MS, AUDIO_FRAME = 33, 1024
TRACKS = {"video": VIDEO_TRACK, "audio": AUDIO_TRACK}


def cut(df: DataFrame, target_ms: int = TARGET_MS, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """(stream_id, seq, kind, is_key, cts, ndts, segment_no) of the packets that
    enter segments.

    A stream starts like start_gate says.  A video key closes the open segment
    if its packets so far span the target, which leaves the key's own time out;
    without video every audio packet may.  The first segment's end fixes the
    tracks: a track that no packet was seen of by then is dropped for good.
    Times are made monotonic on the way.
    """

    def step(s, row):
        seen, tracks, started, origin, last, number, start = s
        video = row.kind == "video"
        seen |= 1 if video else 2
        saw = bool(seen & 1)
        if tracks and not tracks & (1 if video else 2):
            return (seen, tracks, started, origin, last, number, start), []
        if not started:
            if (video and not row.is_key) or (not video and saw):
                return (seen, tracks, False, origin, last, number, start), []
            started = True
        origin = row.dts if origin is None else origin
        before, ts = last, row.dts - origin
        if last is not None and ts < last:
            if last - ts > tolerance:
                origin = row.dts - max(last, 0)
                ts = max(last, 0)
            else:
                ts = last
        if start is not None and before - start >= target_ms and (row.is_key if video else not saw):
            number, start, tracks = number + 1, None, tracks or seen
        start = ts if start is None else start
        return (seen, tracks, started, origin, ts, number, start), [(row.stream_id, row.seq, row.kind, row.is_key, row.pts - row.dts, ts, number)]

    return ordered_fold(df.select("stream_id", "seq", "kind", "is_key", "pts", "dts"), ["stream_id"], ["seq"], lambda: (0, 0, False, None, None, 0, None), step, "stream_id long, seq long, kind string, is_key boolean, cts long, ndts long, segment_no long")


def samples(segmented: DataFrame, audio_rate: int = 44_100) -> DataFrame:
    """Adds each sample's duration_ms and, in its track's ticks, duration and offset."""
    track = Window.partitionBy("stream_id", "segment_no", "kind").orderBy("seq")
    video = F.col("kind") == "video"
    gap = F.lead("ndts").over(track) - F.col("ndts")
    nxt = F.when(gap.isNull(), F.lit(LAST_FRAME_MS)).otherwise(F.greatest(gap, F.lit(0)))
    return segmented.withColumn("duration_ms", F.when(video, nxt).otherwise(F.lit(AUDIO_FRAME * 1000 // audio_rate)).cast("long")).withColumn("duration", F.when(video, F.least(F.col("duration_ms") * 90, F.lit(4_294_967_295))).otherwise(F.lit(AUDIO_FRAME)).cast("long")).withColumn("offset", F.when(video, F.col("cts") * 90).otherwise(F.lit(0)).cast("int"))


def _spans(each: DataFrame) -> DataFrame:
    """Rows of segments with duration_ms and longest_ms for their end_ms."""
    each = each.withColumn("duration_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).drop("end_ms")
    return each.withColumn("longest_ms", F.max("duration_ms").over(Window.partitionBy("stream_id").orderBy("segment_no").rowsBetween(Window.unboundedPreceding, 0)))


def summary(sampled: DataFrame) -> DataFrame:
    """(stream_id, segment_no, n, start_ms, duration_ms, longest_ms): longest_ms of all segments so far."""
    return _spans(sampled.groupBy("stream_id", "segment_no").agg(F.count("*").alias("n"), F.min_by("ndts", "seq").alias("start_ms"), F.max(F.col("ndts") + F.col("duration_ms")).alias("end_ms")))


def _tracks(sampled: DataFrame) -> DataFrame:
    """(stream_id, kind, segment_no, n, seq, ms, end_ms, base): each track's part of a segment."""
    each = sampled.groupBy("stream_id", "kind", "segment_no").agg(F.count("*").alias("n"), F.min("seq").alias("seq"), F.sum("duration").alias("span"), F.min_by("ndts", "seq").alias("ms"), F.max(F.col("ndts") + F.col("duration_ms")).alias("end_ms"))
    each = each.withColumn("own", F.when(F.col("kind") == "video", F.greatest("ms", F.lit(0)) * 90).otherwise(F.expr("greatest(ms, 0) * 44100 div 1000")))
    w = Window.partitionBy("stream_id", "kind").orderBy("segment_no")
    each = each.withColumn("s", F.coalesce(F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return each.withColumn("base", F.col("s") + F.max(F.col("own") - F.col("s")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("span", "own", "s")


def decode_grid(sampled: DataFrame) -> DataFrame:
    """(stream_id, kind, segment_no, base): base = max(base + span of the segment
    before, first sample's ticks), in closed form by a prefix sum."""
    return _tracks(sampled).select("stream_id", "kind", "segment_no", "base")


def playlists(segs: DataFrame, target_secs: int, window: int = WINDOW, prefix: str = "seg", finished: bool = True, history: bool = False) -> DataFrame:
    """(stream_id, segment_no, playlist): the text after the last segment, or after each one."""
    return _listed(segs, target_secs, window, prefix, finished, history).select("stream_id", "segment_no", "playlist")


def _listed(segs: DataFrame, target_secs: int, window: int, prefix: str, finished: bool, history: bool) -> DataFrame:
    """segs with their rank from the last one on and the playlist after them."""
    w = Window.partitionBy("stream_id").orderBy("segment_no").rowsBetween(-(max(window, 1) - 1), 0)
    line = F.format_string("#EXTINF:%d.%03d,\n%s%d.m4s\n", F.expr("duration_ms div 1000"), F.col("duration_ms") % 1000, F.lit(prefix), F.col("segment_no"))
    longest = F.greatest(F.lit(target_secs), F.expr("(longest_ms + 999) div 1000"), F.lit(1))
    listed = segs.withColumn("line", line).withColumn("lines", F.collect_list("line").over(w)).withColumn("rank", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("segment_no"))))
    listed = listed if history else listed.where("rank = 1")
    end = F.when(F.lit(finished) & (F.col("rank") == 1), "#EXT-X-ENDLIST\n").otherwise("")
    head = F.format_string('#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:%d\n#EXT-X-MEDIA-SEQUENCE:%d\n#EXT-X-INDEPENDENT-SEGMENTS\n#EXT-X-MAP:URI="init.mp4"\n', longest, F.col("segment_no") + 1 - F.size("lines"))
    return listed.withColumn("playlist", F.concat(head, F.array_join("lines", ""), end))


def retired(segs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(stream_id, segment_no) of the segments that fell out of the window."""
    last = F.max("segment_no").over(Window.partitionBy("stream_id"))
    return segs.withColumn("last", last).where(F.col("segment_no") <= F.col("last") - max(window, 1)).select("stream_id", "segment_no")


def _bases() -> list[Column]:
    return [F.max(F.when(F.col("kind") == k, F.col("base"))).alias(f"{k}_base") for k in TRACKS]


def segment_bytes(sampled: DataFrame, grid: DataFrame) -> DataFrame:
    """(stream_id, segment_no, data): each segment's bytes, as codecs.media_segment()
    gives them, of samples(...) with their payloads in `data` (null: empty), and
    decode_grid()'s base times.  A group holds one segment, whose length the target bounds."""
    return _bytes(sampled, grid.groupBy("stream_id", "segment_no").agg(*_bases())).select("stream_id", "segment_no", "data")


def _bytes(sampled: DataFrame, bases: DataFrame) -> DataFrame:
    """The rows of bases(stream_id, segment_no, video_base, audio_base, ...) with their segment's bytes in `data`."""
    second = (F.col("kind") == "video") & ~F.coalesce("is_key", F.lit(False))
    flags = F.when(second, F.lit(0x01010000)).otherwise(F.lit(0x02000000)).cast("long")
    rows = sampled.withColumn("data", F.coalesce("data", F.lit(b""))).withColumn("n", F.octet_length("data").cast("long"))
    row = F.concat(be(F.shiftleft("duration", 32).bitwiseOR(F.col("n")), 8), be(F.shiftleft(flags, 32).bitwiseOR(F.col("offset").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8))
    rows, of = rows.select("stream_id", "segment_no", "kind", "seq", "n", "data", row.alias("row")), []
    for k in TRACKS:
        own = F.col("kind") == k
        of += [F.count_if(own).alias(f"{k}_rows"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(f"{k}_bytes")]
        of += [F.expr(f"coalesce(listagg(CASE WHEN kind = '{k}' THEN {c} END) WITHIN GROUP (ORDER BY seq), X'')").alias(f"{k}_{c}") for c in ("row", "data")]
    each = rows.groupBy("stream_id", "segment_no").agg(*of).join(bases, ["stream_id", "segment_no"])
    boxes = [F.when(F.col(f"{k}_rows") > 0, 64 + 16 * F.col(f"{k}_rows")).otherwise(0) for k in TRACKS]
    moof, place, parts = F.lit(24) + boxes[0] + boxes[1], F.lit(8), []
    for k, number in TRACKS.items():
        count = F.col(f"{k}_rows")
        head = F.concat(be(64 + 16 * count, 4), F.lit(b"traf" + box("tfhd", bytes([0, 2, 0, 0]), number.to_bytes(4, "big")) + b"\0\0\0\x14tfdt\1\0\0\0"), be(F.col(f"{k}_base"), 8))
        run = F.concat(be(20 + 16 * count, 4), F.lit(b"trun\1\0\x0f\1"), be(count, 4), be(moof + place, 4), F.col(f"{k}_row"))
        parts.append(F.when(count > 0, F.concat(head, run)).otherwise(F.lit(b"")))
        place = place + F.col(f"{k}_bytes")
    start = F.concat(F.lit(box("styp", b"iso5", (512).to_bytes(4, "big"), b"iso5iso6")), be(moof, 4), F.lit(b"moof\0\0\0\x10mfhd\0\0\0\0"), be(F.col("segment_no"), 4))
    return each.select(*bases.columns, F.concat(start, *parts, be(place, 4), F.lit(b"mdat"), "video_data", "audio_data").alias("data"))


def files(sampled: DataFrame, init: bytes, target_secs: int, window: int = WINDOW, prefix: str = "seg", timed: DataFrame | None = None) -> DataFrame:
    """(stream_id, name, data): the files of each finished stream: its start, the
    segments that didn't fall out of the window, and the playlist.  timed: the same
    samples, if they are at hand without payloads."""
    each = _tracks(sampled if timed is None else timed).groupBy("stream_id", "segment_no")
    segs = _spans(each.agg(F.min_by("ms", "seq").alias("start_ms"), F.max("end_ms").alias("end_ms"), *_bases()))
    # a stream's samples are cut twice, for its segments and for their bytes
    held = _listed(segs, target_secs, window, prefix, True, True).where(F.col("rank") <= max(window, 1))
    held = held.select("stream_id", "segment_no", "rank", "video_base", "audio_base", F.when(F.col("rank") == 1, F.col("playlist")).alias("playlist"))
    made = _bytes(sampled, held)
    file = lambda name, data: F.struct(name.alias("name"), data.alias("data"))
    own = F.array(file(F.concat(F.lit(prefix), F.col("segment_no"), F.lit(".m4s")), F.col("data")))
    whole = F.array(file(F.lit("playlist.m3u8"), F.col("playlist").cast("binary")), file(F.lit("init.mp4"), F.lit(init)))
    return made.select("stream_id", F.explode(F.when(F.col("rank") == 1, F.concat(whole, own)).otherwise(own)).alias("f")).select("stream_id", "f.*")
