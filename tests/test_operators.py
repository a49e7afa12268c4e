"""Operators on small inputs with known results; streams equal batches."""

import pytest
from pyspark.sql import functions as F

from streamloom.functions import codecs
from streamloom.operators import commands, lifecycle, ordering, segments, telemetry, timebase
from streamloom.sources import containers
from streamloom.streaming import sinks


def frames(spark, rows, cols="seq long, kind string, dts long, is_key boolean"):
    return spark.createDataFrame(rows, cols).withColumn("stream_id", F.lit(1).cast("long")).withColumn("pts", F.col("dts")).withColumn("batch_id", F.lit(0).cast("long"))


def video(spark, *dts, keys=()):
    return frames(spark, [(i, "video", t, i in keys) for i, t in enumerate(dts)])


def times(df):
    return [r.ndts for r in df.orderBy("seq").collect()]


def test_small_slips_repeat_the_last_time(spark):
    assert times(timebase.monotonic(video(spark, 0, 40, 37))) == [0, 40, 40]
    assert times(timebase.clamped(video(spark, 0, 40, 37))) == [0, 40, 40]


def test_long_slips_move_the_origin(spark):
    got = timebase.monotonic(video(spark, 0, 10000, 40, 80)).orderBy("seq").collect()
    assert [r.ndts for r in got] == [0, 10000, 10000, 10040] and [r.rebased for r in got] == [False, False, True, False]


def test_segments(spark):
    rows = [("video", 0, True), ("audio", 0, False), ("video", 1000, False), ("video", 2000, True), ("video", 3000, False), ("video", 4000, True)]
    df = frames(spark, [(i, *r) for i, r in enumerate(rows)])
    s = segments.summary(segments.samples(segments.cut(df, 1000)))
    assert [(r.segment_no, r.duration_ms) for r in s.orderBy("segment_no").collect()] == [(0, 1033), (1, 1033), (2, 33)]
    text = segments.playlists(s, 1).first().playlist
    assert "#EXTINF:1.033," in text and "#EXT-X-TARGETDURATION:2\n" in text and text.endswith("#EXT-X-ENDLIST\n")


def test_segment_starts_and_retention(spark):
    assert segments.cut(video(spark, 0, 100, keys=(1,)), 4000).count() == 1
    df = video(spark, *range(0, 5000, 1000), keys=range(5))
    s = segments.summary(segments.samples(segments.cut(df, 1000)))
    assert s.count() == 3 and [r.segment_no for r in segments.retired(s, 2).collect()] == [0]
    assert "#EXT-X-MEDIA-SEQUENCE:1\n" in segments.playlists(s, 1, 2).first().playlist
    audio = frames(spark, [(i, "audio", 23 * i, False) for i in range(100)])
    assert segments.cut(audio, 1000).select("segment_no").distinct().count() >= 2


def test_segment_bytes_without_groups_in_python(spark):
    """Segments of one track or two, rows in any order, payloads that are null, as media_segment() writes them."""
    rows = [
        (s, q, kind, q % 3 == 0, (q % 5 - 2) * 7, 40 * q, q // 5, 40 + q, 3000 + q, (q % 5 - 2) * 630, None if q % 4 == 3 else b"x" * q)
        for s in (1, 2, 3)
        for q in reversed(range(20))
        for kind in (("video", "audio")[(q * s) % 2 if s < 3 else s % 2],)
    ]
    df = spark.createDataFrame(rows, "stream_id long, seq long, kind string, is_key boolean, cts long, ndts long, segment_no long, duration_ms long, duration long, `offset` int, data binary").repartition(3)
    grid = segments.decode_grid(df)
    base = {(g.stream_id, g.kind, g.segment_no): g.base for g in grid.collect()}
    want = {}
    for s, n in {(r[0], r[6]) for r in rows}:
        tracks = []
        for number, kind in ((1, "video"), (2, "audio")):
            own = sorted(r for r in rows if (r[0], r[6], r[2]) == (s, n, kind))
            if own:
                tracks.append((number, base[s, kind, n], [(r[8], r[10] or b"", 1 << 25 if r[3] or kind == "audio" else 0x1010000, r[9]) for r in own]))
        want[s, n] = codecs.media_segment(n, tracks)
    made = segments.segment_bytes(df, grid)
    assert {(r.stream_id, r.segment_no): bytes(r.data) for r in made.collect()} == want
    files = segments.files(df, b"start", 4, window=2)
    assert {(r.stream_id, r.name): bytes(r.data) for r in files.collect() if r.name.endswith("m4s")} == {(s, f"seg{n}.m4s"): x for (s, n), x in want.items() if n >= 2}
    assert sorted(r.stream_id for r in files.where("name = 'init.mp4'").collect()) == sorted(r.stream_id for r in files.where("name = 'playlist.m3u8'").collect()) == [1, 2, 3]
    # a call of Python for each segment took the time of these queries
    for x in (made, files):
        assert "InPandas" not in x._jdf.queryExecution().executedPlan().toString()


def test_buffers(spark):
    df = video(spark, *range(5))
    assert [r.seq for r in ordering.newest(df, 3).orderBy("seq").collect()] == [2, 3, 4]
    assert ordering.buffer_counters(df, 3).first().dropped == 2 and ordering.buffer_counters(df, 0).first().dropped == 5
    assert ordering.from_latest_key(video(spark, *range(16), keys=(0, 4, 8))).count() == 8
    assert ordering.from_latest_key(df).count() == 5
    last = lifecycle.buffered(video(spark, *range(20), keys=(0, 5, 12)), 30, 15).orderBy(F.desc("seq")).first()
    assert (last.first, last.held, last.dropped) == (13, 8, 12)


def test_gates(spark):
    df = frames(spark, [(0, "video", 0, False), (1, "audio", 0, False), (2, "video", 1, True), (3, "video", 2, False)])
    assert [r.seq for r in ordering.key_gate(df).orderBy("seq").collect()] == [1, 2, 3]
    assert [r.seq for r in ordering.start_gate(df).orderBy("seq").collect()] == [2, 3]
    assert ordering.start_gate(df.where("seq > 0")).count() == 3


def ticks(spark, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "stream_id long, seq long, now_ms long, write_ok boolean, dial_ok boolean, command string")
    return df.withColumn("progress_ms", F.lit(None).cast("long"))


def test_sessions(spark):
    rows = [(0, True, True, ""), (10, False, False, ""), (11, True, False, ""), (300, True, True, ""), (400, False, True, "")]
    got = [(r.state, r.attempt, r.reconnects) for r in lifecycle.sessions(ticks(spark, rows)).orderBy("seq").collect()]
    assert got == [("Connected", 0, 0), ("Reconnecting", 1, 0), ("Reconnecting", 1, 0), ("Connected", 0, 1), ("Connected", 0, 2)]
    rows = [(0, False, False, ""), (9999, True, False, ""), (99999, True, True, ""), (99999, True, True, "retry"), (99999, True, True, "finish")]
    got = [r.state for r in lifecycle.sessions(ticks(spark, rows), attempts=2).orderBy("seq").collect()]
    assert got == ["Reconnecting", "Exhausted", "Exhausted", "Connected", "Finished"]


def test_stalls(spark):
    df = ticks(spark, [(5000, True, True, "")]).withColumn("progress_ms", F.lit(0).cast("long"))
    assert lifecycle.sessions(df, stall_ms=50).first().reconnects == 1


def test_backoff(spark):
    got = spark.range(1, 6).select(lifecycle.backoff(F.col("id"), 100, 2.0, 800).alias("d")).collect()
    assert [r.d for r in got] == [100, 200, 400, 800, 800]


def test_summary(spark):
    rows = [(1, i, 1000 * i, 1000.0 * i, 10 * i, float(i), 100, i) for i in range(1, 5)]
    s = telemetry.summary(spark.createDataFrame(rows, "stream_id long, seq long, now_ms long, rate_bps double, lag_ms long, rtt_ms double, pushed long, dropped long")).first()
    assert (s.avg_rate_bps, s.peak_rate_bps, s.avg_lag_ms, s.max_lag_ms, s.avg_rtt_ms, s.max_rtt_ms, s.dropped, s.span_secs, s.drop_ratio) == (2500, 4000, 25, 40, 2.5, 4, 4, 3, 0.04)


def test_event_counters(spark):
    rows = [(1, i, *e) for i, e in enumerate([("Started", None), ("Connected", None), ("Disconnected", "died"), ("ReconnectAttempt", "refused"), ("Reconnected", None)])]
    r = telemetry.event_counters(spark.createDataFrame(rows, "stream_id long, seq long, event string, error string")).first()
    assert (r.reconnects, r.reconnect_attempts, r.last_error) == (1, 1, "refused")


def test_fan_out(spark):
    seen = {"a": [], "b": []}

    def sink(name, fail=()):
        def write(batch, batch_id):
            if batch_id in fail:
                raise OSError("gone")
            seen[name].append(batch.count())

        return write

    fan = sinks.FanOut(sink("a"), sink("b", fail=(1,)))
    for i in range(3):
        fan(spark.range(i + 1), i)
    assert seen == {"a": [1, 2, 3], "b": [1]} and fan.alive() == 1 and fan.status == {1: "gone"}
    with pytest.raises(OSError):
        sinks.FanOut(sink("a", fail=(0,)), sink("b"))(spark.range(7), 0)
    assert seen["b"][-1] == 7


def test_recording_reads_back(spark, tmp_path):
    key = codecs.join_units([bytes.fromhex("6742000A"), bytes.fromhex("68CE3C80"), b"\x65\x88"])
    rows = [(0, "video", 0, True, key), (1, "video", 33, False, codecs.join_units([b"\x41\x77"])), (2, "audio", 40, False, bytes.fromhex("FFF150800140FC") + b"raw")]
    df = frames(spark, rows, "seq long, kind string, dts long, is_key boolean, data binary")
    table, folder = sinks.record(df, str(tmp_path / "table")), str(tmp_path / "files")
    (name,) = sinks.export_recordings(spark, table, folder)
    tags = containers.read_tags(spark, folder).orderBy("ord").collect()
    assert [(t.kind, t.ts) for t in tags] == [(18, 0), (9, 0), (8, 0), (9, 0), (9, 33), (8, 40)]
    assert codecs.decode_tag(8, 0, bytes(tags[2].body)) == {"what": "audio_config", "data": bytes.fromhex("0A10")}
    assert codecs.decode_tag(9, 33, bytes(tags[4].body))["data"] == codecs.join_units([b"\x41\x77"]) and bytes(tags[5].body)[2:] == b"raw"
    spark.dataSource.register(containers.TagSource)
    assert spark.read.format("tags").load(name).count() == 6


def test_several_recordings(spark, tmp_path):
    key = codecs.join_units([bytes.fromhex("6742000A"), bytes.fromhex("68CE3C80"), b"\x65\x88"])
    df = spark.createDataFrame([(s, i, "video", 10 * i, i == 0, key, 10 * i) for s in (1, 2, 3) for i in range(4)], "stream_id long, seq long, kind string, dts long, is_key boolean, data binary, pts long")
    names = sinks.export_recordings(spark, sinks.record(df, str(tmp_path / "t")), str(tmp_path / "f"))
    assert [n[-12:] for n in names] == ["stream-1.flv", "stream-2.flv", "stream-3.flv"]
    assert {tuple(r) for r in containers.read_tags(spark, str(tmp_path / "f")).groupBy("path").count().select("count").collect()} == {(6,)}
    assert sinks.export_recordings(spark, sinks.record(df.where("false"), str(tmp_path / "e")), str(tmp_path / "g")) == []


class Log:
    def __init__(self, fail=()):
        self.calls, self.fail = [], fail

    def codecs(self, video, audio):
        self.calls.append(("codecs", video, audio))

    def write(self, batch, batch_id):
        if batch_id in self.fail:
            raise OSError("gone")
        self.calls.append(("write", batch.count()))

    def finish(self):
        self.calls.append(("finish",))


def test_independent_sinks(spark):
    a, b, c = Log(), Log(fail=(1,)), Log()
    fan = sinks.Independent(a, b)
    fan.codecs(video=b"v")
    fan.codecs(audio=b"a")
    for i in range(3):
        if i == 2:
            fan.attach(c, b"v", b"a")
        fan(spark.range(i + 1), i)
    assert fan.alive() == 2 and fan.sinks[1].error == "gone"
    fan.finish()
    fan.finish()
    assert a.calls == [("codecs", b"v", None), ("codecs", b"v", b"a"), ("write", 1), ("write", 2), ("write", 3), ("finish",)]
    assert b.calls == [("codecs", b"v", None), ("codecs", b"v", b"a"), ("write", 1)]
    assert c.calls == [("codecs", b"v", b"a"), ("write", 3), ("finish",)]
    sinks.Independent()(spark.range(1), 0)


def test_storage(spark, tmp_path):
    files = spark.createDataFrame([("list.m3u8", b"1"), ("a", b"22"), ("z", b"333")], "name string, data binary")
    for storage in (sinks.Folder(str(tmp_path / "s")), sinks.Memory()):
        sinks.store(files, storage)
        assert storage.names() == ["a", "list.m3u8", "z"] and storage.bytes_written == 6
        storage.remove("a")
        storage.remove("a")
        assert storage.names() == ["list.m3u8", "z"]


def test_late_tracks_are_dropped(spark):
    rows = [("video", 0, True), ("video", 1000, False), ("video", 2000, True), ("audio", 2010, False), ("video", 4000, True), ("audio", 4010, False)]
    got = segments.cut(frames(spark, [(i, *r) for i, r in enumerate(rows)]), 1000).collect()
    assert {r.kind for r in got} == {"video"} and len(got) == 4
    early = [("video", 0, True), ("audio", 5, False), *rows[1:]]
    assert segments.cut(frames(spark, [(i, *r) for i, r in enumerate(early)]), 1000).count() == 7


def test_muxer_errors(spark):
    df = frames(spark, [(0, "video", 0, True), (1, "video", 40, False), (2, "video", 37, False), (3, "video", -960, False), (4, "video", 80, False)]).withColumn("configured", F.col("seq") == 0)
    got = lifecycle.muxed(df).orderBy("seq").collect()
    assert [(r.ndts, r.error) for r in got] == [(0, None), (40, None), (40, None), (None, "ordering"), (80, None)]
    bare = lifecycle.muxed(df.withColumn("configured", F.col("seq") == 9)).orderBy("seq").collect()
    assert [r.error for r in bare] == ["config", None, None, "ordering", None]


def test_gate_after_a_reconnect(spark):
    rows = [(0, "video", 0, True, 1), (1, "video", 40, False, 1), (2, "audio", 46, False, 2), (3, "video", 160, False, 2), (4, "video", 1000, True, 2), (5, "video", 1040, False, 2)]
    df = spark.createDataFrame([(1, *r) for r in rows], "stream_id long, seq long, kind string, dts long, is_key boolean, connection long")
    sent, headers = lifecycle.reattached(df)
    assert [(r.seq, r.ndts) for r in sent.orderBy("seq").collect()] == [(0, 0), (1, 40), (2, 46), (4, 1000), (5, 1040)]
    assert [tuple(r)[1:] for r in headers.orderBy("connection").collect()] == [(1, 0, False), (2, 40, True)]
    # without a key before, nothing is held back
    assert lifecycle.reconnect_gate(df.withColumn("is_key", F.lit(False))).count() == 6


def test_commands(spark):
    rows = [(1, 0, "connect", 1.0, "live", None), (1, 1, "createStream", 2.0, None, None), (1, 2, "publish", 3.0, None, "k"), (1, 3, "connect", 4.0, "no", None), (2, 0, "connect", 1.0, "no", None), (2, 1, "publish", 2.0, None, "k"), (3, 0, "FCPublish", None, None, None), (4, 0, "publish", 1.0, None, None)]
    log = spark.createDataFrame(rows, "conn_id long, ord long, name string, txn double, app string, key string")
    assert sorted(tuple(r) for r in commands.negotiated(log, "live").fillna({"key": "-", "ord": -1}).collect()) == [(1, "published", "live", "k", 2), (2, "rejected", "", "-", 0), (3, "pending", "", "-", -1), (4, "invalid", "", "-", 0)]
    got = sorted((r.conn_id, r.ord, r.reply, r.txn, r.code or "-") for r in commands.replies(log, "live").collect())
    assert got == [(1, 0, "_result", 1.0, "-"), (1, 1, "_result", 2.0, "1"), (1, 2, "onStatus", 0.0, "NetStream.Publish.Start"), (2, 0, "_error", 1.0, "NetConnection.Connect.Rejected"), (3, 0, "_result", 1.0, "-")]
    talk = [(1, 0, "connect", 1.0), (1, 1, "note", None), (1, 2, "_result", 9.0), (1, 3, "_result", 1.0), (1, 4, "createStream", 2.0), (1, 5, "_error", 7.0), (1, 6, "_result", 2.0), (1, 7, "publish", 3.0)]
    log = spark.createDataFrame(talk, "conn_id long, ord long, name string, txn double")
    asks = F.col("name").isin("connect", "createStream", "publish")
    assert [(r.ord, r.answer, r.answer_ord) for r in commands.answers(log, asks).orderBy("ord").collect()] == [(0, "_result", 3), (4, "_error", 5), (7, "missing", None)]
    assert commands.answers(log, asks, 2).orderBy("ord").first().answer == "missing"


def test_messages_of_captures(spark):
    head = bytes([3, 0, 0, 1, 0, 0, 4, 1, 0, 0, 0, 0]) + (200).to_bytes(4, "big")
    big = bytes([6, 0, 0, 5, 0, 0, 200, 9, 1, 0, 0, 0]) + bytes(200)
    data = head + big
    rows = [(c, i, data[i : i + 50]) for c in (1, 2) for i in range(0, len(data), 50)]
    got = containers.read_messages(spark.createDataFrame(rows, "conn_id long, offset long, bytes binary")).collect()
    assert sorted((r.conn_id, r.ord, r.kind, r.ts, len(r.payload)) for r in got) == [(1, 0, 1, 1, 4), (1, 1, 9, 5, 200), (2, 0, 1, 1, 4), (2, 1, 9, 5, 200)]


@pytest.mark.parametrize("which", ["monotonic", "cut", "buffered"])
def test_streaming_equals_batch(spark, tmp_path, which):
    fold = {"monotonic": lambda d: timebase.monotonic(d, 100), "cut": lambda d: segments.cut(d, 1000), "buffered": lambda d: lifecycle.buffered(d, 6, 4)}[which]
    rows = [(s, i, "audio" if i % 3 == 2 else "video", (i * 700) % 5000, i % 4 == 0) for i in range(24) for s in (1, 2)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, kind string, dts long, is_key boolean").withColumn("pts", F.col("dts") + 40)
    folder = str(tmp_path / "in")
    for part in range(3):
        df.where(f"seq div 8 = {part}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = fold(stream).writeStream.format("memory").queryName(f"out_{which}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table(f"out_{which}").collect()))
    assert got == sorted(map(tuple, fold(df).collect())) and got
