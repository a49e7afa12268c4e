"""Registered queries over the driver's tables, each with its SQL.

Names begin with the inventory's number of the operator.  Constants are scaled
to the events table, where a user's rows are hours apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, scalars
from ..operators import lifecycle, ordering, segments, telemetry, timebase
from ..sources.packets import PACKETS_SQL, events, packets
from ..streaming.sinks import fanout_metrics

HOUR = 3_600_000
TOLERANCE, TARGET, INTERVAL, IDLE = 6 * HOUR, 24 * HOUR, 12 * HOUR, 72 * HOUR
CAPACITY, CUT_AT = 30, 15

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: str | None = None):
    """Registers a query; sql follows the packet table's expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{PACKETS_SQL}{',' + recursive if recursive else ''} {sql}"
        return f

    return add


KEY = "(kind = 'video' AND is_key)"
SOFAR = "OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
PRIOR = "OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""SELECT stream_id, count(*) AS packets, count(*) FILTER (is_key) AS keys, CAST(sum(size) AS BIGINT) AS bytes, min(dts) AS first_dts, max(dts) AS last_dts, max(ord) AS longest_batch
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY stream_id, batch_id ORDER BY dts, seq) AS INTEGER) AS ord FROM (SELECT *, coalesce(bool_or({KEY}) {SOFAR}, false) AS opened FROM q) WHERE kind <> 'video' OR opened) GROUP BY 1""")
def m0_packet_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = ordering.sort_batches(ordering.key_gate(packets(spark, d)))
    return rows.groupBy("stream_id").agg(F.count("*").alias("packets"), F.count_if("is_key").alias("keys"), F.sum("size").alias("bytes"), F.min("dts").alias("first_dts"), F.max("dts").alias("last_dts"), F.max("ord").alias("longest_batch"))


@query("SELECT stream_id, seq, kind, pts, dts, kind = 'video' AND is_key AS is_key, batch_id FROM q")
def s01_packet_rows(spark, d):
    return packets(spark, d).select("stream_id", "seq", "kind", "pts", "dts", ordering.video_key().alias("is_key"), "batch_id")


@query("""SELECT event_id, valid, CASE WHEN valid THEN host END AS host, CASE WHEN valid THEN CAST(port AS BIGINT) END AS port FROM (
SELECT event_id, host, port, host <> '' AND x NOT IN (3, 4, 5, 6) AND x <> 7 AS valid FROM (SELECT event_id, event_id % 8 AS x, 'h' || user_id AS host, CASE WHEN event_id % 8 = 1 THEN 1936 ELSE 1935 END AS port FROM events))""")
def s12_destination(spark, d):
    x = F.col("event_id") % 8
    tail = F.when(x == 1, ":1936").when(x == 3, ":99999").when(x == 4, "/app").when(x == 5, ":port").otherwise("")
    url = F.concat(F.when(x == 6, "http://").otherwise("rtmp://"), F.lit("h"), F.col("user_id").cast("string"), tail)
    app = F.when(x == 7, "  ").otherwise("live")
    return events(spark, d).select("event_id", scalars.destination(url, app, F.lit("key")).alias("t")).select("event_id", "t.*")


@query(f"SELECT stream_id, seq FROM (SELECT *, coalesce(bool_or(event_type = 'signup') {SOFAR}, false) AS ended FROM q) WHERE NOT ended")
def s09_before_end(spark, d):
    return ordering.before_end(packets(spark, d), F.col("event_type") == "signup").select("stream_id", "seq")


@query("SELECT stream_id, seq, dts - first_value(dts) OVER w AS ndts, pts - first_value(dts) OVER w AS npts FROM q WINDOW w AS (PARTITION BY stream_id ORDER BY seq)")
def p01_normalize(spark, d):
    return timebase.normalized(packets(spark, d)).select("stream_id", "seq", "ndts", "npts")


@query("SELECT event_id, CAST(greatest(0, least(dts - 1704067200000 - 1000000000, 4294967295)) AS BIGINT) AS wire, CAST(greatest(-8388608, least((size - 5000) * 2000, 8388607)) AS BIGINT) AS cts, lpad(upper(to_hex((greatest(-8388608, least((size - 5000) * 2000, 8388607)) + 16777216) % 16777216)), 6, '0') AS cts_bytes, lpad(upper(to_hex(size % 16777216)), 6, '0') AS u24 FROM q")
def p02_clamps_and_bytes(spark, d):
    cts = timebase.composition((F.col("size") - 5000) * 2000)
    return packets(spark, d).select("event_id", timebase.wire_time(F.col("dts") - F.lit(1704067200000) - F.lit(1000000000)).cast("long").alias("wire"), cts.cast("long").alias("cts"), F.hex(scalars.be(cts, 3)).alias("cts_bytes"), F.hex(scalars.be(F.col("size"), 3)).alias("u24"))


@query("SELECT event_id, CAST(ord('d') * 16777216 + ord('a') * 65536 + ord('t') * 256 + ord('a') AS BIGINT) AS word, octet_length(encode(props)) AS n FROM q")
def p05_read_bytes(spark, d):
    return packets(spark, d).select("event_id", scalars.be_read(F.concat(F.lit(b"data"), F.col("props").cast("binary")), 0, 4).alias("word"), F.octet_length("props").cast("long").alias("n"))


@query(f"SELECT stream_id, seq, CAST(greatest(coalesce(max(dts - 1704067200000) {PRIOR}, 0), 0) AS BIGINT) AS header_ts FROM q")
def p06_header_time(spark, d):
    return packets(spark, d).select("stream_id", "seq", scalars.header_time(F.max(F.col("dts") - F.lit(1704067200000)).over(ordering.before())).alias("header_ts"))


@query("SELECT stream_id, seq, (max(dts) OVER (PARTITION BY stream_id)) - pts AS lag_ms FROM q")
def p07_latency(spark, d):
    return packets(spark, d).select("stream_id", "seq", scalars.latency(F.max("dts").over(ordering.whole()), F.col("pts")).alias("lag_ms"))


@query("SELECT event_id, CAST(greatest(pts - dts, 0) * 90 AS BIGINT) AS video_ticks, CAST(greatest(pts - dts, 0) * 44100 // 1000 AS BIGINT) AS audio_ticks, CAST((pts - dts) * 90 AS INTEGER) AS ticks, CAST((size % 4) * 16777216 + CASE WHEN is_key THEN 0 ELSE 65536 END AS BIGINT) AS flags FROM q")
def p09_ticks_and_flags(spark, d):
    ms = F.col("pts") - F.col("dts")
    return packets(spark, d).select("event_id", timebase.ticks(ms, timebase.VIDEO_RATE).alias("video_ticks"), F.expr("greatest(pts - dts, 0) * 44100 div 1000").alias("audio_ticks"), (ms * 90).cast("int").alias("ticks"), scalars.sample_flags(F.col("size"), F.col("is_key")).cast("long").alias("flags"))


@query("SELECT event_id, CAST(((ascii(event_type) % 32) * 1024 + (ascii(substr(event_type, 2)) % 32) * 32 + ascii(substr(event_type, 3)) % 32) AS BIGINT) AS packed FROM q")
def p12_language(spark, d):
    return packets(spark, d).select("event_id", scalars.packed_language(F.col("event_type")).alias("packed"))


@query("SELECT event_id, round(least(8000.0, 250.0 * pow(2, event_id % 12)), 6) AS delay FROM q")
def p14_backoff(spark, d):
    return packets(spark, d).select("event_id", F.round(lifecycle.backoff(F.col("event_id") % 12 + 1), 6).alias("delay"))


@query("SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'connected' WHEN 2 THEN 'reconnecting' WHEN 3 THEN 'exhausted' WHEN 4 THEN 'finished' ELSE 'idle' END AS state, CASE event_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' WHEN 3 THEN 'debug' WHEN 4 THEN 'trace' ELSE 'info' END AS level FROM q WHERE event_id % 6 <= 3")
def p18_levels_and_states(spark, d):
    n = F.col("event_id")
    return packets(spark, d).where(scalars.level_enabled(n % 6, 3)).select("event_id", scalars.state_name(n % 7).alias("state"), scalars.level_name(n % 6).alias("level"))


@query("SELECT event_id, 'server rejected `' || event_type || '`: ' || CAST(size AS VARCHAR) || ': ' || coalesce(CASE WHEN is_key THEN props END, '') AS message, substr(repeat(props, 80), 1, 512) AS error FROM q")
def p22_errors(spark, d):
    return packets(spark, d).select("event_id", scalars.command_error(F.col("event_type"), F.col("size").cast("string"), F.when(F.col("is_key"), F.col("props"))).alias("message"), scalars.capped_error(F.repeat("props", 80)).alias("error"))


@query("SELECT event_id, sha256(props) AS digest FROM q")
def p24_sha256(spark, d):
    return packets(spark, d).select("event_id", F.sha2(F.col("props").cast("binary"), 256).alias("digest"))


_PADS = [bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]


@query(f"SELECT event_id, upper(sha256(unhex('{_PADS[0]}' || sha256(unhex('{_PADS[1]}' || hex(encode(props))))))) AS mac FROM q")
def p25_hmac(spark, d):
    return packets(spark, d).select("event_id", F.hex(scalars.hmac_sha256(b"key", F.col("props").cast("binary"))).alias("mac"))


_M64 = "18446744073709551616::UHUGEINT"


def _mixed(z: str, shift: int, mul: int) -> str:
    return f"CAST((CAST(xor({z}, {z} >> {shift}) AS UHUGEINT) * {mul}::UHUGEINT) % {_M64} AS UBIGINT)"


@query(f"SELECT event_id, u, 50.0::DOUBLE + 50.0::DOUBLE * u AS delay FROM (SELECT event_id, CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992.0::DOUBLE AS u FROM (SELECT event_id, {_mixed('z', 27, 0x94D049BB133111EB)} AS z FROM (SELECT event_id, {_mixed('z', 30, 0xBF58476D1CE4E5B9)} AS z FROM (SELECT event_id, CAST((CAST(event_id AS UHUGEINT) + 11400714819323198485::UHUGEINT) % {_M64} AS UBIGINT) AS z FROM q))))")
def p16_jitter(spark, d):
    def run(it):
        for pdf in it:
            u = codecs.first_doubles(pdf["event_id"].to_numpy())
            yield pdf.assign(u=u, delay=codecs.jittered(100.0, u))

    return packets(spark, d).select("event_id").mapInPandas(run, "event_id long, u double, delay double")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 120 ELSE 480 END AS budget, CASE event_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 120 END AS cut_at FROM q")
def p13_budgets(spark, d):
    profile = F.element_at(F.array(*map(F.lit, ordering.BUDGET)), (F.col("event_id") % 3 + 1).cast("int"))
    return packets(spark, d).select("event_id", ordering.by_profile(ordering.BUDGET, profile).alias("budget"), ordering.by_profile(ordering.CUT_AT, profile).alias("cut_at"))


@query(f"SELECT stream_id, seq FROM (SELECT *, coalesce(bool_or({KEY}) {SOFAR}, false) AS opened FROM q) WHERE kind <> 'video' OR opened")
def g01_key_gate(spark, d):
    return ordering.key_gate(packets(spark, d)).select("stream_id", "seq")


STARTED = f"s1 AS (SELECT *, coalesce(bool_or(kind = 'video') {PRIOR}, false) AS seen FROM o), s2 AS (SELECT *, bool_or({KEY} OR (kind = 'audio' AND NOT seen)) {SOFAR} AS started FROM s1)"


@query("SELECT stream_id, seq FROM s2 WHERE started", STARTED)
def g02_start_gate(spark, d):
    return ordering.start_gate(packets(spark, d)).select("stream_id", "seq")


@query(f"SELECT stream_id, seq, cfg FROM (SELECT *, last_value(CASE WHEN is_key THEN event_id END IGNORE NULLS) {SOFAR} AS cfg FROM q) WHERE cfg IS NOT NULL")
def g03_config_gate(spark, d):
    rows = packets(spark, d).withColumn("own", F.when(F.col("is_key"), F.col("event_id")))
    return ordering.carry_last(rows, "own", "cfg").where("cfg is not null").select("stream_id", "seq", "cfg")


@query(f"SELECT stream_id, seq, coalesce(dts - lag(dts) OVER (PARTITION BY stream_id ORDER BY seq) >= {INTERVAL}, false) AS stalled FROM q")
def g08_stalled(spark, d):
    return packets(spark, d).select("stream_id", "seq", ordering.stalled(F.col("dts"), F.lag("dts").over(ordering.stream()), INTERVAL).alias("stalled"))


@query(f"SELECT stream_id, seq FROM (SELECT *, coalesce(bool_or(event_type = 'error') {PRIOR}, false) AS done FROM q) WHERE NOT done")
def g09_finished_gate(spark, d):
    done = F.coalesce(F.max(F.col("event_type") == "error").over(ordering.before()), F.lit(False))
    return packets(spark, d).withColumn("done", done).where("not done").select("stream_id", "seq")


@query("SELECT stream_id, batch_id, seq, CAST(row_number() OVER (PARTITION BY stream_id, batch_id ORDER BY dts, seq) AS INTEGER) AS ord FROM q")
def b01_sort_batches(spark, d):
    return ordering.sort_batches(packets(spark, d)).select("stream_id", "batch_id", "seq", "ord")


@query(f"SELECT stream_id, seq FROM q QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) <= {CAPACITY}")
def b02_newest(spark, d):
    return ordering.newest(packets(spark, d), CAPACITY).select("stream_id", "seq")


@query("SELECT stream_id, seq, dts FROM q QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq) <= 3")
def b03_pop_oldest(spark, d):
    return ordering.take(packets(spark, d), 3).select("stream_id", "seq", "dts")


@query("SELECT stream_id, seq, dts FROM q QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) <= 3")
def b03_pop_freshest(spark, d):
    return ordering.take(packets(spark, d), 3, True).select("stream_id", "seq", "dts")


@query("SELECT stream_id, seq, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY CASE WHEN batch_id % 2 = 1 THEN 0 ELSE 1 END, seq) AS INTEGER) AS place FROM q")
def b04_restore_front(spark, d):
    p = packets(spark, d).select("stream_id", "seq", "batch_id")
    return ordering.restore_front(p.where("batch_id % 2 = 1"), p.where("batch_id % 2 = 0")).select("stream_id", "seq", "place")


@query(f"SELECT stream_id, seq FROM (SELECT *, max(CASE WHEN {KEY} THEN seq END) OVER (PARTITION BY stream_id) AS k FROM q) WHERE k IS NULL OR seq >= k")
def b05_keep_from_latest_key(spark, d):
    return ordering.from_latest_key(packets(spark, d)).select("stream_id", "seq")


@query("SELECT stream_id, arg_min(dts, seq) AS front, arg_max(dts, seq) AS back FROM q GROUP BY 1")
def b06_front_and_back(spark, d):
    return ordering.ends(packets(spark, d))


@query(f"SELECT stream_id, count(*) AS pushed, greatest(count(*) - {CAPACITY}, 0) AS dropped, round(greatest(count(*) - {CAPACITY}, 0) / count(*), 6) AS drop_ratio FROM q GROUP BY 1")
def b07_counters(spark, d):
    return ordering.buffer_counters(packets(spark, d), CAPACITY).withColumn("drop_ratio", F.round("drop_ratio", 6))


@query("SELECT stream_id, min(CASE WHEN event_type = 'error' THEN seq END) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM q) WHERE n <= 64 GROUP BY 1")
def b11_first_match(spark, d):
    return ordering.first_match(packets(spark, d), F.col("event_type") == "error", 64)


@query("SELECT stream_id, seq, max(nd) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ndts FROM (SELECT stream_id, seq, dts - first_value(dts) OVER (PARTITION BY stream_id ORDER BY seq) AS nd FROM q)")
def f01_running_clamp(spark, d):
    return timebase.clamped(packets(spark, d)).select("stream_id", "seq", "ndts")


REBASE = f"""r AS (SELECT stream_id, seq, i, dts AS origin, CAST(0 AS BIGINT) AS ndts, false AS rebased FROM o WHERE i = 1 UNION ALL
SELECT o.stream_id, o.seq, o.i, CASE WHEN ndts - (dts - origin) > {TOLERANCE} THEN dts - greatest(ndts, 0) ELSE origin END,
CASE WHEN dts - origin >= ndts THEN dts - origin WHEN ndts - (dts - origin) > {TOLERANCE} THEN greatest(ndts, 0) ELSE ndts END,
ndts - (dts - origin) > {TOLERANCE} FROM r JOIN o ON o.stream_id = r.stream_id AND o.i = r.i + 1)"""


@query("SELECT stream_id, seq, ndts, origin, rebased FROM r", REBASE)
def f02_clamp_or_rebase(spark, d):
    return timebase.monotonic(packets(spark, d), TOLERANCE)


def _buffer_sql(per_batch: bool) -> str:
    last = "coalesce(lead(batch_id) OVER (PARTITION BY stream_id ORDER BY seq) <> batch_id, true)" if per_batch else "true"
    return f"""b0 AS (SELECT *, {KEY} AS key, {last} AS last FROM o),
b1 AS (SELECT stream_id, i, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS latest, CAST(0 AS BIGINT) AS dropped, seq FROM b0 WHERE false
UNION ALL SELECT stream_id, 0, 1, 0, 0, -1 FROM b0 WHERE i = 1
UNION ALL SELECT x.stream_id, x.i, CASE WHEN cut THEN latest2 ELSE first2 END, latest2, dropped2 + CASE WHEN cut THEN latest2 - first2 ELSE 0 END, x.seq FROM (
  SELECT b0.stream_id, b0.i, b0.seq, b1.first + CASE WHEN b0.i - b1.first >= {CAPACITY} THEN 1 ELSE 0 END AS first2, b1.dropped + CASE WHEN b0.i - b1.first >= {CAPACITY} THEN 1 ELSE 0 END AS dropped2,
  CASE WHEN key THEN b0.i ELSE b1.latest END AS latest2,
  last AND b0.i - (b1.first + CASE WHEN b0.i - b1.first >= {CAPACITY} THEN 1 ELSE 0 END) + 1 >= {CUT_AT} AND CASE WHEN key THEN b0.i ELSE b1.latest END >= b1.first + CASE WHEN b0.i - b1.first >= {CAPACITY} THEN 1 ELSE 0 END AS cut
  FROM b1 JOIN b0 ON b0.stream_id = b1.stream_id AND b0.i = b1.i + 1) x)"""


_HELD = "SELECT stream_id, seq, CAST(first AS BIGINT) AS first, CAST(i - first + 1 AS BIGINT) AS held, CAST(dropped AS BIGINT) AS dropped FROM b1 WHERE i > 0"


def _recursive_buffer(per_batch: bool) -> str:
    # one anchor, one recursive branch
    s = _buffer_sql(per_batch)
    return s.replace("SELECT stream_id, i, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS latest, CAST(0 AS BIGINT) AS dropped, seq FROM b0 WHERE false\nUNION ALL SELECT stream_id, 0, 1, 0, 0, -1 FROM b0 WHERE i = 1", "SELECT stream_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS first, CAST(0 AS BIGINT) AS latest, CAST(0 AS BIGINT) AS dropped, CAST(-1 AS BIGINT) AS seq FROM b0 WHERE i = 1")


@query(_HELD, _recursive_buffer(False))
def f03_buffer_cut_per_push(spark, d):
    return lifecycle.buffered(packets(spark, d), CAPACITY, CUT_AT)


@query(_HELD, _recursive_buffer(True))
def f03_buffer_cut_per_batch(spark, d):
    return lifecycle.buffered(packets(spark, d), CAPACITY, CUT_AT, True)


@query(f"SELECT stream_id, seq, connection, cfg, connection = 1 OR prev <> connection AS headers FROM (SELECT *, lag(connection) OVER (PARTITION BY stream_id ORDER BY seq) AS prev FROM (SELECT *, 1 + CAST(count(*) FILTER (event_type = 'signup') {PRIOR} AS BIGINT) AS connection, last_value(CASE WHEN is_key THEN event_id END IGNORE NULLS) {SOFAR} AS cfg FROM q))")
def f04_connections(spark, d):
    p = packets(spark, d).withColumn("own", F.when(F.col("is_key"), F.col("event_id")))
    p = ordering.carry_last(p, "own", "cfg").withColumn("connection", 1 + F.count_if(F.col("event_type") == "signup").over(ordering.before()))
    return p.select("stream_id", "seq", "connection", "cfg", ((F.col("connection") == 1) | (F.lag("connection").over(ordering.stream()) != F.col("connection"))).alias("headers"))


CUT = STARTED + f""", k AS (SELECT *, bool_or(kind = 'video') {SOFAR} AS saw, CASE WHEN bool_or(kind = 'video') {SOFAR} THEN 1 ELSE 0 END + CASE WHEN bool_or(kind = 'audio') {SOFAR} THEN 2 ELSE 0 END AS kinds FROM s2), k1 AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS j FROM k WHERE started),
c0 AS (SELECT stream_id, seq, kind, is_key, pts - dts AS cts, j, dts AS origin, CAST(0 AS BIGINT) AS ndts, CAST(0 AS BIGINT) AS segment_no, CAST(0 AS BIGINT) AS start, 0 AS tracks, false AS late FROM k1 WHERE j = 1 UNION ALL
SELECT stream_id, seq, kind, is_key, cts, j, origin, ts, CASE WHEN cut THEN segment_no + 1 ELSE segment_no END, CASE WHEN cut THEN ts ELSE start END, CASE WHEN cut AND tracks = 0 THEN kinds ELSE tracks END, late FROM (
SELECT *, CASE WHEN late THEN origin0 WHEN ndts0 - (dts - origin0) > {TOLERANCE} THEN dts - greatest(ndts0, 0) ELSE origin0 END AS origin,
CASE WHEN late THEN ndts0 WHEN dts - origin0 >= ndts0 THEN dts - origin0 WHEN ndts0 - (dts - origin0) > {TOLERANCE} THEN greatest(ndts0, 0) ELSE ndts0 END AS ts,
NOT late AND ndts0 - start >= {TARGET} AND CASE WHEN kind = 'video' THEN is_key ELSE NOT saw END AS cut FROM (
SELECT k1.stream_id, k1.seq, k1.kind, k1.is_key, k1.pts - k1.dts AS cts, k1.j, k1.dts, k1.saw, k1.kinds, c0.segment_no, c0.start, c0.tracks, c0.origin AS origin0, c0.ndts AS ndts0,
c0.tracks > 0 AND (c0.tracks & CASE WHEN k1.kind = 'video' THEN 1 ELSE 2 END) = 0 AS late
FROM c0 JOIN k1 ON k1.stream_id = c0.stream_id AND k1.j = c0.j + 1))), c AS (SELECT * FROM c0 WHERE NOT late)"""
SAMPLES = CUT + """, sm AS (SELECT *, CASE WHEN kind = 'video' THEN coalesce(CASE WHEN lead(ndts) OVER w < ndts THEN 0 ELSE lead(ndts) OVER w - ndts END, 33) ELSE 23 END AS duration_ms FROM c WINDOW w AS (PARTITION BY stream_id, segment_no, kind ORDER BY seq)),
sm2 AS (SELECT *, CASE WHEN kind = 'video' THEN least(duration_ms * 90, 4294967295) ELSE 1024 END AS duration FROM sm),
sg AS (SELECT stream_id, segment_no, count(*) AS n, arg_min(ndts, seq) AS start_ms, greatest(max(ndts + duration_ms) - arg_min(ndts, seq), 0) AS duration_ms FROM sm2 GROUP BY 1, 2),
sl AS (SELECT *, max(duration_ms) OVER (PARTITION BY stream_id ORDER BY segment_no ROWS UNBOUNDED PRECEDING) AS longest_ms FROM sg)"""


@query("SELECT stream_id, seq, kind, is_key, cts, ndts, segment_no FROM c", CUT)
def f05_segment_cut(spark, d):
    return segments.cut(packets(spark, d), TARGET, TOLERANCE)


def _samples(spark, d):
    return segments.samples(segments.cut(packets(spark, d), TARGET, TOLERANCE))


@query("SELECT stream_id, seq, segment_no, CAST(duration_ms AS BIGINT) AS duration_ms, CAST(duration AS BIGINT) AS duration, CAST(CASE WHEN kind = 'video' THEN cts * 90 ELSE 0 END AS INTEGER) AS \"offset\" FROM sm2", SAMPLES)
def f06_sample_durations(spark, d):
    return _samples(spark, d).select("stream_id", "seq", "segment_no", "duration_ms", "duration", "offset")


@query("SELECT stream_id, segment_no, n, start_ms, CAST(duration_ms AS BIGINT) AS duration_ms, CAST(longest_ms AS BIGINT) AS longest_ms FROM sl", SAMPLES)
def a05_segment_statistics(spark, d):
    return segments.summary(_samples(spark, d))


GRID = SAMPLES + """, g0 AS (SELECT stream_id, kind, segment_no, CAST(sum(duration) AS BIGINT) AS span, CASE WHEN kind = 'video' THEN greatest(arg_min(ndts, seq), 0) * 90 ELSE greatest(arg_min(ndts, seq), 0) * 44100 // 1000 END AS own FROM sm2 GROUP BY stream_id, kind, segment_no),
g1 AS (SELECT *, row_number() OVER (PARTITION BY stream_id, kind ORDER BY segment_no) AS j1 FROM g0),
g2 AS (SELECT stream_id, kind, segment_no, span, own AS base, j1 FROM g1 WHERE j1 = 1 UNION ALL
SELECT g1.stream_id, g1.kind, g1.segment_no, g1.span, greatest(g2.base + g2.span, g1.own), g1.j1 FROM g2 JOIN g1 ON g1.stream_id = g2.stream_id AND g1.kind = g2.kind AND g1.j1 = g2.j1 + 1)"""


@query("SELECT stream_id, kind, segment_no, CAST(base AS BIGINT) AS base FROM g2", GRID)
def f07_decode_grid(spark, d):
    return segments.decode_grid(_samples(spark, d)).withColumn("base", F.col("base").cast("long"))


def _list_sql(history: bool) -> str:
    return f"""SELECT stream_id, segment_no, '#EXTM3U
#EXT-X-VERSION:7
#EXT-X-TARGETDURATION:' || greatest({TARGET // 1000}, (longest_ms + 999) // 1000, 1) || '
#EXT-X-MEDIA-SEQUENCE:' || (segment_no + 1 - len(lines)) || '
#EXT-X-INDEPENDENT-SEGMENTS
#EXT-X-MAP:URI="init.mp4"
' || array_to_string(lines, '') || CASE WHEN r = 1 THEN '#EXT-X-ENDLIST
' ELSE '' END AS playlist FROM (SELECT *, list('#EXTINF:' || (duration_ms // 1000) || '.' || lpad(CAST(duration_ms % 1000 AS VARCHAR), 3, '0') || ',
seg' || segment_no || '.m4s
') OVER (PARTITION BY stream_id ORDER BY segment_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lines, row_number() OVER (PARTITION BY stream_id ORDER BY segment_no DESC) AS r FROM sl){'' if history else ' WHERE r = 1'}"""


@query(_list_sql(False), SAMPLES)
def w01_playlist(spark, d):
    return segments.playlists(segments.summary(_samples(spark, d)), TARGET // 1000)


@query(_list_sql(True), SAMPLES)
def w02_playlist_history(spark, d):
    return segments.playlists(segments.summary(_samples(spark, d)), TARGET // 1000, history=True)


@query("SELECT stream_id, segment_no FROM (SELECT *, max(segment_no) OVER (PARTITION BY stream_id) AS m FROM sl) WHERE segment_no <= m - 6", SAMPLES)
def b09_retired_segments(spark, d):
    return segments.retired(segments.summary(_samples(spark, d)))


@query("SELECT stream_id, coalesce(bool_and(ok), true) AS monotonic FROM (SELECT stream_id, ndts >= lag(ndts) OVER (PARTITION BY stream_id ORDER BY seq) AS ok FROM c) GROUP BY 1", CUT)
def w04_monotonic(spark, d):
    rows = segments.cut(packets(spark, d), TARGET, TOLERANCE).select("stream_id", (F.col("ndts") >= F.lag("ndts").over(ordering.stream())).alias("ok"))
    return rows.groupBy("stream_id").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("monotonic"))


def _ticks(spark, d):
    p = packets(spark, d)
    # a transport that failed twice in a row with the same size stays down for the dial
    return p.select("stream_id", "seq", (F.max("dts").over(ordering.so_far())).alias("now_ms"), (F.col("event_type") != "error").alias("write_ok"), (F.col("size") % 3 != 0).alias("dial_ok"), F.lit(None).cast("long").alias("progress_ms"), F.when(F.col("size") % 97 == 0, "retry").otherwise("").alias("command"))


SESSION = f"""t AS (SELECT stream_id, seq, i, max(dts) {SOFAR} AS now_ms, event_type <> 'error' AS write_ok, size % 3 <> 0 AS dial_ok, size % 97 = 0 AS again FROM o),
z AS (SELECT stream_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, 'Connected' AS state, 0 AS attempt, CAST(NULL AS DOUBLE) AS due, 0 AS reconnects FROM t WHERE i = 1 UNION ALL
SELECT stream_id, i, seq, CASE WHEN NOT dials THEN s1 WHEN dial_ok THEN 'Connected' WHEN a1 + 1 >= 3 THEN 'Exhausted' ELSE s1 END,
CASE WHEN NOT dials THEN a1 WHEN dial_ok THEN 0 ELSE a1 + 1 END,
CASE WHEN NOT dials THEN d1 WHEN dial_ok THEN NULL WHEN a1 + 1 >= 3 THEN d1 ELSE now_ms + least({48 * HOUR}, {6 * HOUR} * pow(2, a1)) END,
CASE WHEN dials AND dial_ok THEN reconnects + 1 ELSE reconnects END FROM (
 SELECT *, s1 = 'Reconnecting' AND (d1 IS NULL OR now_ms >= d1) AS dials FROM (
  SELECT t.stream_id, t.i, t.seq, t.now_ms, t.dial_ok, z.reconnects,
  CASE WHEN (state = 'Exhausted' AND again) OR (state = 'Connected' AND NOT write_ok) THEN 'Reconnecting' ELSE state END AS s1,
  CASE WHEN (state = 'Exhausted' AND again) OR (state = 'Connected' AND NOT write_ok) THEN 0 ELSE attempt END AS a1,
  CASE WHEN (state = 'Exhausted' AND again) OR (state = 'Connected' AND NOT write_ok) THEN NULL ELSE due END AS d1
  FROM z JOIN t ON t.stream_id = z.stream_id AND t.i = z.i + 1)))"""


@query("SELECT stream_id, seq, state, CAST(attempt AS INTEGER) AS attempt, CAST(reconnects AS INTEGER) AS reconnects FROM z WHERE i > 0", SESSION)
def f08_sessions(spark, d):
    return lifecycle.sessions(_ticks(spark, d), 6 * HOUR, 2.0, 48 * HOUR, 3)


GREEDY = f"""n AS (SELECT stream_id, seq, i, max(dts) {SOFAR} AS now_ms, CAST(sum(size) {SOFAR} AS BIGINT) AS bytes FROM o),
y AS (SELECT stream_id, seq, i, now_ms, now_ms AS last, true AS taken, bytes FROM n WHERE i = 1 UNION ALL
SELECT n.stream_id, n.seq, n.i, n.now_ms, CASE WHEN n.now_ms - y.last >= {INTERVAL} THEN n.now_ms ELSE y.last END, n.now_ms - y.last >= {INTERVAL}, n.bytes FROM y JOIN n ON n.stream_id = y.stream_id AND n.i = y.i + 1),
yy AS (SELECT *, lag(now_ms) OVER w AS t0, lag(bytes) OVER w AS b0 FROM y WHERE taken WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
sp AS (SELECT stream_id, seq, now_ms, CASE WHEN now_ms - t0 <= {IDLE} AND now_ms > t0 THEN 8 * (bytes - b0) * 1000.0 / (now_ms - t0) ELSE 0.0 END AS rate_bps, i AS pushed FROM yy WHERE t0 IS NOT NULL)"""


def _sampled(spark, d):
    p = packets(spark, d).select("stream_id", "seq", F.max("dts").over(ordering.so_far()).alias("now_ms"), "size")
    return telemetry.sampled(p, INTERVAL, IDLE)


@query("SELECT stream_id, seq, now_ms, round(CAST(rate_bps AS DOUBLE), 6) AS rate_bps, pushed FROM sp", GREEDY)
def f09_samples(spark, d):
    return _sampled(spark, d).withColumn("rate_bps", F.round("rate_bps", 6))


@query("SELECT stream_id, seq, now_ms FROM sp QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) <= 5", GREEDY)
def b08_ring(spark, d):
    return telemetry.ring(_sampled(spark, d), 5).select("stream_id", "seq", "now_ms")


@query("""SELECT stream_id, count(*) AS samples, round(CASE WHEN count(*) >= 2 THEN (arg_max(now_ms, seq) - arg_min(now_ms, seq)) / 1000.0 ELSE 0.0 END, 3) AS span_secs, round(avg(CAST(rate_bps AS DOUBLE)), 6) AS avg_rate_bps, round(greatest(max(CAST(rate_bps AS DOUBLE)), 0.0), 6) AS peak_rate_bps,
round(avg(seq % 50), 6) AS avg_lag_ms, greatest(max(seq % 50), 0) AS max_lag_ms, round(avg(CASE WHEN seq % 3 = 0 THEN seq * 1.5::DOUBLE END), 6) AS avg_rtt_ms, max(CASE WHEN seq % 3 = 0 THEN seq * 1.5::DOUBLE END) AS max_rtt_ms, arg_max(pushed, seq) AS pushed, arg_max(pushed // 4, seq) AS dropped, round((arg_max(pushed // 4, seq)) / (arg_max(pushed, seq)), 6) AS drop_ratio FROM sp GROUP BY 1""", GREEDY)
def a01_summary(spark, d):
    s = _sampled(spark, d).withColumn("lag_ms", F.col("seq") % 50).withColumn("rtt_ms", F.when(F.col("seq") % 3 == 0, F.col("seq") * F.lit(1.5))).withColumn("dropped", F.expr("pushed div 4"))
    out = telemetry.summary(s)
    for c, n in (("span_secs", 3), ("avg_rate_bps", 6), ("peak_rate_bps", 6), ("avg_lag_ms", 6), ("avg_rtt_ms", 6), ("drop_ratio", 6)):
        out = out.withColumn(c, F.round(c, n))
    return out.withColumn("max_lag_ms", F.col("max_lag_ms").cast("long"))


@query("""SELECT stream_id, count(*) FILTER (event_type = 'purchase') AS reconnects, count(*) FILTER (event_type = 'view') AS reconnect_attempts, substr(arg_max(props, CASE WHEN event_type IN ('view', 'error') AND size % 2 = 0 THEN seq END), 1, 512) AS last_error FROM q GROUP BY 1""")
def a02_event_counters(spark, d):
    kind = F.col("event_type")
    e = packets(spark, d).select("stream_id", "seq", F.when(kind == "purchase", "Reconnected").when(kind == "view", "ReconnectAttempt").when(kind == "error", "Disconnected").otherwise("Connected").alias("event"), F.when(F.col("size") % 2 == 0, F.col("props")).alias("error"))
    return telemetry.event_counters(e)


@query(f"SELECT stream_id, count(*) AS pushed, count(*) FILTER (opened OR kind <> 'video') AS muxed, count(*) FILTER (NOT opened AND kind = 'video') AS dropped, CAST(sum(CASE WHEN opened OR kind <> 'video' THEN 15 + size ELSE 0 END) + 13 AS BIGINT) AS bytes, max(dts) - arg_max(pts, seq) AS lag_ms FROM (SELECT *, coalesce(bool_or({KEY}) {SOFAR}, false) AS opened FROM q) GROUP BY 1")
def a03_statistics(spark, d):
    passes = F.col("opened") | (F.col("kind") != "video")
    p = packets(spark, d).withColumn("opened", F.coalesce(F.max(ordering.video_key()).over(ordering.so_far()), F.lit(False)))
    return p.groupBy("stream_id").agg(F.count("*").alias("pushed"), F.count_if(passes).alias("muxed"), F.count_if(~passes).alias("dropped"), (F.sum(F.when(passes, 15 + F.col("size")).otherwise(0)) + 13).alias("bytes"), (F.max("dts") - F.max_by("pts", "seq")).alias("lag_ms"))


@query("SELECT s.stream_id, s.pushed, coalesce(round(CAST(t.rate_bps AS DOUBLE), 6), 0.0) AS rate_bps FROM (SELECT stream_id, count(*) AS pushed FROM q GROUP BY 1) s LEFT JOIN (SELECT stream_id, arg_max(rate_bps, seq) AS rate_bps FROM sp GROUP BY 1) t USING (stream_id)", GREEDY)
def a04_merged_statistics(spark, d):
    last = _sampled(spark, d).groupBy("stream_id").agg(F.max_by("rate_bps", "seq").alias("rate_bps"))
    return packets(spark, d).groupBy("stream_id").agg(F.count("*").alias("pushed")).join(last, "stream_id", "left").select("stream_id", "pushed", F.round(F.coalesce("rate_bps", F.lit(0.0)), 6).alias("rate_bps"))


@query(f"SELECT stream_id, seq, CAST(13 + sum(15 + size) {SOFAR} AS BIGINT) AS bytes_written FROM q")
def e06_bytes_written(spark, d):
    return packets(spark, d).select("stream_id", "seq", (13 + F.sum(15 + F.col("size")).over(ordering.so_far())).alias("bytes_written"))


@query("SELECT stream_id, batch_id, seq, coalesce(ord < min(CASE WHEN event_type = 'error' THEN ord END) OVER (PARTITION BY stream_id, batch_id), true) AS sent FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, batch_id ORDER BY dts, seq) AS ord FROM q)")
def f10_sent_prefix(spark, d):
    return ordering.sent_prefix(packets(spark, d), F.col("event_type") == "error").select("stream_id", "batch_id", "seq", "sent")


@query("SELECT stream_id, seq, session_no, CAST(row_number() OVER (PARTITION BY stream_id, session_no ORDER BY seq) AS INTEGER) AS pushed FROM (SELECT *, CAST(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM q)")
def f12_reset(spark, d):
    p = packets(spark, d).withColumn("session_no", F.count_if(F.col("event_type") == "purchase").over(ordering.so_far()))
    return p.select("stream_id", "seq", "session_no", F.row_number().over(Window.partitionBy("stream_id", "session_no").orderBy("seq")).alias("pushed"))


ACK = f"""n AS (SELECT stream_id, seq, i, CAST(sum(size) {SOFAR} AS BIGINT) AS received FROM o),
y AS (SELECT stream_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS received, CAST(0 AS BIGINT) AS last, false AS taken FROM n WHERE i = 1 UNION ALL
SELECT n.stream_id, n.seq, n.i, n.received, CASE WHEN n.received - y.last >= 50000 THEN n.received ELSE y.last END, n.received - y.last >= 50000 FROM y JOIN n ON n.stream_id = y.stream_id AND n.i = y.i + 1)"""


@query("SELECT stream_id, seq, received FROM y WHERE taken", ACK)
def f13_acknowledgements(spark, d):
    return lifecycle.acknowledged(packets(spark, d), 50_000)


@query("SELECT stream_id, seq, kind, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY dts, seq) AS INTEGER) AS ord FROM q")
def u01_interleave(spark, d):
    p = packets(spark, d)
    return ordering.interleave(p.where("kind = 'video'"), p.where("kind = 'audio'")).select("stream_id", "seq", "kind", "ord")


@query("SELECT stream_id, part, ord, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY part, ord) AS INTEGER) AS place FROM (SELECT DISTINCT stream_id, 0 AS part, CAST(0 AS BIGINT) AS ord FROM q UNION ALL SELECT DISTINCT stream_id, 1, CAST(0 AS BIGINT) FROM q UNION ALL SELECT stream_id, 2, seq FROM q WHERE is_key UNION ALL SELECT stream_id, 3, seq FROM q)")
def u02_headers_then_media(spark, d):
    p = packets(spark, d)
    zero, n = F.lit(0).cast("long").alias("ord"), lambda k: F.lit(k).alias("part")
    s = p.select("stream_id").distinct()
    rows = s.select("stream_id", n(0), zero).union(s.select("stream_id", n(1), zero)).union(p.where("is_key").select("stream_id", n(2), "seq")).union(p.select("stream_id", n(3), "seq"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("stream_id").orderBy("part", "ord")))


@query(f"SELECT stream_id, seq, last_value(CASE WHEN event_type = 'purchase' THEN size END IGNORE NULLS) {SOFAR} AS video_config, last_value(CASE WHEN event_type = 'signup' THEN size END IGNORE NULLS) {SOFAR} AS audio_config FROM q")
def u04_config_merge(spark, d):
    p = packets(spark, d).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("size"))).withColumn("a", F.when(F.col("event_type") == "signup", F.col("size")))
    return ordering.carry_last(ordering.carry_last(p, "v", "video_config"), "a", "audio_config").select("stream_id", "seq", "video_config", "audio_config")


@query("SELECT max(CASE WHEN alive THEN dts END) AS progress_ms, max(CASE WHEN slot = 0 THEN size END) AS bytes, arg_min(rtt, CASE WHEN alive AND rtt IS NOT NULL THEN slot END) AS rtt_ms FROM (SELECT event_id AS slot, event_id % 3 <> 1 AS alive, dts, size, CASE WHEN event_id % 5 = 4 THEN size END AS rtt FROM q)")
def k04_fanout_metrics(spark, d):
    return fanout_metrics(packets(spark, d).select(F.col("event_id").alias("slot"), (F.col("event_id") % 3 != 1).alias("alive"), F.col("dts").alias("progress_ms"), F.col("size").alias("bytes"), F.when(F.col("event_id") % 5 == 4, F.col("size")).alias("rtt_ms")))


@query("SELECT event_id, 'kind=' || kind || ', size=' || size || ', user=' || stream_id AS line FROM q")
def k15_log_line(spark, d):
    f = lambda k, v: F.struct(F.lit(k).alias("key"), F.col(v).cast("string").alias("value"))
    return packets(spark, d).select("event_id", scalars.flat_fields(F.array(f("kind", "kind"), f("size", "size"), f("user", "stream_id"))).alias("line"))


HEX = "upper(to_hex({0}))"


@query("SELECT event_id, CASE WHEN is_key THEN '09' ELSE '08' END || lpad(upper(to_hex(octet_length(encode(props)))), 6, '0') || lpad(upper(to_hex(size % 16777216)), 6, '0') || '00000000' || hex(encode(props)) || lpad(upper(to_hex(octet_length(encode(props)) + 11)), 8, '0') AS tag FROM q")
def e05_tag(spark, d):
    return packets(spark, d).select("event_id", F.hex(scalars.tag(F.when(F.col("is_key"), 9).otherwise(8), F.col("size"), F.col("props").cast("binary"))).alias("tag"))


@query("""SELECT event_id, '07' || lpad(upper(to_hex(size)), 6, '0') || lpad(upper(to_hex(n)), 6, '0') || '09' || '01000000' || substr(h, 1, 16) || CASE WHEN n > 8 THEN 'C7' || substr(h, 17, 16) ELSE '' END || CASE WHEN n > 16 THEN 'C7' || substr(h, 33, 16) ELSE '' END || CASE WHEN n > 24 THEN 'C7' || substr(h, 49, 16) ELSE '' END AS frames FROM (SELECT event_id, size, hex(encode(props)) AS h, octet_length(encode(props)) AS n FROM q)""")
def e07_message_chunks(spark, d):
    return packets(spark, d).select("event_id", F.hex(scalars.message(7, F.lit(9), F.lit(1), F.col("size"), F.col("props").cast("binary"), 8)).alias("frames"))


@query("SELECT event_id, lpad(upper(to_hex(octet_length(encode(event_type)))), 8, '0') || hex(encode(event_type)) || lpad(upper(to_hex(octet_length(encode(props)))), 8, '0') || hex(encode(props)) AS prefixed, '00000001' || hex(encode(event_type)) || '00000001' || hex(encode(props)) AS annex_b, ascii(event_type) % 32 AS unit_type, ascii(event_type) % 32 = 5 OR ascii(props) % 32 = 5 AS has_key FROM q")
def c06_units(spark, d):
    units = F.array(F.col("event_type").cast("binary"), F.col("props").cast("binary"))
    return packets(spark, d).select("event_id", F.hex(scalars.length_prefixed(units)).alias("prefixed"), F.hex(scalars.annex_b(units)).alias("annex_b"), scalars.nal_type(units[0]).cast("int").alias("unit_type"), scalars.has_keyframe(units).alias("has_key"))


@query("SELECT event_id, 2 AS n, hex(encode(event_type)) AS first, hex(encode(props)) AS last, true AS prefixed_same FROM q")
def c02_split_units(spark, d):
    units = F.array(F.col("event_type").cast("binary"), F.col("props").cast("binary"))
    back = codecs.split_units_col(scalars.annex_b(units))
    return packets(spark, d).select("event_id", F.size(back).alias("n"), F.hex(back[0]).alias("first"), F.hex(back[1]).alias("last"), (codecs.split_prefixed_col(scalars.length_prefixed(units)) == units).alias("prefixed_same"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 4 + 1 END AS object_type, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 16 END AS rate_index, CASE event_id % 16 WHEN 0 THEN 96000 WHEN 1 THEN 88200 WHEN 2 THEN 64000 WHEN 4 THEN 44100 WHEN 5 THEN 32000 WHEN 6 THEN 24000 WHEN 8 THEN 16000 WHEN 9 THEN 12000 WHEN 10 THEN 11025 WHEN 12 THEN 7350 END AS rate, CASE WHEN event_id % 4 = 3 THEN NULL ELSE lpad(upper(to_hex((event_id % 4) * 2048 + (event_id % 16) * 128 + 16)), 4, '0') END AS config FROM q")
def c13_adts(spark, d):
    x = F.col("event_id")
    third = F.shiftleft(x % 4, 6) + F.shiftleft(x % 16, 2)
    data = F.concat(F.when(x % 4 == 3, F.lit(b"\xfe\xf1")).otherwise(F.lit(b"\xff\xf1")), scalars.be(third, 1), F.lit(b"\x80\x01\x00\x00"), F.col("props").cast("binary"))
    head = scalars.adts(data)
    return packets(spark, d).select("event_id", head["object_type"].cast("long").alias("object_type"), head["rate_index"].cast("long").alias("rate_index"), scalars.sample_rate(head["rate_index"]).alias("rate"), F.hex(scalars.audio_config(head)).alias("config"))


@query("SELECT event_id, event_type AS name, CAST(event_id AS DOUBLE) AS txn, event_type AS code, CAST(size AS DOUBLE) AS size FROM q")
def j03_values(spark, d):
    make = codecs.column(lambda t, n, s: codecs.encode_value(t) + codecs.encode_value(float(n)) + codecs.encode_value([("code", t), ("size", s), ("ok", True)]), "binary")
    v = F.parse_json(codecs.values_json_col(make("event_type", "event_id", "size")))
    return packets(spark, d).select("event_id", F.try_variant_get(v, "$[0]", "string").alias("name"), F.try_variant_get(v, "$[1]", "double").alias("txn"), F.try_variant_get(v, "$[2].code", "string").alias("code"), F.try_variant_get(v, "$[2].size", "double").alias("size"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM q")
def j04_field(spark, d):
    return packets(spark, d).select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT a.stream_id, a.event_id, min(b.dts) - min(a.dts) AS rtt_ms FROM q a JOIN q b ON b.stream_id = a.stream_id AND b.event_type = 'view' AND a.event_type = 'click' AND b.size % 50 = a.size % 50 AND b.dts > a.dts GROUP BY 1, 2")
def h06_round_trips(spark, d):
    p = packets(spark, d).select("stream_id", "event_id", "event_type", "dts", (F.col("size") % 50).alias("echo"))
    # from the end on, the earliest answer so far is the first one after a row
    later = Window.partitionBy("stream_id", "echo").orderBy(F.desc("dts")).rangeBetween(Window.unboundedPreceding, -1)
    back = F.min(F.when(F.col("event_type") == "view", F.col("dts"))).over(later)
    return p.withColumn("back", back).where("event_type = 'click' and back is not null").select("stream_id", "event_id", (F.col("back") - F.col("dts")).alias("rtt_ms"))


@query("SELECT event_id, kind, size AS dts, size + CASE WHEN kind = 'video' THEN pts - dts ELSE 0 END AS pts, kind = 'video' AND is_key AS is_key, CASE WHEN kind = 'video' THEN '00000001' ELSE '' END || hex(encode(props)) AS data FROM q")
def c18_tag_round_trip(spark, d):
    video = F.col("kind") == "video"
    payload = F.col("props").cast("binary")
    body = F.when(video, scalars.video_body(F.col("is_key"), F.col("pts") - F.col("dts"), scalars.length_prefixed(F.array(payload)))).otherwise(scalars.audio_body(payload))
    p = packets(spark, d).select("*", codecs.decode_tag_col(F.when(video, 9).otherwise(8), F.col("size"), body).alias("t"))
    return p.select("event_id", "t.kind", "t.dts", "t.pts", "t.is_key", F.hex("t.data").alias("data"))


def _u32(x: str) -> str:
    return f"lpad(upper(to_hex(CAST({x} AS BIGINT))), 8, '0')"


#: A track's part of a fragment header, and its share of the payloads, in hex.
_TRAF = GRID + f""", x0 AS (SELECT sm2.*, hex(encode(props)) AS h, octet_length(encode(props)) AS n, sm2.kind = 'audio' OR sm2.is_key AS sync FROM sm2 JOIN q ON q.stream_id = sm2.stream_id AND q.seq = sm2.seq),
x1 AS (SELECT stream_id, segment_no, kind, count(*) AS k, CAST(sum(n) AS BIGINT) AS bytes, string_agg(h, '' ORDER BY seq) AS payload,
  string_agg({_u32('duration')} || {_u32('n')} || CASE WHEN sync THEN '02000000' ELSE '01010000' END || {_u32("CASE WHEN kind = 'video' THEN (cts * 90 + 4294967296) % 4294967296 ELSE 0 END")}, '' ORDER BY seq) AS rows FROM x0 GROUP BY 1, 2, 3),
x2 AS (SELECT x1.*, g2.base, sum(64 + 16 * k) OVER w + 24 AS moof, coalesce(sum(bytes) OVER (PARTITION BY x1.stream_id, x1.segment_no ORDER BY x1.kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x1 JOIN g2 ON g2.stream_id = x1.stream_id AND g2.segment_no = x1.segment_no AND g2.kind = x1.kind WINDOW w AS (PARTITION BY x1.stream_id, x1.segment_no)),
x3 AS (SELECT stream_id, segment_no, any_value(moof) AS moof, CAST(sum(bytes) AS BIGINT) AS bytes, string_agg(payload, '' ORDER BY kind DESC) AS payload,
  string_agg({_u32('64 + 16 * k')} || '74726166' || '00000010' || '74666864' || '00020000' || CASE WHEN kind = 'video' THEN '00000001' ELSE '00000002' END || '00000014' || '74666474' || '01000000' || lpad(upper(to_hex(CAST(base AS BIGINT))), 16, '0') || {_u32('20 + 16 * k')} || '7472756E' || '01000F01' || {_u32('k')} || {_u32('moof + 8 + before')} || rows, '' ORDER BY kind DESC) AS tracks FROM x2 GROUP BY 1, 2),
x4 AS (SELECT stream_id, segment_no, '00000018737479706973' || '6F350000020069736F3569736F36' || {_u32('moof')} || '6D6F6F66' || '00000010' || '6D666864' || '00000000' || {_u32('segment_no')} || tracks || {_u32('bytes + 8')} || '6D646174' || payload AS h FROM x3)"""


def _with_payloads(spark, d):
    return _samples(spark, d).join(packets(spark, d).select("stream_id", "seq", F.col("props").cast("binary").alias("data")), ["stream_id", "seq"])


@query("SELECT stream_id, segment_no, CAST(length(h) // 2 AS BIGINT) AS bytes, sha256(unhex(h)) AS digest FROM x4", _TRAF)
def c20_segment_bytes(spark, d):
    """Each segment's bytes: sizes and digests."""
    rows = _with_payloads(spark, d)
    made = segments.segment_bytes(rows, segments.decode_grid(_samples(spark, d)))
    return made.select("stream_id", "segment_no", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("digest"))
