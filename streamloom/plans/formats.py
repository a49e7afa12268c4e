"""Queries of byte formats: configurations, tags, files and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs, scalars
from ..operators import ordering, segments
from ..sources import containers
from ..sources.packets import packets
from .queries import SAMPLES, SOFAR, TARGET, _samples, _with_payloads, query

B1 = "lpad(upper(to_hex(event_id % 200 + 1)), 2, '0')"
_SETS = f"'01' || {B1} || '010A' || 'FFE1' || '0004' || '67' || {B1} || '010A' || '01' || '0004' || '68CE3C80'"


@query(f"SELECT event_id, {_SETS} AS config, '67' || {B1} || '010A' AS sps, '68CE3C80' AS pps FROM q")
def c03_parameter_sets(spark, d):
    """The sets inside a key frame, as a configuration, and back."""
    hexed = lambda s: F.unhex(F.lit(s))
    sps = F.concat(hexed("67"), scalars.be(F.col("event_id") % 200 + 1, 1), hexed("010A"))
    data = scalars.annex_b(F.array(sps, hexed("68CE3C80"), F.concat(hexed("6588"), F.col("props").cast("binary"))))
    p = packets(spark, d).select("event_id", codecs.config_of_col(data).alias("config"))
    p = p.withColumn("sets", codecs.sets_of_config_col("config"))
    return p.select("event_id", F.hex("config").alias("config"), F.hex("sets.sps").alias("sps"), F.hex("sets.pps").alias("pps"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 320 ELSE 0 END AS width, CASE WHEN event_id % 3 = 0 THEN 240 ELSE 0 END AS height FROM q")
def c21_dimensions(spark, d):
    """The size of pictures by their configuration; zeros if it doesn't tell."""
    config = lambda sps: codecs.video_config(bytes.fromhex(sps), bytes.fromhex("68CE3C80"))
    x = F.col("event_id") % 3
    c = F.when(x == 0, F.lit(config("6742C01EF40A0FC8"))).when(x == 1, F.lit(config("67"))).otherwise(F.lit(b"\x01"))
    p = packets(spark, d).select("event_id", codecs.size_of_config_col(c).alias("s"))
    return p.select("event_id", F.col("s.width").cast("int").alias("width"), F.col("s.height").cast("int").alias("height"))


_RATES = ", ".join(map(str, scalars.SAMPLE_RATES))


@query(f"SELECT event_id, event_id % 31 + 1 AS object_type, event_id % 16 AS rate_index, event_id % 8 AS channels, list_extract([{_RATES}], CAST(event_id % 16 + 1 AS INTEGER)) AS rate, CASE WHEN event_id % 16 < 13 THEN greatest(event_id % 8, 1) END AS used FROM q")
def c14_audio_config(spark, d):
    x = F.col("event_id")
    config = scalars.be((x % 31) * 2048 + (x % 16) * 128 + (x % 8) * 8, 2)
    f, a = scalars.audio_config_fields(config), scalars.audio_params(config)
    return packets(spark, d).select("event_id", f["object_type"].alias("object_type"), f["rate_index"].alias("rate_index"), f["channels"].alias("channels"), a["rate"].alias("rate"), a["channels"].alias("used"))


@query("SELECT event_id, hex(encode(props)) AS raw FROM q")
def c15_without_header(spark, d):
    x, props = F.col("event_id") % 3, F.col("props").cast("binary")
    head = F.when(x == 0, F.lit(bytes.fromhex("FFF150800140FC"))).when(x == 1, F.lit(bytes.fromhex("FFF050800140FC0000"))).otherwise(F.lit(b""))
    return packets(spark, d).select("event_id", F.hex(scalars.without_adts(F.concat(head, props))).alias("raw"))


def _tag(kind: str, ts: str, body: str) -> str:
    return f"'{kind}' || lpad(upper(to_hex(length({body}) // 2)), 6, '0') || lpad(upper(to_hex({ts})), 6, '0') || '00000000' || {body} || lpad(upper(to_hex(length({body}) // 2 + 11)), 8, '0')"


@query(f"SELECT event_id, {_tag('09', 'size', chr(40) + chr(39) + '1700000000' + chr(39) + ' || hex(encode(props)))')} AS video, {_tag('08', 'size', chr(40) + chr(39) + 'AF00' + chr(39) + ' || hex(encode(props)))')} AS audio FROM q")
def e03_sequence_tags(spark, d):
    data = F.col("props").cast("binary")
    return packets(spark, d).select("event_id", F.hex(scalars.video_config_tag(F.col("size"), data)).alias("video"), F.hex(scalars.audio_config_tag(F.col("size"), data)).alias("audio"))


@query("SELECT event_id, '02000D' || hex(encode('@setDataFrame')) || '02000A' || hex(encode('onMetaData')) || hex(encode(props)) AS body FROM q")
def e08_live_metadata(spark, d):
    make = codecs.column(lambda p: codecs.publish_metadata(codecs.encode_value("onMetaData") + p), "binary")
    return packets(spark, d).select("event_id", F.hex(make(F.col("props").cast("binary"))).alias("body"))


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 8 ELSE 772 END AS place, CAST(NULL AS INTEGER) AS foreign_place, true AS echoed, 1536 AS size, lpad(upper(to_hex(xor(xor(size, event_id), {codecs.SEED_MIX & 0xFFFFFFFF}))), 8, '0') AS time FROM q")
def h01_signed_blocks(spark, d):
    """First blocks of clients: where their digest is, by their key and another, and what a server echoes."""

    def run(time, seed):
        place = codecs.PLACES[seed % 2]
        block = codecs.signed_block(time, seed, codecs.CLIENT_KEY, place)
        reply = codecs.server_reply(block)
        echoed = reply[place : place + codecs.DIGEST] == block[place : place + codecs.DIGEST] and not any(reply[place + codecs.DIGEST :])
        return {"place": codecs.digest_at(block, codecs.CLIENT_KEY), "foreign_place": codecs.digest_at(block, codecs.SERVER_KEY), "echoed": echoed, "size": len(block), "time": reply[:4].hex().upper()}

    made = codecs.column(run, "struct<place: int, foreign_place: int, echoed: boolean, size: int, time: string>")
    return packets(spark, d).select("event_id", made("size", "event_id").alias("b")).select("event_id", "b.*")


def _files(spark, d, piece, head=b""):
    """One file of a stream's batch: head and the pieces of its packets, in order."""
    rows = packets(spark, d).select("stream_id", "batch_id", F.struct("seq", piece.alias("x")).alias("r"))
    each = rows.groupBy("stream_id", "batch_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return each.select("stream_id", "batch_id", F.aggregate("r", F.lit(head), lambda a, x: F.concat(a, x["x"])).alias("content"))


_ORD = "row_number() OVER (PARTITION BY stream_id, batch_id ORDER BY seq) - 1"


@query(f"SELECT stream_id, batch_id, {_ORD} AS ord, CASE WHEN kind = 'video' THEN 9 ELSE 8 END AS kind, size AS ts, octet_length(encode(props)) AS n, true AS same FROM q")
def s04_file_tags(spark, d):
    """Files of tags, read whole and in pieces of seven bytes."""
    kind = F.when(F.col("kind") == "video", 9).otherwise(8)

    def walk(data):
        p = containers.TagParser()
        pieces = [t for i in range(0, len(data), 7) for t in p.feed(data[i : i + 7])]
        whole = list(containers.file_tags(data))
        return [(k, ts, len(body), pieces[i] == (k, ts, body)) for i, (k, ts, body) in enumerate(whole)]

    made = _files(spark, d, scalars.tag(kind, F.col("size"), F.col("props").cast("binary")), scalars.FILE_HEADER)
    return containers.each_file(made, walk, "kind int, ts long, n int, same boolean")


@query(f"SELECT stream_id * 100000 + batch_id AS conn_id, {_ORD} AS ord, CASE WHEN kind = 'video' THEN 9 ELSE 8 END AS kind, size AS ts, octet_length(encode(props)) AS n FROM q")
def s05_messages(spark, d):
    """Connections whose messages are cut into chunks of 128 bytes."""
    kind = F.when(F.col("kind") == "video", 9).otherwise(8)
    made = _files(spark, d, scalars.message(7, kind, F.lit(1), F.col("size"), F.col("props").cast("binary")))
    capture = made.select((F.col("stream_id") * 100000 + F.col("batch_id")).alias("conn_id"), F.lit(0).cast("long").alias("offset"), F.col("content").alias("bytes"))
    return containers.read_messages(capture).select("conn_id", "ord", "kind", "ts", F.octet_length("payload").alias("n"))


@query(f"SELECT stream_id, batch_id, {_ORD} AS ord, ({_ORD}) * 23 AS pts, octet_length(encode(props)) + 7 AS n FROM q")
def s13_audio_file(spark, d):
    props = F.col("props").cast("binary")
    n = (F.octet_length(props) + 7).cast("long")
    head = F.concat(F.unhex(F.lit("FFF150")), scalars.be(128 + F.shiftright(n, 11), 1), scalars.be(F.shiftright(n, 3), 1), scalars.be(F.shiftleft(n.bitwiseAND(F.lit(7)), 5), 1), F.unhex(F.lit("FC")))
    return containers.each_file(_files(spark, d, F.concat(head, props)), lambda data: [(t, len(f)) for t, f in containers.audio_frames(data)], "pts int, n int")


@query("SELECT stream_id, batch_id, ord, CAST(floor(ord * 1000.0 / 15) AS INTEGER) AS pts, unit_type = 5 AS is_key, n FROM (SELECT stream_id, batch_id, row_number() OVER (PARTITION BY stream_id, batch_id ORDER BY seq) - 1 AS ord, event_id % 8 AS unit_type, octet_length(encode(props)) + 5 AS n FROM q WHERE event_id % 8 BETWEEN 1 AND 5)")
def s14_video_file(spark, d):
    unit = F.concat(F.unhex(F.lit("00000001")), scalars.be(96 + F.col("event_id") % 8, 1), F.col("props").cast("binary"))
    return containers.each_file(_files(spark, d, unit), lambda data: [(t, key, len(u)) for t, key, u in containers.video_frames(data)], "pts int, is_key boolean, n int")


@query(f"""SELECT stream_id, seq, what, last_value(CASE WHEN what = 'video_config' THEN h END IGNORE NULLS) {SOFAR} AS video_config, last_value(CASE WHEN what = 'audio_config' THEN h END IGNORE NULLS) {SOFAR} AS audio_config
FROM (SELECT stream_id, seq, CASE event_id % 5 WHEN 0 THEN 'video_config' WHEN 1 THEN 'audio_config' ELSE 'packet' END AS what, hex(encode(props)) AS h FROM q WHERE event_id % 5 <> 2)""")
def s10_dispatch(spark, d):
    """Media messages by what they hold; those that can't be decoded are skipped, configurations merge."""
    x, props = F.col("event_id") % 5, F.col("props").cast("binary")
    video = scalars.video_body(F.col("is_key"), F.lit(0), scalars.length_prefixed(F.array(props)))
    body = F.when(x == 0, F.concat(F.unhex(F.lit("1700000000")), props)).when(x == 1, F.concat(F.unhex(F.lit("AF00")), props)).when(x == 2, F.lit(b"\x22\x01")).when(x == 3, video).otherwise(scalars.audio_body(props))
    kind = F.when(x.isin(0, 2, 3), 9).otherwise(8)
    p = packets(spark, d).select("stream_id", "seq", codecs.decode_tag_col(kind, "size", body).alias("t")).where("t is not null")
    for c in ("video_config", "audio_config"):
        p = ordering.carry_last(p.withColumn("own", F.when(F.col("t.what") == c, F.hex("t.data"))), "own", c)
    return p.select("stream_id", "seq", F.col("t.what").alias("what"), "video_config", "audio_config")


_INIT = codecs.init_segment((codecs.video_config(bytes.fromhex("6742000A"), bytes.fromhex("68CE3C80")), 320, 240), (b"\x12\x10", 44_100, 2, 128_000))


@query(f"""SELECT stream_id, 'init.mp4' AS name, {len(_INIT)} AS n FROM sl GROUP BY 1
UNION ALL SELECT stream_id, 'seg' || segment_no || '.m4s', n FROM (SELECT stream_id, segment_no, CAST(24 + 24 + sum(64 + 16 * k) + 8 + sum(bytes) AS BIGINT) AS n FROM (
  SELECT sm2.stream_id, segment_no, sm2.kind, count(*) AS k, sum(octet_length(encode(props))) AS bytes FROM sm2 JOIN q ON q.stream_id = sm2.stream_id AND q.seq = sm2.seq GROUP BY 1, 2, 3) GROUP BY 1, 2)
  JOIN (SELECT stream_id, max(segment_no) AS m FROM sl GROUP BY 1) USING (stream_id) WHERE segment_no > m - 6
UNION ALL SELECT stream_id, 'playlist.m3u8', octet_length(encode('#EXTM3U' || '#EXT-X-VERSION:7' || '#EXT-X-TARGETDURATION:' || greatest({TARGET // 1000}, (longest_ms + 999) // 1000, 1) || '#EXT-X-MEDIA-SEQUENCE:' || (segment_no + 1 - len(lines)) || '#EXT-X-INDEPENDENT-SEGMENTS' || '#EXT-X-MAP:URI="init.mp4"' || array_to_string(lines, '') || '#EXT-X-ENDLIST')) + 7
FROM (SELECT *, list('#EXTINF:' || (duration_ms // 1000) || '.000,' || 'seg' || segment_no || '.m4s..') OVER (PARTITION BY stream_id ORDER BY segment_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lines, row_number() OVER (PARTITION BY stream_id ORDER BY segment_no DESC) AS r FROM sl) WHERE r = 1""", SAMPLES)
def k14_segment_files(spark, d):
    """The files that a finished stream leaves: start, retained segments, playlist."""
    made = segments.files(_with_payloads(spark, d), _INIT, TARGET // 1000, timed=_samples(spark, d))
    return made.select("stream_id", "name", F.octet_length("data").alias("n"))
