"""Scalar functions over packet and telemetry columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Connection states and log levels by number; unknown numbers are the first state and "info".
STATES = ("idle", "connected", "reconnecting", "exhausted", "finished")
LEVELS = ("error", "warn", "info", "debug", "trace")


def be(value: Column, size: int) -> Column:
    """An unsigned number as big-endian bytes, cut to `size` bytes."""
    mask = (1 << (8 * size)) - 1
    number = value.cast("long") if size >= 8 else value.cast("long").bitwiseAND(F.lit(mask))
    return F.unhex(F.lpad(F.hex(number), 2 * size, "0"))


def be_read(data: Column, at: int, size: int) -> Column:
    """Big-endian bytes as a number; `at` counts from 0."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def byte(data: Column, at: int) -> Column:
    return be_read(data, at, 1)


def header_time(last: Column) -> Column:
    """The time of headers between packets."""
    return F.greatest(F.coalesce(last, F.lit(0)), F.lit(0))


def latency(now: Column, pts: Column) -> Column:
    return now - pts


def sample_flags(depends_on: Column, sync: Column) -> Column:
    return F.shiftleft(depends_on.bitwiseAND(F.lit(3)).cast("long"), 24) + F.when(sync, 0).otherwise(65536)


def wall_clock() -> Column:
    """The time of the query in milliseconds."""
    return F.unix_millis(F.current_timestamp())


def hmac_sha256(key: bytes, data: Column) -> Column:
    """A keyed hash with a fixed key, as two nested hashes."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), data), 256))), 256))


def packed_language(code: Column) -> Column:
    """A three-letter code as three 5-bit numbers."""
    bits = [F.ascii(F.substring(code, i, 1)).cast("long").bitwiseAND(F.lit(31)) for i in (1, 2, 3)]
    return F.shiftleft(bits[0], 10) + F.shiftleft(bits[1], 5) + bits[2]


def by_number(number: Column, names: tuple[str, ...], other: str) -> Column:
    out = F.lit(other)
    for i, n in enumerate(names):
        out = F.when(number == i, n).otherwise(out)
    return out


def state_name(number: Column) -> Column:
    return by_number(number, STATES, STATES[0])


def level_name(number: Column) -> Column:
    return by_number(number, LEVELS, "info")


def level_enabled(level: Column, most: Column | int) -> Column:
    return level <= most


def capped_error(text: Column, most: int = 512) -> Column:
    return F.substring(text, 1, most)


def command_error(operation: Column, code: Column, description: Column) -> Column:
    return F.format_string("server rejected `%s`: %s: %s", operation, F.coalesce(code, F.lit("unknown")), F.coalesce(description, F.lit("")))


def flat_fields(fields: Column) -> Column:
    """array<struct<key, value>> as "key=value" parts."""
    return F.array_join(F.transform(fields, lambda f: F.concat(f["key"], F.lit("="), f["value"])), ", ")


def first_field(fields: Column, key: str) -> Column:
    """The value of the first field with a key."""
    return F.try_element_at(F.filter(fields, lambda f: f["key"] == key), F.lit(1))["value"]


def destination(url: Column, app: Column, key: Column) -> Column:
    """struct(valid, host, port) of rtmp://host[:port]: no path, a port of 16
    bits (1935 if none is given), app and key that aren't blank."""
    rest = F.regexp_extract(url, r"^rtmp://(.*)$", 1)
    host = F.regexp_extract(rest, r"^(.*?)(?::[^:]*)?$", 1)
    given = F.regexp_extract(rest, r":([^:]*)$", 1)
    port = F.when(rest.contains(":"), F.when(given.rlike(r"^\+?[0-9]+$"), F.try_to_number(F.regexp_replace(given, r"^\+", ""), F.lit("99999999999999999999")).cast("long"))).otherwise(F.lit(1935).cast("long"))
    full = F.coalesce
    valid = full(url.startswith("rtmp://"), F.lit(False)) & (rest != "") & ~rest.contains("/") & (host != "") & full(port.between(0, 65535), F.lit(False)) & (F.trim(full(app, F.lit(""))) != "") & (F.trim(full(key, F.lit(""))) != "")
    return F.struct(valid.alias("valid"), F.when(valid, host).alias("host"), F.when(valid, port).alias("port"))


# -- container bytes ------------------------------------------------------------------

FILE_HEADER = bytes.fromhex("464c5601050000000900000000")
AUDIO, VIDEO, SCRIPT = 8, 9, 18


def tag(kind: Column, ts: Column, body: Column) -> Column:
    """A container tag: kind, size, time with its extension byte, stream 0, body, size before."""
    n = F.octet_length(body)
    return F.concat(be(kind, 1), be(n, 3), be(ts, 3), be(F.shiftright(ts.cast("long"), 24), 1), F.unhex(F.lit("000000")), body, be(n + 11, 4))


def video_body(is_key: Column, cts: Column, payload: Column) -> Column:
    return F.concat(be(F.when(is_key, 0x17).otherwise(0x27), 1), F.unhex(F.lit("01")), be(cts, 3), payload)


def audio_body(payload: Column) -> Column:
    return F.concat(F.unhex(F.lit("AF01")), payload)


def video_config_tag(ts: Column, config: Column) -> Column:
    return tag(F.lit(VIDEO), ts, F.concat(F.unhex(F.lit("1700000000")), config))


def audio_config_tag(ts: Column, config: Column) -> Column:
    return tag(F.lit(AUDIO), ts, F.concat(F.unhex(F.lit("AF00")), config))


def message(cid: int, kind: Column, stream: Column, ts: Column, payload: Column, chunk: int = 128) -> Column:
    """A message as chunks: a full header, then headers of one byte.  Times of 24
    bits or more are extended, in the first chunk only."""
    n = F.octet_length(payload)
    little = F.concat(*[be(F.shiftright(stream.cast("long"), 8 * i), 1) for i in range(4)])
    long_time = ts >= 0xFFFFFF
    head = F.concat(F.lit(bytes([cid])), be(F.when(long_time, 0xFFFFFF).otherwise(ts), 3), be(n, 3), be(kind, 1), little, F.when(long_time, be(ts, 4)).otherwise(F.lit(b"")))
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(chunk))
    parts = F.transform(starts, lambda i: F.call_function("substring", payload, i, F.lit(chunk)))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.when(F.octet_length(a) == 0, p).otherwise(F.concat(a, F.lit(bytes([0xC0 | cid])), p)))
    return F.concat(head, joined)


def length_prefixed(nals: Column) -> Column:
    return F.aggregate(nals, F.lit(b""), lambda a, n: F.concat(a, be(F.octet_length(n), 4), n))


def annex_b(nals: Column) -> Column:
    return F.aggregate(nals, F.lit(b""), lambda a, n: F.concat(a, F.unhex(F.lit("00000001")), n))


def nal_type(nal: Column) -> Column:
    return byte(nal, 0).bitwiseAND(F.lit(31))


def has_keyframe(nals: Column) -> Column:
    return F.exists(nals, lambda n: nal_type(n) == 5)


#: The sampling rates that audio headers refer to by index.
SAMPLE_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def sample_rate(index: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, SAMPLE_RATES)), index.cast("int") + 1)


def adts(data: Column) -> Column:
    """struct(object_type, rate_index, channels, frame_length, header_length) of an
    ADTS header; null if there is none."""
    b = [F.coalesce(byte(data, i), F.lit(0)) for i in range(6)]
    header = F.when(b[1].bitwiseAND(F.lit(1)) == 1, 7).otherwise(9)
    ok = (F.octet_length(data) >= header) & (b[0] == 255) & (b[1].bitwiseAND(F.lit(0xF0)) == 0xF0)
    fields = F.struct(
        (F.shiftright(b[2], 6) + 1).alias("object_type"),
        F.shiftright(b[2], 2).bitwiseAND(F.lit(15)).alias("rate_index"),
        (F.shiftleft(b[2].bitwiseAND(F.lit(1)), 2) + F.shiftright(b[3], 6)).alias("channels"),
        (F.shiftleft(b[3].bitwiseAND(F.lit(3)), 11) + F.shiftleft(b[4], 3) + F.shiftright(b[5], 5)).alias("frame_length"),
        header.alias("header_length"),
    )
    return F.when(ok, fields)


def audio_config(header: Column) -> Column:
    """Two bytes from an ADTS header's struct; they hold the object type less 1."""
    first = F.shiftleft((header["object_type"] - 1).bitwiseAND(F.lit(31)), 3) + F.shiftright(header["rate_index"], 1).bitwiseAND(F.lit(7))
    second = F.shiftleft(header["rate_index"].bitwiseAND(F.lit(1)), 7) + F.shiftleft(header["channels"].bitwiseAND(F.lit(15)), 3)
    return F.concat(be(first, 1), be(second, 1))


def audio_config_fields(data: Column) -> Column:
    a, b = byte(data, 0), byte(data, 1)
    fields = F.struct((F.shiftright(a, 3) + 1).alias("object_type"), (F.shiftleft(a.bitwiseAND(F.lit(7)), 1) + F.shiftright(b, 7)).alias("rate_index"), F.shiftright(b, 3).bitwiseAND(F.lit(15)).alias("channels"))
    return F.when(F.octet_length(data) >= 2, fields)


def audio_params(config: Column) -> Column:
    """struct(rate, channels) of two configuration bytes, at least one channel;
    null if they are too short or name no rate."""
    fields = audio_config_fields(config)
    rate = sample_rate(fields["rate_index"])
    return F.when(rate.isNotNull(), F.struct(rate.alias("rate"), F.greatest(fields["channels"], F.lit(1)).alias("channels")))


def without_adts(data: Column) -> Column:
    head = adts(data)
    return F.when(head.isNotNull(), F.call_function("substring", data, head["header_length"] + 1, F.octet_length(data))).otherwise(data)
