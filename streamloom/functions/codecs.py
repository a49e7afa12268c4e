"""Byte formats that expressions can't parse: plain functions, and Arrow UDFs of them.

All functions are total: malformed input gives None (null).
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

# -- video units ----------------------------------------------------------------------

# a three-byte start code counts only if something follows it
_START = re.compile(rb"(?:\x00\x00\x01(?=.)|\x00\x00\x00\x01)+", re.S)


def split_units(data: bytes) -> list[bytes]:
    """The units between start codes, without the zeros that pad them."""
    marks = list(_START.finditer(data))
    out = [data[a.end() : b.start()].rstrip(b"\0") for a, b in zip(marks, marks[1:], strict=False)]
    if marks:
        tail = data[marks[-1].end() :].rstrip(b"\0")
        for code in (b"\0\0\1", b"\0\0\0\1"):
            while tail.endswith(code):
                tail = tail[: -len(code)]
        out.append(tail)
    return [x for x in out if x]


def parameter_sets(units: list[bytes]) -> tuple[bytes, bytes] | None:
    """The last SPS and PPS up to where both are known."""
    found: dict[int, bytes] = {}
    for u in units:
        if u[0] & 31 in (7, 8):
            found[u[0] & 31] = u
        if len(found) == 2:
            return found[7], found[8]
    return None


def video_config(sps: bytes, pps: bytes) -> bytes:
    profile = bytes(sps[i] if i < len(sps) else d for i, d in ((1, 0x64), (2, 0), (3, 0x1F)))
    return b"\1" + profile + b"\xff\xe1" + struct.pack(">H", len(sps) & 0xFFFF) + sps + b"\1" + struct.pack(">H", len(pps) & 0xFFFF) + pps


def config_of(data: bytes) -> bytes | None:
    sets = parameter_sets(split_units(data))
    return video_config(*sets) if sets else None


def join_prefixed(units: list[bytes]) -> bytes:
    return b"".join(struct.pack(">I", len(u)) + u for u in units)


def split_prefixed(data: bytes) -> list[bytes] | None:
    at, out = 0, []
    while at < len(data):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if n == 0 or at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def join_units(units: list[bytes]) -> bytes:
    return b"".join(b"\0\0\0\1" + u for u in units)


def sets_of_config(config: bytes) -> tuple[bytes, bytes] | None:
    """The first SPS and PPS of a configuration record."""
    if len(config) < 7 or config[0] != 1:
        return None
    at, got = 5, []
    for mask in (31, 255):
        if at >= len(config):
            return None
        count, at, first = config[at] & mask, at + 1, None
        for _ in range(count):
            if at + 2 > len(config):
                return None
            n = int.from_bytes(config[at : at + 2], "big")
            unit = config[at + 2 : at + 2 + n]
            if len(unit) < n:
                return None
            first, at = first if first is not None else unit, at + 2 + n
        if first is None:
            return None
        got.append(first)
    return got[0], got[1]


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise EOFError
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while self.take(1) == 0:
            zeros += 1
            if zeros > 31:
                raise EOFError
        return (1 << zeros) - 1 + self.take(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


#: The profiles whose parameter sets carry chroma and scaling fields.
HIGH_PROFILES = (100, 110, 122, 244, 44, 83, 86, 118, 128)


def _dimensions(sps: bytes) -> tuple[int, int] | None:
    b = _Bits(sps)
    if b.take(8) & 31 != 7:
        return None
    profile = b.take(8)
    b.take(16)
    b.ue()
    chroma = 1
    if profile in HIGH_PROFILES:
        chroma = b.ue()
        if chroma == 3:
            b.take(1)
        b.ue()
        b.ue()
        b.take(1)
        if b.take(1):
            for i in range(12 if chroma == 3 else 6):
                if b.take(1):
                    last = now = 8
                    for _ in range(16 if i < 6 else 64):
                        if now:
                            now = (last + b.se()) % 256
                        last = now or last
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.take(1)
        b.se()
        b.se()
        cycle = b.ue()
        if cycle > 255:
            return None
        for _ in range(cycle):
            b.se()
    b.ue()
    b.take(1)
    columns, rows = b.ue() + 1, b.ue() + 1
    frames = b.take(1)
    if not frames:
        b.take(1)
    b.take(1)
    left = right = top = bottom = 0
    if b.take(1):
        left, right, top, bottom = b.ue(), b.ue(), b.ue(), b.ue()
    across = 2 if chroma in (1, 2) else 1
    down = (2 - frames) * (2 if chroma == 1 else 1)
    w, h = 16 * columns - (left + right) * across, 16 * rows * (2 - frames) - (top + bottom) * down
    return (w, h) if 0 < w < 1 << 32 and 0 < h < 1 << 32 else None


def dimensions(sps: bytes) -> tuple[int, int] | None:
    """Width and height of a picture by its SPS."""
    try:
        return _dimensions(sps)
    except EOFError:
        return None


def dimensions_of_config(config: bytes | None) -> tuple[int, int]:
    """Width and height by a configuration record; zeros if it doesn't tell."""
    sets = sets_of_config(config) if config else None
    return (dimensions(sets[0]) if sets else None) or (0, 0)


def decode_tag(kind: int, ts: int, body: bytes) -> dict | None:
    """A container tag's body as a configuration or a packet; other codecs and kinds are None."""
    if kind == 9 and len(body) >= 5 and body[0] & 15 == 7:
        payload = body[5:]
        if body[1] == 0 and payload:
            return {"what": "video_config", "data": payload}
        if body[1] == 1 and (units := split_prefixed(payload)):
            offset = int.from_bytes(body[2:5], "big", signed=True)
            return {"what": "packet", "kind": "video", "dts": ts, "pts": ts + offset, "is_key": body[0] >> 4 == 1, "data": join_units(units)}
    elif kind == 8 and len(body) >= 2 and body[0] >> 4 == 10:
        if body[1] == 0 and len(body) > 2:
            return {"what": "audio_config", "data": body[2:]}
        if body[1] == 1:
            return {"what": "packet", "kind": "audio", "dts": ts, "pts": ts, "is_key": False, "data": body[2:]}
    return None


# -- typed values of the command protocol ---------------------------------------------

MOST_DEPTH = 64


def encode_value(v) -> bytes:
    """A value by its Python type; a list of (key, value) pairs is an object and
    a tuple of pairs an ordered array with a count."""
    text = lambda s: struct.pack(">H", len(s.encode()) & 0xFFFF) + s.encode()
    if v is None:
        return b"\x05"
    if isinstance(v, bool):
        return b"\x01" + bytes([v])
    if isinstance(v, (int, float)):
        return b"\x00" + struct.pack(">d", v)
    if isinstance(v, str):
        return b"\x02" + text(v)
    pairs = b"".join(text(k) + encode_value(x) for k, x in v) + b"\0\0\x09"
    return (b"\x08" + struct.pack(">I", len(v)) if isinstance(v, tuple) else b"\x03") + pairs


UNDEFINED = object()


class _Values:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise EOFError
        self.at += n
        return got

    def pairs(self, count: int | None, depth: int) -> list:
        out = []
        while count is None or len(out) < count:
            n = int.from_bytes(self.take(2), "big")
            if n == 0 and self.data[self.at : self.at + 1] == b"\x09":
                self.at += 1
                return out
            key = self.take(n).decode("utf-8", "replace")
            out.append((key, self.value(depth + 1)))
        self.take(2)
        self.at += 1
        return out

    def value(self, depth: int = 0):
        kind = self.take(1)[0]
        if depth > MOST_DEPTH:
            raise EOFError
        if kind == 0:
            return struct.unpack(">d", self.take(8))[0]
        if kind == 1:
            return self.take(1) != b"\0"
        if kind == 2:
            return self.take(int.from_bytes(self.take(2), "big")).decode("utf-8", "replace")
        if kind == 3:
            return self.pairs(None, depth)
        if kind == 8:
            return self.pairs(int.from_bytes(self.take(4), "big"), depth)
        if kind == 5:
            return None
        if kind == 6:
            return UNDEFINED
        raise EOFError


def decode_values(data: bytes) -> list:
    """Every value up to the first that is cut off or of an unknown kind."""
    r, out = _Values(data), []
    while r.at < len(data):
        try:
            out.append(r.value())
        except EOFError:
            break
    return out


def values_json(data: bytes) -> str:
    """The values as JSON; of keys that repeat, the first counts."""

    def plain(v):
        if isinstance(v, list):
            return {k: plain(x) for k, x in reversed(v)}
        return None if v is UNDEFINED or (isinstance(v, float) and (v != v or v in (float("inf"), float("-inf")))) else v

    return json.dumps([plain(v) for v in decode_values(data)])


def metadata(width: int, height: int, framerate: float, sample_rate: int) -> bytes:
    """The script tag's body that describes a stream."""
    entries = (("duration", 0.0), ("width", float(width)), ("height", float(height)), ("framerate", float(framerate)), ("videocodecid", 7.0), ("audiocodecid", 10.0), ("audiosamplerate", float(sample_rate)))
    return encode_value("onMetaData") + encode_value(entries)


def publish_metadata(body: bytes) -> bytes | None:
    """A script tag's body as the message that sets a live stream's metadata."""
    if len(body) > 3 and body[0] == 2:
        rest = body[3 + int.from_bytes(body[1:3], "big") :]
        if rest:
            return encode_value("@setDataFrame") + encode_value("onMetaData") + rest
    return None


# -- handshake blocks -----------------------------------------------------------------

#: The keys, the block's and the digest's size, and the places of the digest.
CLIENT_KEY, SERVER_KEY = b"Genuine Adobe Flash Player 001", b"Genuine Adobe Flash Player 002"
BLOCK, DIGEST, PLACES = 1536, 32, (8, 772)
#: Fixed values of the filler's generator.
LCG_MUL, LCG_ADD, SEED_MIX = 6364136223846793005, 1442695040888963407, 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1


def digest_at(block: bytes, key: bytes) -> int | None:
    """The place of a block's valid digest."""
    for p in PLACES:
        if len(block) >= p + DIGEST and hmac.digest(key, block[:p] + block[p + DIGEST :], "sha256") == block[p : p + DIGEST]:
            return p
    return None


@lru_cache(1)
def _lcg_steps() -> tuple[np.ndarray, np.ndarray]:
    """The generator's multiplier and addend for 1, 2, ... steps at once."""
    mul, add, out = 1, 0, []
    for _ in range(BLOCK):
        mul, add = mul * LCG_MUL & _MASK, (add * LCG_MUL + LCG_ADD) & _MASK
        out.append((mul, add))
    return tuple(np.array(x, np.uint64) for x in zip(*out, strict=True))


def filler(seed: int, n: int) -> bytes:
    """n bytes of the generator."""
    mul, add = _lcg_steps()
    with np.errstate(over="ignore"):
        x = np.uint64(seed & _MASK) * mul[:n] + add[:n]
    return ((x >> np.uint64(33)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def plain_block(time: int, seed: int) -> bytes:
    return struct.pack(">I", time & 0xFFFFFFFF) + bytes(4) + filler(seed, BLOCK - 8)


def signed_block(time: int, seed: int, key: bytes, place: int = PLACES[0]) -> bytes:
    x = (time ^ seed ^ SEED_MIX) & _MASK
    b = plain_block(x, x)
    return b[:place] + hmac.digest(key, b[:place] + b[place + DIGEST :], "sha256") + b[place + DIGEST :]


def reply_block(block: bytes, key: bytes) -> bytes:
    """What echoes a peer's block: its valid digest alone, or else its filler."""
    if len(block) < BLOCK:
        return bytes(BLOCK)
    p = digest_at(block, key)
    if p is None:
        return block[:BLOCK]
    out = bytearray(BLOCK)
    out[:8] = block[:8]
    out[p : p + DIGEST] = block[p : p + DIGEST]
    return bytes(out)


def server_block(time: int, seed: int, signed: bool = False) -> bytes:
    """A server's first block: the time and filler, or one that is signed."""
    if signed:
        return signed_block(time, seed, SERVER_KEY)
    return struct.pack(">I", time & 0xFFFFFFFF) + bytes(4) + filler(seed ^ SEED_MIX, BLOCK - 8)


def server_reply(client: bytes) -> bytes:
    """A server's second block, which echoes the client's first."""
    return reply_block(client, CLIENT_KEY)


def client_reply(server: bytes) -> bytes:
    """A client's second block, which echoes the server's first."""
    return reply_block(server, SERVER_KEY)


def hmac_sha256(key: bytes, data: bytes) -> bytes:
    return hmac.digest(key, data, hashlib.sha256)


class SplitMix:
    """A seeded stream of 64-bit numbers; doubles are their top 53 bits."""

    def __init__(self, seed: int):
        self.state = np.uint64(seed & _MASK)

    def integers(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = self.state + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=np.uint64)
            if n:
                self.state = z[-1]
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    def doubles(self, n: int) -> np.ndarray:
        return (self.integers(n) >> np.uint64(11)).astype(float) / float(1 << 53)


def first_doubles(seeds: np.ndarray) -> np.ndarray:
    """The first double of a stream for each of many seeds."""
    with np.errstate(over="ignore"):
        z = seeds.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def jittered(delay: float, u: float) -> float:
    """Half of the delay, and a random share of the other half."""
    return delay / 2 + delay / 2 * u


# -- fragmented media files -----------------------------------------------------------

VIDEO_TRACK, AUDIO_TRACK, VIDEO_RATE = 1, 2, 90_000
#: Fixed value: the identity matrix of headers, in fixed point.
MATRIX = bytes.fromhex("00010000" + "00" * 12 + "00010000" + "00" * 12 + "40000000")


def box(name: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name.encode() + body


def full(name: str, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(name, bytes([version]), flags.to_bytes(3, "big"), *parts)


def _u32(*v: int) -> bytes:
    return struct.pack(f">{len(v)}I", *v)


def _u16(*v: int) -> bytes:
    return struct.pack(f">{len(v)}H", *v)


def _track(number: int, size: tuple[int, int], volume: int, rate: int, handler: str, media_header: bytes, entry: bytes) -> bytes:
    tables = box("stbl", full("stsd", _u32(1), entry), full("stts", _u32(0)), full("stsc", _u32(0)), full("stsz", _u32(0, 0)), full("stco", _u32(0)))
    info = box("minf", media_header, box("dinf", full("dref", _u32(1), full("url ", flags=1))), tables)
    language = sum((ord(c) & 31) << s for c, s in zip("und", (10, 5, 0), strict=True))
    media = box("mdia", full("mdhd", _u32(0, 0, rate, 0), _u16(language, 0)), full("hdlr", _u32(0), handler.encode(), bytes(13)), info)
    head = full("tkhd", _u32(0, 0, number, 0, 0, 0, 0), _u16(0, 0, volume, 0), MATRIX, _u32((size[0] << 16) & 0xFFFFFFFF, (size[1] << 16) & 0xFFFFFFFF), flags=3)
    return box("trak", head, media)


def init_segment(video: tuple[bytes, int, int] | None, audio: tuple[bytes, int, int, int] | None) -> bytes:
    """The file's start: video is (config, width, height), audio (config, rate, channels, bitrate)."""
    tracks, extends, following = [], [], 1
    if video:
        config, w, h = video
        entry = box("avc1", bytes(6), _u16(1), bytes(16), _u16(w & 0xFFFF, h & 0xFFFF), _u32(0x480000, 0x480000, 0), _u16(1), bytes(32), _u16(0x18, 0xFFFF), box("avcC", config))
        tracks.append(_track(VIDEO_TRACK, (w, h), 0, VIDEO_RATE, "vide", full("vmhd", bytes(8), flags=1), entry))
        extends.append(full("trex", _u32(VIDEO_TRACK, 1, 0, 0, 0)))
        following = VIDEO_TRACK + 1
    if audio:
        config, rate, channels, bitrate = audio
        decoder = b"\x40\x15\0\0\0" + _u32(bitrate, bitrate) + bytes([5, len(config)]) + config
        stream = _u16(1) + b"\0" + bytes([4, len(decoder)]) + decoder + b"\x06\x01\x02"
        entry = box("mp4a", bytes(6), _u16(1), bytes(8), _u16(channels, 16, 0, 0), _u32((rate << 16) & 0xFFFFFFFF), full("esds", bytes([3, len(stream)]), stream))
        tracks.append(_track(AUDIO_TRACK, (0, 0), 0x100, rate, "soun", full("smhd", bytes(4)), entry))
        extends.append(full("trex", _u32(AUDIO_TRACK, 1, 0, 0, 0)))
        following = AUDIO_TRACK + 1
    movie = full("mvhd", _u32(0, 0, 1000, 0, 0x10000), _u16(0x100, 0), _u32(0, 0), MATRIX, bytes(24), _u32(following))
    return box("ftyp", b"iso5", _u32(512), b"iso5iso6mp41") + box("moov", movie, *tracks, box("mvex", *extends))


def media_segment(number: int, fragments: list[tuple[int, int, list[tuple[int, bytes, int, int]]]]) -> bytes:
    """A segment of (track, base time, samples), samples (duration, payload, flags, offset).
    Every track's data offset counts from the fragment header's start."""
    sizes = [sum(len(p) for _, p, _, _ in samples) for _, _, samples in fragments]

    def header(places: list[int]) -> bytes:
        runs = []
        for (track, base, samples), place in zip(fragments, places, strict=True):
            rows = b"".join(struct.pack(">IIIi", d, len(p), f, c) for d, p, f, c in samples)
            runs.append(box("traf", full("tfhd", _u32(track), flags=0x20000), full("tfdt", struct.pack(">Q", base), version=1), full("trun", _u32(len(samples), place), rows, version=1, flags=0xF01)))
        return box("moof", full("mfhd", _u32(number)), *runs)

    start = len(header([0] * len(fragments))) + 8
    head = header([start + sum(sizes[:i]) for i in range(len(fragments))])
    return box("styp", b"iso5", _u32(512), b"iso5iso6") + head + box("mdat", *[p for _, _, samples in fragments for _, p, _, _ in samples])


# -- as columns -----------------------------------------------------------------------


def _nullable(f):
    return lambda *a: None if any(x is None for x in a) else f(*(bytes(x) if isinstance(x, bytearray) else x for x in a))


def column(f, kind: str):
    """A function as an Arrow UDF; null arguments give null."""
    # made when it is used: executors import this module without a session
    return lambda *cols: F.udf(_nullable(f), kind, useArrow=True)(*cols)


split_units_col = column(split_units, "array<binary>")
split_prefixed_col = column(split_prefixed, "array<binary>")
config_of_col = column(config_of, "binary")
sets_of_config_col = column(lambda c: dict(zip(("sps", "pps"), s, strict=True)) if (s := sets_of_config(c)) else None, "struct<sps: binary, pps: binary>")
dimensions_col = column(lambda s: dict(zip(("width", "height"), d, strict=True)) if (d := dimensions(s)) else None, "struct<width: long, height: long>")
size_of_config_col = column(lambda c: dict(zip(("width", "height"), dimensions_of_config(c), strict=True)), "struct<width: long, height: long>")
decode_tag_col = column(decode_tag, "struct<what: string, kind: string, dts: long, pts: long, is_key: boolean, data: binary>")
values_json_col = column(values_json, "string")
metadata_col = column(metadata, "binary")
init_segment_col = column(lambda c, w, h, a, r, n, b: init_segment((c, w, h) if c else None, (a, r, n, b) if a else None), "binary")
