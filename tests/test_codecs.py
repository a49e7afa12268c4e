"""Byte formats against known bytes and round trips."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streamloom.functions import codecs as C
from streamloom.sources import containers as S

CONFIG = bytes.fromhex("0142001FFFE100036742000A01000368CE")
unit = st.binary(min_size=1, max_size=63).map(lambda b: bytes(x or 1 for x in b)).filter(lambda b: b[-1] != 0)


def test_split_units():
    assert C.split_units(bytes.fromhex("000000016742000A0000000168CE3C8000000001658884")) == [bytes.fromhex(x) for x in ("6742000A", "68CE3C80", "658884")]
    assert C.split_units(bytes.fromhex("000000016512000003" + "01AB")) == [bytes.fromhex("651200000301AB")]
    assert C.split_units(b"no start code") == [] and C.split_units(b"") == []


def test_dimensions():
    assert C.dimensions(bytes.fromhex("6742C01EF40A0FC8")) == (320, 240)
    assert C.dimensions(b"\x67") is None and C.dimensions(b"") is None


def test_config_round_trip():
    sps, pps = bytes.fromhex("6742000A"), bytes.fromhex("68CE3C80")
    assert C.sets_of_config(C.video_config(sps, pps)) == (sps, pps)
    assert C.config_of(C.join_units([sps, pps, b"\x65\x88"])) == C.video_config(sps, pps)
    for n in range(len(CONFIG)):
        assert C.sets_of_config(CONFIG[:n]) is None or n == len(CONFIG)


@settings(max_examples=100, deadline=None)
@given(st.lists(unit, max_size=5))
def test_unit_round_trips(units):
    assert C.split_units(C.join_units(units)) == units
    assert C.split_prefixed(C.join_prefixed(units)) == units


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=512))
def test_total(data):
    C.split_units(data), C.split_prefixed(data), C.dimensions(data), C.sets_of_config(data), C.decode_values(data), C.decode_tag(9, 0, data), C.decode_tag(8, 0, data)


def test_prefixed_is_strict():
    assert C.split_prefixed(b"") == []
    for bad in (b"\0\0\0", b"\0\0\0\5ab", b"\0\0\0\0"):
        assert C.split_prefixed(bad) is None


def test_decode_tag():
    body = bytes.fromhex("1701000028") + struct.pack(">I", 2) + bytes.fromhex("6588")
    got = C.decode_tag(9, 100, body)
    assert (got["dts"], got["pts"], got["is_key"], got["data"]) == (100, 140, True, bytes.fromhex("000000016588"))
    assert C.decode_tag(9, 0, b"\x27\x01\xff\xff\xf6" + struct.pack(">I", 1) + b"A")["pts"] == -10
    for n in range(5):
        assert C.decode_tag(9, 0, body[:n]) is None
    assert C.decode_tag(8, 5, b"\xaf\x01xy")["data"] == b"xy" and C.decode_tag(8, 5, b"\x2f\x01xy") is None


def test_values():
    v = ["connect", 1.0, [("app", "live"), ("ok", True), ("none", None)]]
    data = b"".join(map(C.encode_value, v))
    assert C.decode_values(data) == v
    for n in range(len(data)):
        assert C.decode_values(data[:n]) == v[: len(C.decode_values(data[:n]))]
    assert C.decode_values(C.encode_value((("a", 1.0), ("b", 2.0)))) == [[("a", 1.0), ("b", 2.0)]]
    assert C.decode_values(b"\x0a\0\0\0\0") == []
    assert C.decode_values(b"\x03\0\1a" * 200) == []


def test_handshake():
    c1 = C.signed_block(7, 9, C.CLIENT_KEY)
    assert len(c1) == C.BLOCK and C.digest_at(c1, C.CLIENT_KEY) == 8 and C.digest_at(c1, C.SERVER_KEY) is None
    assert C.digest_at(C.signed_block(7, 9, C.SERVER_KEY, 772), C.SERVER_KEY) == 772
    reply = C.reply_block(c1, C.CLIENT_KEY)
    assert reply[8:40] == c1[8:40] and not any(reply[40:])
    simple = C.plain_block(5, 5)
    assert C.reply_block(simple, C.CLIENT_KEY) == simple and C.reply_block(b"x", C.CLIENT_KEY) == bytes(C.BLOCK)


def test_server_blocks():
    c1 = C.plain_block(3, 4)
    assert C.server_reply(c1) == c1 and C.digest_at(C.server_block(5, 6, signed=True), C.SERVER_KEY) == 8
    s1 = C.server_block(0x01020304, 6)
    assert len(s1) == C.BLOCK and s1[:8] == bytes([1, 2, 3, 4, 0, 0, 0, 0]) and C.digest_at(s1, C.SERVER_KEY) is None and C.client_reply(s1) == s1
    signed = C.server_block(5, 6, signed=True)
    assert C.client_reply(signed)[8:40] == signed[8:40] and C.client_reply(b"") == bytes(C.BLOCK)
    x, slow = 77, []
    for _ in range(40):
        x = (x * C.LCG_MUL + C.LCG_ADD) % (1 << 64)
        slow.append((x >> 33) & 255)
    assert C.filler(77, 40) == bytes(slow)


def test_dimensions_of_configurations():
    assert C.dimensions_of_config(C.video_config(bytes.fromhex("6742C01EF40A0FC8"), b"\x68\xce")) == (320, 240)
    assert C.dimensions_of_config(None) == C.dimensions_of_config(b"\x01") == C.dimensions_of_config(CONFIG) == (0, 0)


def test_hmac_and_generator():
    assert C.hmac_sha256(b"key", b"The quick brown fox jumps over the lazy dog").hex() == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"
    assert C.SplitMix(0).integers(1)[0] == 0xE220A8397B1DCDAF
    u = C.SplitMix(42).doubles(1000)
    assert all(50 <= C.jittered(100, x) < 100 for x in u)


def boxes(data):
    at, out = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        out.append((data[at + 4 : at + 8].decode(), data[at + 8 : at + n]))
        at += n
    return out


def test_segment_layout():
    seg = C.media_segment(1, [(1, 0, [(3000, b"abcd", 1 << 25, -3600)]), (2, 7, [(1024, b"xy", 1 << 25, 0)])])
    found = boxes(seg)
    assert [n for n, _ in found] == ["styp", "moof", "mdat"] and found[2][1] == b"abcdxy"
    moof = seg.index(b"moof") - 4
    runs = [seg.index(b"trun"), seg.index(b"trun", seg.index(b"trun") + 4)]
    places = [int.from_bytes(seg[r + 12 : r + 16], "big") for r in runs]
    assert [seg[moof + p : moof + p + n] for p, n in zip(places, (4, 2), strict=True)] == [b"abcd", b"xy"]
    assert int.from_bytes(seg[runs[0] + 28 : runs[0] + 32], "big", signed=True) == -3600


def test_init_layout():
    both = C.init_segment((CONFIG, 320, 240), (bytes.fromhex("1210"), 44100, 2, 128000))
    assert [n for n, _ in boxes(both)] == ["ftyp", "moov"]
    inner = boxes(boxes(both)[1][1])
    assert [n for n, _ in inner] == ["mvhd", "trak", "trak", "mvex"] and len(inner[0][1]) == 100
    assert len(boxes(inner[1][1])[0][1]) == 84 and CONFIG in both and bytes.fromhex("05021210") in both
    assert [n for n, _ in boxes(boxes(C.init_segment(None, (b"\x12\x10", 44100, 2, 1)))[1][1])] == ["mvhd", "trak", "mvex"]


def file_of(*tags):
    out = bytes.fromhex("464C5601050000000900000000")
    for kind, ts, body in tags:
        out += bytes([kind]) + len(body).to_bytes(3, "big") + (ts & 0xFFFFFF).to_bytes(3, "big") + bytes([ts >> 24]) + bytes(3) + body + (11 + len(body)).to_bytes(4, "big")
    return out


def test_file_tags():
    tags = [(9, 0, b"abc"), (8, 0x01000000, b"")]
    data = file_of(*tags)
    assert list(S.file_tags(data)) == tags
    p = S.TagParser()
    assert [t for i in range(len(data)) for t in p.feed(data[i : i + 1])] == tags
    assert list(S.file_tags(data[:-6])) == tags[:1]
    with pytest.raises(ValueError):
        list(S.file_tags(b"XLV" + data[3:]))


def test_chunk_reader():
    payload = bytes(range(256)) + bytes(44)
    head = bytes([6]) + (16777215).to_bytes(3, "big") + (300).to_bytes(3, "big") + bytes([9]) + bytes(4) + (20_000_000).to_bytes(4, "big")
    data = head + payload[:128] + b"\xc6" + payload[128:256] + b"\xc6" + payload[256:]
    for step in (1, 7, len(data)):
        r = S.ChunkReader()
        assert [m for i in range(0, len(data), step) for m in r.messages(data[i : i + step])] == [(9, 20_000_000, payload)]
        assert r.bytes_read == len(data)
    with pytest.raises(ValueError):
        S.ChunkReader().set_size(0)


def test_audio_frames():
    frame = bytes.fromhex("FFF150800140FC") + b"abc"
    assert [(t, len(f)) for t, f in S.audio_frames(frame * 3)] == [(0, 10), (23, 10), (46, 10)]
    assert [len(f) for _, f in S.audio_frames(frame + frame[:8])] == [10, 8] and S.audio_frames(frame[:6]) == []


def test_video_frames():
    data = C.join_units([b"\x67a", b"\x68b", b"\x65c", b"\x41d", b"\x06e", b"\x41f"])
    assert S.video_frames(data, 15.0) == [(0, True, C.join_units([b"\x65c"])), (66, False, C.join_units([b"\x41d"])), (133, False, C.join_units([b"\x41f"]))]
    assert S.video_frames(b"") == []
