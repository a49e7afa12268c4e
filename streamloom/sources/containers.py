"""Reading container files and captured connections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codecs import join_units, split_units

MOST_OFFSET = 4096


def file_tags(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(kind, time, body) of every complete tag of a file; a bad header is an error."""
    if len(data) < 13:
        return
    at = int.from_bytes(data[5:9], "big")
    if data[:3] != b"FLV" or data[3] != 1 or not 9 <= at <= MOST_OFFSET:
        raise ValueError("bad file header")
    at += 4
    while at + 11 <= len(data):
        size = int.from_bytes(data[at + 1 : at + 4], "big")
        if at + 11 + size > len(data):
            return
        yield data[at], data[at + 7] << 24 | int.from_bytes(data[at + 4 : at + 7], "big"), data[at + 11 : at + 11 + size]
        at += 15 + size


class TagParser:
    """The same for bytes that arrive in pieces."""

    def __init__(self):
        self.data, self.header = b"", False

    def feed(self, more: bytes) -> list[tuple[int, int, bytes]]:
        self.data += more
        if not self.header:
            if len(self.data) < 13:
                return []
            next(file_tags(self.data), None)
            start = int.from_bytes(self.data[5:9], "big") + 4
            if len(self.data) < start:
                return []
            self.data, self.header = self.data[start:], True
        out, at = [], 0
        while at + 11 <= len(self.data):
            size = int.from_bytes(self.data[at + 1 : at + 4], "big")
            if at + 15 + size > len(self.data):
                break
            h = self.data[at : at + 11]
            out.append((h[0], h[7] << 24 | int.from_bytes(h[4:7], "big"), self.data[at + 11 : at + 11 + size]))
            at += 15 + size
        self.data = self.data[at:]
        return out


_TAG = "path string, ord long, kind int, ts long, body binary"


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, kind, ts, body) of the tags of all files below a path, on any
    file system that Spark reads; a task reads whole files."""

    def run(it):
        for pdf in it:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, i, *t) for i, t in enumerate(file_tags(bytes(data)))]
                for k in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[k : k + 5000], columns=["path", "ord", "kind", "ts", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _TAG)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TagReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for i, (kind, ts, body) in enumerate(file_tags(f.read())):
                yield partition.path, i, kind, ts, body


class TagSource(DataSource):
    """spark.read.format("tags"): local container files, a partition for each."""

    @classmethod
    def name(cls):
        return "tags"

    def schema(self):
        return _TAG

    def reader(self, schema):
        return TagReader(self.options)


MOST_CHUNK, MOST_STREAMS = 0xFFFFFF, 65_600


class Incomplete(Exception):
    pass


class ChunkReader:
    """Messages of a connection's bytes, whose chunks interleave."""

    def __init__(self, size: int = 128):
        self.size, self.streams, self.data, self.at = size, {}, b"", 0
        #: Bytes of the connection that whole chunks took so far, with their headers.
        self.bytes_read = 0

    def set_size(self, size: int) -> None:
        if size <= 0:
            raise ValueError("a chunk needs a size")
        self.size = min(size, MOST_CHUNK)

    def abort(self, cid: int) -> None:
        if cid in self.streams:
            self.streams[cid]["payload"] = b""

    def _take(self, n: int) -> bytes:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise Incomplete
        self.at += n
        return got

    def messages(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(kind, time, payload) of the messages that end in these bytes or before."""
        self.data, self.at = self.data[self.at :] + data, 0
        while True:
            begin, before = self.at, None
            try:
                first = self._take(1)[0]
                form, cid = first >> 6, first & 63
                if cid < 2:
                    cid = 64 + int.from_bytes(self._take(1 + cid), "little")
                if cid >= MOST_STREAMS:
                    raise ValueError(f"chunk stream {cid} is out of range")
                s = dict(self.streams.get(cid) or {"ts": 0, "length": 0, "kind": 0, "payload": b""})
                before = cid
                if form < 3:
                    h = self._take((11, 7, 3)[form])
                    time = int.from_bytes(h[:3], "big")
                    if form < 2:
                        s["length"], s["kind"] = int.from_bytes(h[3:6], "big"), h[6]
                    s["payload"] = b""
                    if time == 0xFFFFFF:
                        time = int.from_bytes(self._take(4), "big")
                    s["ts"] = time if form == 0 else (s["ts"] + time) & 0xFFFFFFFF
                left = s["length"] - len(s["payload"])
                if left > 0:
                    s["payload"] += self._take(min(left, self.size))
            except Incomplete:
                self.at = begin
                return
            self.streams[before] = s
            self.bytes_read += self.at - begin
            if left > 0 and len(s["payload"]) == s["length"]:
                payload, s["payload"] = s["payload"], b""
                yield s["kind"], s["ts"], payload


def read_messages(capture: DataFrame, size: int = 128) -> DataFrame:
    """(conn_id, ord, kind, ts, payload) of capture(conn_id, offset, bytes).  A
    message of kind 1 sets the chunk size, one of kind 2 aborts a partial one."""

    def run(it):
        key, reader, n, rows = None, None, 0, []
        for pdf in it:
            for conn, data in zip(pdf["conn_id"], pdf["bytes"], strict=True):
                if conn != key:
                    key, reader, n = conn, ChunkReader(size), 0
                for kind, ts, payload in reader.messages(bytes(data)):
                    if kind == 1 and len(payload) >= 4:
                        reader.set_size(int.from_bytes(payload[:4], "big"))
                    elif kind == 2 and len(payload) >= 4:
                        reader.abort(int.from_bytes(payload[:4], "big"))
                    rows.append((conn, n, kind, ts, payload))
                    n += 1
            if rows:
                yield pd.DataFrame(rows, columns=["conn_id", "ord", "kind", "ts", "payload"])
                rows = []

    return capture.select("conn_id", "offset", "bytes").repartition("conn_id").sortWithinPartitions("conn_id", "offset").mapInPandas(run, "conn_id long, ord long, kind int, ts long, payload binary")


def audio_frames(data: bytes, rate: int = 44_100) -> list[tuple[int, bytes]]:
    """(pts ms, frame with its header) of a file of ADTS frames; a last frame that
    is cut off is given as far as it goes."""
    out, at, step = [], 0, round(1024 * 1000 / rate)
    while at + 7 <= len(data) and data[at] == 255 and data[at + 1] & 0xF0 == 0xF0:
        head = 7 if data[at + 1] & 1 else 9
        n = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if n < head or at + head > len(data):
            break
        out.append((len(out) * step, data[at : at + n]))
        at += n
    return out


def video_frames(data: bytes, fps: float = 15.0) -> list[tuple[int, bool, bytes]]:
    """(pts ms, whether it is a key, unit with a start code) of the pictures of a
    file of units at a constant frame rate; units that are no picture are left out."""
    pictures = [u for u in split_units(data) if 1 <= u[0] & 31 <= 5]
    return [(int(i * 1000.0 / fps), u[0] & 31 == 5, join_units([u])) for i, u in enumerate(pictures)]


def each_file(df: DataFrame, walk, schema: str) -> DataFrame:
    """The rows walk(bytes) gives for every file of df(..., content), after its
    other columns and the row's number; a task holds one file at a time."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    others = [c for c in df.columns if c != "content"]

    def run(it):
        for pdf in it:
            for row in pdf.itertuples(index=False):
                own = tuple(getattr(row, c) for c in others)
                rows = [(*own, i, *x) for i, x in enumerate(walk(bytes(row.content)))]
                for k in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[k : k + 5000], columns=[*others, "ord", *names])

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in others), "ord long", schema]))
