"""WARC archives and their capture index.

Pages become WARC/1.1 records, gzip member by member, in archives made of
record-aligned blocks (a Parquet table, so that Spark's committer keeps half
written archives of lost executors out, on any file system; `export` turns
archives into plain files).  Reading the archives back gives captures; every
reading task sorts its own, which makes runs.  Range partitions of URL key and
timestamp then merge their slices of the runs with a loser tree, which gives
one index in global order.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, keep, map_arrow, out_batch, table

#: Payloads of so many bytes or more are stored once.
LEAST_REVISIT = 100
BLOCK_BYTES = 1 << 20
LEVEL = 3
#: The first capture's time; pages without a time of their own are a second apart by id.
EPOCH = 1_577_836_800


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host parts reversed, then port, path and query in lower case."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return (url or "").lower()
    path = (u.path or "/").lower()
    return f"{','.join(reversed(host.split('.')))}{port}){path}" + (f"?{'&'.join(sorted(u.query.lower().split('&')))}" if u.query else "")


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}.items())
    return gzip.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


#: Compressed bytes that are looked at together, so what follows a record is copied only so far.
_CHUNK = 1 << 14


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of the records in archive bytes."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d, parts, end = zlib.decompressobj(31), [], at
        while not d.eof:
            if end >= len(data):
                raise ValueError("a record is cut")
            parts.append(d.decompress(view[end : end + _CHUNK]))
            end = min(end + _CHUNK, len(data))
        raw, size = b"".join(parts), end - at - len(d.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield at, size, headers, rest[:n]
        at += size


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def clean_url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


_BLOCK = pa.schema([("archive", pa.int64()), ("block", pa.int32()), ("data", pa.binary())])


def _stamp(seconds: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _write(it):
    archive, block, out, size = TaskContext.get().partitionId(), 0, [], 0
    for batch, texts in batches(it, "html"):
        cols = {c: batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first", "second")}
        for i, text in enumerate(texts):
            payload, page, first = text.encode("utf-8", "surrogatepass"), cols["page_id"][i], cols["first"][i]
            if not block and not out:
                out.append(record("warcinfo", {"WARC-Date": _stamp(EPOCH), "Content-Type": "application/warc-fields"}, b"software: streamloom\r\nformat: WARC File Format 1.1\r\n"))
            again = first is not None and first != page
            headers = {"WARC-Record-ID": f"<urn:page:{page}>", "WARC-Target-URI": clean_url(cols["url"][i]), "WARC-Date": _stamp(cols["second"][i]), "WARC-Payload-Digest": f"sha256:{cols['digest'][i]}", "Content-Type": "application/http; msgtype=response"}
            if again:
                headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{first}>"}
            made = record("revisit" if again else "response", headers, _http(len(payload)) + (b"" if again else payload))
            out.append(made)
            size += len(made)
            if size >= BLOCK_BYTES:
                yield out_batch(_BLOCK, archive=[archive], block=[block], data=[b"".join(out)])
                block, out, size = block + 1, [], 0
    if out:
        yield out_batch(_BLOCK, archive=[archive], block=[block], data=[b"".join(out)])


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, block, data) for pages(page_id, url, html[, captured_at seconds]).

    Of pages with equal payloads of LEAST_REVISIT bytes or more the smallest
    page_id is stored, the others as revisits that refer to it.  Null html is
    an empty payload, a null url an empty one; rows that repeat a page_id are
    stored alike; a row with a null page_id is never referred to, and a revisit if
    another row with its payload has a page_id.
    """
    second = F.coalesce("captured_at", F.lit(EPOCH)) if "captured_at" in pages.columns else F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))
    own = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), second.cast("long").alias("second")).withColumn("digest", F.sha2("html", 256))
    copies = own.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # only digests with copies, so the table is small next to the pages; a hot digest is one row
    copies = keep(copies.where("n > 1 and first is not null").select("digest", "first"), "copies")
    return keep(own.join(copies, "digest", "left").select("page_id", "url", "html", "digest", "first", "second").transform(map_arrow, _write, "archive long, block int, data binary"), "archives", "uncompressed")


_CAPTURE = pa.schema([("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.int64()), ("block", pa.int32()), ("offset", pa.int64()), ("size", pa.int64())])
_CAPTURE_DDL = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive long, block int, offset long, size long"
#: A reading task sorts so many captures at a time into a run; a merging task has about so many.
RUN, MERGED = 100_000, 50_000


def _page(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if n == "None" else int(n)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8], row[9]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return out_batch(_CAPTURE, **dict(zip(_CAPTURE.names, map(list, zip(*rows, strict=True)), strict=True)))


def _read(it):
    rows: list[tuple] = []
    for batch in it:
        for archive, block, data in zip(*(batch.column(c).to_pylist() for c in ("archive", "block", "data")), strict=True):
            for at, size, headers, body in records(data):
                if headers["WARC-Type"] not in ("response", "revisit"):
                    continue
                head, _, payload = body.partition(b"\r\n\r\n")
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                if headers["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged payload in archive {archive}, block {block}, at {at}")
                refers = _page(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
                rows.append((url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), n, digest, headers["WARC-Type"], refers, archive, block, at, size))
            if len(rows) >= RUN:
                yield _batch(sorted(rows, key=_order))
                rows = []
    if rows:
        yield _batch(sorted(rows, key=_order))


def loser_tree(runs: list[Iterable], key) -> Iterator:
    """The items of sorted runs in order.  The inner nodes of a tournament hold
    the losers, so each item costs one comparison per level."""
    its = [iter(r) for r in runs]
    k = len(its)
    if not k:
        return
    heads = [next(i, None) for i in its]
    keys = [None if h is None else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    tree = [-1] * k
    for leaf in range(k):
        x, node = leaf, (leaf + k) // 2
        while node > 0 and tree[node] >= 0:
            if beats(tree[node], x):
                x, tree[node] = tree[node], x
            node //= 2
        tree[node] = x
    while keys[w := tree[0]] is not None:
        yield heads[w]
        heads[w] = next(its[w], None)
        keys[w] = None if heads[w] is None else key(heads[w])
        x, node = w, (w + k) // 2
        while node > 0:
            if beats(tree[node], x):
                x, tree[node] = tree[node], x
            node //= 2
        tree[0] = x


def _merge(it):
    """Ascending stretches of what arrives are slices of runs, whatever order they come in."""
    runs: list[list[tuple]] = []
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if runs and _order(runs[-1][-1]) <= _order(row):
                runs[-1].append(row)
            else:
                runs.append([row])
    out: list[tuple] = []
    for row in loser_tree(runs, _order):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def capture_index(archives: DataFrame) -> DataFrame:
    """All captures of archives(archive, block, data), in the order of URL key,
    timestamp and page_id, within and across partitions.  Payloads are checked
    against their digests; a damaged one is an error.  There are as many range
    partitions as MERGED asks for, and their bounds are by place too, so a task
    holds a bounded part of the index however often a URL was captured."""
    runs = keep(archives.select("archive", "block", "data").transform(map_arrow, _read, _CAPTURE_DDL), "runs")
    n = max(1, -(-runs.count() // MERGED))
    return runs.repartitionByRange(n, "url_key", "captured_at", "page_id", "archive", "block", "offset").transform(map_arrow, _merge, _CAPTURE_DDL)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write archives as .warc.gz files, one archive at a time, into a local folder."""
    os.makedirs(folder, exist_ok=True)
    names = {}
    for r in archives.orderBy("archive", "block").toLocalIterator():
        names.setdefault(r.archive, f"{folder}/part-{r.archive:06d}.warc.gz")
        with open(names[r.archive], "ab" if r.block else "wb") as f:
            f.write(r.data)
    return list(names.values())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index(write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN coalesce(first < page_id, first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN coalesce(first < page_id, first IS NOT NULL) THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

QUERIES = {"op6_warc": op6_warc}
ORACLES = {"op6_warc": OP6_SQL}
