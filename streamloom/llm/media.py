"""Documents as interleaved sequences of text and media.

HTML is parsed into ordered items: text blocks and references to media by
digest, with positions and captions.  Media are stored once by digest, and
joins on the digest resolve references; payload bytes never move with them.
"""

from __future__ import annotations

import hashlib
import html
import math
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, keep, map_arrow, out_batch, table

UNIT = 64
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "blockquote", "pre", "td", "th"}
_HIDDEN = {"script", "style", "template", "noscript"}
_MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src"}


#: What a head may hold; any other tag ends a head whose end tag is left out.
_IN_HEAD = {"head", "title", "meta", "link", "base", "script", "style", "template", "noscript"}


class _Sequence(HTMLParser):
    """Items of a page in order.  End tags that HTML lets authors leave out are
    implied: a head ends at the first tag of a body, and at text beside a title
    and scripts; a caption at its figure's end, at the next caption, figure or
    medium, or with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.pending: str | None = None
        self.hidden = 0
        self.head = self.title = False

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is None:
            return
        caption, self.caption = " ".join("".join(self.caption).split()), None
        # a caption belongs to the media of its figure, those before it and after it
        self.pending = caption or None
        for item in self.items[self.figure or 0 :]:
            if item[0] == "media":
                item[3] = caption or item[3]

    def handle_starttag(self, tag, attrs):
        if self.head and not self.hidden and tag not in _IN_HEAD:
            self.head = self.title = False
        if tag == "head":
            self.head = True
        elif tag == "title" and self.head:
            self.title = True
        elif tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA:
            self.end_caption()
            a = dict(attrs)
            if a.get(_MEDIA[tag]):
                self.flush()
                self.items.append(["media", None, a[_MEDIA[tag]], (self.pending if self.figure is not None else None) or a.get("alt") or None])
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in _BREAKS:
            if self.caption is not None and tag != "figure":
                self.caption.append(" ")
                return
            self.end_caption()
            self.flush()
            if tag == "figure":
                self.figure, self.pending = len(self.items), None

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = self.title = False
        elif tag == "title":
            self.title = False
        elif tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in _BREAKS:
            if tag == "figure":
                self.end_caption()
            elif self.caption is not None:
                self.caption.append(" ")
                return
            self.flush()
            if tag == "figure":
                self.figure = self.pending = None

    def handle_data(self, data):
        if self.hidden or self.title or self.head and not data.strip():
            return
        self.head = False
        (self.text if self.caption is None else self.caption).append(data)


def parse(source: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, reference, caption) of a page's items in order."""
    p = _Sequence()
    p.feed(source or "")
    p.close()
    p.end_caption()
    p.flush()
    return [(i, *x) for i, x in enumerate(p.items)]


ITEMS = "array<struct<position: int, kind: string, text: string, reference: string, caption: string>>"
_STRUCT = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())]))


def interleave(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items): each page's items in order; none for null or empty HTML."""
    schema = pa.schema([("id", pa.int64()), ("items", _STRUCT)])

    def run(it):
        for batch, texts in batches(it, "text"):
            yield out_batch(schema, id=batch.column("id"), items=[[dict(zip(("position", "kind", "text", "reference", "caption"), x, strict=True)) for x in parse(t)] for t in texts])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("text")).transform(map_arrow, run, f"id long, items {ITEMS}")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row (id, position, kind, text, reference, caption, and media's
    columns) for each item of sequences(id, items); references are digests in
    media(digest, ...), one row for each digest.  Unknown digests and text have
    null media; a column of media with the name of an item's gets "media_"
    before it."""
    flat = sequences.select("id", F.explode("items").alias("i")).select("id", "i.*")
    own = media.select(F.col("digest").alias("__digest"), *[F.col(c).alias(f"media_{c}" if c in flat.columns else c) for c in media.columns if c != "digest"])
    return flat.join(own, flat["reference"] == own["__digest"], "left").drop("__digest")


def sequence_sha256(items: list[tuple]) -> str:
    """A digest of a page's items in order: kind, text, reference and caption of each."""
    h = hashlib.sha256()
    for _, kind, text, reference, caption in items:
        for x in (kind, text, reference, caption):
            raw = b"" if x is None else x.encode("utf-8", "surrogatepass")
            h.update(b"-" if x is None else str(len(raw)).encode() + b":" + raw)
    return h.hexdigest()


def to_media(payload: bytes) -> bytes:
    """A payload of whole UNITs as a grey image of 8-bit samples, UNIT wide (PGM)."""
    return b"P5\n%d %d\n255\n" % (UNIT, len(payload) // UNIT) + payload


def from_media(media: bytes) -> np.ndarray:
    """The samples, a row for each line of the image."""
    kind, size, most, data = media.split(b"\n", 3)
    w, h = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(data) != w * h:
        raise ValueError("not a grey image of 8-bit samples")
    return np.frombuffer(data, np.uint8).reshape(h, w)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy, and a 64-bit hash of which cells of an 8 x 8 grid are brighter than the mean."""
    n, counts = samples.size, np.bincount(samples.ravel(), minlength=256)
    values = np.arange(256)
    total = int((counts * values).sum())
    square = int((counts * values * values).sum())
    p = counts[counts > 0] / n
    entropy = math.fsum(-p * np.log2(p))
    rows = (np.arange(samples.shape[0]) * 8) // samples.shape[0]
    cells = np.zeros((8, samples.shape[1]), np.int64)
    np.add.at(cells, rows, samples.astype(np.int64))
    cells = cells.reshape(8, 8, -1).sum(2)
    size = np.maximum(np.bincount(rows, minlength=8), 1)[:, None] * (samples.shape[1] // 8)
    bits = "".join("1" if c * n > total * s else "0" for c, s in zip(cells.ravel().tolist(), np.broadcast_to(size, (8, 8)).ravel().tolist(), strict=True))
    return f"mean={total / n:.6f};sd={math.sqrt(max(0, square * n - total * total)) / n:.6f};entropy={abs(entropy):.6f};hash={int(bits, 2):016x}"


def page_of(text: str, reference: str, caption: str) -> str:
    """A document as a page: its lines as paragraphs, and its payload as a figure
    after the first half of them."""
    parts = [f"<p>{html.escape(x, quote=False)}</p>" for x in text.split("\n")]
    figure = f'<figure><img src="{reference}" alt=""><figcaption>{html.escape(caption)}</figcaption></figure>'
    parts.insert((len(parts) + 1) // 2, figure)
    return "<article>" + "".join(parts) + "</article>"


def document_sequence(text: str) -> tuple[bytes, bytes, str, list[tuple]]:
    """A document's bytes, its stored form and the digest of that, and the items of its page."""
    raw = text.encode("utf-8", "surrogatepass")
    media = to_media(raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT)))
    digest = hashlib.sha256(media).hexdigest()
    return raw, media, digest, parse(page_of(text, f"sha256:{digest}", f"{len(raw)} bytes"))


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_items", pa.int32()), ("sequence_sha256", pa.string()), ("items", _STRUCT), ("digest", pa.string()), ("media", pa.binary())])
_FOUND = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _store(it):
    for batch, texts in batches(it):
        seen, cols = set(), {x: [] for x in _STORED.names[1:]}
        for t in texts:
            raw, media, digest, items = document_sequence(t)
            cols["n_bytes"].append(len(raw))
            cols["n_items"].append(len(items))
            cols["sequence_sha256"].append(sequence_sha256(items))
            # the text is the media's payload already; of the sequence the references are joined
            cols["items"].append([dict(position=p, kind=k, text=None, reference=r, caption=c) for p, k, _, r, c in items if k == "media"])
            cols["digest"].append(None if digest in seen else digest)
            cols["media"].append(None if digest in seen else media)
            seen.add(digest)
        yield out_batch(_STORED, doc_id=batch.column("doc_id"), **cols)


def _analyse(it):
    for batch in it:
        rows = []
        for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
            if (real := hashlib.sha256(media).hexdigest()) != digest:
                raise ValueError(f"damaged media {digest}")
            samples = from_media(media)
            payload = samples.tobytes()
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), real, feature(samples)))
        if rows:
            yield out_batch(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*rows, strict=True)), strict=True)))


def media_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, position, caption, n_items, sequence_sha256) for
    docs(doc_id, text).

    Every whole text (null: empty) is a payload, padded with bytes 0 to a
    positive multiple of UNIT, stored as an image and referred to by a figure in
    the document's page.  The pages are parsed into text and media items, the
    stored images read back and analysed, and a join on the digest brings both
    together: position and caption are the figure's, n_items and sequence_sha256
    are of all items of the page.  Equal texts share
    an image; repeated rows each give a row; a null id stays null; other columns
    are ignored.
    """
    stored = keep(docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, _store, f"doc_id long, n_bytes long, n_items int, sequence_sha256 string, items {ITEMS}, digest string, media binary"), "media")
    ddl = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = stored.where("digest is not null").select("digest", "media").transform(map_arrow, _analyse, ddl)
    # one row of figures for each digest; copies of the media itself stay where they are
    catalog = keep(found.groupBy("digest").agg(*[F.first(x).alias(x) for x in _FOUND.names[1:]]), "catalog")
    flat = stored.select("doc_id", "n_bytes", "n_items", "sequence_sha256", F.explode("items").alias("i")).select("doc_id", "n_bytes", "n_items", "sequence_sha256", "i.position", "i.caption", F.substring("i.reference", 8, 64).alias("digest"))
    return flat.join(catalog, "digest").select("doc_id", "n_bytes", *_FOUND.names[1:], "position", "caption", "n_items", "sequence_sha256")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_media": op2_media}
ORACLES: dict[str, str] = {}
