"""Helpers shared by the text operators: shared folder, whole-text hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are worked on in groups of about so many bytes, so a worker's memory
#: depends on this and on the longest single text, not on the partition.
GROUP_BYTES = 1 << 20


_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.

    Only a session without that setting gets a temporary folder; that is for
    tests in local mode.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="streamloom-"))


#: Removes an execution's shuffle files at its end.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a
    lost executor costs no recomputation.  The shuffle files of the write go
    when it has ended, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch_path = path
    return kept


#: Arrow batches hold about so many bytes, also of long texts.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run, ddl: str) -> DataFrame:
    """df.mapInArrow, with batches of bounded bytes in this session: by default a
    batch has 10000 rows, however long their texts are."""
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH, None) or 1 << 31) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, ddl)


def discard(*tables: DataFrame) -> None:
    """Remove tables that keep() wrote, once all that is read from them is written itself."""
    for kept in tables:
        spark = kept.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(kept._scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers
    live on between tasks, and would hold what their largest one needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def id_bucket(col: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as bucket 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(0))


def batches(it: Iterable[pa.RecordBatch], text: str = "text", most: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the record batches with about `most` bytes of text each, and
    their texts with "" for null."""
    for batch in it:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
        if not len(sizes):
            continue
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield (piece := batch.slice(a, b - a)), [x or "" for x in piece.column(piece.schema.get_field_index(text)).to_pylist()]
    give_back()


def byte_table(word: bytes | None = None, space: bytes = b" \t\n\x0b\x0c\r") -> bytes:
    """A translation table: A-Z become a-z, and separators become blanks.
    word: the ASCII bytes (in lower case) that words have; else all but space."""
    out = bytearray(range(256))
    for c in range(0x41, 0x5B):
        out[c] = c + 32
    for c in range(128):
        if (out[c] not in word) if word is not None else (out[c] in space):
            out[c] = 32
    return bytes(out)


#: Words are what blanks, tabs and line ends separate.
BLANK_WORDS = byte_table()
#: Words are ASCII digits and letters and all other characters beyond ASCII.
PLAIN_WORDS = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz")

_BASE, _LEN = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
#: Words are hashed in blocks of about so many bytes.
_BLOCK = 1 << 16


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for a block and a word of its length."""
    return _power(_BASE, 2 * _BLOCK + 1), _power(pow(_BASE, -1, 1 << 64), 2 * _BLOCK + 1)


def _power(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, U64)
    steps[0] = 1
    return np.cumprod(steps, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    y ^= y >> U64(27)
    y *= U64(0x94D049BB133111EB)
    y ^= y >> U64(31)
    return y


class Words:
    """The words of some texts, without one Python object for each.

    hash: a 64-bit hash of each word; doc: the index of its text; first: each
    text's first word, one entry more than texts; start, end: byte positions in
    `blob`, the translated UTF-8 of the texts with a blank after each.
    """

    def __init__(self, texts: list[str], table: bytes):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.blob = b" ".join([*raw, b""]).translate(table)
        arr = np.frombuffer(self.blob, np.uint8)
        inside = np.empty(len(arr) + 2, bool)
        inside[0] = inside[-1] = False
        np.not_equal(arr, 32, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.hash = np.empty(len(self.start), U64)
        part = self.start // _BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            # only a word beyond the block's size needs longer tables
            up, down = _powers() if hi - lo <= 2 * _BLOCK else (_power(_BASE, hi - lo + 1), _power(pow(_BASE, -1, 1 << 64), hi - lo + 1))
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(arr[lo:hi].astype(U64) * up[: hi - lo], dtype=U64, out=sums[1:])
            start, end = self.start[a:b] - lo, self.end[a:b] - lo
            self.hash[a:b] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(_LEN))
        limits = np.cumsum([0, *(len(x) + 1 for x in raw)])
        self.first = np.searchsorted(self.start, limits)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.bytes_at = limits

    def word(self, i: int) -> bytes:
        return self.blob[self.start[i] : self.end[i]]


def out_batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type, from_pandas=False) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in schema], schema=schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, label), label the
    smallest node.  Every round takes each node's smallest label among its
    neighbours and then the label's own label, until nothing changes, so few
    rounds suffice even for long chains.  All tables stay distributed, a node's
    neighbours are added up before the shuffle, and only the result's table
    is left."""
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = keep(ends.union(ends.select("y", "x")).where("x <> y").distinct(), "edges")
    labels = keep(both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("node"), F.least("x", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("low"))
        step = keep(labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old")), "labels")
        discard(labels)
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("to"))
        labels = keep(step.join(jump, F.col("label") == F.col("at")).select("node", F.least("label", "to").alias("label"), "old"), "labels")
        discard(step)
        if not labels.where("label <> old").head(1):
            discard(both)
            return labels


#: The bitmap of ids that is broadcast has so many bits, 2 MB, or BITS_PER_ID
#: for each id up to MOST_BITS, 64 MB.
LEAST_BITS, BITS_PER_ID, MOST_BITS = 1 << 24, 16, 1 << 29


def perhaps(rows: DataFrame, ids: DataFrame, mark: str, bits: int | None = None) -> DataFrame:
    """rows with a column `mark`: whether their doc_id is in ids(doc_id); a few
    others are marked, too.

    Before a join of whole texts with few ids, this keeps the other texts out
    of the shuffle.  Ids set bits of a bitmap of bounded size, broadcast in rows
    of 4 KB; a null id is among the ids if they have one.  With more ids than
    MOST_BITS can tell apart all rows are marked, so a join must follow.
    """
    n, none = ids.agg(F.count("*"), F.coalesce(F.max(F.col("doc_id").isNull()), F.lit(False))).first()
    if bits is None:
        bits = LEAST_BITS
        while bits < n * BITS_PER_ID:
            bits *= 2
        if bits > MOST_BITS:
            return rows.withColumn(mark, F.lit(True))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    marks = ids.where("doc_id is not null").select(place.alias("place")).select("place", F.bitmap_bucket_number("place").alias("__bucket")).repartition("__bucket")
    bitmaps = marks.groupBy("__bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bitmap"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.col("__bitmap").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number(place) == F.col("__bucket"), "left")
    known = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return near.select(*rows.columns, F.when(F.col("doc_id").isNull(), F.lit(none)).otherwise(known).alias(mark))


def perhaps_in(rows: DataFrame, ids: DataFrame, bits: int | None = None) -> DataFrame:
    """The rows that perhaps() marks."""
    return perhaps(rows, ids, "__perhaps", bits).where("__perhaps").select(rows.columns)


class Bitmap:
    """Which hashes may be in a set: one bit each, by the highest bits of the hash."""

    def __init__(self, bits: int, data: np.ndarray | None):
        self.shift, self.data = U64(64 - bits.bit_length() + 1), data

    def has(self, x: np.ndarray) -> np.ndarray:
        if self.data is None:
            return np.ones(len(x), bool)
        at = x >> self.shift
        return (self.data[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & np.uint8(1) > 0


#: Bits of a bitmap of hashes: so many for each, up to 32 MB.
BITS_PER_KEY, MOST_KEY_BITS = 12, 1 << 28


def bitmap(keys: DataFrame, n: int) -> Bitmap:
    """Of the n hashes `g`; beyond MOST_KEY_BITS a bitmap that has everything."""
    bits = 1 << 20
    while bits < n * BITS_PER_KEY:
        bits *= 2
    if bits > MOST_KEY_BITS:
        return Bitmap(1 << 20, None)
    place = F.shiftrightunsigned("g", 65 - bits.bit_length()) + 1
    found = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    data = np.zeros((max(bits // 32768, 1), 4096), np.uint8)
    for r in found.toLocalIterator():
        data[r.b - 1] = np.frombuffer(r.m, np.uint8)
    return Bitmap(bits, data.ravel())


def bucket_bits(n: int, most: int) -> int:
    """Bits of the numbers of buckets with at most `most` of n rows each, about."""
    return max(0, (-(-n // most) - 1).bit_length())
