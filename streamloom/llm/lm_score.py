"""Scoring texts by a probabilistic suffix tree over words.

A context is the last one to DEPTH words.  Word sequences that occur MIN_COUNT
times in the training text are looked at, whatever their share, so the tree
grows with the corpus; those of three words and more if the tree stores what is
left without their last and without their first word.  A context's next word is stored if it is so much
likelier after the context than after the context's own suffix that its
occurrences gain MIN_GAIN nats; a context is retained if the divergence of its
next-word distribution from its suffix's, times its occurrences, is
MIN_DIVERGENCE nats or more.  With c occurrences of the word after n of the
context, its probability there is

    P(w | s) = (c - DISCOUNT) / n  [if stored]  +  left(s) * P(w | next shorter retained suffix)

where left(s) is what the discounts and the words that aren't stored leave, so
every distribution sums to one.  The root is the smoothed distribution of all
training words.

So a text's score is a sum of values of its word sequences of up to DEPTH + 1
words: log P(w | s) over log P(w | suffix) for stored words, log left(s) for
retained contexts.  The tree is a table of such values.  Counting and look-up
are columnar shuffles: tasks pack hashes into one binary per bucket of the hash
space, so the shuffle has few rows and no bucket depends on a hot word.
Executors get only the values of sequences that make up MIN_WORD of the tokens,
at most 1 / MIN_WORD for each length, and a bitmap of bounded size that keeps
sequences without a value out of the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_WORDS, Bitmap, Words, batches, bitmap, bucket_bits, discard, id_bucket, keep, map_arrow, mix, out_batch, table

U64 = np.uint64
#: Words of the longest context.
DEPTH = 2
MIN_WORD = 1e-6
#: Sequences that occur more rarely aren't stored, nor are contexts of them.
MIN_COUNT = 2
DISCOUNT = 0.75
#: In nats: of a stored word's occurrences together, of a context's.
MIN_GAIN, MIN_DIVERGENCE = 6.0, 9.0
ALPHA = 0.1
END = U64(0x0E4D0E4D0E4D0E4D)
GROUP = 1 << 20
#: A task adds up so many sequences before it passes them on.
KEYS = 1 << 20
#: A bucket has about so many tokens' sequences, or so many values.
BUCKET_TOKENS, BUCKET_VALUES = 1 << 20, 1 << 19


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end, and each text's first."""
    n = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(first[-1], END, U64)
    out[np.arange(len(w.hash)) + w.doc] = w.hash
    return out, first


def combine(s: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its words but the last, and but the first."""
    return mix(s * U64(0x9FB21C651E98DF25) + u + U64(1))


def sequences(tok: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """For each token a hash of the 1, 2, ... `size` tokens that end with it; 0 if the text has fewer."""
    back = np.arange(len(tok)) - np.repeat(first[:-1], np.diff(first))
    out = [combine(np.zeros(len(tok), U64), tok)]
    for n in range(2, size + 1):
        key = np.zeros(len(tok), U64)
        key[1:] = combine(out[-1][:-1], out[-1][1:])
        key[back < n - 1] = 0
        out.append(key)
    return out


def among(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each x's place in sorted_keys, -1 if it isn't there."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)


_PACKED = pa.schema([("bucket", pa.int64()), ("s", pa.binary()), ("u", pa.binary()), ("c", pa.binary())])
_COUNTED = pa.schema([(x, pa.int64()) for x in ("g", "s", "u", "c")])


def _added(g, s, u, c):
    """Equal sequences with their counts added, by g."""
    order = np.argsort(g, kind="stable")
    g = g[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[first], s[order[first]], u[order[first]], np.add.reduceat(c[order], first) if len(first) else c


def _count(size: int, bits: int, shorter):
    """Packs the sequences of `size` words of each text as those that are left
    without the last word (s) and without the first (u); of one word as u and
    nothing.  shorter: the bitmap of sequences that are one word shorter, and
    frequent enough."""

    def packed(parts):
        g, s, u, c = _added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        cuts = np.searchsorted(g >> U64(64 - bits) if bits else np.zeros(len(g), U64), np.arange((1 << bits) + 1, dtype=U64))
        at = np.flatnonzero(np.diff(cuts))
        blob = lambda x: [x[cuts[i] : cuts[i + 1]].tobytes() for i in at]
        return out_batch(_PACKED, bucket=at, s=blob(s.astype("<u8")) if size > 1 else [b""] * len(at), u=blob(u.astype("<u8")), c=blob(c.astype("<u4")))

    def run(it):
        parts, n = [], 0
        for _, texts in batches(it, most=GROUP):
            tok, first = tokens(Words(texts, BLANK_WORDS))
            *_, g = keys = sequences(tok, first, size)
            s = u = g
            if size > 1:
                u = keys[-2]
                s = np.concatenate([[U64(0)], u[:-1]])
                may = shorter.value.has(u)
                ok = np.flatnonzero((g != 0) & may & np.concatenate([[False], may[:-1]]))
                g, s, u = g[ok], s[ok], u[ok]
            parts.append(_added(g, s, u, np.ones(len(g), np.int64)))
            n += len(parts[-1][0])
            if n > KEYS:
                yield packed(parts)
                parts, n = [], 0
        if parts:
            yield packed(parts)

    return run


def _merge(size: int, least: int):
    """Rows come sorted by bucket: adds up what all tasks packed for it."""

    def done(parts):
        s, u, c = (np.frombuffer(b"".join(x), k) for x, k in zip(zip(*parts, strict=True), ("<u8", "<u8", "<u4"), strict=True))
        s = s if size > 1 else u
        g, s, u, c = _added(combine(s, u) if size > 1 else u, s, u, c.astype(np.int64))
        ok = np.flatnonzero(c >= least)
        for i in range(0, len(ok), 1 << 16):
            k = ok[i : i + (1 << 16)]
            yield out_batch(_COUNTED, g=g[k].view(np.int64), s=s[k].view(np.int64), u=u[k].view(np.int64), c=c[k])

    def run(it):
        key, parts = None, []
        for batch in it:
            for b, *data in zip(*(batch.column(x).to_pylist() for x in _PACKED.names), strict=True):
                if b != key and parts:
                    yield from done(parts)
                    parts = []
                key = b
                parts.append(data)
        if parts:
            yield from done(parts)

    return run


def counted(train: DataFrame, size: int, bits: int, least: int, shorter=None) -> DataFrame:
    """(g, s, u, c): the sequences of `size` words that occur `least` times."""
    packed = train.transform(map_arrow, _count(size, bits, shorter), "bucket long, s binary, u binary, c binary")
    found = packed.repartition("bucket").sortWithinPartitions("bucket").transform(map_arrow, _merge(size, least), "g long, s long, u long, c long")
    return keep(found if size > 1 else found.select("g", "c"), f"words{size}")


def _parts(found: DataFrame, level: DataFrame, least: float) -> DataFrame:
    """found(g, s, u, c) with the count of s (n) and the probabilities of u (q, logp).
    What is frequent is broadcast, `least` bounds how much, so only the rest is shuffled."""

    def joined(rows: DataFrame, at: DataFrame, how: str, wrap=lambda x: x) -> DataFrame:
        own = wrap(at.select(F.col("g").alias("s"), F.col("c").alias("n")))
        return rows.join(own, "s", how).join(wrap(at.select(F.col("g").alias("u"), "q", "logp")), "u", how)

    near = joined(found, level.where(F.col("c") >= least), "left", F.broadcast)
    both = F.col("n").isNotNull() & F.col("q").isNotNull()
    rest = joined(near.where(~both).select("g", "s", "u", "c"), level, "inner")
    cols = ["g", "s", "c", "n", "q", "logp"]
    return near.where(both).select(cols).union(rest.select(cols))


_VALUES = ("g", "value", "c", "often", "size")


def tree(train: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, int, int]:
    """(values, tokens, distinct words) of train(text).

    values(g, value, c, often, size): what each word sequence of `size` words adds
    to a text's log probability, and how often it occurs; rows of one sequence
    add up.  All words are there, c is their count (0 for longer sequences), and
    their probability at the root isn't in the value.
    """
    sc = train.sparkSession.sparkContext
    # about the number of tokens, which says how many buckets there must be
    guess = train.agg(F.coalesce(F.sum(F.octet_length("text") / 5 + 1), F.lit(0))).first()[0]
    bits = bucket_bits(int(guess), BUCKET_TOKENS)
    words = counted(train, 1, bits, 1)
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    root = (F.col("c") + ALPHA) / F.lit(total + ALPHA * (distinct + 1))
    # of each sequence its count, its last word's share after its other words (q), and the tree's log probability of it there
    level = words.select("g", "c", root.alias("q"), F.log(root).alias("logp"))
    values = [words.select("g", F.lit(0.0), "c", "c", F.lit(1))]
    frequent, kept = words.where(F.col("c") >= MIN_COUNT).select("g"), [words]
    for size in range(2, depth + 2):
        n = frequent.count()
        if not n:
            break
        shorter = sc.broadcast(bitmap(frequent, n))
        found = counted(train, size, bits, MIN_COUNT, shorter)
        shorter.unpersist()
        gain = F.col("c") * F.log(F.col("c") / (F.col("n") * F.col("q")))
        known = keep(_parts(found, level, MIN_WORD * total).withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN), "known")
        discard(found)
        sums = known.groupBy("s").agg(F.first("n").alias("n"), F.sum("c").alias("sc"), F.sum("q").alias("sq"), F.sum("gain").alias("sg"), F.count("*").alias("k"))
        # the words that aren't stored count as one
        rest = F.col("n") - F.col("sc")
        other = F.when(rest > 0, rest * F.log(rest / (F.col("n") * F.greatest(1 - F.col("sq"), F.lit(1e-12))))).otherwise(0.0)
        context = keep(sums.where(F.col("sg") + other >= MIN_DIVERGENCE).select("s", "n", ((rest + F.col("k") * DISCOUNT) / F.col("n")).alias("left")), "contexts")
        here = F.log((F.col("c") - DISCOUNT) / F.col("n") + F.col("left") * F.exp("logp"))
        stored = known.join(context.select("s", "left"), "s")
        level = keep(stored.select("g", "c", (F.col("c") / F.col("n")).alias("q"), here.alias("logp"), (here - F.col("logp") - F.log("left")).alias("value")), "level")
        discard(known)
        values += [context.select("s", F.log("left"), F.lit(0).cast("long"), "n", F.lit(size - 1)), level.select("g", "value", F.lit(0).cast("long"), "c", F.lit(size))]
        kept += [context, level]
        frequent = level.select("g")
    every = values[0]
    for x in values[1:]:
        every = every.union(x)
    out = keep(every.toDF(*_VALUES), "tree")
    discard(*kept)
    return out, total, distinct


class Frequent:
    """What executors get of the tree: values(g, value, c, size) of frequent
    sequences, and the bitmaps of the others of two words and more."""

    def __init__(self, rows: pa.Table, maps: list[Bitmap], norm: float, bits: int):
        self.levels, self.maps, self.norm, self.bits = [], maps, norm, bits
        size = rows["size"].to_numpy()
        for k in range(1, len(maps) + 2):
            own = size == k
            g = rows["g"].to_numpy()[own].view(U64)
            order = np.argsort(g)
            self.levels.append((g[order], rows["c"].to_numpy()[own][order], rows["value"].to_numpy()[own][order]))


_MIXED = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("row", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("g", pa.int64()), ("value", pa.float64()), ("c", pa.int64())])
_MIXED_DDL = "bucket long, kind int, row long, keys binary, docs binary, g long, value double, c long"
_ADDED = pa.schema([("row", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_TEXT = np.dtype([("doc_id", "<i8"), ("null", "?"), ("held_out", "?"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("gain", "<f8")])
_ADD = np.dtype([("doc", "<u4"), ("n_known", "<i8"), ("base", "<f8"), ("gain", "<f8")])


def _records(kind: np.dtype, **cols) -> bytes:
    out = np.empty(len(next(iter(cols.values()))), kind)
    for name, x in cols.items():
        out[name] = x
    return out.tobytes()


def _features(use):
    """For each group of texts, by the number of its first, rows of kind 1 for
    each bucket: hashes of sequences, and the texts that hold them; and one of
    kind 2 with all its texts and what frequent sequences add."""

    def run(it):
        t, row = use.value, (TaskContext.get().partitionId() << 36)
        for batch, texts in batches(it, most=GROUP):
            tok, first = tokens(Words(texts, BLANK_WORDS))
            doc, n = np.repeat(np.arange(len(texts)), np.diff(first)), len(texts)
            sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023, E731
            levels = sequences(tok, first, 1 + len(t.maps))
            g, c, v = t.levels[0]
            at = among(g, levels[0])
            known = at >= 0
            # as if all others were unknown
            base = np.log10((np.where(known, c[at], 0) + ALPHA) / t.norm) if len(g) else np.full(len(tok), math.log10(ALPHA / t.norm))
            gain = np.where(known, v[at], 0.0) if len(g) else np.zeros(len(tok))
            keys, docs = [levels[0][~known]], [doc[~known]]
            for key, may, (g, _, v) in zip(levels[1:], t.maps, t.levels[1:], strict=True):
                at = among(g, key)
                if len(g):
                    gain += np.where(at >= 0, v[at], 0.0)
                rare = np.flatnonzero((at < 0) & (key != 0) & may.has(key))
                keys.append(key[rare])
                docs.append(doc[rare])
            ids = batch.column("doc_id")
            own = _records(_TEXT, doc_id=ids.fill_null(0).to_numpy(), null=ids.is_null().to_numpy(zero_copy_only=False), held_out=batch.column("held").to_numpy(zero_copy_only=False), n_tokens=np.diff(first), n_known=sums(known.astype(np.int64)), base=sums(base), gain=sums(gain))
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            bucket = (keys >> U64(64 - t.bits)).astype(np.int64) if t.bits else np.zeros(len(keys), np.int64)
            order = np.argsort(bucket, kind="stable")
            # the texts of a group are few, as a rule
            keys, docs, bucket = keys[order].astype("<u8"), docs[order].astype("<u2" if n <= 1 << 16 else "<u4"), bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            blob = lambda x: [x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]  # noqa: B023, E731
            k = len(cuts) - 1
            none = lambda kind: pa.nulls(k + 1, kind)  # noqa: B023, E731
            yield out_batch(_MIXED, bucket=[*bucket[cuts[:-1]], int(mix(np.array([row], U64))[0] & U64((1 << t.bits) - 1))], kind=[1] * k + [2], row=[row] * (k + 1), keys=[*blob(keys), own], docs=[*blob(docs), None], g=none(pa.int64()), value=none(pa.float64()), c=none(pa.int64()))
            row += n

    return run


def _look_up(it):
    """Rows come sorted by (bucket, kind): the bucket's values (kind 0), then the
    packed sequences of groups of texts (kind 1), of which it gives what they add
    to each text; and texts (kind 2), which pass."""
    key, parts, g = None, [], None
    for batch in it:
        kind, bucket = batch.column("kind").to_numpy(), batch.column("bucket").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(kind)]]) if len(kind) else []
        for x, y in zip(cuts, cuts[1:], strict=False):
            if bucket[x] != key:
                key, parts, g = int(bucket[x]), [], None
            own = batch.slice(x, y - x)
            if kind[x] == 0:
                cols = [own.column(c).to_numpy(zero_copy_only=False).copy() for c in ("g", "value", "c")]
                parts.append((cols[0].view(U64), *cols[1:]))
                continue
            rows, keys = own.column("row").to_pylist(), own.column("keys").to_pylist()
            if kind[x] == 2:
                yield out_batch(_ADDED, row=rows, kind=[0] * len(rows), data=keys)
                continue
            if g is None:
                (g, value, c), parts = _values(parts), []
            out = []
            for k, d in zip(keys, own.column("docs").to_pylist(), strict=True):
                at, d = among(g, np.frombuffer(k, "<u8")), np.frombuffer(d, "<u2" if 4 * len(d) == len(k) else "<u4").astype(np.int64)
                k, d = at[at >= 0], d[at >= 0]
                some, place = np.unique(d, return_inverse=True)
                add = lambda z: np.bincount(place, z, len(some))  # noqa: B023, E731
                out.append(_records(_ADD, doc=some, n_known=add(c[k] > 0), base=add(np.log10((c[k] + ALPHA) / ALPHA)), gain=add(value[k])))
            yield out_batch(_ADDED, row=rows, kind=[1] * len(rows), data=out)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _added_up(it):
    """Rows come sorted by (row, kind): a group's texts, then what is added to them."""

    def done(texts):
        yield out_batch(_SCORED, doc_id=pa.array(texts["doc_id"], mask=texts["null"]), held_out=texts["held_out"], n_tokens=texts["n_tokens"], n_known=texts["n_known"], base_score=texts["base"], score=texts["base"] + texts["gain"] / math.log(10))

    texts = None
    for batch in it:
        for k, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if k == 0:
                if texts is not None:
                    yield from done(texts)
                texts = np.frombuffer(data, _TEXT).copy()
                continue
            more = np.frombuffer(data, _ADD)
            for name in ("n_known", "base", "gain"):
                texts[name][more["doc"]] += more[name]
    if texts is not None:
        yield from done(texts)


def _values(parts: list[tuple]) -> list[np.ndarray]:
    """Sequences with their values and counts added up, in order."""
    if not parts:
        return [np.zeros(0, U64), np.zeros(0), np.zeros(0, np.int64)]
    g, value, c = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(g, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
    return [g[order][new], np.add.reduceat(value[order], new), np.add.reduceat(c[order], new)]


def scored(docs: DataFrame, values: DataFrame, total: int, distinct: int) -> DataFrame:
    """docs(doc_id, text, held) scored with the tree's values."""
    norm = total + ALPHA * (distinct + 1)
    often = F.col("often") >= MIN_WORD * total
    top = values.where(often).groupBy("g", "size").agg(F.sum("value").alias("value"), F.sum("c").alias("c")).toArrow()
    rare = values.where(~often)
    many = {r["size"]: r["count"] for r in rare.groupBy("size").count().collect()}
    longest = values.agg(F.max("size")).first()[0] or 1
    maps = [bitmap(rare.where(F.col("size") == k).select("g"), many.get(k, 0)) for k in range(2, longest + 1)]
    bits = bucket_bits(sum(many.values()), BUCKET_VALUES)
    use = docs.sparkSession.sparkContext.broadcast(Frequent(top, maps, norm, bits))
    packed = docs.select("doc_id", "text", "held").transform(map_arrow, _features(use), _MIXED_DDL)
    bucket = F.shiftrightunsigned("g", 64 - bits) if bits else F.lit(0).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    model = rare.select(bucket, F.lit(0), none("long"), none("binary"), none("binary"), "g", "value", "c").toDF(*_MIXED.names)
    added = model.union(packed).repartition("bucket").sortWithinPartitions("bucket", "kind").transform(map_arrow, _look_up, "row long, kind int, data binary")
    found = added.repartition("row").sortWithinPartitions("row", "kind").transform(map_arrow, _added_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, held_out: int = 0, modulus: int = 10, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    for docs(doc_id, text).

    Learns from rows whose crc32(doc_id as text) mod `modulus` isn't `held_out`.
    base_score: log10 probability by smoothed word counts; score: by the suffix
    tree.  A null or empty text is the end alone.  Repeated rows each give a
    row; a null id counts as remainder 0; without training rows every token
    has the probability that is left to unknown ones; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held", id_bucket("doc_id", modulus) == held_out)
    values, total, distinct = tree(own.where("not held").select(F.coalesce("text", F.lit("")).alias("text")), depth)
    return scored(own, values, total, distinct)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_score": op10_lm_score}
ORACLES: dict[str, str] = {}
