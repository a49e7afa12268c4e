"""Near-duplicate documents by SetSketch registers.

Every document's set of word shingles gives m registers K = floor(1 - log_b(x)), cut to 0..254, where x is the smallest of exponentially
distributed values that hash functions give its shingles (Ertl, 2021).  The
registers of a union are the maxima of the registers, and equal registers are
about as likely as the sets are similar.  Bands of registers give candidates;
the likelihood of the register comparisons drops the hopeless ones; what is
left is confirmed on the full sets.

Equal word sequences are one class, and only classes are compared.  Register
rows are compared freely, as they are small; whole texts move only for pairs
that pass the likelihood, once for each pair and once for each STAR of pairs
that share a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BLANK_WORDS, Words, batches, components, discard, keep, map_arrow, mix, out_batch, perhaps, perhaps_in, table

U64 = np.uint64
M, ROWS = 192, 6
BANDS = M // ROWS
BASE = 1.1
#: Register comparisons estimate a similarity within about 0.03; candidates
#: whose likeliest similarity is below threshold - SLACK are not compared.
SLACK = 0.13
#: Buckets of up to so many texts give all their pairs; larger ones are resolved by hubs.
SMALL_BUCKET = 8
HUBS = 4
#: Texts outside a bucket's largest part first meet so many central texts of it.
CENTRAL = 16
#: Then registers are compared in blocks of about so many rows, and each text's
#: likeliest partners of a block are confirmed; what is still outside is compared
#: by whole sets in larger blocks.
BLOCK, FIRST, WHOLE_BLOCK = 128, 2, 512
#: So many pairs share one copy of a text.
STAR = 64

_seeds = mix(np.arange(1, 2 * M + 1, dtype=U64))
_XOR = (_seeds[:M] >> U64(32)).astype(np.uint32)
_MUL = (_seeds[M:] >> U64(32)).astype(np.uint32) | np.uint32(1)
#: _LEVEL[k]: a smallest 32-bit hash up to this gives a register above k.
_LEVEL = (-np.expm1(-(BASE ** -(np.arange(255, dtype=float) - 30.0))) * 2.0**32)


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, and each text's first;
    a text with fewer words, but not none, has its whole sequence as one run."""
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], count)
    padded = np.concatenate([w.hash, np.zeros(size, U64)])
    step = lambda h, words, k: mix(h * U64(0x9FB21C651E98DF25) + words + U64(k + 1))
    every = np.zeros(len(w.hash), U64)
    for k in range(size):
        every = step(every, padded[k : k + len(every)], k)
    h = every[at]
    few = np.flatnonzero((n > 0) & (n < size))
    part, of = np.zeros(len(few), U64), w.first[few]
    for k in range(size):
        part = np.where(k < n[few], step(part, padded[of + k], k), part)
    h[first[few]] = part
    return h, first


def registers(h: np.ndarray) -> np.ndarray:
    """The M registers of a set of shingle hashes; none for the empty set."""
    low = np.full(M, 0xFFFFFFFF, np.uint32)
    short = (h >> U64(32)).astype(np.uint32)
    for i in range(0, len(short), 512):
        np.minimum(low, ((short[i : i + 512, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    return np.searchsorted(-_LEVEL, -(low.astype(float) + 0.5)).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("text_hi", pa.int64()), ("text_lo", pa.int64()), ("registers", pa.binary())])


def sequence_key(w: Words, i: int) -> tuple[int | None, int | None]:
    """128 bits that stand for the i-th text's words in order; none without words."""
    seq = w.hash[w.first[i] : w.first[i + 1]]
    if not len(seq):
        return None, None
    place = np.arange(1, len(seq) + 1, dtype=U64)
    return int(np.sum(mix(seq + place), dtype=U64).view(np.int64)), int(np.sum(mix(seq * (place | U64(1)) ^ U64(0x5BF03635)), dtype=U64).view(np.int64))


def _sketch(size: int):
    def run(it):
        for batch, texts in batches(it):
            w = Words(texts, BLANK_WORDS)
            h, first = shingle_hashes(w, size)
            n, keys, regs = [], [], []
            for i in range(len(texts)):
                own = np.unique(h[first[i] : first[i + 1]])
                n.append(len(own))
                keys.append(sequence_key(w, i))
                regs.append(registers(own).tobytes() if len(own) else None)
            yield out_batch(_SKETCH, doc_id=batch.column("doc_id"), n_shingles=n, text_hi=[k[0] for k in keys], text_lo=[k[1] for k in keys], registers=regs)

    return run


def sketches(docs: DataFrame, size: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, _sketch(size), "doc_id long, n_shingles long, text_hi long, text_lo long, registers binary")


def likeliest(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity that makes the register comparisons likeliest, given the
    sets' sizes; a row for each pair."""
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    score = more * np.log(up) + less * np.log(down) + (ra.shape[1] - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(u)), score.argmax(1)]


def _likely(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        for batch in it:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, M) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                good = np.concatenate([likeliest(ra[i : i + 2000], rb[i : i + 2000], na[i : i + 2000], nb[i : i + 2000]) for i in range(0, len(na), 2000)]) >= least
                yield out_batch(schema, a=batch.column("a").to_numpy()[good], b=batch.column("b").to_numpy()[good])

    return run


#: Columns of shingles that two blocks of sets are multiplied over at a time.
COLUMNS = 4096


def _coordinates(sets: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, column) of the shingles that are in the sorted vocabulary, by column."""
    size = [len(x) for x in sets]
    values = np.concatenate(sets) if sets else np.zeros(0, U64)
    at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
    hit = vocabulary[at] == values
    row, column = np.repeat(np.arange(len(sets)), size)[hit], at[hit]
    order = np.argsort(column, kind="stable")
    return row[order], column[order]


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a has in common with each of b, as products of 0-1 matrices."""
    vocabulary = np.unique(np.concatenate(a)) if a else np.zeros(0, U64)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(vocabulary) or not b:
        return out.astype(np.int64)
    parts = [_coordinates(x, vocabulary) for x in (a, b)]
    for lo in range(0, len(vocabulary), COLUMNS):
        dense = []
        for (row, column), n in zip(parts, out.shape, strict=True):
            x, y = np.searchsorted(column, (lo, lo + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(vocabulary) - lo)), np.float32)
            m[row[x:y], column[x:y] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _meet(least: float, percent: int, first: int | None):
    """Rows come sorted by (main, salt, part, kind): the odd texts (kind 0) of a
    block, then the texts to compare each of them with.

    With `first` it gives likely pairs of texts with different labels, for each
    odd text the `first` likeliest; else links of the sets in `shingles`, one
    for each odd text and label at most.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    pair = lambda x, y: (min(int(x), int(y)), max(int(x), int(y)))

    def linked(odd, main):
        o, ol, _, _, oset, reached = odd
        m, ml, _, _, mset, _ = main
        a, b = ([np.frombuffer(x, "<u8") for x in sets] for sets in (oset, mset))
        both = common_counts(a, b)
        union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b]) - both
        found = []
        for i, k in np.argwhere((100 * both >= percent * union) & (ol[:, None] != ml)).tolist():
            if int(ml[k]) not in reached[i]:
                reached[i].add(int(ml[k]))
                found.append(pair(o[i], m[k]))
        return found

    def pairs(odd, main):
        if first is None:
            return linked(odd, main)
        found = []
        o, ol, on, oreg, _, _ = odd
        m, ml, mn, mreg, _, _ = main
        for i in range(len(o)):
            at = np.flatnonzero((100 * np.minimum(mn, on[i]) >= percent * np.maximum(mn, on[i])) & (ml != ol[i]))
            # registers agree at least as often as the sets do
            at = at[(mreg[at] == oreg[i]).sum(1) >= (least - 0.1) * M]
            if len(at):
                j = likeliest(np.broadcast_to(oreg[i], (len(at), M)), mreg[at], np.full(len(at), float(on[i])), mn[at].astype(float))
                at, j = at[j >= least], j[j >= least]
                found += [pair(o[i], x) for x in m[at[np.lexsort((m[at], -j))[:first]]]]
        return found

    def run(it):
        key, odd = None, None
        for batch in it:
            if not batch.num_rows:
                continue
            main, salt, part, kind, node, label, n = (batch.column(c).to_numpy() for c in ("main", "salt", "part", "kind", "node", "label", "n"))
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8).reshape(-1, M)
            sets = batch.column("shingles").to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero((main[1:] != main[:-1]) | (salt[1:] != salt[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(main)]])
            links = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                rows = node[x:y], label[x:y], n[x:y], regs[x:y], sets[x:y], [set() for _ in range(x, y)]
                if (now := (int(main[x]), int(salt[x]), int(part[x]))) != key:
                    key, odd = now, None
                if kind[x] == 0:
                    odd = rows if odd is None else tuple(c + d if isinstance(c, list) else np.concatenate((c, d)) for c, d in zip(odd, rows, strict=True))
                elif odd is not None:
                    links += pairs(odd, rows)
            yield out_batch(schema, a=[x for x, _ in links], b=[y for _, y in links])

    return run


def shingle_set(text: str, size: int) -> set:
    words = text.encode("utf-8", "surrogatepass").translate(BLANK_WORDS).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def _sets(texts: list[str], size: int) -> list[np.ndarray]:
    h, first = shingle_hashes(Words(texts, BLANK_WORDS), size)
    return [np.unique(h[x:y]) for x, y in zip(first, first[1:], strict=False)]


def _set_of(size: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(it):
        for batch, texts in batches(it):
            yield out_batch(schema, node=batch.column("node"), shingles=[x.astype("<u8").tobytes() for x in _sets(texts, size)])

    return run


def _confirm(size: int, percent: int):
    """Rows come sorted by (hub, salt, kind): a star's hub (kind 0), then its others."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        last, own = None, np.zeros(0, U64)
        for batch, texts in batches(it):
            hub, kind, node, good = batch.column("hub").to_pylist(), batch.column("kind").to_pylist(), batch.column("node").to_pylist(), []
            for h, k, x, other in zip(hub, kind, node, _sets(texts, size), strict=True):
                if k == 0:
                    last, own = h, other
                    continue
                if h != last:
                    raise ValueError("a star without its hub")
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    good.append((min(h, x), max(h, x)))
            yield out_batch(schema, a=[x for x, _ in good], b=[y for _, y in good])

    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts(node, text)."""
    degree = pairs.select(F.col("a").alias("x")).union(pairs.select("b")).groupBy("x").agg(F.count("*").alias("d"))
    both = pairs.join(degree.select(F.col("x").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("x").alias("b"), F.col("d").alias("db")), "b")
    left = F.col("da") >= F.col("db")
    stars = both.select(F.when(left, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(left, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("da", "db").alias("d"))
    stars = keep(stars.select("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("d") / STAR)).alias("salt"), "node"), "stars")
    heads = stars.select("hub", "salt").distinct().join(texts, F.col("hub") == F.col("node")).select("hub", "salt", F.lit(0).alias("kind"), "node", "text")
    others = stars.join(texts, "node").select("hub", "salt", F.lit(1).alias("kind"), "node", "text")
    rows = heads.union(others).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    found = keep(rows.transform(map_arrow, _confirm(size, percent), "a long, b long"), "links")
    discard(stars)
    return found


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label) of components after further links(a, b), which join
    whole components: only their labels are gone through again."""
    own = labels.select("node", "label")
    name = lambda c: own.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ends = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
    top = components(ends.where("x <> y"), "x", "y")
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(own, "node", "left_anti")
    every = own.union(fresh.select("node", F.col("node").alias("label")))
    out = keep(every.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
    discard(top)
    return out


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row's doc_id, n_shingles and class; the classes of
    equal word sequences with their smallest doc_id and a number, node."""
    sk = keep(sketches(docs, size), "sketches")
    alike = sk.where("n_shingles > 0").groupBy("text_hi", "text_lo").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    # written with its numbers, so they stay the same for all that reads them
    classes = keep(alike.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = keep(sk.drop("registers"), "rows")
    discard(sk)
    return rows, classes


_KEYED = pa.schema([("text_hi", pa.int64()), ("text_lo", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])


def _keyed(it):
    for batch, texts in batches(it):
        w = Words(texts, BLANK_WORDS)
        keys = [sequence_key(w, i) for i in range(len(texts))]
        yield out_batch(_KEYED, text_hi=[k[0] for k in keys], text_lo=[k[1] for k in keys], doc_id=batch.column("doc_id"), text=texts)


def _components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, reached): every row's doc_id, n_shingles and class (text_hi,
    text_lo); every class's component and the smallest doc_id in it."""
    rows, classes = _classes(docs, size)
    byte = lambda i: F.conv(F.hex(F.substring("registers", i + 1, ROWS)), 16, 10).cast("long")
    bands = keep(classes.select("node", F.col("n").alias("size"), F.explode(F.array(*[byte(k * ROWS) + F.lit(k << 8 * ROWS) for k in range(BANDS)])).alias("band")), "bands")
    order = lambda k: F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "size")
    hub = F.min(F.when(F.shiftright("band", 8 * ROWS) % HUBS == 0, order(0)).when(F.shiftright("band", 8 * ROWS) % HUBS == 1, order(1)).when(F.shiftright("band", 8 * ROWS) % HUBS == 2, order(2)).otherwise(order(3)))
    buckets = keep(bands.groupBy("band").agg(hub.alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", F.col("n").alias("many"), F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size")), "buckets")
    shared = keep(bands.join(buckets, "band").select("band", "node", "size", "hub", "hub_size", "many"), "shared")
    discard(bands, buckets)
    # at most SMALL_BUCKET texts meet in a list, and so at most that many pairs for each
    small = shared.where(F.col("many") <= SMALL_BUCKET).groupBy("band").agg(F.collect_list(F.struct("node", "size")).alias("ids"))
    x, y = F.col("x"), F.col("y")
    alike = lambda s, t: 100 * F.least(s, t) >= percent * F.greatest(s, t)
    pairs = small.select(F.explode("ids").alias("s"), "ids").select("s", F.explode("ids").alias("t")).where(alike(F.col("s.size"), F.col("t.size"))).select(F.col("s.node").alias("x"), F.col("t.node").alias("y")).where(x < y)
    pairs = pairs.union(shared.where((F.col("many") > SMALL_BUCKET) & alike(F.col("size"), F.col("hub_size"))).select(F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y")).where(x < y))
    info = classes.select("node", "n", "registers")

    def likely(pairs: DataFrame) -> DataFrame:
        left = pairs.distinct().join(info.select(F.col("node").alias("x"), F.col("n").alias("na"), F.col("registers").alias("ra")), "x")
        full = left.join(info.select(F.col("node").alias("y"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "y")
        full = full.where(alike(F.col("na"), F.col("nb")))
        return keep(full.select(F.col("x").alias("a"), F.col("y").alias("b"), "na", "nb", "ra", "rb").transform(map_arrow, _likely(percent / 100 - SLACK), "a long, b long"), "likely")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text): one text of each of these classes."""
        wanted = keep(classes.select("node", "doc_id", "text_hi", "text_lo").join(nodes.select("node").distinct(), "node"), "wanted")
        first = perhaps_in(docs.select(F.col("doc_id").cast("long"), "text").where("text is not null"), wanted.select("doc_id"))
        # the texts' own keys, as an id may stand for several texts; one text of each class
        held = first.transform(map_arrow, _keyed, "text_hi long, text_lo long, doc_id long, text string")
        near = held.join(wanted.select("node", "text_hi", "text_lo", F.col("doc_id").alias("least")), ["text_hi", "text_lo"]).where("doc_id <=> least")
        found = keep(near.select("node", "text").dropDuplicates(["node"]), "texts")
        discard(wanted)
        return found

    def confirmed(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        found = _links(pairs, texts, size, percent)
        discard(texts)
        return found

    done = [likely(pairs)]
    links = [confirmed(done[0])]
    labels = components(links[0])
    large = shared.where(F.col("many") > SMALL_BUCKET)

    def odd() -> DataFrame:
        """(main, node, label) of texts that share a large bucket with its largest part, main, but aren't in it."""
        placed = keep(large.join(labels.select("node", "label"), "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "placed")
        parts = placed.groupBy("band", "label").agg(F.count("*").alias("n"))
        main = keep(parts.groupBy("band").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("band", F.col("m.label").alias("main")), "main")
        found = keep(placed.join(main, "band").where("label <> main").select("main", "node", "label").distinct(), "odd")
        discard(placed, main)
        return found

    def add(found: DataFrame) -> None:
        nonlocal labels
        links.append(found)
        if found.head(1):
            joined = _joined(labels, found)
            discard(labels)
            labels = joined

    def add_pairs(pairs: DataFrame) -> None:
        known = done[0]
        for p in done[1:]:
            known = known.union(p)
        done.append(new := keep(pairs.join(known, ["a", "b"], "left_anti"), "new"))
        if new.head(1):
            add(confirmed(new))

    def met(away: DataFrame, first: int | None) -> DataFrame:
        """The texts that are away from a part met with all its texts and with each
        other: likely pairs, or without `first` links."""
        mains, block = away.select("main").distinct(), BLOCK if first else WHOLE_BLOCK
        inside = labels.select(F.col("label").alias("main"), "node", "label").join(mains, "main", "left_semi")
        lone = mains.select("main", F.col("main").alias("node"), F.col("main").alias("label"))
        members = inside.union(lone).union(away).distinct()
        sizes = members.groupBy("main").agg(F.count("*").alias("nm")).join(away.groupBy("main").agg(F.count("*").alias("no")), "main")
        sizes = keep(sizes.select("main", F.ceil(F.col("nm") / block).cast("int").alias("salts"), F.ceil(F.col("no") / block).cast("int").alias("blocks")), "sizes")
        own = info.withColumn("shingles", F.lit(None).cast("binary"))
        if not first:
            texts = texts_of(members)
            sets = keep(texts.transform(map_arrow, _set_of(size), "node long, shingles binary"), "sets")
            discard(texts)
            own = info.join(sets, "node")
        full = keep(members.withColumn("kind", F.lit(1)).union(away.select("main", "node", "label", F.lit(0))).join(sizes, "main").join(own, "node"), "members")
        h = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        cols = ["main", "node", "label", "kind", "n", "registers", "shingles"]
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = full.where("kind = 1").select(*cols, h("salts").alias("salt"), every("blocks").alias("part")).unionByName(full.where("kind = 0").select(*cols, every("salts").alias("salt"), h("blocks").alias("part")))
        found = rows.repartition("main", "salt", "part").sortWithinPartitions("main", "salt", "part", "kind").transform(map_arrow, _meet(percent / 100 - SLACK, percent, first), "a long, b long")
        found = keep(found.distinct(), "met")
        discard(sizes, full, *([] if first else [sets]))
        return found

    away = odd() if large.head(1) else None
    if away is not None and away.head(1):
        # the texts with the most links are the likeliest to be near to others of their group
        degree = links[0].select(F.col("a").alias("node")).union(links[0].select("b")).groupBy("node").agg(F.count("*").alias("d"))
        spread = F.pmod(F.xxhash64("node"), F.lit(CENTRAL))
        central = keep(labels.join(degree, "node").groupBy("label", spread).agg(F.max(F.struct("d", "node")).alias("m")).select(F.col("label").alias("main"), F.col("m.node").alias("other")), "central")
        add_pairs(likely(away.join(central, "main").select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y"))))
        discard(central)
        for first in (FIRST, None):
            discard(away)
            away = odd()
            if not away.head(1):
                break
            if first:
                add_pairs(pairs := met(away, first))
                discard(pairs)
            else:
                add(met(away, None))
    low = classes.join(labels, "node", "left").select("text_hi", "text_lo", "doc_id", F.coalesce("label", "node").alias("component"))
    least = low.groupBy("component").agg(F.min("doc_id").alias("least"))
    reached = keep(low.select("text_hi", "text_lo", "component").join(least, "component"), "reached")
    discard(classes, shared, labels, *links, *done, *([away] if away is not None else []))
    return rows, reached


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs(doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets
    of `size`-word shingles.  component_id is the smallest doc_id that links
    lead to.  A null or empty text has no shingles and is linked with nothing;
    rows with the same word sequence are linked; rows that repeat a doc_id each
    give a row, and if their texts differ each is linked by its own; a null
    doc_id is linked like others, but never is a component's id, and kept only
    where the component has no other.  Other columns are ignored, so their names
    can't clash.

    Texts that share a band of registers are compared: all pairs of buckets of
    up to SMALL_BUCKET texts; in larger ones every text with a few hub texts; a
    text that isn't in its bucket's largest part then with central texts of that
    part, and, if it is still outside, with all of them and all others outside,
    in blocks of bounded size, so no such pair stays uncompared.
    """
    rows, reached = _components(docs, size, percent)
    found = rows.join(reached, ["text_hi", "text_lo"], "left")
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _with_keys(it):
    for batch, texts in batches(it):
        w = Words(texts, BLANK_WORDS)
        keys = [sequence_key(w, i) for i in range(len(texts))]
        cols = [*batch.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in range(2))]
        yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "__text_hi", "__text_lo"])


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each group of near_duplicates():
    one with the group's smallest doc_id (a null one comes last).  Rows without
    words stay; rows and columns stay as they are."""
    rows, reached = _components(docs, size, percent)
    placed = rows.join(reached, ["text_hi", "text_lo"])
    # of each component one class stays, and of that one row
    first = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.struct("text_hi", "text_lo")))
    several = keep(placed.groupBy("component").agg(F.count("*").alias("n"), first.alias("c")).where("n > 1").select("component", "c"), "several")
    chosen = (F.col("c.text_hi") == F.col("text_hi")) & (F.col("c.text_lo") == F.col("text_lo"))
    classes = keep(reached.join(several, "component").select(F.col("text_hi").alias("__hi"), F.col("text_lo").alias("__lo"), F.col("least").alias("__least"), chosen.alias("__chosen")), "groups")
    ids = keep(placed.join(several, "component", "left_semi").select("doc_id").distinct(), "ids")
    discard(rows, reached, several)
    marked = perhaps(docs, ids, "__doubt")
    doubt = marked.where("__doubt").select(docs.columns)
    keyed = doubt.transform(map_arrow, _with_keys, StructType([*docs.schema, StructField("__text_hi", LongType()), StructField("__text_lo", LongType())]))
    met = keyed.join(classes, (F.col("__text_hi") == F.col("__hi")) & (F.col("__text_lo") == F.col("__lo")), "left")
    one = met.where("__chosen and doc_id <=> __least").dropDuplicates(["__text_hi", "__text_lo"])
    return marked.where("not __doubt").select(docs.columns).unionByName(met.where("__chosen is null").select(docs.columns)).unionByName(one.select(docs.columns))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLES: dict[str, str] = {}
