"""Benchmark decontamination with suffix arrays over the training text.

Groups of training texts are shards.  A shard's suffix array holds, in order,
the word suffixes that begin like some benchmark suffix (others can't match).
The benchmark's suffixes are sorted whole, so those that share a window lie side
by side; every distinct window is binary-searched in every shard, which gives
all its places, and every place is searched among the window's suffixes, which
gives the longest verbatim match there.  So a place counts once for a window,
however many items hold it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN_WORDS, Words, batches, keep, map_arrow, out_batch, table

U64 = np.uint64
WINDOW = 13
#: Suffixes enter a shard's array if so many first words begin a benchmark suffix.
HEAD = 3
SHARD_BYTES = 1 << 20
#: The benchmark is sent to the executors in blocks of about so many bytes of
#: text, so many at a time; a larger benchmark takes several passes.
BLOCK_BYTES, MOST_BLOCKS = 4 << 20, 4
#: Places that are compared for their longest match at a time, besides those of a single suffix.
PLACES = 1 << 20


class Suffixes:
    """The suffixes of a block of benchmark items. ids: the items' ids as text.

    order: the suffixes that begin with a whole window, sorted by their words up
    to their item's end; begin, many: the part of it that shares a window, for
    each distinct window; head: that window's first suffix; lists, list_of: the
    distinct lists of item ids that hold a window, and each window's.
    """

    def __init__(self, ids: list[str], texts: list[str], window: int):
        w = Words(texts, PLAIN_WORDS)
        self.ids, self.window = ids, window
        self.vocabulary = np.unique(w.hash)
        n = np.diff(w.first)
        words = np.searchsorted(self.vocabulary, w.hash).astype(np.int64) + 1
        # 0 ends an item, so no match leads beyond it
        at = np.arange(len(words)) + w.doc
        self.words = np.zeros(len(words) + len(n) + window + HEAD, np.int64)
        self.words[at] = words
        left = np.repeat(w.first[1:], n) - np.arange(len(words))
        need = np.minimum(n, window)[w.doc]
        self.at, self.item, self.size = at, w.doc, np.minimum(left, need)
        whole = np.flatnonzero(left >= need)
        rank = suffix_ranks(self.words, int(n.max(initial=0)))[at[whole]]
        self.order = whole[np.lexsort((whole, rank))]
        rows = self.words[self.at[self.order][:, None] + np.arange(window)[None, :]] * (np.arange(window)[None, :] < self.size[self.order][:, None])
        new = np.ones(len(self.order), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        self.begin = np.flatnonzero(new)
        self.many = np.diff(np.append(self.begin, len(self.order)))
        self.head = self.order[self.begin]
        names, name = np.unique(np.array(ids, object).astype(str), return_inverse=True) if ids else (np.zeros(0, str), np.zeros(0, np.int64))
        self.names, pairs = names.tolist(), np.cumsum(new) - 1
        pairs = np.unique(pairs * max(len(names), 1) + name[self.item[self.order]]) if len(self.order) else pairs
        cuts = np.searchsorted(pairs, np.arange(len(self.begin) + 1) * max(len(names), 1))
        seen: dict[bytes, int] = {}
        self.list_of = np.array([seen.setdefault((pairs[x:y] % max(len(names), 1)).tobytes(), len(seen)) for x, y in zip(cuts, cuts[1:], strict=False)], np.int64)
        self.lists = [np.frombuffer(x, np.int64) for x in seen]


def suffix_ranks(words: np.ndarray, most: int) -> np.ndarray:
    """The rank of each place by the `most` words from it on, by doubling."""
    rank, step = words.copy(), 1
    while step < most:
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1]
        step *= 2
    return rank


def _heads(words: np.ndarray, at: np.ndarray, k: int, base: int) -> np.ndarray:
    key = np.zeros(len(at), np.int64)
    for i in range(k):
        key = key * base + words[at + i] if base ** HEAD < 1 << 62 else key * np.int64(0x2545F4914F6CDD1D) + words[at + i]
    return key


def _keys(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    rows = words[at[:, None] + np.arange(k)[None, :]].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * k}").ravel()


class Shard:
    """The suffix array of the words of some texts, for searches of a block."""

    def __init__(self, w: Words, bench: Suffixes):
        v = bench.vocabulary
        at = np.searchsorted(v, w.hash)
        ids = np.where(v[np.minimum(at, len(v) - 1)] == w.hash, at + 1, 0) if len(v) else np.zeros(len(w.hash), np.int64)
        # 0 stands for words that no item has, and after each text
        self.place = np.arange(len(ids)) + w.doc
        self.words = np.zeros(len(ids) + len(w.first) + bench.window + HEAD, np.int64)
        self.words[self.place] = ids
        self.bench = bench
        self.arrays = {}
        base = len(v) + 1
        for k in np.unique(np.minimum(bench.size, HEAD)):
            own = bench.at[np.minimum(bench.size, HEAD) == k]
            begins = np.unique(_heads(bench.words, own, k, base))
            head = _heads(self.words, self.place, k, base)
            found = self.place[begins[np.minimum(np.searchsorted(begins, head), len(begins) - 1)] == head]
            found = found[(self.words[found[:, None] + np.arange(k)[None, :]] > 0).all(1)] if len(found) else found
            keys = _keys(self.words, found, bench.window)
            order = np.argsort(keys, kind="stable")
            self.arrays[int(k)] = (found[order], keys[order])

    def ranges(self, own: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends in `keys` of what shares `size` words, up to a window, with the benchmark suffixes `own`."""
        b = self.bench
        rows = b.words[b.at[own][:, None] + np.arange(b.window)[None, :]]
        beyond = np.arange(b.window)[None, :] >= size[:, None]
        low, high = (np.ascontiguousarray(np.where(beyond, x, rows).astype(">u4")).view(f"S{4 * b.window}").ravel() for x in (0, 0xFFFFFFFF))
        return np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """All (distinct window, place in the shard) where a whole window matches."""
        b, found = self.bench, []
        for k, (suffix, keys) in self.arrays.items():
            own = np.flatnonzero(np.minimum(b.size[b.head], HEAD) == k)
            if not len(own) or not len(suffix):
                continue
            lo, hi = self.ranges(b.head[own], b.size[b.head[own]], keys)
            n = hi - lo
            each = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found.append((np.repeat(own, n), suffix[each]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def best(self, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of a window the suffix with the longest match there, and
        its length: a binary search of the place among the window's suffixes."""
        b = self.bench
        lo, hi = b.begin[window], b.begin[window] + b.many[window]
        suffix, size = b.head[window], np.zeros(len(window), np.int64)
        live = np.arange(len(window))
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            own = b.order[mid]
            n = self.extend(own, place[live], b.size[own])
            better = n > size[live]
            suffix[live[better]], size[live[better]] = own[better], n[better]
            x = self.words[np.minimum(place[live] + n, len(self.words) - 1)]
            y = b.words[np.minimum(b.at[own] + n, len(b.words) - 1)]
            after = x > y
            lo[live[after]], hi[live[~after]] = mid[after] + 1, mid[~after]
            live = live[lo[live] < hi[live]]
        return suffix, size

    def extend(self, suffix: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many words match from each place on, if `size` of them do."""
        b, size, live = self.bench, size.copy(), np.arange(len(size))
        while len(live):
            x = self.words[np.minimum(place[live] + size[live], len(self.words) - 1)]
            y = b.words[np.minimum(b.at[suffix[live]] + size[live], len(b.words) - 1)]
            live = live[(x == y) & (x > 0)]
            size[live] += 1
        return size

    def longest(self, least: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
        """For each benchmark suffix the length of its longest match in the
        shard, and its first place (0 and -1 where there is none).  Keys end
        after a window, so of matches with `least` words or more all places
        that share the longest one's words in their keys are compared."""
        b = self.bench
        best, where = np.zeros(len(b.at), np.int64), np.full(len(b.at), -1)
        for k, (suffix, keys) in self.arrays.items():
            own = np.flatnonzero(np.minimum(b.size, HEAD) == k)
            if not len(own) or not len(suffix):
                continue
            place = np.searchsorted(keys, _keys(b.words, b.at[own], b.window))
            for step in range(-1, 1):
                near = np.clip(place + step, 0, len(suffix) - 1)
                size = self.extend(own, suffix[near], np.zeros(len(own), np.int64))
                better = size > best[own]
                best[own[better]], where[own[better]] = size[better], suffix[near[better]]
            own = own[best[own] >= max(least, 1)]
            if not len(own):
                continue
            lo, hi = self.ranges(own, best[own], keys)
            part = np.cumsum(hi - lo) // PLACES
            for cut in np.split(np.arange(len(own)), np.flatnonzero(np.diff(part)) + 1):
                n = (hi - lo)[cut]
                each = np.repeat(lo[cut] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                of, at = np.repeat(own[cut], n), suffix[each]
                size = self.extend(of, at, np.minimum(best[of], b.window))
                order = np.lexsort((at, -size, of))
                first = order[np.concatenate([[0], np.flatnonzero(np.diff(of[order])) + 1])]
                best[of[first]], where[of[first]] = size[first], at[first]
        return best, where


class Benchmark:
    """The benchmark's rows in blocks of a checked size, which passes() broadcasts
    a bounded number at a time."""

    def __init__(self, bench: DataFrame, window: int, item: str = "item_id", text: str = "text"):
        self.rows = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        self.n = -(-(self.rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0) // BLOCK_BYTES)
        self.window, self.sc = window, bench.sparkSession.sparkContext

    def block(self, k: int):
        got = sorted((r.item, r.text) for r in (self.rows if self.n == 1 else self.rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.n)) == k)).toLocalIterator())
        return self.sc.broadcast(Suffixes([x for x, _ in got], [x for _, x in got], self.window))

    def passes(self):
        for k in range(0, max(self.n, 1), MOST_BLOCKS):
            blocks = [self.block(i) for i in range(k, min(k + MOST_BLOCKS, self.n))]
            yield blocks
            if self.n > MOST_BLOCKS:
                for x in blocks:
                    x.unpersist()


_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_BEST = pa.struct([("length", pa.int64()), ("less_word", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])
_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", _SPAN), ("items", pa.list_(pa.string())), ("best", _BEST)])
_HITS_DDL = "doc_id long, n_words long, hits array<struct<a: long, b: long>>, items array<string>, best struct<length: long, less_word: long, item: string, item_word: long>"


def _search(texts: list[str], blocks: list, window: int) -> tuple:
    """For each text its number of words, which words are hit (of all texts end to
    end, and each text's first), the items found, and the longest match."""
    w = Words(texts, PLAIN_WORDS)
    n = np.diff(w.first)
    change = np.zeros(len(w.hash) + len(texts) + window + HEAD + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    longest: list[tuple | None] = [None] * len(texts)
    place_doc = np.repeat(np.arange(len(texts)), n + 1)
    for block in blocks:
        shard = Shard(w, b := block.value)
        win, place = shard.windows()
        if not len(win):
            continue
        np.add.at(change, place, 1)
        np.add.at(change, place + b.size[b.head[win]], -1)
        doc = place_doc[place]
        for x in np.unique(doc * len(b.lists) + b.list_of[win]).tolist():
            items[x // len(b.lists)].update(b.lists[x % len(b.lists)].tolist())
        for d in np.unique(doc).tolist():
            items[d] = {b.names[x] if isinstance(x, int) else x for x in items[d]}
        suffix, size = shard.best(win, place)
        order = np.lexsort((suffix, place, -size, doc))
        for k in order[np.unique(doc[order], return_index=True)[1]].tolist():
            d, s = int(doc[k]), int(suffix[k])
            # the first of the longest matches
            found = (int(size[k]), -int(place[k] - w.first[d] - d), b.ids[b.item[s]], int(b.at[s] - b.at[np.searchsorted(b.item, b.item[s])]))
            longest[d] = max(longest[d] or found, found)
    return n, np.cumsum(change)[np.arange(len(w.hash)) + w.doc] > 0, w.first, items, longest


def _spans(hit: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Runs of hit words in each text, counted from its first word."""
    out: list[list[dict]] = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8))).tolist()
        out.append([dict(a=x, b=y) for x, y in zip(edge[::2], edge[1::2], strict=True)])
    return out


def _hits(blocks: list, window: int):
    def run(it):
        for batch, texts in batches(it, most=SHARD_BYTES):
            n, hit, first, items, longest = _search(texts, blocks, window)
            best = [x and dict(zip(("length", "less_word", "item", "item_word"), x, strict=True)) for x in longest]
            yield out_batch(_HITS, doc_id=batch.column("doc_id"), n_words=n, hits=_spans(hit, first), items=[sorted(x) for x in items], best=best)

    return run


#: Of spans in order, the words that at least one covers.
_COVERED = "aggregate(array_sort(hits), named_struct('n', 0L, 'to', 0L), (s, x) -> named_struct('n', s.n + greatest(x.b - greatest(x.a, s.to), 0L), 'to', greatest(s.to, x.b)), s -> s.n)"
_ROW = "__streamloom_row"


def _numbered(docs: DataFrame, *cols) -> DataFrame:
    return keep(docs.select(*cols).withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def _merged(rows: DataFrame, bench: Benchmark) -> DataFrame:
    """Hits by row of rows(text, _ROW) over several passes."""
    parts = []
    for blocks in bench.passes():
        got = rows.select(F.col(_ROW).alias("doc_id"), "text").transform(map_arrow, _hits(blocks, bench.window), _HITS_DDL)
        parts.append(keep(got if not parts else got.where("size(hits) > 0"), "hits"))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy(F.col("doc_id").alias(_ROW)).agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("best").alias("best"))


def benchmark_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, longest, longest_word,
    longest_item, longest_item_word) for docs(doc_id, text).

    items: the ids of the benchmark items of which a whole window occurs, as
    sorted strings; n_hit: the words inside such occurrences; longest: the words
    of the longest verbatim match that holds a whole window (0 without any), and
    where it begins in the document and the item, counted from 0 (else null).
    Null and empty texts have no words and no hits; repeated rows each give a
    row; equal ids of items count once, and a null one is "null"; without items
    nothing is hit.  Other columns are ignored.

    A benchmark beyond MOST_BLOCKS * BLOCK_BYTES takes several passes over the
    documents, so what is broadcast stays bounded.
    """
    blocks = Benchmark(bench, window)
    if blocks.n <= MOST_BLOCKS:
        found = docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, _hits(next(blocks.passes()), window), _HITS_DDL)
    else:
        rows = _numbered(docs, F.col("doc_id").cast("long"), "text")
        found = rows.select("doc_id", _ROW).join(_merged(rows, blocks), _ROW)
    return found.select("doc_id", "n_words", F.expr(_COVERED).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.coalesce("best.length", F.lit(0)).cast("long").alias("longest"), (-F.col("best.less_word")).alias("longest_word"), F.col("best.item").alias("longest_item"), F.col("best.item_word").alias("longest_item_word"))


def keep_clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(text, ...) without contaminated documents; rows and columns stay as they are."""
    blocks = Benchmark(bench, window)
    if blocks.n > MOST_BLOCKS:
        rows = _numbered(docs, "*")
        bad = _merged(rows, blocks).select(_ROW, "n_words", F.expr(_COVERED).alias("n_hit")).where(is_contaminated())
        return rows.join(bad.select(_ROW), _ROW, "left_anti").select(docs.columns)
    use = next(blocks.passes())

    def run(it):
        for batch, texts in batches(it, most=SHARD_BYTES):
            n, hit, first, _, _ = _search(texts, use, window)
            sums = np.concatenate([[0], np.cumsum(hit)])
            hit = sums[first[1:]] - sums[first[:-1]]
            yield batch.filter(pa.array((hit == 0) | (20 * hit < n)))

    return docs.transform(map_arrow, run, docs.schema)


_MATCH = pa.schema([("item_id", pa.string()), ("item_word", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("doc_word", pa.int64())])


def longest_matches(docs: DataFrame, bench: DataFrame, least: int = WINDOW, window: int = WINDOW) -> DataFrame:
    """(item_id, item_word, length, doc_id, doc_word): for every benchmark
    suffix its longest verbatim match in any shard, of `least` words or more,
    ties to the smallest (doc_id, doc_word)."""

    def search(blocks):
        def run(it):
            for batch, texts in batches(it, most=SHARD_BYTES):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                # by id, so that a shard's first place is that of the smallest id
                order = np.argsort(ids, kind="stable")
                ids, texts = ids[order], [texts[i] for i in order]
                w = Words(texts, PLAIN_WORDS)
                before = np.repeat(np.arange(len(texts)), np.diff(w.first) + 1)
                for block in blocks:
                    b = block.value
                    starts = np.unique(b.item, return_index=True)[1]
                    best, where = Shard(w, b).longest(least)
                    k = np.flatnonzero(best >= least)
                    d = before[where[k]]
                    first = np.zeros(len(b.ids), np.int64)
                    first[b.item[starts]] = b.at[starts]
                    yield out_batch(_MATCH, item_id=[b.ids[i] for i in b.item[k]], item_word=b.at[k] - first[b.item[k]], length=best[k], doc_id=ids[d], doc_word=where[k] - w.first[d] - d)

        return run

    own = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    best = F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_word")).alias("m")
    parts, blocks = [], Benchmark(bench, window)
    for use in blocks.passes():
        each = own.transform(map_arrow, search(use), "item_id string, item_word long, length long, doc_id long, doc_word long")
        found = each.groupBy("item_id", "item_word").agg(best)
        parts.append(found if blocks.n <= MOST_BLOCKS else keep(found, "longest"))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    # items that share an id may lie in several blocks
    every = every.groupBy("item_id", "item_word").agg(F.min("m").alias("m")) if len(parts) > 1 else every
    return every.select("item_id", "item_word", (-F.col("m.less")).alias("length"), "m.doc_id", "m.doc_word")


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"), "longest", "longest_word", "longest_item", "longest_item_word")


def brute_hits(text: str | None, items: list[tuple], window: int = WINDOW) -> tuple[int, int, int, str]:
    """n_words, n_hit, n_items and items_sha256 of one text, by plain comparison; for tests."""
    words = (text or "").encode().translate(PLAIN_WORDS).split()
    hit, found = set(), set()
    for i, t in items:
        own = (t or "").encode().translate(PLAIN_WORDS).split()
        size = min(window, len(own))
        wins = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
        for p in range(len(words) - size + 1 if wins else 0):
            if tuple(words[p : p + size]) in wins:
                hit.update(range(p, p + size))
                found.add(str(i))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES: dict[str, str] = {}
