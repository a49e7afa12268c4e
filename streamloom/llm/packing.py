"""Packing documents into training sequences by bin completion.

Documents become token ids; lengths beyond the capacity are cut.  Pieces are
dealt at random (by a hash of their row) into shards of bounded size, and every
shard is packed on its own by branch and bound: best fit is the incumbent; bin
by bin, the fillings around the largest remaining piece that no other filling
dominates are enumerated, and branches that can't beat the incumbent, by the
waste so far or a lower bound of the bins for the rest, are cut.  A shard loses
at most part of a sequence against one packing of everything.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, keep, map_arrow, out_batch, table

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 8192
#: Pieces that the search of a shard may place, in all branches, before the incumbent stands.
NODES = 400_000
#: A search is over so many pieces at a time, and may place so many; around one piece so many for a first packing.
SEARCHED, PART_NODES, FIRST_NODES = 150, 6_000, 60
#: Fillings of a bin that are looked at together, to branch on the fullest first.
AHEAD = 12
#: Ids of so many distinct strings are remembered by a worker, in 16 bytes and 4 for each id.
MEMORY = 1 << 20
#: So many new strings are kept apart before they are sorted in; so many runs of letters are remembered.
RECENT, RUNS = 1 << 16, 1 << 17

_PLAIN = re.compile("[!-~\xa1-\xff]+")
_RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
_known: dict[str, Tokens] = {}
_SEPARATED = bytes(32 if c in b"\t\n\r" else c for c in range(256))


class Tokens:
    """Ids of whole texts.

    The vocabulary's pre-tokenizer drops white space and never joins what
    stands on both sides of it, so ids are looked up for each blank-free
    string by its hash, and for Latin-1 strings (where lower case and
    composition are plain) learned for each of the runs that the pre-tokenizer
    makes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
        ends = [x for x in range(tok.get_vocab_size()) if (t := tok.id_to_token(x)) and t.endswith("</w>")]
        self.ends = np.zeros(tok.get_vocab_size(), bool)
        self.ends[ends] = True
        self.forget()

    def forget(self) -> None:
        self.runs: dict[str, bytes] = {}
        # sorted hashes with the places and numbers of their ids in data, the old ones and the recent ones
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.known, self.data, self.used = [none, none], np.zeros(1 << 16, "<u4"), 0

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each hash; -1 if it isn't known."""
        at, size = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for keys, places, sizes in self.known:
            if len(keys):
                k = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[k] == hashes
                at[hit], size[hit] = places[k[hit]], sizes[k[hit]]
        return at, size

    def _add(self, hashes: np.ndarray, found: list[bytes]) -> None:
        size = np.array([len(x) // 4 for x in found], np.int32)
        data = np.frombuffer(b"".join(found), "<u4")
        if self.used + len(data) > len(self.data):
            more = np.zeros(max(2 * len(self.data), self.used + len(data)), "<u4")
            more[: self.used] = self.data[: self.used]
            self.data = more
        self.data[self.used : self.used + len(data)] = data
        level = 1 if len(self.known[1][0]) + len(hashes) <= RECENT else 0
        parts = self.known[level:] if level else self.known
        keys, at, sizes = (np.concatenate([*x, y]) for x, y in zip(zip(*parts, strict=True), (hashes, self.used + np.cumsum(size, dtype=np.int64) - size, size), strict=True))
        self.used += len(data)
        order = np.argsort(keys)
        none = tuple(x[:0] for x in self.known[1])
        self.known = [self.known[0], (keys[order], at[order], sizes[order])] if level else [(keys[order], at[order], sizes[order]), none]

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of some strings, as little-endian unsigned 32-bit bytes."""
        plain = [_RUN.findall(x.lower()) if _PLAIN.fullmatch(x) and "<|" not in x else None for x in new]
        if runs := list({r for p in plain if p for r in p if r not in self.runs}):
            blocks = [runs[i : i + 512] for i in range(0, len(runs), 512)]
            for block, e in zip(blocks, self.encode([" ".join(b) for b in blocks], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                data, cuts = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cuts) != len(block):
                    raise ValueError("the vocabulary has no word ends as expected")
                at = 0
                for r, to in zip(block, cuts, strict=True):
                    self.runs[r] = data[at:to]
                    at = to
        other = iter(self.encode(odd, add_special_tokens=False) if (odd := [x for x, p in zip(new, plain, strict=True) if p is None]) else [])
        return [np.array(next(other).ids, "<u4").tobytes() if p is None else b"".join([self.runs[r] for r in p]) for p in plain]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's first, one entry more than texts."""
        if sum(len(x[0]) for x in self.known) > MEMORY:
            self.forget()
        if len(self.runs) > RUNS:
            self.runs = {}
        w = Words(texts, _SEPARATED)
        hashes, index, back = np.unique(w.hash, return_index=True, return_inverse=True)
        at, size = self._found(hashes)
        if len(new := np.flatnonzero(at < 0)):
            self._add(hashes[new], self.learn([w.word(i).decode("utf-8", "surrogatepass") for i in index[new].tolist()]))
            at[new], size[new] = self._found(hashes[new])
        n = size[back]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.data[np.repeat(at[back] - ends[:-1], n) + np.arange(ends[-1])], ends[w.first]


def tokens(path: str) -> Tokens:
    if path not in _known:
        _known[path] = Tokens(path)
    return _known[path]


_PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_end = np.array([END_ID], "<u4").tobytes()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) of every whole text's ids
    and the end id; a null or empty text is the end id alone.  row: a number."""

    def run(it):
        tok, row = tokens(path), TaskContext.get().partitionId() << 36
        for batch, texts in batches(it):
            data, first = tok.ids(texts)
            data, rows = data.tobytes(), []
            for i, a, b in zip(batch.column("doc_id").to_pylist(), (4 * first[:-1]).tolist(), (4 * first[1:]).tolist(), strict=True):
                own = data[a:b] + _end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    rows.append((row, i, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    row += 1
            yield out_batch(_PIECE, **dict(zip(_PIECE.names, map(list, zip(*rows, strict=True)), strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, run, _PIECE_DDL)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Decreasing best fit: bins as lists of indices."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        at = bisect_left(gaps, (lengths[i], -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if gap > lengths[i]:
            insort(gaps, (gap - lengths[i], b))
    return bins


def least_bins(count: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins for count[length] pieces (Martello and Toth): for
    every a, pieces above capacity - a share a bin with no piece from a on, and
    those of a to half the capacity must fit beside the others above half."""
    if not count.any():
        return 0
    length = np.arange(capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * length)
    half = capacity // 2
    a = np.arange(half + 1)
    large, middle = number[capacity] - number[capacity - a], number[capacity - a] - number[half]
    room = middle * capacity - (total[capacity - a] - total[half])
    small = total[half] - np.where(a > 0, total[a - 1], 0)
    return int((large + middle + np.maximum(0, -(-(small - room) // capacity))).max())


class _Stock:
    """How many pieces of each length are left, and which lengths those are."""

    def __init__(self, lengths: list[int], capacity: int):
        self.count = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)
        self.n = self.count.tolist()
        self.have = [x for x in range(1, capacity + 1) if self.n[x]]

    def take(self, x: int) -> None:
        self.n[x] -= 1
        self.count[x] -= 1
        if not self.n[x]:
            self.have.pop(bisect_left(self.have, x))

    def give(self, x: int) -> None:
        self.n[x] += 1
        self.count[x] += 1
        if self.n[x] == 1:
            insort(self.have, x)

    def largest(self, most: int) -> int:
        """The largest length up to `most` that is left, else 0."""
        at = bisect_right(self.have, most)
        return self.have[at - 1] if at else 0


def fillings(stock: _Stock, rest: int, waste: int, budget: list[int]):
    """(waste, lengths) of the undominated fillings of `rest` that waste at most
    `waste`, largest pieces first.

    A piece that fills the rest exactly dominates all other fillings.  A filling
    is dominated if a further piece fits, or if one of its pieces or the sum of
    two gives way to a larger piece within its waste.
    """
    if stock.largest(rest) == rest:
        yield 0, ((rest,) if rest else ())
        return
    total = np.cumsum(stock.count * np.arange(len(stock.count)))
    path: list[int] = []
    used: dict[int, int] = {}

    def left(most: int) -> int:
        x = stock.largest(most)
        while x and used.get(x, 0) >= stock.n[x]:
            x = stock.largest(x - 1)
        return x

    def dominated() -> bool:
        if left(rest):
            return True
        if rest:
            sums = set(path)
            sums.update(path[i] + path[j] for i in range(len(path)) for j in range(i) if len(path) <= 16)
            return any(left(x + rest) > x or (left(x + rest) == x and x not in used) for x in sums)
        return False

    top = rest
    while budget[0] > 0:
        y = left(min(rest, top))
        # all that may still come can't fill enough
        if y and total[y] >= rest - waste:
            budget[0] -= 1
            path.append(y)
            used[y] = used.get(y, 0) + 1
            rest, top = rest - y, y
            continue
        if rest <= waste and not dominated():
            yield rest, tuple(path)
        if not path:
            return
        y = path.pop()
        used[y] -= 1
        if not used[y]:
            del used[y]
        rest, top = rest + y, y - 1


def _fullest_first(found, ahead: int = AHEAD):
    """The fillings in order, but of each few the fullest first; one without waste at once."""
    some: list = []
    for x in found:
        if x[0] == 0:
            yield x
            continue
        some.append(x)
        if len(some) == ahead:
            yield from sorted(some)
            some = []
    yield from sorted(some)


def _search(lengths: list[int], capacity: int, fewest: int, bound: int, budget: list[int]) -> list[tuple[int, ...]] | None:
    """Bins as lists of lengths, fewer than `fewest`, and as few as can be unless
    the budget of pieces to place ends before the search; None without any.

    Depth first over bins: a bin gets the largest piece that is left and one of
    the undominated fillings around it.  A branch is cut if its waste is more
    than a packing with fewer bins than the incumbent can have, or if its bins
    and the lower bound for the rest are no fewer.
    """
    stock, total, best = _Stock(lengths, capacity), sum(lengths), None
    bins: list[tuple[int, ...]] = []
    wastes: list[int] = [0]
    open_: list = []
    allowed = lambda: (fewest - 1) * capacity - total - wastes[-1]
    deeper = True
    while budget[0] > 0 and fewest > bound:
        if deeper and not stock.have:
            best, fewest, deeper = list(bins), len(bins), False
        elif deeper and (allowed() < 0 or len(bins) + least_bins(stock.count, capacity) >= fewest):
            deeper = False
        elif deeper:
            x = stock.have[-1]
            stock.take(x)
            open_.append((x, _fullest_first(fillings(stock, capacity - x, allowed(), budget))))
        if not deeper:
            # back to the last bin with another filling; its own is taken back first
            if len(bins) < len(open_):
                stock.give(open_.pop()[0])
            if not open_:
                break
            for x in bins.pop():
                stock.give(x)
            wastes.pop()
            stock.take(open_[-1][0])
        x, choices = open_[-1]
        got = next(choices, None)
        deeper = False
        if got is not None and got[0] <= allowed():
            for y in got[1]:
                stock.take(y)
            bins.append((x, *got[1]))
            wastes.append(wastes[-1] + got[0])
            deeper = True
    return best


def _first_packing(lengths: list[int], capacity: int, budget: list[int]) -> list[tuple[int, ...]]:
    """Bin after bin the fullest of the first fillings around the largest piece."""
    stock, bins = _Stock(lengths, capacity), []
    while stock.have:
        x = stock.have[-1]
        stock.take(x)
        left = [FIRST_NODES]
        # the first filling is what best fit does, however many pieces it takes
        best = None
        for got in fillings(stock, capacity - x, capacity, left):
            best = got if best is None else min(best, got)
            if best[0] == 0:
                break
        if best is None:
            rest, path = capacity - x, []
            while y := stock.largest(rest):
                path.append(y)
                stock.take(y)
                rest -= y
            bins.append((x, *path))
        else:
            for y in best[1]:
                stock.take(y)
            bins.append((x, *best[1]))
        budget[0] -= FIRST_NODES - left[0]
    return bins


def bin_completion(lengths: list[int], capacity: int, nodes: int | None = None) -> list[list[int]]:
    """Bins as lists of indices, never more than best fit makes, and as few as
    can be for up to SEARCHED pieces if the search ends within `nodes`.

    The incumbent is best fit, or a packing of the fullest fillings if that has
    fewer bins.  While the incumbent is above the lower bound, groups of its bins
    with about SEARCHED pieces, those with the most waste first, are searched for
    packings with fewer bins.
    """
    plain = best_fit(lengths, capacity)
    bound = least_bins(np.bincount(np.array(lengths, np.int64), minlength=capacity + 1), capacity)
    if len(plain) <= bound:
        return plain
    budget = [NODES if nodes is None else nodes]
    bins = [tuple(lengths[i] for i in b) for b in plain]
    first = _first_packing(lengths, capacity, budget)
    bins = first if len(first) < len(bins) else bins
    draw, idle = random.Random(len(lengths)), 0
    while len(bins) > bound and budget[0] > 0 and idle < 2 + len(bins) // 4:
        # the fuller a bin, the later its turn
        order = sorted(range(len(bins)), key=lambda i: draw.random() * (1 + capacity - sum(bins[i])), reverse=True)
        group, n = [], 0
        for i in order:
            if group and n + len(bins[i]) > SEARCHED:
                break
            group.append(i)
            n += len(bins[i])
        own = [x for i in group for x in bins[i]]
        least = least_bins(np.bincount(np.array(own, np.int64), minlength=capacity + 1), capacity)
        whole = len(group) == len(bins)
        left = [budget[0] if whole else min(budget[0], PART_NODES)]
        given = left[0]
        got = _search(own, capacity, len(group), least, left) if least < len(group) else None
        budget[0] -= max(given - left[0], 50)
        idle = 0 if got else idle + 1
        if got:
            chosen = set(group)
            bins = [b for i, b in enumerate(bins) if i not in chosen] + got
        if whole:
            break
    if len(bins) >= len(plain):
        return plain
    places: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        places.setdefault(x, []).append(i)
    return [[places[x].pop() for x in b] for b in bins]


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found(row, doc_id, piece, start, length, ids_crc32) with sequence_id and offset, without row."""
    # written once, so a piece's row is the same whatever is computed again
    found = keep(found, "pieces")
    n = max(1, -(-found.count() // SHARD_PIECES))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"]).reset_index(drop=True)
        lengths = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, own in enumerate(bin_completion(lengths, capacity)):
            at = 0
            for i in own:
                sequence[i], offset[i] = b, at
                at += lengths[i]
        rows["sequence_id"], rows["offset"] = rows["shard"].astype("int64") * (1 << 32) + sequence, offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for docs(doc_id, text).

    Null and empty texts give one piece of one id; a text of any length is cut
    into pieces of `capacity` ids and a rest; repeated rows each give their
    pieces; a null doc_id stays null; an empty table gives no rows; other
    columns are ignored.  path: the vocabulary's file, for the `tokenizers` library.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, str(path), capacity), capacity)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pack": op3_pack}
ORACLES: dict[str, str] = {}
