import os
from collections import defaultdict

import duckdb
import numpy as np

from streamloom.llm import common, decontaminate, near_dedup, substring_dedup

from .conftest import DATA


def brute_components(rows, size=2, percent=80):
    sets = {i: near_dedup.shingle_set(t or "", size) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    pairs = {(a, b) for h in holders.values() if len(h) < 400 for k, a in enumerate(h) for b in h[:k]}
    for a, b in pairs:
        s, t = sets[a], sets[b]
        if 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def documents(sf=DATA):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()


def test_near_dedup_equals_brute_force(spark):
    want = brute_components(documents())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op9_near_dedup(spark, DATA).collect()}
    assert got == want


def test_large_group_of_near_copies(spark):
    import random

    r = random.Random(4)
    words = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(words)
        for k in r.sample(range(120), r.randrange(4, 16)):
            own[k] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (2, 5):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs, size).collect()}
        assert got == brute_components(rows, size)


def test_five_words_by_default(spark):
    rows = documents()
    want = brute_components(rows, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert got == want and want != brute_components(rows)


def test_blocks_lose_no_link(spark, monkeypatch):
    """Chains of texts that are just alike, in large buckets, with several blocks and stars."""
    import random

    for name, value in (("SMALL_BUCKET", 2), ("CENTRAL", 1), ("BLOCK", 7), ("WHOLE_BLOCK", 9), ("STAR", 3), ("FIRST", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    r = random.Random(12)
    words = [f"w{r.randrange(5000)}" for _ in range(100)]
    rows, met = [], []
    for i in range(70):
        own = list(words)
        for k in r.sample(range(100), r.randrange(4, 14)):
            own[k] = f"z{r.randrange(40)}"
        rows.append((i, " ".join(own)))
    real = near_dedup._meet
    monkeypatch.setattr(near_dedup, "_meet", lambda *a: met.append(a) or real(*a))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute_components(rows) and met
    assert len({c for _, c in got.values()}) > 1


def test_common_counts(monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(near_dedup, "COLUMNS", 16)
    r = random.Random(2)
    make = lambda n: [np.array(sorted(r.sample(range(90), r.randrange(40))), np.uint64) for _ in range(n)]
    for n, m in ((7, 9), (1, 1), (0, 3), (3, 0)):
        a, b = make(n), make(m)
        assert near_dedup.common_counts(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_repeated_ids_are_linked_by_their_texts(spark):
    a = [f"a{k}" for k in range(60)]
    b = [f"b{k}" for k in range(60)]
    rows = [(1, a), (1, b), (2, ["x", *a[1:]]), (3, ["x", *b[1:]]), (4, a), (4, a), (None, b), (None, ["q"] * 3), (None, ["q"] * 3), (7, []), (7, []), (8, ["v", "w"])]
    docs = spark.createDataFrame([(i, " ".join(t) if t else None, "s") for i, t in rows], "doc_id long, text string, least string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 1, False), (0, 1, False), (0, 0, True), (0, 0, True), (7, 7, True), (7, 7, True), (8, 8, True)])
    kept = near_dedup.keep_one(docs, 2)
    assert kept.columns == docs.columns
    # a and b are two groups; one row of each, one of the rows "q q q"; rows without words stay
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in kept.collect()) == sorted([(1, "a0"), (1, "b0"), (0, "q "), (7, ""), (7, ""), (8, "v ")])
    assert near_dedup.keep_one(docs.where("false")).count() == 0


def test_near_dedup_hard_rows(spark, hard_docs, no_docs):
    got = near_dedup.near_duplicates(hard_docs).collect()
    assert len(got) == hard_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == by[8].component_id == 1 and not by[4].kept
    assert by[2].component_id == 2 and by[2].kept and by[2].n_shingles == 0 and by[5].n_shingles == 1
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_decontaminate_equals_brute_force(spark):
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.op5_decontaminate(spark, DATA).collect()}
    want = {i: decontaminate.brute_hits(t, items) for i, t in documents()}
    assert got == want and any(x[1] for x in want.values())


def test_decontaminate_hard_rows(spark, hard_docs, no_docs):
    items = [(1, "c d e"), (2, "x"), (3, None), (4, ""), (5, "words tail"), (5, "é 1"), (None, "b"), (6, " ".join(["tail of words"] * 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_words, r.n_hit, r.n_items) for r in decontaminate.benchmark_hits(hard_docs, bench).collect()))
    named = [("null" if i is None else i, t) for i, t in items]
    want = sorted(((r.doc_id or -1, *decontaminate.brute_hits(r.text, named)[:3]) for r in hard_docs.collect()))
    assert got == want
    assert decontaminate.benchmark_hits(no_docs, bench).count() == 0
    assert {r.n_hit for r in decontaminate.benchmark_hits(hard_docs, bench.where("1 = 0")).collect()} == {0}
    best = {(r.item_id, r.item_word): r for r in decontaminate.longest_matches(hard_docs, bench, least=2).collect()}
    assert best["6", 0].length == 27 and best["6", 0].doc_id == 6 and best["1", 0].doc_id == 1 and best["1", 0].doc_word == 2


def test_longest_matches_equal_brute_force(spark):
    import random

    r = random.Random(6)
    words = lambda n: [f"q{r.randrange(10**6)}" for _ in range(n)]
    item, other = words(100), words(30)
    texts = [(9, item), (3, item[:15]), (5, words(5) + item[40:60]), (4, item), (8, item[20:70]), (2, other[:14] + words(3) + other), (7, other[10:] + other)]
    rows = [(i, " ".join(words(4) + t + words(4))) for i, t in texts]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    want = {}
    for name, own in (("1", item), ("2", other)):
        for k in range(len(own)):
            found = []
            for i, t in rows:
                t = t.split()
                for p in range(len(t)):
                    n = 0
                    while k + n < len(own) and p + n < len(t) and own[k + n] == t[p + n]:
                        n += 1
                    found.append((-n, i, p))
            if -min(found)[0] >= 13:
                want[name, k] = min(found)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(x.item_id, x.item_word): (-x.length, x.doc_id, x.doc_word) for x in decontaminate.longest_matches(docs, bench).collect()}
    assert got == want


def brute_longest(text, items):
    """(length, place, item) of the longest match that holds a whole window, for one text."""
    words = (text or "").encode().translate(common.PLAIN_WORDS).split()
    best = (0, 0)
    for _, t in items:
        own = (t or "").encode().translate(common.PLAIN_WORDS).split()
        least = min(13, len(own))
        for p in range(len(words) if own else 0):
            for k in range(len(own)):
                n = 0
                while k + n < len(own) and p + n < len(words) and own[k + n] == words[p + n]:
                    n += 1
                if n >= least:
                    best = max(best, (n, -p))
    return best[0], -best[1]


def test_longest_match_of_each_document(spark):
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    rep = " ".join(["to be or not"] * 30)
    items = [*items, (900, rep), (901, rep + " that is"), (902, "not to be"), (903, rep[:60])]
    docs = [(i, t) for i, t in documents() if decontaminate.brute_hits(t, items)[1]][:30] + [(10**6, "well " + rep + " that is all"), (10**6 + 1, rep), (10**6 + 2, "not to be")]
    got = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    for r in got.collect():
        assert (r.longest, r.longest_word or 0) == brute_longest(dict(docs)[r.doc_id], items), r


def test_large_benchmark_takes_several_passes(spark, hard_docs, monkeypatch):
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall() + [(1, "c d e"), (2, "tail of words"), (3, "no id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(hard_docs.select("doc_id", "text"))
    plain = lambda: sorted((r.doc_id or -1, r.n_words, r.n_hit, r.items, r.longest, r.longest_word) for r in decontaminate.benchmark_hits(docs, bench).collect())
    clean = lambda: sorted((r.doc_id or -1, r.text or "") for r in decontaminate.keep_clean(docs, bench).collect())
    want = plain(), clean()
    size = sum(len(t.encode()) + len(str(i)) for i, t in items)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size // 7)
    assert decontaminate.Benchmark(bench, 13).n > decontaminate.MOST_BLOCKS
    assert (plain(), clean()) == want


def test_repeated_windows_give_no_pairs():
    """Work follows the words, not (benchmark suffixes) x (places)."""
    found = []
    for n in (200, 400, 800):
        text = "a b " * n
        shard = decontaminate.Shard(common.Words([text], common.PLAIN_WORDS), decontaminate.Suffixes(["1"], [text], 13))
        win, place = shard.windows()
        suffix, size = shard.best(win, place)
        assert len(win) == 2 * n - 12 and (size == 2 * n - place).all()
        found.append(len(win))
    assert found[2] < 4.2 * found[0]


def test_perhaps_in_loses_no_id(spark):
    rows = spark.createDataFrame([(i - 500, "x") for i in range(1000)] + [(None, "y"), (3, "z")], "doc_id long, text string")
    ids = rows.where("doc_id % 7 = 3").select("doc_id")
    for bits in (1 << 15, 1 << 24, None):
        got = common.perhaps_in(rows, ids, bits)
        assert got.columns == rows.columns
        assert got.join(ids.distinct(), "doc_id", "left_semi").count() == ids.count()
        assert got.count() < 250
    assert common.perhaps_in(rows, ids.where("false")).count() == 0
    none = common.perhaps_in(rows, rows.where("doc_id is null").select("doc_id")).collect()
    assert [r.text for r in none] == ["y"]
    marked = common.perhaps(rows, ids, "m")
    assert marked.count() == rows.count() and marked.where("m").join(ids.distinct(), "doc_id", "left_semi").count() == ids.count()


def test_discard_removes_only_the_table(spark):
    rows = spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").count()
    first = common.keep(rows, "first")
    second = common.keep(first.where("k < 3"), "second")
    assert spark.conf.get(common._CLEAN_UP) == "false"
    common.discard(first)
    assert not os.path.exists(first._scratch_path)
    assert second.count() == 3 and rows.count() == 7


def test_places_are_ordered_and_hashed_once(monkeypatch):
    """Sorts of several columns are one sort of packed numbers, and runs of a group that fits are made once."""
    rng = np.random.default_rng(3)
    for top in (9, 1 << 40):
        cols = [rng.integers(0, n, 5000) for n in (50, top, 7)]
        order = substring_dedup.ordered(*cols)
        assert np.array_equal(np.stack(cols)[:, order], np.stack(cols)[:, np.lexsort(cols)])
    assert len(substring_dedup.ordered(*[np.zeros(0, np.int64)] * 2)) == 0
    calls, made = [], substring_dedup.three_words
    monkeypatch.setattr(substring_dedup, "three_words", lambda *a: calls.append(len(a[0])) or made(*a))
    group, around = np.repeat(np.arange(1, 5), 50), rng.integers(1, 4, (200, 2 * substring_dedup.AROUND)).astype(np.uint8)
    once = substring_dedup.rare_runs(group, around)
    assert calls == [200]
    monkeypatch.setattr(substring_dedup, "TOGETHER", 10)
    assert all(np.array_equal(x, y) for x, y in zip(once, substring_dedup.rare_runs(group, around), strict=True))


def test_both_sides_of_pairs_are_compared_at_once(monkeypatch):
    """alike() makes one table for both sides, and distinct() gives what np.unique() does."""
    calls, made = [], substring_dedup.side_common
    monkeypatch.setattr(substring_dedup, "side_common", lambda a, b: calls.append(len(a)) or made(a, b))
    rng = np.random.default_rng(4)
    a = rng.integers(1, 9, (30, 2 * substring_dedup.AROUND)).astype(np.uint8)
    assert substring_dedup.alike(a, a)[4].all() and not substring_dedup.alike(a, a[::-1] ^ 64)[4].any()
    assert calls == [60, 60]
    for x in (rng.integers(0, 50, 200), np.zeros(0, np.int64)):
        assert np.array_equal(substring_dedup.distinct(x), np.unique(x))
