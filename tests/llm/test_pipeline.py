"""The pipeline's run() against a plain version, and on hard rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.llm import decontaminate, language_id, packing, pii

from .conftest import DATA
from .test_dedup import brute_components


def plain_run(spark, rows, items, labelled):
    """(doc_id, piece, start, length, ids_crc32) of rows(doc_id, text), stage by stage in plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    model = language_id.learn(labelled.where(language_id.id_bucket("doc_id", 4) != 2))
    kept = []
    for i, t in rows:
        (lang,), (score,) = model.predict([t or ""])
        if lang != "und" and score >= 0.4 if model.languages else any(c.isalpha() for c in t or ""):
            kept.append((i, t))
    # near copies by row, so that repeated ids are their own
    numbered = list(enumerate(kept))
    groups = brute_components([(n, t) for n, (_, t) in numbered], 5)
    members = {}
    for n, (i, t) in numbered:
        members.setdefault(groups[n][1], []).append((i is None, i or 0, n))
    kept = [kept[min(m)[2]] for m in members.values()]
    hits = {n: decontaminate.brute_hits(t, items) for n, (_, t) in enumerate(kept)}
    kept = [x for n, x in enumerate(kept) if not (hits[n][1] and 20 * hits[n][1] >= hits[n][0])]
    net = pii.trained()
    clean = [(i, pii.mask(t or "", pii.find_spans(net, [t or ""])[0][1])) for i, t in kept]
    tok, out = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), Counter()
    for i, t in clean:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a : a + 4096]
            out[i, k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    return out


def got_rows(df):
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_run_equals_a_plain_version(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_run(spark, rows, items, docs.select("doc_id", "text", "lang"))
    assert got_rows(corpus_pipeline.run(spark, DATA)) == want and len(want) > 100


@pytest.mark.parametrize("kind", ["hard", "unlabelled", "empty"])
def test_run_on_hard_rows(spark, tmp_path, kind):
    import corpus_pipeline

    long = "tail of words and the house " * 3000
    text = "the house of the water is in the garden and the tree was near the river with many birds"
    rows = [(1, text, "en"), (2, None, "en"), (3, "", "de"), (4, text, "en"), (4, text, "en"), (None, text + " again", "en"), (5, "x", "en"), (6, long, "en"), (7, "\n\t  ", None), (8, text.upper(), "en"), (9, "12 34 5678", "de"), (10, "der hund und die katze sind nicht im haus mit dem wasser", "de"), (10, "le chat et le chien ne sont pas dans la maison avec de eau", "fr"), (None, "ein ganz anderer satz mit worten die es nur hier gibt und sonst nicht", "de"), (11, "mail to a.b@c.example.org or 10.1.2.3 now please and the house of the water", "en")]
    rows += [(20 + k, f"the and of with {w} house water tree {w} river", "en") for k, w in enumerate("abcdefgh")] + [(40 + k, f"der und die das nicht {w} haus wasser baum {w} fluss", "de") for k, w in enumerate("abcdefgh")]
    rows = [] if kind == "empty" else [(i, t, None if kind == "unlabelled" else lang) for i, t, lang in rows]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, least int")
    items = [(1, "der und die das nicht a haus wasser baum a fluss"), (None, None), (2, "")]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_run(spark, [(i, t) for i, t, _ in rows], items, docs.select("doc_id", "text", "lang"))
    got = got_rows(corpus_pipeline.run(spark, str(tmp_path)))
    # which of the rows with a group's smallest id stays is open where its texts differ
    assert got == want
    assert (not got) == (kind == "empty")
    if got:
        ids = Counter(i for i, k, *_ in got.elements() if k == 0)
        assert ids[1] == 1 and not ids[4] and not ids[8] and not ids[2] and not ids[40] and ids[10] == 2
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "least"], name
        docs = docs.withColumn("n_chars", F.col("n_chars")).cache()
