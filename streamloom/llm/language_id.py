"""Language of words and documents by a linear-chain conditional random field.

Every word gets a label from affix, n-gram and lexicon features and from
learned transitions between the labels of neighbours; forward-backward over the
whole text gives each word's label probabilities, also in code-switched text.
A document's language is the one with the largest expected share of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN_WORDS, Words, batches, id_bucket, map_arrow, mix, out_batch, table

U64 = np.uint64
#: The model learns from about so many labelled documents of each language.
SAMPLE_PER_LANGUAGE = 250
#: ... and from at most so many of their segments, each of SEGMENT words.
SEGMENTS, SEGMENT, JOINED = 4000, 16, 3
TABLE_BITS, GRAMS = 16, 4
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.3, 1e-6
GROUP = 1 << 19
#: Words whose messages are held at a time; longer chains are passed through in such pieces.
PIECE = 1 << 17


def word_features(blob: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table indices of each word's features, and where each word's begin.

    n-grams of up to GRAMS bytes of the word between two marks (those with a
    mark are its prefixes and suffixes), and the word itself as a lexicon entry.
    """
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - start + 1, size)
    chars = blob[np.clip(at, 0, len(blob) - 1)].astype(U64)
    chars[first[:-1]], chars[first[1:] - 1] = U64(1), U64(2)
    left = np.repeat(first[1:], size) - np.arange(first[-1])
    found, owner, key = [mix(hashes ^ U64(0x51ED270B))], [np.arange(len(start))], np.zeros(len(chars), U64)
    word = np.repeat(np.arange(len(start)), size)
    for n in range(1, GRAMS + 1):
        key[: len(chars) - n + 1] = key[: len(chars) - n + 1] * U64(257) + chars[n - 1 :]
        ok = left >= n
        found.append(mix(key[ok] + U64(n << 56)))
        owner.append(word[ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    index = (np.concatenate(found)[order] >> U64(64 - TABLE_BITS)).astype(np.int64)
    return index, np.searchsorted(owner[order], np.arange(len(start) + 1))


def emissions(weights: np.ndarray, w: Words, which: np.ndarray) -> np.ndarray:
    """Scores of the languages for the words at the places `which`."""
    out = np.zeros((len(which), weights.shape[1]), np.float32)
    blob = np.frombuffer(w.blob, np.uint8)
    for i in range(0, len(which), 20000):
        own = which[i : i + 20000]
        index, first = word_features(blob, w.start[own], w.end[own], w.hash[own])
        out[i : i + 20000] = np.add.reduceat(weights[index], first[:-1], axis=0) / np.diff(first)[:, None] ** 0.5
    return out


def _steps(p: np.ndarray, trans: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A matrix for each word: scores p of its labels after those of the word before."""
    m = np.exp(trans)[None] * p[:, None, :]
    m[begins] = p[begins][:, None, :]
    return m


def _product(m: np.ndarray) -> np.ndarray:
    """The product of some matrices, scaled."""
    while len(m) > 1:
        if len(m) % 2:
            m = np.concatenate([m, np.eye(m.shape[1])[None]])
        m = m[::2] @ m[1::2]
        m /= m.max((1, 2), keepdims=True)
    return m[0]


def _piece(m: np.ndarray, before: np.ndarray, after: np.ndarray, block: int) -> np.ndarray:
    """Label probabilities of the words with matrices m, given the message before and after them."""
    n, k, _ = m.shape
    nb = -(-n // block)
    m = np.concatenate([m, np.broadcast_to(np.eye(k), (nb * block - n, k, k))]).reshape(nb, block, k, k)
    fwd, bwd = np.empty_like(m), np.empty_like(m)
    fwd[:, 0] = m[:, 0]
    bwd[:, -1] = np.eye(k)
    for i in range(1, block):
        x = fwd[:, i - 1] @ m[:, i]
        fwd[:, i] = x / x.max((1, 2), keepdims=True)
        x = m[:, block - i] @ bwd[:, block - i]
        bwd[:, block - i - 1] = x / x.max((1, 2), keepdims=True)
    whole = fwd[:, -1]
    a, z = np.empty((nb, k)), np.empty((nb, k))
    a[0], z[-1] = before, after
    for i in range(1, nb):
        x = a[i - 1] @ whole[i - 1]
        a[i] = x / x.sum()
        x = whole[nb - i] @ z[nb - i]
        z[nb - i - 1] = x / x.sum()
    out = np.einsum("bj,bijk->bik", a, fwd) * np.einsum("bijk,bk->bij", bwd, z)
    out = out.reshape(-1, k)[:n]
    return out / out.sum(1, keepdims=True)


def marginals(score: np.ndarray, trans: np.ndarray, begins: np.ndarray, block: int = 64, piece: int = PIECE) -> np.ndarray:
    """Label probabilities of each word in chains laid end to end; begins: where a chain starts.

    Forward and backward messages are products of one small matrix per word.
    Products within blocks of words are taken for all blocks at once, then the
    blocks are passed through, so long chains cost no Python step per word.  Of
    more than `piece` words the messages between pieces come first, from the
    product of each, so memory doesn't grow with the longest text.
    """
    n, k = score.shape
    if not n:
        return np.zeros((0, k))
    cuts = list(range(0, n, piece))
    starts = np.zeros(n, bool)
    starts[begins] = True

    def steps(a: int) -> np.ndarray:
        own = score[a : a + piece].astype(float)
        return _steps(np.exp(own - own.max(1, keepdims=True)), trans, np.flatnonzero(starts[a : a + piece]))

    before, after = np.ones((len(cuts), k)), np.ones((len(cuts), k))
    if len(cuts) > 1:
        whole = [_product(steps(a)) for a in cuts]
        for i in range(1, len(cuts)):
            x = before[i - 1] @ whole[i - 1]
            before[i] = x / x.sum()
            x = whole[-i] @ after[-i]
            after[-i - 1] = x / x.sum()
    return np.concatenate([_piece(steps(a), before[i], after[i], block) for i, a in enumerate(cuts)])


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, trans: np.ndarray):
        self.languages, self.weights, self.trans = languages, weights, trans

    def words(self, texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words, their label probabilities, and which have a letter."""
        w = Words(texts, PLAIN_WORDS)
        if not len(w.hash) or not self.languages:
            return w, np.zeros((len(w.hash), len(self.languages))), np.zeros(len(w.hash), bool)
        _, which, back = np.unique(w.hash, return_index=True, return_inverse=True)
        blob = np.frombuffer(w.blob, np.uint8)
        letters = np.concatenate([[0], np.cumsum((blob > 57) | ((blob != 32) & (blob < 48)))])
        lettered = letters[w.end] > letters[w.start]
        score = emissions(self.weights, w, which)[back] * lettered[:, None]
        begins = np.unique(w.first[:-1][np.diff(w.first) > 0])
        return w, marginals(score, self.trans, begins), lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Each text's language and its expected share of the words that have a
        letter; "und" and 0 without a letter."""
        w, p, lettered = self.words(texts)
        if not len(p) or not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p * lettered[:, None], axis=0)])
        share = sums[w.first[1:]] - sums[w.first[:-1]]
        total = share.sum(1)
        best = share.argmax(1)
        # bytes beyond ASCII need not be letters
        known = [t > 0 and any(c.isalpha() for c in x) for t, x in zip(total, texts, strict=True)]
        score = np.where(known, share.max(1) / np.maximum(total, 1e-9), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.clip(score, 0, 1)


def train(rows: list[tuple[str, str]], seed: int = 11) -> Model:
    """rows: (language, text).  Maximum likelihood by Adagrad on sequences of
    segments of one or several languages, so that switches are learned too."""
    languages = sorted({x for x, _ in rows})
    k, rng = len(languages), np.random.default_rng(seed)
    weights, trans = np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k))
    w = Words([t for _, t in rows], PLAIN_WORDS)
    label = np.array([languages.index(x) for x, _ in rows], np.int64)
    if k < 2 or not len(w.hash):
        return Model(languages, weights, trans)
    # each language's texts end to end, so short ones count too; a language with few words repeats them
    of, stream, begin, size = label[w.doc], [], [], 0
    for x in range(k):
        own = np.flatnonzero(of == x)
        own = np.tile(own, -(-SEGMENT // len(own))) if 0 < len(own) < SEGMENT else own
        begin.append(size + np.arange(0, len(own) - SEGMENT + 1, SEGMENT))
        stream.append(own)
        size += len(own)
    stream = np.concatenate(stream)
    per = max(1, SEGMENTS // k)
    begin = [rng.permutation(b)[:per] for b in begin]
    lang = np.repeat(np.arange(k), [len(b) for b in begin])
    begin = np.concatenate(begin)
    _, which, back = np.unique(w.hash, return_index=True, return_inverse=True)
    back = back[stream]
    index, first = word_features(np.frombuffer(w.blob, np.uint8), w.start[which], w.end[which], w.hash[which])
    count = np.diff(first)
    g2w, g2t = np.full(weights.shape, 1e-8, np.float32), np.full(trans.shape, 1e-8)
    own = [np.flatnonzero(lang == x) for x in range(k)]
    by = [x for x in own if len(x)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(begin))
        for i in range(0, len(order), BATCH):
            seq = [order[i : i + BATCH]]
            for _ in range(JOINED - 1):
                # half of the time the next segment has any language, else the same
                seq.append(np.array([rng.choice(by[rng.integers(len(by))]) if rng.random() < 0.5 else rng.choice(own[lang[s]]) for s in seq[-1]]))
            words = np.concatenate([begin[s][:, None] + np.arange(SEGMENT) for s in seq], axis=1)
            gold = np.repeat(np.stack([lang[s] for s in seq], 1), SEGMENT, axis=1)
            uniq, place = np.unique(back[words], return_inverse=True)
            place = place.reshape(words.shape)
            size = count[uniq]
            feats = index[np.repeat(first[uniq] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
            cut = np.concatenate([[0], np.cumsum(size)[:-1]])
            e = (np.add.reduceat(weights[feats], cut, axis=0) / size[:, None] ** 0.5)[place].astype(float)
            b, t = gold.shape
            p = np.exp(e - e.max(2, keepdims=True))
            m = np.exp(trans)
            fwd, bwd = np.empty((t, b, k)), np.ones((t, b, k))
            fwd[0] = p[:, 0]
            for j in range(1, t):
                x = fwd[j - 1] @ m * p[:, j]
                fwd[j] = x / x.sum(1, keepdims=True)
            for j in range(t - 2, -1, -1):
                x = (bwd[j + 1] * p[:, j + 1]) @ m.T
                bwd[j] = x / x.sum(1, keepdims=True)
            post = fwd * bwd
            post /= post.sum(2, keepdims=True)
            pair = fwd[:-1, :, :, None] * m * (p[:, 1:].transpose(1, 0, 2) * bwd[1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            want = np.eye(k)[gold]
            gt = np.einsum("bti,btj->ij", want[:, :-1], want[:, 1:]) - pair.sum((0, 1))
            ge = np.zeros((len(uniq), k))
            np.add.at(ge, place.ravel(), (want - post.transpose(1, 0, 2)).reshape(-1, k))
            ge = np.repeat(ge / size[:, None] ** 0.5, size, axis=0)
            touched, spot = np.unique(feats, return_inverse=True)
            gw = np.stack([np.bincount(spot, ge[:, x], len(touched)) for x in range(k)], 1) / b - DECAY * weights[touched]
            g2w[touched] += gw**2
            weights[touched] += RATE * gw / np.sqrt(g2w[touched])
            gt = gt / b
            g2t += gt**2
            trans += RATE * gt / np.sqrt(g2t)
    return Model(languages, weights, trans)


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from whole texts of about per_language documents of each
    language, chosen by a hash among docs(doc_id, text, lang)."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    counts = docs.where("lang is not null").groupBy("lang").count().collect()
    if not counts:
        return train([])
    pick = F.lit(False)
    for r in counts:
        pick = pick | ((F.col("lang") == r["lang"]) & (F.col("h") < int(min(1.0, per_language / r["count"]) * (1 << 30))))
    # equal ids have equal hashes, so a limit keeps the bound for tables that repeat an id
    got = rows.where(pick).orderBy("h", "lang", "text").limit(2 * per_language * len(counts)).collect()
    return train(sorted((r.lang, r.text) for r in got))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def label_documents(docs: DataFrame, held_out: int = 2, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for docs(doc_id, text, lang).

    held_out: crc32(doc_id as text) mod 4 is `held_out`; only other rows are
    learned from, unless a model is given.  A null, empty or letterless text is
    "und" with score 0; so is everything if there is nothing to learn from; with
    one language to learn every text with letters has it.
    Repeated rows each give a row; null ids are not held out; other columns are
    ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").alias("lang") if "lang" in docs.columns else F.lit(None).alias("lang"))
    own = own.withColumn("held", id_bucket("doc_id", 4) == held_out)
    use = spark.sparkContext.broadcast(model or learn(own.where("not held")))

    def run(it):
        m = use.value
        for batch, texts in batches(it, most=GROUP):
            pred, score = m.predict(texts)
            yield out_batch(_OUT, doc_id=batch.column("doc_id"), held_out=batch.column("held"), lang_pred=pred, score=score)

    return own.select("doc_id", "text", "held").transform(map_arrow, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_settled(docs: DataFrame, least: float, held_out: int = 2) -> DataFrame:
    """docs(doc_id, text, lang, ...) without documents that are "und" or whose
    language has less than `least` of their words; rows and columns stay as they
    are.  Without labels to learn from all documents with a letter stay."""
    own = docs.select("doc_id", "text", "lang").where(id_bucket("doc_id", 4) != held_out)
    use = docs.sparkSession.sparkContext.broadcast(learn(own))

    def run(it):
        m = use.value
        for batch, texts in batches(it, most=GROUP):
            if not m.languages:
                yield batch.filter(pa.array([any(c.isalpha() for c in t) for t in texts]))
                continue
            pred, score = m.predict(texts)
            yield batch.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score, strict=True)]))

    return docs.transform(map_arrow, run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
