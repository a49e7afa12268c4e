"""Text quality by positive-unlabelled learning.

A small network minimises the non-negative unbiased risk (Kiryo et al., 2017):
trusted positives, unlabelled text and an estimated class prior, with no use of
negative labels.  The prior is the share of unlabelled text above the score at
which positives crowd most (best bin estimation, Garg et al., 2021).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_WORDS, Words, batches, id_bucket, map_arrow, out_batch, table

#: The classifier is fitted on about so many positives and unlabelled texts.
POSITIVES, UNLABELLED = 4000, 6000
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 700, 512, 0.01, 0.03
THRESHOLD = 0.7
FEATURES = 256 + 7


def features(texts: list[str]) -> np.ndarray:
    """A row for each whole text: square roots of the shares of all byte values,
    and shares of capitals, marks, repeated and distinct words and the like."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw])
    doc = np.repeat(np.arange(len(raw)), size)
    counts = np.bincount(doc * 256 + np.frombuffer(b"".join(raw), np.uint8), minlength=256 * len(raw)).reshape(-1, 256)
    w = Words(texts, BLANK_WORDS)
    n = np.diff(w.first)
    same = np.zeros(len(w.hash) + 1)
    same[1:-1] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]) if len(w.hash) else 0
    total = lambda x: np.add.reduceat(np.append(x, 0.0), np.minimum(w.first[:-1], len(x)))[: len(n)] * (n > 0)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    fresh = np.ones(len(h))
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d, fresh, len(n))
    length = total((w.end - w.start).astype(float))
    letters = counts[:, 65:91].sum(1) + counts[:, 97:123].sum(1) + counts[:, 128:].sum(1)
    per = 1.0 / np.maximum(size, 1)
    word = 1.0 / np.maximum(n, 1)
    extra = np.stack([total(same[: len(w.hash)]) * word, distinct * word, length * word / 10, counts[:, 65:91].sum(1) * per, (size - letters) * per, np.log1p(n) / 10, distinct / np.maximum(np.sqrt(n), 1) / 10], 1)
    return np.concatenate([np.sqrt(counts * per[:, None]), extra], 1).astype(np.float32)


class Network:
    """One hidden layer; a positive output means the positive class."""

    def __init__(self, mean, scale, seed: int = 3):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = [r.normal(0, len(mean) ** -0.5, (len(mean), HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [0 * x for x in self.p], [0 * x for x in self.p], 0

    def out(self, x: np.ndarray) -> np.ndarray:
        self.x = np.clip((x - self.mean) / self.scale, -6, 6)
        self.h = np.tanh(self.x @ self.p[0] + self.p[1])
        return self.h @ self.p[2] + self.p[3][0]

    def step(self, slope: np.ndarray) -> None:
        """One step of Adam, given the risk's slope at the last outputs."""
        back = slope[:, None] * self.p[2] * (1 - self.h**2)
        grads = [self.x.T @ back + DECAY * self.p[0], back.sum(0), self.h.T @ slope + DECAY * self.p[2], np.array([slope.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - RATE * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int) -> Network:
    """prior None: tell positives from unlabelled; else the non-negative risk."""
    both = np.concatenate([pos, unl])
    net, r = Network(both.mean(0), both.std(0) + 0.02, seed), np.random.default_rng(seed)
    soft = lambda x: np.logaddexp(0, x)
    for _ in range(STEPS):
        a, b = pos[r.integers(len(pos), size=min(BATCH, 4 * len(pos)))], unl[r.integers(len(unl), size=min(BATCH, 4 * len(unl)))]
        g = net.out(np.concatenate([a, b]))
        gp, gu = g[: len(a)], g[len(a) :]
        sp, su = sigmoid(gp), sigmoid(gu)
        if prior is None:
            net.step(np.concatenate([(sp - 1) / len(a), su / len(b)]))
            continue
        negative = soft(gu).mean() - prior * soft(gp).mean()
        down = np.concatenate([-prior * sp / len(a), su / len(b)])
        if negative >= 0:
            net.step(np.concatenate([prior * (sp - 1) / len(a), np.zeros(len(b))]) + down)
        else:  # the estimate can't be below zero: undo what made it so
            net.step(-down)
    return net


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 5) -> float:
    """The positives' share of unlabelled text."""
    half = lambda x: (x[::2], x[1::2])
    (p1, p2), (u1, u2) = half(pos), half(unl)
    if min(map(len, (p1, p2, u1, u2))) < 8:
        return 0.5
    net = _fit(p1, u1, None, seed)
    sp, su = np.sort(net.out(p2))[::-1], np.sort(net.out(u2))[::-1]
    share_p = np.arange(1, len(sp) + 1) / len(sp)
    share_u = np.searchsorted(-su, -sp, "right") / len(su)
    width = np.sqrt(np.log(40) / 2 / len(su)) + np.sqrt(np.log(40) / 2 / len(sp))
    best = np.argmin((share_u + width) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.95))


def fit(pos: np.ndarray, unl: np.ndarray) -> tuple[Network | None, float]:
    if len(pos) < 4 or len(unl) < 4:
        return None, 0.5
    prior = class_prior(pos, unl)
    return _fit(pos, unl, prior, 7), prior


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _extract(it):
    schema = pa.schema([("positive", pa.bool_()), ("unlabelled", pa.bool_()), ("turn", pa.int64()), ("x", pa.binary())])
    for batch, texts in batches(it):
        yield out_batch(schema, positive=batch.column("positive"), unlabelled=batch.column("unlabelled"), turn=batch.column("turn"), x=[r.tobytes() for r in features(texts)])


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) for docs(doc_id, text) and labels(doc_id, quality).

    held_out: crc32(doc_id as text) mod 4 is `held_out`; such rows are neither
    positives nor unlabelled text.  Null labels count as none; an id with
    several labels is a trusted positive if one of them is 1.  A null text is
    scored as the empty one; repeated rows each give a row; with fewer than four
    positives or other texts every score is 0.5; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held", id_bucket("doc_id", 4) == held_out)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).where(id_bucket("doc_id", 4) != held_out).distinct()
    cut = lambda n, most: int(min(1.0, most / max(n, 1)) * (1 << 30))
    trusted = good.where(place < cut(good.count(), POSITIVES)).orderBy(place, "doc_id").limit(2 * POSITIVES).withColumn("positive", F.lit(True))
    least = cut(own.where("not held").count(), UNLABELLED)
    # `trusted` has at most 2 * POSITIVES ids
    marked = own.where("not held").join(F.broadcast(trusted), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))).withColumn("turn", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30))).withColumn("unlabelled", F.col("turn") < least)
    # equal ids have equal hashes, so limits keep the bounds for tables that repeat an id
    chosen = marked.where("positive or unlabelled").select("positive", "unlabelled", "turn", "text").transform(map_arrow, _extract, "positive boolean, unlabelled boolean, turn long, x binary")
    chosen = chosen.orderBy(~F.col("positive"), "turn", "x").limit(2 * (POSITIVES + UNLABELLED)).toArrow()
    x = np.frombuffer(b"".join(chosen["x"].to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
    x = x[order := np.lexsort(x.T[-7:])] if len(x) else x
    mark = lambda c: np.array(chosen[c].to_pylist(), bool)[order if len(x) else slice(0)]
    net, _ = fit(x[mark("positive")], x[mark("unlabelled")])
    use = own.sparkSession.sparkContext.broadcast(net)

    def run(it):
        m = use.value
        for batch, texts in batches(it):
            score = np.clip(sigmoid(m.out(features(texts).astype(float))), 0, 1) if m else np.full(len(texts), 0.5)
            yield out_batch(_OUT, doc_id=batch.column("doc_id"), held_out=batch.column("held"), score=score, predicted=(score >= THRESHOLD).astype(np.int32))

    return own.transform(map_arrow, run, "doc_id long, held_out boolean, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
