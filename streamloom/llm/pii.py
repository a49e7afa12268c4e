"""Personal data by fixed patterns and a character-level BiLSTM with a CRF.

The base patterns find emails, IP addresses, card and phone numbers.  The
network, trained in numpy from generated sentences with labelled spans, adds
what the patterns miss: other forms of these kinds, and secrets (keys, tokens,
passwords), for which there is no pattern.  It reads overlapping windows; where
they overlap their scores are averaged, those near a window's edge counting
less, and one CRF path is decoded over all windows that hang together, so no
span is cut by a window.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, map_arrow, out_batch, table

KINDS = ("email", "ip", "card", "phone")
#: What the network tags: the kinds of the patterns, and secrets.
LEARNED = (*KINDS, "secret")
WINDOW, STRIDE = 96, 48
HIDDEN, STEPS, BATCH, RATE = 24, 450, 64, 0.02
#: Windows that the network reads at a time.
MANY = 1024
TAGS = 1 + 2 * len(LEARNED)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match that fails at a digit run's start fails at its other digits too
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile("[0-9@]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(digits: str) -> bool:
    """Whether digits, with any zeros before them, are at most 255."""
    d = digits.lstrip("0")
    return len(d) <= 3 and int(d or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order: leftmost non-overlapping matches of each kind that pass its check."""
    found = []
    if not _ANCHOR.search(text):
        return found
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


# -- labelled sentences ---------------------------------------------------------------


def _word(r: random.Random) -> str:
    return "".join(r.choice(("the", "on", "re", "in", "er", "sch", "ung", "que", "ment", "ción", "é", "an", "tion", "os", "lich", "st")) for _ in range(r.randint(1, 3)))


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _entity(r: random.Random, kind: int) -> str:
    if kind == 0:
        name = r.choice((_word(r), f"{_word(r)}.{_number(r, 2)}", f"{_word(r)}_{_word(r)}", f"{_word(r)}+{_word(r)}"))
        return name + r.choice(("@", "@", "@", " @ ")) + f"{r.choice(('mail', _word(r)))}{r.choice(('', _number(r, 1)))}.{r.choice(('example.com', 'org', 'net', 'de', 'example.net'))}"
    if kind == 1:
        return r.choice((".", ".", ".", " . ")).join(str(r.randrange(256)) for _ in range(4))
    if kind == 2:
        d = _number(r, r.choice((12, 14, 15, 15, 15, 18)))
        d = next(d + c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", "", " ", "-", ".", "/"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d
    if kind == 4:
        x = r.randrange(4)
        if x < 2:
            s = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 40, 40, 64))))
            return s.upper() if x and r.random() < 0.3 else s
        return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + "_-+/" * (x == 3)) for _ in range(r.randint(20, 48)))
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    return r.choice((f"+{r.randrange(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randrange(1, 99)} {a} {b} {c}", f"({a}){b}-{c}"))


_NAMES = ("token", "TOKEN", "api_key", "key", "secret", "password", "Authorization: Bearer", "access_token")


def _other(r: random.Random) -> str:
    x = r.randrange(10)
    if x == 0:
        return f"{r.choice(_NAMES)} {r.choice(('is', 'for', 'to', '=', 'of'))} {_word(r)}"
    if x == 9:
        d = _number(r, 15)
        return next(d + c for c in "0123456789" if not luhn(d + c))
    if x == 1:
        return f"{r.randrange(1900, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"
    if x == 2:
        return f"{r.randrange(1, 9999)}.{r.randrange(100):02d}"
    if x == 3:
        return f"{r.randrange(1, 30)}.{r.randrange(20)}.{r.randrange(20)}"
    if x == 4:
        return str(r.randrange(10 ** r.randint(1, 9)))
    if x == 5:
        return f"@{_word(r)}"
    if x == 6:
        return f"{r.randrange(1, 999)},{_number(r, 3)}"
    if x == 7:
        return f"{_word(r)}{_number(r, r.randint(1, 4))}"
    return f"{r.randrange(24):02d}:{r.randrange(60):02d}"


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of WINDOW characters with labelled spans (start, kind, end), one in four in capitals."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW + 40:
            x = r.random()
            if x < 0.16:
                kind = r.randrange(len(LEARNED))
                e = _entity(r, kind)
                quote = ""
                if kind == 4:
                    quote = r.choice(('"', '"', "'", ""))
                    text += r.choice(_NAMES) + r.choice((" = ", " = ", "=", ": ", " ")) + quote
                spans.append((len(text), kind, len(text) + len(e)))
                text += e + quote
            else:
                text += _other(r) if x < 0.3 else _word(r)
            text += r.choice((" ", " ", " ", " ", ", ", ". ", "\n", " | ", "*** ", "!! ", ": "))
        at = r.randrange(0, 40)
        text = text.upper() if r.random() < 0.25 else text
        out.append((text[at : at + WINDOW], [(max(a - at, 0), k, min(b - at, WINDOW)) for a, k, b in spans if a - at < WINDOW and b > at]))
    return out


# -- the network ----------------------------------------------------------------------

_BEYOND, _SPACE, _PAD = 95, 96, 97
_CODES = np.full(0x110001, _BEYOND, np.int8)
_CODES[32:127] = np.arange(95)
_CODES[[9, 10, 13]] = _SPACE
_CODES[0x110000] = _PAD


def encode(windows: list[str]) -> np.ndarray:
    points = np.full((len(windows), WINDOW), 0x110000, np.int64)
    for i, w in enumerate(windows):
        points[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CODES[points]


#: Inside tags follow only tags of their kind; a window may begin inside a span.
_BAN = np.zeros((TAGS, TAGS))
for _k in range(len(LEARNED)):
    _BAN[:, 2 + 2 * _k] = -1e4
    _BAN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0.0


def _sig(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(0, s[0] ** -0.5, s).astype(np.float32)
        h = HIDDEN
        self.p = {f"{x}{d}": v for d in "fb" for x, v in (("x", r.normal(0, 0.5, (98, 4 * h)).astype(np.float32)), ("h", n(h, 4 * h)))}
        self.p |= {"o": n(2 * h, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}

    def lstm(self, ids: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, HIDDEN) of one direction."""
        h = HIDDEN
        x, w = self.p["x" + d], self.p["h" + d]
        times = range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1)
        out = np.empty((ids.shape[1], len(ids), h), np.float32)
        s = c = np.zeros((len(ids), h), np.float32)
        for t in times:
            z = x[ids[:, t]] + s @ w
            gate, g = _sig(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            c0, s0 = c, s
            c = gate[:, h : 2 * h] * c + gate[:, :h] * g
            tc = np.tanh(c)
            s = gate[:, 2 * h :] * tc
            out[t] = s
            if tape is not None:
                tape.append((t, gate, g, c0, s0, tc))
        return out

    def back(self, ids: np.ndarray, d: str, tape: list, slope: np.ndarray) -> dict[str, np.ndarray]:
        h, w = HIDDEN, self.p["h" + d]
        gx, gw = np.zeros_like(self.p["x" + d]), np.zeros_like(w)
        ds = dc = np.zeros((len(ids), h), np.float32)
        for t, gate, g, c0, s0, tc in reversed(tape):
            ds = ds + slope[t]
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            dc = dc + ds * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            gx += np.eye(len(gx), dtype=np.float32)[ids[:, t]].T @ dz
            gw += s0.T @ dz
            ds, dc = dz @ w.T, dc * f
        return {"x" + d: gx, "h" + d: gw}

    def train(self, ids: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean negative log-likelihood of gold tags."""
        tapes = {"f": [], "b": []}
        hid = np.concatenate([self.lstm(ids, d, tapes[d]) for d in "fb"], 2)
        e = (hid @ self.p["o"] + self.p["c"]).astype(float)
        n, b = len(e), ids.shape[0]
        trans = self.p["t"] + _BAN
        m, pe = np.exp(trans), np.exp(e - e.max(2, keepdims=True))
        fwd, bwd = np.empty_like(pe), np.ones_like(pe)
        fwd[0] = pe[0]
        for t in range(1, n):
            x = (fwd[t - 1] @ m) * pe[t]
            fwd[t] = x / x.sum(1, keepdims=True)
        for t in range(n - 2, -1, -1):
            x = (bwd[t + 1] * pe[t + 1]) @ m.T
            bwd[t] = x / x.sum(1, keepdims=True)
        post = fwd * bwd
        post /= post.sum(2, keepdims=True)
        pair = np.einsum("tbi,tbj->tbij", fwd[:-1], pe[1:] * bwd[1:]) * m
        pair /= pair.sum((2, 3), keepdims=True)
        want = np.eye(TAGS)[gold.T]
        de = ((post - want) / b).astype(np.float32)
        grad = {"t": ((pair.sum((0, 1)) - np.einsum("tbi,tbj->ij", want[:-1], want[1:])) / b).astype(np.float32), "c": de.sum((0, 1)), "o": np.einsum("tbh,tbk->hk", hid, de)}
        dh = de @ self.p["o"].T
        for k, d in enumerate("fb"):
            grad |= self.back(ids, d, tapes[d], dh[:, :, k * HIDDEN : (k + 1) * HIDDEN])
        return grad

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores of the tags (batch, time, TAGS)."""
        return np.swapaxes(np.concatenate([self.lstm(ids, d) for d in "fb"], 2) @ self.p["o"] + self.p["c"], 0, 1)

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of sequences of any length, by Viterbi, a batch at a time."""
        trans = (self.p["t"] + _BAN).astype(np.float32)
        out: list = [None] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            # sequences of about one length
            own = [i for i in order[at : at + 256] if len(scores[i]) <= 2 * len(scores[order[at]]) + 64]
            at += len(own)
            size = np.array([len(scores[i]) for i in own])
            e = np.zeros((size.max(), len(own), TAGS), np.float32)
            for k, i in enumerate(own):
                e[: size[k], k] = scores[i]
            best, trace = e[0], np.empty(e.shape, np.int8)
            for t in range(1, len(e)):
                x = best[:, :, None] + trans
                trace[t] = x.argmax(1)
                best = np.where((t < size)[:, None], x.max(1) + e[t], best)
            tags = np.zeros((len(own), len(e)), np.int8)
            now = best.argmax(1)
            for t in range(len(e) - 1, -1, -1):
                tags[:, t] = now
                if t:
                    now = np.where(t < size, trace[t][np.arange(len(own)), now], now)
            for k, i in enumerate(own):
                out[i] = tags[k, : size[k]]
        return out


@lru_cache(1)
def trained(seed: int = 1) -> Tagger:
    """The tagger, trained on generated sentences; the same for every table."""
    net, data, r = Tagger(seed), sentences(1500, seed), np.random.default_rng(seed)
    ids = encode([t for t, _ in data])
    gold = np.zeros(ids.shape, np.int64)
    for i, (_, spans) in enumerate(data):
        for a, k, b in spans:
            gold[i, a:b] = 2 + 2 * k
            if a > 0:
                gold[i, a] = 1 + 2 * k
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = r.integers(len(ids), size=BATCH)
        grad = net.train(ids[pick], gold[pick])
        norm = min(1.0, 5 / (float(np.sqrt(sum((g.astype(float) ** 2).sum() for g in grad.values()))) + 1e-9))
        for k, g in grad.items():
            g = g * norm
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - RATE * min(1.0, 2 - 2 * step / STEPS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def plausible(kind: int, s: str) -> bool:
    """Whether a span that the network found can be of its kind."""
    d = _digits(s)
    if kind == 0:
        return "@" in s and "." in s.partition("@")[2] and s[0] in _LOCAL
    if kind == 1:
        return len(p := [x.strip() for x in s.split(".")]) == 4 and all(x.isdecimal() and x.isascii() and len(x) <= 3 and int(x) <= 255 for x in p)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and len(s) <= 2 * len(d)
    if kind == 4:
        return len(s) >= 16 and len(d) >= 2 and len(d) < len(s) and not any(c.isspace() for c in s)
    return 10 <= len(d) <= 15 and not luhn(d) * (len(d) > 13) and len(s) <= 2 * len(d) and sum(c in " ().-+" for c in s) >= 2


#: How much a window's score counts at each of its places.
_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)[:, None]


def _scores(net: Tagger, texts: list[str], regions: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """For regions (text, start, end) of texts the averaged scores of the windows inside."""
    where = [(k, a) for k, (_, lo, hi) in enumerate(regions) for a in range(lo, lo + 1 + STRIDE * max(0, -(-(hi - lo - WINDOW) // STRIDE)), STRIDE)]
    total = [np.zeros((hi - lo, TAGS), np.float32) for _, lo, hi in regions]
    weight = [np.zeros((hi - lo, 1), np.float32) for _, lo, hi in regions]
    for at in range(0, len(where), MANY):
        some = where[at : at + MANY]
        e = net.emissions(encode([texts[regions[k][0]][a : a + WINDOW] for k, a in some]))
        for (k, a), own in zip(some, e, strict=True):
            _, lo, hi = regions[k]
            n = min(WINDOW, hi - a)
            total[k][a - lo : a - lo + n] += own[:n] * _WEIGHT[:n]
            weight[k][a - lo : a - lo + n] += _WEIGHT[:n]
    return [t / w for t, w in zip(total, weight, strict=True)]


def _regions(text: str) -> list[list[int]]:
    """Starts and ends of what the network reads: windows around digits and @, those that touch joined."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        k = m.start() // STRIDE
        lo, hi = max(0, (k - 1) * STRIDE), min(len(text), k * STRIDE + WINDOW)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def learned_spans(net: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) for whole texts.  Every kind holds a digit or an
    @, so what is far from both isn't read; a region whose first or last span
    goes on beyond it is read again with twice the text on that side."""
    found: list[list] = [[] for _ in texts]
    todo = [(i, lo, hi, STRIDE) for i, t in enumerate(texts) for lo, hi in _regions(t)]
    while todo:
        # windows of a region start at its start, the last may be shorter
        tags = net.decode(_scores(net, texts, [(i, lo, hi) for i, lo, hi, _ in todo]))
        again = []
        for (i, lo, hi, more), row in zip(todo, tags, strict=True):
            left, right = row[0] > 0 and lo > 0, row[-1] > 0 and hi < len(texts[i])
            if left or right:
                again.append((i, max(0, lo - more * left), min(len(texts[i]), hi + more * right), 2 * more))
                continue
            edge = np.flatnonzero((row[1:] != row[:-1])) + 1
            runs = [0, *edge.tolist(), len(row)]
            at = 0
            while at < len(runs) - 1:
                t = runs[at]
                at += 1
                if row[t] == 0:
                    continue
                kind = (int(row[t]) - 1) // 2
                if row[t] == 1 + 2 * kind and at < len(runs) - 1 and row[runs[at]] == 2 + 2 * kind:
                    at += 1
                found[i].append((lo + t, kind, lo + runs[at]))
        todo = again
    # regions that grew may have met
    return [sorted({s for s in f if plausible(s[1], texts[i][s[0] : s[2]])}) for i, f in enumerate(found)]


def find_spans(net: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; what the network adds overlaps no other span."""
    out = []
    for t, more in zip(texts, learned_spans(net, texts), strict=True):
        base = base_spans(t)
        ends, new = sorted((b[0], b[2]) for b in base), []
        at, last, k = 0, -1, 0
        for s in more:
            while k < len(ends) and ends[k][0] < s[2]:
                last = max(last, ends[k][1])
                k += 1
            if last <= s[0] and s[0] >= at:
                new.append(s)
                at = s[2]
        out.append((base, sorted(base + new)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LEARNED[k]}:{a}:{b}" for a, k, b in spans)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for docs(doc_id, text).

    The counts by kind and the hash are of the base patterns' spans; spans and
    n_spans have those that the network adds, too.  Null and empty texts have none; repeated rows
    each give a row; a null id stays null; other columns are ignored.
    """
    use = docs.sparkSession.sparkContext.broadcast(trained())

    def run(it):
        for batch, texts in batches(it):
            got = find_spans(use.value, texts)
            counts = {f"n_{k}": [sum(s[1] == i for s in base) for base, _ in got] for i, k in enumerate(KINDS)}
            yield out_batch(_OUT, doc_id=batch.column("doc_id"), **counts, base_sha256=[hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got], spans=[written(s) for _, s in got], n_spans=[len(s) for _, s in got])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans replaced by their kinds in angle brackets; spans that overlap become one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{LEARNED[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; null stays null, other columns stay as they are."""
    use = docs.sparkSession.sparkContext.broadcast(trained())

    def run(it):
        for batch, texts in batches(it):
            clean = [mask(t, s) for t, (_, s) in zip(texts, find_spans(use.value, texts), strict=True)]
            at = batch.schema.get_field_index("text")
            valid = batch.column(at).is_valid().to_pylist()
            yield batch.set_column(at, batch.schema.field(at), pa.array([c if v else None for c, v in zip(clean, valid, strict=True)], batch.schema.field(at).type))

    return docs.transform(map_arrow, run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
